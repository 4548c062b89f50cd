"""Registered queries over the given tables, each beside an independent SQL text."""
