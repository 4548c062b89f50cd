"""Operators for training-data pipelines: text, vectors, tokens and conversations at scale."""
