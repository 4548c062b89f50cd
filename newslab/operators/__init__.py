"""Joins, aggregations and windows over whole tables; every operator takes all tickers."""
