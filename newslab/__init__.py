"""News-headline event studies and sentiment strategies as Spark DataFrame jobs."""
