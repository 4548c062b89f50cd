"""Column contracts of the tables that operators take and return."""

from pyspark.sql import types as T

S, D, L, DT, B = T.StringType(), T.DoubleType(), T.LongType(), T.DateType(), T.BooleanType()


def _struct(**fields) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


HEADLINES = _struct(ticker=S, headline=S, date=DT, sentiment_score=D)
PRICES = _struct(ticker=S, date=DT, close=D)
DAILY = _struct(ticker=S, date=DT, daily_score=D, articles=L)
QUERIES = _struct(query_id=L, ticker=S, headline=S)
MATCHES = _struct(
    query_id=L, ticker=S, rank=L, headline=S, date=DT, sentiment_score=D,
    shared_count=L, jaccard=D, similarity=D,
)
FORWARD_RETURNS = _struct(ticker=S, date=DT, base_date=DT, ret_1d=D, ret_5d=D, ret_10d=D)
