"""Headline, price and vector tables made from the given tables."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, functions as F

from newslab.operators.dedup import dedup_index
from newslab.operators.strategy import apply_signal, run_backtest, strategy_frame
from newslab.session import new_table_path

AS_OF = "2001-12-31"
TEST_KEYWORDS = ["urgent", "red", "widget", "blue"]
TICKERS = "economy, Medium,LARGE,, standard,promo , SMALL"
LIST_HEADLINE = "Urgent: the red widget and a blue widget recall"


class Tables:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self._tables: dict[str, DataFrame] = {}

    def path(self, name: str) -> str:
        return f"{self.folder}/{name}.parquet"

    def read(self, name: str) -> DataFrame:
        if name not in self._tables:
            self._tables[name] = self.spark.read.parquet(self.path(name))
        return self._tables[name]

    def scratch(self, name: str) -> str:
        return new_table_path(self.spark, name)

    @cached_property
    def raw(self) -> DataFrame:
        """Scored headlines with repeats; the part type stands for the ticker."""
        lines, orders, parts = (self.read(t) for t in ("lineitem", "orders", "part"))
        joined = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(
            parts, F.col("l_partkey") == F.col("p_partkey")
        )
        return joined.select(
            F.col("p_type").alias("ticker"),
            F.lower(F.concat("o_orderpriority", F.lit(" "), "p_name", F.lit(" "),
                             "l_returnflag", "l_linestatus")).alias("headline"),
            F.to_date("o_orderdate").alias("date"),
            (F.col("l_extendedprice") % 1000 / 500 - 1).alias("sentiment_score"),
        )

    @cached_property
    def index(self) -> DataFrame:
        return dedup_index(self.raw)

    @cached_property
    def prices(self) -> DataFrame:
        lines = self.read("lineitem").join(
            self.read("part"), F.col("l_partkey") == F.col("p_partkey")
        )
        cents = F.sum(F.round(F.col("l_tax") * 100).cast("long")).cast("double")
        return lines.groupBy(
            F.col("p_type").alias("ticker"), F.to_date("l_shipdate").alias("date")
        ).agg((100 + 2 * (cents / F.count("*") - 4)).alias("close"))

    @cached_property
    def frame(self) -> DataFrame:
        return strategy_frame(self.raw, self.prices)

    @cached_property
    def backtest(self) -> DataFrame:
        return run_backtest(apply_signal(self.frame))

    @cached_property
    def universe(self) -> DataFrame:
        return self.read("part").select(F.col("p_type").alias("ticker")).distinct()

    @cached_property
    def queries(self) -> DataFrame:
        """One query headline per ticker and part name."""
        return self.read("part").groupBy(F.col("p_type").alias("ticker"), "p_name").agg(
            F.min("p_partkey").alias("query_id")
        ).select(
            "query_id", "ticker",
            F.concat(F.lit("Urgent: "), "p_name", F.lit(" was NOT recalled")).alias("headline"),
        )

    @cached_property
    def named_queries(self) -> DataFrame:
        """One query headline per part name, worded up or down."""
        tone = F.when(F.col("p_name").contains("red"), " profit gains but fear").otherwise(
            " beats on growth, weak loss, drop"
        )
        return self.read("part").groupBy("p_name").agg(
            F.min("p_partkey").alias("query_id")
        ).select("query_id", F.concat(F.lit("Urgent: "), "p_name", tone).alias("headline"))

    @cached_property
    def ticker_queries(self) -> DataFrame:
        """The same headline for every ticker."""
        return self.universe.select(
            F.lit(1).cast("long").alias("query_id"), "ticker",
            F.lit(LIST_HEADLINE).alias("headline"),
        )

    @cached_property
    def vectors(self) -> DataFrame:
        v = F.col("vec_id")
        return self.read("embeddings").select(
            v.alias("query_id"),
            F.col("label").cast("string").alias("ticker"),
            F.concat(F.lit("vec "), v.cast("string")).alias("headline"),
            F.date_add(F.lit("2000-01-01").cast("date"), (v % 365).cast("int")).alias("date"),
            ((v % 200) / 100 - 1).alias("sentiment_score"),
            "embedding",
        )

    @cached_property
    def events(self) -> DataFrame:
        """Timed rows: event type as ticker."""
        return self.read("events").select(
            F.col("event_type").alias("ticker"), F.col("props").alias("headline"),
            F.col("ts").alias("date"), F.col("value").alias("sentiment_score"),
        )

    @cached_property
    def documents(self) -> DataFrame:
        return self.read("documents")
