"""The given tables seen as quotes, books, ticks and orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.operators import book
from tickloom.plans import Series
from tickloom.schema import LEVELS, PRICE_COLUMNS

FEATURES = ["price", "size"]
QUOTE_TIES = ["quantity", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
BOOK_SERIES = Series.of("product", "t")
TICK_SERIES = Series.of("product", ("time", "event_id"))


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _days(column: str):
    return F.datediff(F.col(column), F.lit("1995-01-01").cast("date")).cast("long")


def quotes_long(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "lineitem").select(
        F.concat(F.lit("P"), (F.col("l_suppkey") % 5).cast("string")).alias("product"),
        _days("l_shipdate").alias("t"),
        F.when(F.col("l_linestatus") == "F", "BID").otherwise("ASK").alias("side"),
        F.floor(F.col("l_extendedprice") / F.col("l_quantity")).cast("double").alias("price"),
        F.col("l_quantity").alias("quantity"),
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        "l_suppkey",
        "l_extendedprice",
    )


def quote_products(spark: SparkSession, folder: str) -> DataFrame:
    """One product name per quote: bounds the rows of each product's book series."""
    return quotes_long(spark, folder).select("product")


def book_wide(spark: SparkSession, folder: str) -> DataFrame:
    pivoted = book.l2_pivot(quotes_long(spark, folder), 3, time="t", ties=QUOTE_TIES)
    return pivoted.withColumn("mid_price", book.book_mid())


def book_sizes(spark: SparkSession, folder: str) -> DataFrame:
    """The book with size columns instead of volume columns."""
    names = {f"{s}_volume_{i}": f"{s}_size_{i}" for s in ("bid", "ask") for i in LEVELS}
    return book_wide(spark, folder).drop("mid_price").withColumnsRenamed(names)


def prices17(spark: SparkSession, folder: str) -> DataFrame:
    """The book in the 17 columns of a price file."""
    return book_wide(spark, folder).select(
        F.floor(F.col("t") / 365).cast("long").alias("day"),
        ((F.col("t") - 365 * F.floor(F.col("t") / 365)) * 100).cast("long").alias("timestamp"),
        *PRICE_COLUMNS[2:-1],
        F.lit(0.0).alias("profit_and_loss"),
    )


def ticks(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").select(
        F.col("event_type").alias("product"),
        F.col("ts").alias("time"),
        "event_id",
        F.col("value").alias("price"),
        F.col("value").alias("mid_price"),
        (F.col("user_id") % 20 + 1).alias("size"),
        (F.col("user_id") % 5).alias("action"),
    )


def real_ticks(spark: SparkSession, folder: str) -> DataFrame:
    return ticks(spark, folder).filter(F.col("event_id") % 2 == 0)


def synth_ticks(spark: SparkSession, folder: str) -> DataFrame:
    return ticks(spark, folder).filter(F.col("event_id") % 2 == 1)


def orders_sim(spark: SparkSession, folder: str) -> DataFrame:
    size = F.col("o_custkey") % 20 + 1
    return table(spark, folder, "orders").select(
        "o_orderkey",
        F.concat(F.lit("P"), (F.col("o_custkey") % 5).cast("string")).alias("product"),
        _days("o_orderdate").alias("t"),
        F.floor(F.col("o_totalprice") / 100).cast("double").alias("price"),
        F.when(F.col("o_orderkey") % 2 == 1, -size).otherwise(size).alias("quantity"),
    )


# The parameters of three products; others take the defaults.
def params(spark: SparkSession) -> DataFrame:
    return spark.sql(
        """
        SELECT * FROM VALUES
          ('P0', 0.4D, 15, 1.2D, 0.5D, 50),
          ('P1', 0.8D, 20, 0.8D, 0.4D, 50),
          ('P2', 0.6D, 18, 1.5D, 0.7D, 50)
        AS p(product, momentum_weight, min_position, volatility_threshold, zscore_threshold, position_limit)
        """
    )


ACTION_WEIGHTS = [[((a * 7 + i * 3) % 11 - 5) / 10.0 for i in range(64)] for a in range(5)]
