"""Equi-joins that hold when one key has a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.plans.settings import BROADCAST_BYTES, BROADCAST_ROWS, ROWS_PER_JOIN_KEY, settle, size_setting


def match(left: DataFrame, right: DataFrame, on: Sequence[str], how: str, null_safe: bool) -> DataFrame:
    """Join on equally named columns and keep the left copy of each."""
    renamed = right.withColumnsRenamed({c: f"_r_{c}" for c in on})
    if null_safe:
        tests = [F.col(c).eqNullSafe(F.col(f"_r_{c}")) for c in on]
    else:
        tests = [F.col(c) == F.col(f"_r_{c}") for c in on]
    condition = reduce(lambda a, b: a & b, tests)
    return left.join(renamed, condition, how).drop(*[f"_r_{c}" for c in on])


def attach(
    rows: DataFrame,
    side: DataFrame,
    on: Sequence[str],
    how: str = "left",
    null_safe: bool = False,
    bound: tuple[str, int] = BROADCAST_ROWS,
) -> DataFrame:
    """Add the columns of an aggregate or parameter table (one row per key) to every row.

    The side table is computed once and measured, in rows and in bytes. Below both broadcast bounds the
    rows are not shuffled at all; above them the join is salted for hot keys.
    """
    spark = rows.sparkSession
    side = settle(side)
    size = F.sum(F.octet_length(F.to_json(F.struct("*"))))
    n, written = side.agg(F.count(F.lit(1)), F.coalesce(size, F.lit(0))).first()
    if n <= size_setting(spark, bound) and written <= size_setting(spark, BROADCAST_BYTES):
        return match(rows, F.broadcast(side), on, how, null_safe)
    return join_on(rows, side, on, how, null_safe)


def _hashed(rows: DataFrame) -> list[str]:
    """The columns that have a hash."""
    return [f"`{f.name}`" for f in rows.schema.fields if "map<" not in f.dataType.simpleString()]


def join_on(
    rows: DataFrame, side: DataFrame, on: Sequence[str], how: str = "left", null_safe: bool = False
) -> DataFrame:
    """Join where ``side`` has at most one row per key and ``rows`` may have a hot key.

    Keys with more rows than one task should hold are spread over salts; only
    their side rows are repeated. The salt is a hash of the row (its maps left out), so a rerun task
    sends each row to the same place; equal rows share a salt.
    """
    spark = rows.sparkSession
    bound = size_setting(spark, ROWS_PER_JOIN_KEY)
    hot = rows.groupBy(*on).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > bound)
    hot = settle(hot.select(*on, F.ceil(F.col("_n") / bound).cast("int").alias("_salts")))
    n_hot = hot.count()
    if n_hot == 0:
        return match(rows, side, on, how, null_safe)
    if n_hot <= size_setting(spark, BROADCAST_ROWS):
        hot = F.broadcast(hot)
    salted = match(rows, hot, on, "left", null_safe).withColumn(
        "_salt", F.pmod(F.xxhash64(*_hashed(rows)), F.coalesce("_salts", F.lit(1))).cast("int")
    )
    spread = match(side, hot, on, "left", null_safe).withColumn(
        "_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1))
    )
    joined = match(
        salted.drop("_salts"), spread.drop("_salts"), [*on, "_salt"], how, null_safe
    )
    return joined.drop("_salt")
