"""Sinks: tables split by product, whole tables, nested state as JSON."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def write_split(
    df: DataFrame, path: str, by: str = "product", format: str = "csv", one_file: bool = False
) -> None:
    """One folder per product in one job.

    Rows are rebalanced by product before the write, so a small product gives
    one file and a large one is spread over several tasks by its size.
    ``one_file`` forbids that and gathers each product in one task.
    """
    laid = df.repartition(by) if one_file else df.hint("rebalance", by)
    writer = laid.write.mode("overwrite").partitionBy(by)
    if format == "csv":
        writer = writer.option("header", True)
    writer.format(format).save(path)


def write_table(df: DataFrame, path: str, format: str = "parquet") -> None:
    writer = df.write.mode("overwrite")
    if format == "csv":
        writer = writer.option("header", True)
    writer.format(format).save(path)


def state_to_json(*columns: str) -> Column:
    """Nested state as JSON text, fields in name order."""
    return F.to_json(F.struct(*[F.col(c) for c in sorted(columns)]))


def sorted_map(entries: Column) -> Column:
    """A map of (``key``, ``value``) entries, keys unique, in the order of its keys, so equal maps give equal JSON."""
    by_key = lambda a, b: F.when(a["key"] < b["key"], -1).when(a["key"] > b["key"], 1).otherwise(0)
    return F.map_from_entries(F.array_sort(entries, by_key))


def trading_states(rows: DataFrame, time: str, key: str, fields: Sequence[str]) -> DataFrame:
    """One row per instant: ``time`` and ``state``, JSON text of the instant and of a map from key to value for each field.

    ``rows`` has at most one row per instant and key. A key whose field is NULL is left out of that field's map, rows
    without a key of all maps. Names and keys are in order. One state is one text, so it must fit a task.
    """

    def mapped(field: str) -> Column:
        given = F.col(key).isNotNull() & F.col(field).isNotNull()
        return sorted_map(F.collect_list(F.when(given, F.struct(F.col(key).alias("key"), F.col(field).alias("value"))))).alias(field)

    return rows.groupBy(time).agg(*[mapped(f) for f in fields]).select(time, state_to_json(time, *fields).alias("state"))


def state_from_json(text: Column, schema: T.StructType | str) -> Column:
    """JSON text back to nested state; NULL where it cannot be read."""
    return F.from_json(text, schema, {"mode": "PERMISSIVE"})
