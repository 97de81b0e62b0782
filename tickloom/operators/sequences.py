"""Sliding sequences of feature rows, positional splits and row lookups."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.functions.columns import plus_minutes
from tickloom.plans import Series, arrange, attach, row_index
from tickloom.plans.scan import sorted_groups

# Task functions travel by value, so executors need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# The shortest series that gives sequences, and the shortest sequence.
MIN_ROWS = 10
MIN_LENGTH = 5
# Most values that one Arrow batch of sequences holds, if a sequence is not longer.
VALUES_AT_ONCE = 1 << 20


def sequence_length(rows: Column, wanted: int) -> Column:
    """The length used for a series of ``rows`` rows; NULL when it is too short for any."""
    return F.when(rows >= wanted, F.lit(wanted)).when(
        rows >= MIN_ROWS, F.greatest(F.lit(MIN_LENGTH), F.floor(rows / 2).cast("int"))
    )


def sequences(df: DataFrame, series: Series, features: Sequence[str], length: int, stride: int = 1) -> DataFrame:
    """One sequence per starting row: the next ``length`` rows as float vectors.

    Series shorter than ``length`` use half their rows instead. With a ``stride``, sequences start at every so many rows of
    their series. A task keeps the last rows of one block and the batch it reads, and writes sequences as slices of
    them; no frame holds ``length`` copies of a row. Missing features stay missing.
    """
    counts = df.groupBy(*series.key).agg(F.count(F.lit(1)).alias("n_rows"))
    lengths = counts.select(
        *series.key, sequence_length(F.col("n_rows"), length).alias("sequence_length")
    ).filter(F.col("sequence_length").isNotNull())
    rows = attach(df, lengths, series.key, "inner", null_safe=True)
    layout = arrange(rows, series, ahead=length - 1, measure=df)
    columns = rows.columns
    held = {f"_f{i}": F.col(f).cast("float") for i, f in enumerate(features)}
    starts = F.lit(True)
    if "_own" in layout.helpers:
        starts = starts & F.col("_own")
    if stride > 1:
        starts = starts & (layout.index % stride == 0)
    laid = layout.df.withColumn("_starts", starts).withColumns(held)
    laid = laid.select(*dict.fromkeys([*layout.parts, *columns]), "_starts", *held)
    laid = laid.repartition(*layout.parts).sortWithinPartitions(*layout.parts, *series.sort)
    schema = T.StructType([*rows.schema, T.StructField("sequence", T.ArrayType(T.ArrayType(T.FloatType())))])
    return laid.mapInArrow(_slices(layout.parts, columns, list(held)), schema)


def _slices(parts: Sequence[str], columns: Sequence[str], features: Sequence[str]) -> Callable:
    width = len(features)

    def nested(flat: pa.Array, at: np.ndarray, length: int) -> pa.Array:
        """The sequences of ``length`` vectors that start at rows ``at``."""
        places = ((at[:, None] + np.arange(length))[:, :, None] * width + np.arange(width)).reshape(-1)
        vectors = pa.ListArray.from_arrays(pa.array(np.arange(len(at) * length + 1, dtype=np.int32) * width), flat.take(pa.array(places)))
        return pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1, dtype=np.int32) * length), vectors)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting = None
        for table, edges, goes_on in sorted_groups(batches, parts):
            for first, end in zip(edges, edges[1:]):
                rows = table.slice(first, end - first)
                if first == 0 and goes_on and waiting is not None:
                    rows = pa.concat_tables([waiting, rows])
                length = rows.column("sequence_length")[0].as_py()
                # The last rows wait for those that follow them.
                whole = max(0, rows.num_rows - length + 1)
                waiting = rows.slice(whole)
                at = np.flatnonzero(rows.column("_starts").to_numpy()[:whole])
                kinds = [rows.column(f).combine_chunks() for f in features]
                values = np.stack([k.fill_null(0.0).to_numpy() for k in kinds], axis=1).reshape(-1)
                missing = np.stack([k.is_null().to_numpy(zero_copy_only=False) for k in kinds], axis=1).reshape(-1)
                flat = pa.array(values, pa.float32(), mask=missing)
                kept = rows.select(list(columns)).combine_chunks()
                step = max(1, VALUES_AT_ONCE // (length * width))
                for i in range(0, len(at), step):
                    pick = at[i : i + step]
                    yield from kept.take(pa.array(pick)).append_column("sequence", nested(flat, pick, length)).to_batches()

    return run


def split_rows(df: DataFrame, series: Series, train_share: float = 0.8) -> DataFrame:
    """Mark the first share of each series as training rows (``is_train``)."""
    cut = df.groupBy(*series.key).agg(
        F.floor(F.count(F.lit(1)) * F.lit(train_share)).alias("_cut")
    )
    numbered = attach(row_index(df, series), cut, series.key, "left", null_safe=True)
    return numbered.withColumn("is_train", F.col("row_index") < F.col("_cut")).drop("_cut")


def latest_rows(df: DataFrame, series: Series, n: int = 1) -> DataFrame:
    """The last ``n`` rows of each series; each task keeps its own last rows before the shuffle."""
    newest = Window.partitionBy(*series.key).orderBy(*[F.col(c).desc() for c in series.order_names])
    ranked = df.withColumn("_rank", F.row_number().over(newest)).filter(F.col("_rank") <= n)
    return ranked.drop("_rank")


def last_row(df: DataFrame, series: Series) -> DataFrame:
    """The last row of each series, by partial aggregation."""
    rest = [c for c in df.columns if c not in series.key]
    newest = df.groupBy(*series.key).agg(
        F.max_by(F.struct(*rest), F.struct(*series.order_names)).alias("_row")
    )
    return newest.select(*series.key, "_row.*")


def numeric_columns(df: DataFrame, keys: Sequence[str] = ()) -> list[str]:
    """Names of number columns, keys left out; reads the schema only."""
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType) and f.name not in keys]


def numeric_only(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys and number columns."""
    return df.select(*keys, *numeric_columns(df, keys))


def feature_columns(df: DataFrame, time: str = "timestamp") -> list[str]:
    return [c for c in df.columns if c != time]


def time_window(df: DataFrame, time: str, start: object, end: object) -> DataFrame:
    """Rows from ``start`` to ``end``, both included."""
    return df.filter(F.col(time).between(F.lit(start), F.lit(end)))


def default_timestamp(
    df: DataFrame, series: Series, start: str = "2024-01-01 00:00:00", name: str = "timestamp"
) -> DataFrame:
    """A minute per row from ``start``, for tables without a time column."""
    numbered = row_index(df, series, "_row")
    begin = F.lit(start).cast("timestamp_ntz")
    return numbered.withColumn(name, plus_minutes(begin, F.col("_row"))).drop("_row")
