"""Row-order windows over series that may be too long for one task.

A window partitioned by product sorts a whole product in one task. ``arrange``
measures the longest series first. If it fits, windows run by key. If not, long
series are cut into blocks of consecutive rows; each block also receives the
few rows before (and after) it that a bounded row frame reaches, windows run by
(key, block), and ``Layout.finish`` drops the copies. Results are the same.

Cutting needs no sort: a quantile sketch of each long key's order axis gives
edges between slices of about equal size, wherever the rows lie; rows are
counted per (key, slice), the slices are put into blocks by their running
count, and each row looks its slice up. Keys that have a slice too full for a
block (a burst on one instant, an axis that has no numbers, more blocks than a
sketch tells apart) are range-partitioned on the full order instead, which splits
at any row; only their rows are sorted and written, other keys stay with their slices.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.plans.joins import match
from tickloom.plans.settings import (
    BROADCAST_SLICES,
    ROWS_PER_BLOCK,
    settle,
    settle_table,
    size_setting,
)

# Slices per block when a long series is cut: more slices, less overlap. With very
# many blocks there are fewer slices in each, so that all slices can be broadcast.
MOST_SLICES, FEWEST_SLICES = 16, 4
# Most slices that one sketch is asked for, and its size for each of them; the largest sketch that Spark has.
MOST_SKETCHED, SKETCH_SIZE_PER_SLICE, LARGEST_SKETCH = 1 << 14, 8, 65_535


@dataclass(frozen=True)
class Series:
    """What makes a table a set of series: key columns and a total order.

    A name in ``order`` may start with ``-`` for descending.
    """

    key: tuple[str, ...]
    order: tuple[str, ...]

    @staticmethod
    def of(key: str | Sequence[str], order: str | Sequence[str]) -> Series:
        key = (key,) if isinstance(key, str) else tuple(key)
        order = (order,) if isinstance(order, str) else tuple(order)
        return Series(key, order)

    @property
    def order_names(self) -> list[str]:
        return [c.removeprefix("-") for c in self.order]

    @property
    def sort(self) -> list[Column]:
        return [F.col(c[1:]).desc() if c.startswith("-") else F.col(c).asc() for c in self.order]


@dataclass(frozen=True)
class Layout:
    """A frame ready for windows: partition columns, order, and what to drop after."""

    df: DataFrame
    series: Series
    parts: list[str]
    split: bool
    helpers: list[str] = field(default_factory=list)
    index: Column | None = None

    @property
    def window(self) -> WindowSpec:
        return Window.partitionBy(*self.parts).orderBy(*self.series.sort)

    def last(self, n: int) -> WindowSpec:
        """The current row and the n - 1 rows before it."""
        return self.window.rowsBetween(-(n - 1), 0)

    def next(self, n: int) -> WindowSpec:
        """The current row and the n - 1 rows after it."""
        return self.window.rowsBetween(0, n - 1)

    def with_df(self, df: DataFrame) -> Layout:
        """The same layout over a frame with more columns or fewer rows."""
        return replace(self, df=df)

    def finish(self, df: DataFrame) -> DataFrame:
        """Drop context copies and helper columns of ``df``, made from this layout's frame."""
        if "_own" in self.helpers:
            df = df.filter("_own")
        return df.drop(*self.helpers)

    def rows(self) -> DataFrame:
        return self.finish(self.df)

    def owned(self) -> Layout:
        """Without context copies: every row once, still cut into blocks."""
        if "_own" not in self.helpers:
            return self
        df = self.df.filter("_own").drop(*[h for h in self.helpers if h != "_block"])
        return Layout(df, self.series, self.parts, True, ["_block"])

    def settled(self, name: str) -> Layout:
        """Written out when split, so that the steps after it do not repeat the ones before."""
        return self.with_df(settle_table(self.df, name)) if self.split else self


def arrange(
    df: DataFrame, series: Series, back: int = 0, ahead: int = 0, measure: DataFrame | None = None
) -> Layout:
    """Lay ``df`` out so that frames of ``back`` rows before and ``ahead`` after are whole.

    ``measure`` names the input of a costly step (say, the quotes of a book):
    a frame with the same key and at least as many rows per key. If its longest
    series fits, so does that of ``df``; if not, ``df`` is written out once
    before it is counted and cut.
    """
    spark = df.sparkSession
    limit = size_setting(spark, ROWS_PER_BLOCK)
    if measure is not None:
        if not _has_long(measure, series, limit):
            return _whole(df, series)
        df = settle_table(df, "series")
    sizes = df.groupBy(*series.key).agg(F.count(F.lit(1)).alias("_n"))
    long_keys = sizes.filter(F.col("_n") > limit)
    if long_keys.isEmpty():
        return _whole(df, series)
    return _cut(df, series, settle(long_keys), limit, back, ahead)


def _whole(df: DataFrame, series: Series) -> Layout:
    window = Window.partitionBy(*series.key).orderBy(*series.sort)
    index = F.row_number().over(window).cast("long") - 1
    return Layout(df, series, list(series.key), False, index=index)


def _has_long(df: DataFrame, series: Series, limit: int) -> bool:
    counts = df.groupBy(*series.key).agg(F.count(F.lit(1)).alias("_n"))
    return not counts.filter(F.col("_n") > limit).isEmpty()


def row_index(df: DataFrame, series: Series, name: str = "row_index") -> DataFrame:
    """Number the rows of each series from 0 without sorting a whole series in one task."""
    layout = arrange(df, series)
    return layout.finish(layout.df.withColumn(name, layout.index))


def _axis(df: DataFrame, series: Series) -> Column | None:
    """The leading order column as a number that rises in sort order, or None."""
    name = series.order_names[0]
    kind = df.schema[name].dataType
    if isinstance(kind, T.TimestampNTZType):
        value = F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', `{name}`)")
    elif isinstance(kind, T.TimestampType):
        value = F.unix_micros(name)
    elif isinstance(kind, T.DateType):
        value = F.unix_date(name)
    elif isinstance(kind, T.NumericType):
        value = F.col(name)
    else:
        return None
    value = value.cast("double")
    # NaN sorts after all numbers, so before them where the order falls.
    return F.when(F.isnan(value), float("-inf")).otherwise(-value) if series.order[0].startswith("-") else value


def _sketched_edges(narrow: DataFrame, slices: dict[int, int]) -> dict[int, np.ndarray]:
    """For each long key (by its number ``_k``) the inner edges of its slices on ``_axis``, from one sketch a key."""
    size = min(LARGEST_SKETCH, max(256, SKETCH_SIZE_PER_SLICE * max(slices.values())))
    numbers = narrow.filter(F.col("_axis").isNotNull() & ~F.isnan("_axis"))
    sketches = settle(numbers.groupBy("_k").agg(F.kll_sketch_agg_double("_axis", F.lit(size)).alias("_sketch")))
    edges = dict.fromkeys(slices, np.zeros(0))
    # A sketch is asked for constant ranks: once for each number of slices, all powers of two.
    for n in sorted(set(slices.values()) - {1}):
        ranks = F.lit([i / n for i in range(1, n)])
        asked = sketches.filter(F.col("_k").isin([k for k, m in slices.items() if m == n]))
        for k, found in asked.select("_k", F.kll_sketch_get_quantile_double("_sketch", ranks)).collect():
            edges[k] = np.unique(found)
    return edges


def _slice_of(edges: dict[int, np.ndarray], at_null: int) -> Column:
    """The slice of a row of a long key: how many edges are not above its place on the axis."""

    def find(keys: pa.Array, places: pa.Array) -> pa.Array:
        key, place = keys.fill_null(-1).to_numpy(), places.fill_null(0.0).to_numpy()
        out = np.zeros(len(key), np.int64)
        for k in np.unique(key).tolist():
            if k >= 0:
                of = key == k
                out[of] = np.searchsorted(edges[k], place[of], side="right")
        return pa.array(out)

    found = F.arrow_udf(find, "long")(F.col("_k"), F.col("_axis"))
    return F.when(F.col("_k").isNotNull(), F.when(F.col("_axis").isNull(), F.lit(at_null).cast("long")).otherwise(found))


def _cut(df: DataFrame, series: Series, long_keys: DataFrame, limit: int, back: int, ahead: int) -> Layout:
    key, axis = list(series.key), _axis(df, series)
    small = size_setting(df.sparkSession, BROADCAST_SLICES)
    n_long, total = long_keys.agg(F.count(F.lit(1)), F.sum("_n")).first()
    if axis is None or n_long > small:
        return _by_range(df, series, limit, back, ahead, long_keys if n_long <= small else None)
    # Past a quarter as many blocks as slices can be broadcast, blocks grow instead.
    limit = max(limit, FEWEST_SLICES * total // max(small, 1) if small > FEWEST_SLICES else limit)
    per_block = min(MOST_SLICES, max(FEWEST_SLICES, small * limit // total))
    numbered = settle(long_keys.withColumn("_k", F.monotonically_increasing_id()))
    wanted = {k: -(-n * per_block // limit) for k, n in numbered.select("_k", "_n").collect()}
    # The next power of two, or the one before if there were too many to look up.
    round_up = 1 if 2 * sum(wanted.values()) <= small else 0
    slices = {k: min(MOST_SKETCHED, 1 << max(0, (n - round_up).bit_length() - 1 + round_up)) for k, n in wanted.items()}
    lookup = F.broadcast(numbered.drop("_n"))
    # NULL sorts first ascending and last descending, so it gets the outermost slice.
    at_null = 2**62 if series.order[0].startswith("-") else -1

    narrow = match(
        df.select(*key, *dict.fromkeys(c for c in series.order_names[:1] if c not in key)), lookup, key, "inner", True
    ).select("_k", axis.alias("_axis"))
    slice_of = _slice_of(_sketched_edges(narrow, slices), at_null)
    counts = narrow.withColumn("_slice", slice_of).groupBy("_k", "_slice").agg(F.count(F.lit(1)).alias("_n"))
    counts = settle(match(counts, numbered.drop("_n").select(F.col("_k"), *key), ["_k"], "inner", True))
    burst = [k for (k,) in counts.filter(F.col("_n") > limit).select("_k").distinct().collect()]
    counts = counts.filter(~F.col("_k").isin(burst)) if burst else counts
    n_slices = counts.count()

    before = F.coalesce(
        F.sum("_n").over(
            Window.partitionBy(*key).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
        ),
        F.lit(0),
    )
    block = F.floor(F.col("_before") / limit)
    first = block
    if ahead:
        # The block of the slice that holds the row ``ahead`` rows before this slice.
        reach = Window.partitionBy(*key).orderBy("_before").rangeBetween(Window.unboundedPreceding, -ahead)
        first = F.coalesce(F.max("_home").over(reach), F.lit(0).cast("long"))
    last = F.greatest(F.floor((F.col("_before") + F.col("_n") + back - 1) / limit), block) if back else block
    placed = (
        counts.withColumn("_before", before)
        .withColumn("_home", block)
        .withColumns({"_first": first, "_last": last})
        .withColumn("_block", F.explode(F.sequence("_first", "_last")))
        .withColumn("_base", F.min("_before").over(Window.partitionBy(*key, "_block")))
        .groupBy(*key, "_slice")
        .agg(
            F.collect_list(
                F.struct(
                    F.col("_block"), (F.col("_block") == F.col("_home")).alias("_own"), F.col("_base")
                )
            ).alias("_spots")
        )
    )
    placed = F.broadcast(placed) if n_slices <= small else placed

    alone = F.array(
        F.struct(
            F.lit(0).cast("long").alias("_block"), F.lit(True).alias("_own"), F.lit(0).cast("long").alias("_base")
        )
    )
    rows = match(df, lookup, key, "left", True)
    if burst:
        rows = rows.filter(F.col("_k").isNull() | ~F.col("_k").isin(burst))
    rows = rows.withColumn("_axis", axis).withColumn("_slice", slice_of)
    rows = match(rows, placed, [*key, "_slice"], "left", True)
    rows = rows.withColumn("_spot", F.explode(F.coalesce("_spots", alone))).select(
        *df.columns, "_spot._block", "_spot._own", "_spot._base"
    )
    parts = [*key, "_block"]
    index = F.col("_base") + F.row_number().over(Window.partitionBy(*parts).orderBy(*series.sort)) - 1
    if not burst:
        return Layout(rows, series, parts, True, ["_block", "_own", "_base"], index)
    crowded = F.broadcast(numbered.filter(F.col("_k").isin(burst)).select(*key))
    ranged = _ranged(match(df, crowded, key, "inner", True), series, limit, back, ahead)
    return _joined(rows, ranged, series, index)


def _joined(rows: DataFrame, ranged: DataFrame, series: Series, index: Column) -> Layout:
    """One layout of keys cut by slices, whose rows are numbered by a window, and keys cut by rows, which have their numbers."""
    none = F.lit(None).cast("long")
    both = rows.withColumn("_index", none).unionByName(ranged.withColumn("_base", none))
    helpers = ["_block", "_own", "_base", "_index"]
    return Layout(both, series, [*series.key, "_block"], True, helpers, F.coalesce(F.col("_index"), index))


def _by_range(
    df: DataFrame, series: Series, limit: int, back: int, ahead: int, long_keys: DataFrame | None
) -> Layout:
    """Cut the long keys, or all if they are too many to look up, at any row; short keys are one block each."""
    key = list(series.key)
    if long_keys is None:
        rows = _ranged(df, series, limit, back, ahead)
        return Layout(rows, series, [*key, "_block"], True, ["_block", "_own", "_index"], F.col("_index"))
    long_keys = F.broadcast(long_keys.select(*key, F.lit(True).alias("_long")))
    marked = match(df, long_keys, key, "left", True)
    zero = F.lit(0).cast("long")
    short = marked.filter(F.col("_long").isNull()).drop("_long").withColumns({"_block": zero, "_own": F.lit(True), "_base": zero})
    ranged = _ranged(marked.filter("_long").drop("_long"), series, limit, back, ahead)
    index = F.row_number().over(Window.partitionBy(*key, "_block").orderBy(*series.sort)).cast("long") - 1
    return _joined(short, ranged, series, index)


def _ranged(df: DataFrame, series: Series, limit: int, back: int, ahead: int) -> DataFrame:
    """Rows with their blocks, sorted and numbered: ``_block``, ``_own`` and ``_index``."""
    key = list(series.key)
    sort = [F.col(k).asc() for k in key] + series.sort
    n_parts = max(1, -(-df.count() // limit))
    # Within a sorted partition this id is (partition << 33) + position.
    laid = settle_table(
        df.repartitionByRange(n_parts, *sort)
        .sortWithinPartitions(*sort)
        .withColumn("_at", F.monotonically_increasing_id()),
        "ordered",
    ).withColumn("_part", F.shiftright("_at", 33))
    spans = laid.groupBy(*key, "_part").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    spans = settle(
        spans.select(
            *key,
            "_part",
            "_first",
            F.coalesce(
                F.sum("_n").over(
                    Window.partitionBy(*key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
                ),
                F.lit(0),
            ).alias("_before"),
        )
    )
    if spans.count() <= size_setting(df.sparkSession, BROADCAST_SLICES):
        spans = F.broadcast(spans)
    return (
        match(laid, spans, [*key, "_part"], "inner", True)
        .withColumn("_index", F.col("_before") + F.col("_at") - F.col("_first"))
        .withColumn(
            "_block",
            F.explode(
                F.sequence(
                    F.floor(F.greatest(F.col("_index") - ahead, F.lit(0)) / limit),
                    F.floor((F.col("_index") + back) / limit),
                )
            ),
        )
        .withColumn("_own", F.col("_block") == F.floor(F.col("_index") / limit))
        .select(*df.columns, "_block", "_own", "_index")
    )
