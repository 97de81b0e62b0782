"""Scans whose step depends on what came before in a way that no window sum can say.

A state (a position) starts somewhere and every row changes it by a function of itself. Functions compose, so a long series is
folded block by block in parallel, the few block functions are chained to get each block's start, and the blocks are
replayed in parallel. Spark sorts the rows; Python sees them in Arrow batches and carries a state from batch to batch,
so a task holds one batch of a block, whatever its size.

Two families of functions are here: ``Clamps`` (three numbers each) and ``Pieces`` (any integer functions that are
linear with slope -1, 0 or 1 between a few cuts, also with jumps).
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.plans.joins import attach
from tickloom.plans.series import Layout
from tickloom.plans.settings import BROADCAST_SLICES, settle_table

# Task functions travel by value, so executors need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# No state, limit or cut lies beyond these.
LOW, HIGH = -(1 << 62), 1 << 62
NO_LIMIT = 1 << 60
Rows = Mapping[str, np.ndarray]


class Clamps:
    """Steps ``x -> min(limit, max(-limit, x + delta))``. Inputs: ``delta`` (null: 0) and ``limit`` (null: none)."""

    defaults = {"delta": 0, "limit": NO_LIMIT}

    def _upto(self, rows: Rows) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each row the function of all steps up to it: a prefix scan that doubles its reach."""
        shift, low, high = rows["delta"].copy(), -rows["limit"], rows["limit"].copy()
        reach = 1
        while reach < len(shift):
            first, then = slice(None, -reach), slice(reach, None)
            lows = np.clip(low[first] + shift[then], low[then], high[then])
            highs = np.clip(high[first] + shift[then], low[then], high[then])
            shifts = shift[first] + shift[then]
            low[then], high[then], shift[then] = lows, highs, shifts
            reach *= 2
        return shift, low, high

    def fold(self, rows: Rows) -> np.ndarray:
        return np.array([part[-1] for part in self._upto(rows)])

    def join(self, first: np.ndarray, then: np.ndarray) -> np.ndarray:
        low, high = np.clip(first[1:] + then[0], then[1], then[2])
        return np.array([first[0] + then[0], low, high])

    def value(self, function: np.ndarray, x: int) -> int:
        shift, low, high = function.tolist()
        return min(high, max(low, x + shift))

    def replay(self, rows: Rows, x: int) -> np.ndarray:
        shift, low, high = self._upto(rows)
        return np.clip(x + shift, low, high)


class Pieces:
    """Steps that are linear between cuts. ``steps`` turns the inputs of n rows into cuts (n, m) in ascending order,
    slopes (n, m + 1) and offsets (n, m + 1): from cut k on, until the next one, a state x becomes slope * x + offset.

    Functions of many rows are lists of pieces (start, slope, offset). Rows are worked on in as many runs as a run has
    rows, all runs at once: first the function of each run, then the state at its start, then the state at each row.
    """

    def __init__(self, steps: Callable[[Rows], tuple[np.ndarray, np.ndarray, np.ndarray]], defaults: Mapping[str, int]):
        self.steps, self.defaults = steps, dict(defaults)

    def _runs(self, rows: Rows) -> tuple[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
        cuts, slopes, offsets = self.steps(rows)
        n = len(cuts)
        width = max(1, int(np.sqrt(n)))
        more = -n % width
        # Rows that change nothing fill up the last run.
        cuts = np.concatenate([cuts, np.full((more, cuts.shape[1]), HIGH)])
        slopes = np.concatenate([slopes, np.ones((more, slopes.shape[1]), np.int64)])
        offsets = np.concatenate([offsets, np.zeros((more, offsets.shape[1]), np.int64)])
        return width, (cuts, slopes, offsets)

    def _run_functions(self, width: int, made: tuple[np.ndarray, ...]) -> list[np.ndarray]:
        n = len(made[0]) // width
        counts = np.ones(n, np.int64)
        pieces = np.array([[LOW] * n, [1] * n, [0] * n])
        for t in range(width):
            counts, pieces = compose(counts, pieces, *[part[t::width] for part in made])
        return np.split(pieces, np.cumsum(counts)[:-1], axis=1)

    def fold(self, rows: Rows) -> np.ndarray:
        whole = None
        for function in self._run_functions(*self._runs(rows)):
            whole = function if whole is None else self.join(whole, function)
        return whole.reshape(-1)

    def join(self, first: np.ndarray, then: np.ndarray) -> np.ndarray:
        flat = first.ndim == 1
        first, then = first.reshape(3, -1), then.reshape(3, -1)
        _, joined = compose(np.array([first.shape[1]]), first, then[0, 1:][None], then[1][None], then[2][None])
        return joined.reshape(-1) if flat else joined

    def value(self, function: np.ndarray, x: int) -> int:
        start, slope, offset = function.reshape(3, -1)
        k = int(np.searchsorted(start, x, side="right")) - 1
        return int(slope[k] * x + offset[k])

    def replay(self, rows: Rows, x: int) -> np.ndarray:
        width, made = self._runs(rows)
        at = []
        for function in self._run_functions(width, made):
            at.append(x)
            x = self.value(function, x)
        states = np.array(at)
        out = np.empty((len(at), width), np.int64)
        lanes = np.arange(len(at))
        for t in range(width):
            cuts, slopes, offsets = (part[t::width] for part in made)
            k = (cuts <= states[:, None]).sum(axis=1)
            states = slopes[lanes, k] * states + offsets[lanes, k]
            out[:, t] = states
        return out.reshape(-1)[: len(rows[next(iter(self.defaults))])]


def compose(
    counts: np.ndarray, pieces: np.ndarray, cuts: np.ndarray, slopes: np.ndarray, offsets: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """Function i (its ``counts[i]`` of the joined ``pieces``), then the step of row i. Equal neighbours become one piece."""
    start, slope, offset = pieces
    owner = np.repeat(np.arange(len(counts)), counts)
    end = np.append(start[1:], HIGH)
    end[np.cumsum(counts) - 1] = HIGH
    # Where a piece's value passes a cut, as a place on its own axis.
    cut = cuts[owner]
    passed = np.where(slope[:, None] > 0, cut - offset[:, None], offset[:, None] - cut + 1)
    inside = (slope[:, None] != 0) & (passed > start[:, None]) & (passed < end[:, None])
    places = np.concatenate([start[:, None], np.where(inside, passed, HIGH)], axis=1)
    places.sort(axis=1)
    new = places < HIGH
    new[:, 1:] &= places[:, 1:] != places[:, :-1]
    of = np.nonzero(new)[0]
    start, slope, offset, owner = places[new], slope[of], offset[of], owner[of]
    k = (cuts[owner] <= (slope * start + offset)[:, None]).sum(axis=1)
    slope, offset = slopes[owner, k] * slope, slopes[owner, k] * offset + offsets[owner, k]
    kept = np.ones(len(start), bool)
    kept[1:] = (owner[1:] != owner[:-1]) | (slope[1:] != slope[:-1]) | (offset[1:] != offset[:-1])
    return np.bincount(owner[kept], minlength=len(counts)), np.stack([start[kept], slope[kept], offset[kept]])


def _groups(table: pa.Table, parts: Sequence[str]) -> np.ndarray:
    """Where rows of other ``parts`` than the row before start, the first row included, and the number of rows."""
    n = table.num_rows
    new = np.zeros(n, bool)
    new[:1] = True
    for name in parts:
        column = table.column(name).combine_chunks()
        a, b = column.slice(0, n - 1), column.slice(1)
        unequal = pc.or_(pc.fill_null(pc.not_equal(a, b), False), pc.not_equal(pc.is_null(a), pc.is_null(b)))
        new[1:] |= unequal.to_numpy(zero_copy_only=False)
    return np.append(np.flatnonzero(new), n)


def _inputs(table: pa.Table, names: Mapping[str, str], defaults: Mapping[str, int]) -> dict[str, np.ndarray]:
    return {name: pc.fill_null(table.column(held), defaults[name]).to_numpy() for name, held in names.items()}


def sorted_groups(batches: Iterator[pa.RecordBatch], parts: Sequence[str]) -> Iterator[tuple[pa.Table, list[int], bool]]:
    """Each batch with its group edges and whether its first group goes on from the batch before."""
    last = None
    for batch in batches:
        if batch.num_rows:
            table = pa.Table.from_batches([batch])
            at = lambda i: tuple(table.column(p)[i].as_py() for p in parts)  # noqa: B023, E731
            yield table, _groups(table, parts).tolist(), last is not None and at(0) == last
            last = at(table.num_rows - 1)


def _fold(family, names: Mapping[str, str], parts: Sequence[str]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_, function = None, None

        def done() -> Iterator[pa.RecordBatch]:
            yield from open_.append_column("_function", pa.array([function.astype("<i8").tobytes()], pa.binary())).to_batches()

        for table, edges, goes_on in sorted_groups(batches, parts):
            rows = _inputs(table, names, family.defaults)
            for first, end in zip(edges, edges[1:]):
                made = family.fold({n: a[first:end] for n, a in rows.items()})
                if first == 0 and goes_on:
                    function = family.join(function, made)
                    continue
                if open_ is not None:
                    yield from done()
                open_, function = table.select(list(parts)).slice(first, 1), made
        if open_ is not None:
            yield from done()

    return run


def _chain(family, parts: Sequence[str]) -> Callable:
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("_block", "ascending")])
        at = table.column("_from")[0].as_py() or 0
        starts = []
        for function in table.column("_function").to_pylist():
            starts.append(at)
            at = family.value(np.frombuffer(function, "<i8"), at)
        return pa.table({**{p: table.column(p) for p in parts}, "_start": pa.array(starts, pa.int64())})

    return run


def _replay(family, names: Mapping[str, str], parts: Sequence[str], columns: Sequence[str], outputs: Sequence[str]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = 0
        for table, edges, goes_on in sorted_groups(batches, parts):
            rows = _inputs(table, names, family.defaults)
            before, after = np.empty(table.num_rows, np.int64), np.empty(table.num_rows, np.int64)
            for first, end in zip(edges, edges[1:]):
                if first or not goes_on:
                    state = table.column("_start")[first].as_py() or 0
                after[first:end] = family.replay({n: a[first:end] for n, a in rows.items()}, state)
                before[first], before[first + 1 : end] = state, after[first : end - 1]
                state = int(after[end - 1])
            out = table.select(list(columns))
            for name, values in zip(outputs, (before, after, after - before)):
                out = out.append_column(name, pa.array(values))
            yield from out.to_batches()

    return run


def scan(
    layout: Layout,
    family,
    inputs: Mapping[str, Column],
    start: DataFrame | None = None,
    outputs: Sequence[str] = ("position_before", "position", "change"),
) -> Layout:
    """Add the state before and after each row and its change, all long.

    ``inputs`` are integers by the family's names. ``start`` may hold a state per key (columns: key, ``position``); others
    start at 0. An empty table gives an empty table; the order may not leave ties if the result is to be unique.
    """
    layout = layout.owned()
    columns, parts, key = layout.df.columns, layout.parts, list(layout.series.key)
    names = {name: f"_in_{name}" for name in inputs}
    rows = layout.df.withColumns({names[n]: c.cast("long") for n, c in inputs.items()})

    def in_order(df: DataFrame) -> DataFrame:
        return df.repartition(*parts).sortWithinPartitions(*parts, *layout.series.sort)

    if layout.split:
        # Read twice below: once narrow to fold the blocks, once whole to replay them.
        rows = settle_table(rows, "steps")
        narrow = rows.select(*dict.fromkeys([*parts, *layout.series.order_names]), *names.values())
        part_fields = [narrow.schema[p] for p in parts]
        folded = T.StructType([*part_fields, T.StructField("_function", T.BinaryType())])
        # One row per block: far fewer than the rows of the longest series.
        blocks = in_order(narrow).mapInArrow(_fold(family, names, parts), folded)
        if start is not None:
            blocks = attach(blocks, start.withColumnRenamed("position", "_from"), key, null_safe=True)
        else:
            blocks = blocks.withColumn("_from", F.lit(0).cast("long"))
        starts = blocks.groupBy(*key).applyInArrow(
            _chain(family, parts), T.StructType([*part_fields, T.StructField("_start", T.LongType())])
        )
        # A block without a row here starts at 0.
        rows = attach(rows, starts.filter(F.col("_start") != 0), parts, null_safe=True, bound=BROADCAST_SLICES)
    elif start is not None:
        rows = attach(rows, start.withColumnRenamed("position", "_start"), key, null_safe=True)
    else:
        rows = rows.withColumn("_start", F.lit(0).cast("long"))
    schema = T.StructType([*layout.df.schema, *[T.StructField(n, T.LongType()) for n in outputs]])
    return layout.with_df(in_order(rows).mapInArrow(_replay(family, names, parts, columns, outputs), schema))
