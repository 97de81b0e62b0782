"""Near-duplicates by min-max hashing: shingle sets, banded signatures, exact links, components.

Of each permutation both the smallest and the largest value are kept (Ji, Li, Yan, Tian, Zhang 2013), so
``PERMUTATIONS`` hash evaluations a shingle give twice as many unbiased, less correlated values. Bands of
``ROWS`` values make buckets; two sets of similarity s share none with chance (1 - s^4)^32, 5e-6 at 0.75.

No group is paired with itself. Documents with equal sets are one node. Nodes are sorted by bucket and compared with
the first node of their bucket and the one before; the best of these pairs are confirmed on full sets and give first
components. Only where a bucket still holds several components are members of different ones compared, in
blocks: by the share of equal signature values first, then on full sets.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.llm.common import (
    batches_of,
    located,
    mixed,
    rolling,
    stage_table,
    texts_of,
    whole_windows,
    word_edges,
    word_hashes,
)

SHINGLE = 5
LEAST_PERCENT = 75
PERMUTATIONS = 64
ROWS = 4
BANDS = 2 * PERMUTATIONS // ROWS
# Share of equal signature values under which a pair is not looked at: at 0.75 a pair has less with chance 5e-7,
# if its values were independent, which is below the chance that it shares no band.
LEAST_SHARE = 0.55
# Pairs that each node brings to the first components; the rest is found between components.
FIRST_PAIRS = 2
# Members of a bucket that one task compares with each other.
BLOCK = 512
TEXT_BYTES_AT_ONCE = 1 << 20
BASE = 0x5851F42D4C957F2D
# A-Z to a-z on UTF-8 bytes; no byte of a longer character is below 128.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def shingle_hashes(texts: list[str], width: int = SHINGLE) -> list[np.ndarray]:
    """The distinct shingles of each text as sorted 64-bit hashes; fewer words than ``width`` are one shingle."""
    data, starts, ends, counts = word_edges(texts)
    words = word_hashes(LOWER[data], starts, ends)
    at, own = whole_windows(counts, width)
    hashes = mixed(rolling(words, width, BASE)[at])
    out, seen, first = [], 0, 0
    for n, k in zip(counts.tolist(), own.tolist()):
        if n >= width:
            out.append(np.unique(hashes[seen : seen + k]))
        elif n:
            out.append(mixed(rolling(words[first : first + n], n, BASE) + np.uint64(n)))
        else:
            out.append(np.zeros(0, np.uint64))
        seen += k
        first += n
    return out


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """Minima then maxima of every permutation, one row for each set (none may be empty)."""
    flat = np.concatenate(sets)
    first = np.concatenate([[0], np.cumsum([len(s) for s in sets])])[:-1]
    rng = np.random.default_rng(2013)
    factors = rng.integers(0, 1 << 63, PERMUTATIONS, np.uint64) * np.uint64(2) + np.uint64(1)
    out = np.empty((len(sets), 2 * PERMUTATIONS), np.uint64)
    for k, factor in enumerate(factors):
        values = flat * factor
        values ^= values >> np.uint64(32)
        values *= factor
        out[:, k] = np.minimum.reduceat(values, first)
        out[:, PERMUTATIONS + k] = np.maximum.reduceat(values, first)
    return out


def band_keys(signature: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band; a band takes its values from different permutations."""
    values = mixed(signature)
    # A minimum and a maximum of one permutation would agree together too seldom in small sets.
    values[:, PERMUTATIONS:] = np.roll(values[:, PERMUTATIONS:], -BANDS // 2, axis=1)
    values = values.reshape(len(signature), ROWS, BANDS)
    key = np.zeros((len(signature), BANDS), np.uint64)
    for k in range(ROWS):
        key = key * np.uint64(BASE) + values[:, k]
    return mixed(key)


SKETCH = "node long, check long, n_shingles long, bands binary, bytes binary"


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for table in batches_of(batches, "text", TEXT_BYTES_AT_ONCE):
        sets = shingle_hashes(texts_of(table.column("text")))
        full = [s for s in sets if len(s)]
        some = signatures(full) if full else np.zeros((0, 2 * PERMUTATIONS), np.uint64)
        keys, low = band_keys(some), mixed(some).astype(np.uint8)
        at = iter(range(len(full)))
        rows = []
        for s in sets:
            if len(s):
                i = next(at)
                # Order-free sums over the set tell sets apart.
                node = (mixed(s).sum(dtype=np.uint64), mixed(s ^ np.uint64(BASE)).sum(dtype=np.uint64))
                rows.append((*(int(x.astype(np.int64)) for x in node), len(s), keys[i].tobytes(), low[i].tobytes()))
            else:
                rows.append((None, None, 0, None, None))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary())
        made = [pa.array(c, k) for c, k in zip(zip(*rows), kinds)]
        yield from pa.table(
            [*(table.column(c) for c in ("doc_id", "__file", "__row")), *made],
            ["doc_id", "__file", "__row", "node", "check", "n_shingles", "bands", "bytes"],
        ).to_batches()


def _bands(nodes: DataFrame) -> DataFrame:
    """One row (bucket, rest, node) for each band; ``bucket`` is the band's key, ``rest`` orders like nodes together."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                keys = np.frombuffer(b"".join(batch.column("bands").to_pylist()), np.int64).reshape(-1, BANDS)
                nodes = np.repeat(batch.column("node").to_numpy(), BANDS)
                numbered = mixed(keys.astype(np.uint64) + np.arange(BANDS, dtype=np.uint64)).astype(np.int64)
                rest = np.roll(keys, -1, axis=1) & 0x7FFFFFFF
                yield pa.RecordBatch.from_arrays(
                    [pa.array(numbered.reshape(-1)), pa.array(rest.reshape(-1)), pa.array(nodes), pa.array(np.tile(np.arange(BANDS, dtype=np.int32), batch.num_rows))],
                    ["bucket", "rest", "node", "band"],
                )

    return nodes.select("node", "bands").mapInArrow(spread, "bucket long, rest long, node long, band int")


def _first_pairs(bands: DataFrame) -> DataFrame:
    """Pairs (a, b) of a node with the first of its bucket and with the one before it, over sorted rows.

    Range partitions cut a large bucket anywhere; the first nodes of its pieces meet in a second, small step.
    """

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last_bucket, last_node, leader = None, None, None
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            bucket, node = batch.column("bucket").to_numpy(), batch.column("node").to_numpy()
            before_bucket = np.concatenate([[bucket[0] if last_bucket is None else last_bucket], bucket[:-1]])
            before = np.concatenate([[node[0] if last_node is None else last_node], node[:-1]])
            new = bucket != before_bucket
            if last_bucket is None:
                new[0] = True
            where = np.maximum.accumulate(np.where(new, np.arange(n), -1))
            leaders = np.where(where >= 0, node[where], leader if leader is not None else 0)
            follow = ~new
            own = np.flatnonzero(new)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate([leaders[follow], before[follow], node[own]])),
                    pa.array(np.concatenate([node[follow], node[follow], node[own]])),
                    pa.array(np.concatenate([bucket[follow], bucket[follow], bucket[own]])),
                ],
                ["a", "b", "bucket"],
            )
            last_bucket, last_node, leader = bucket[-1], node[-1], leaders[-1]

    rows = bands.repartitionByRange("bucket", "rest", "node").sortWithinPartitions("bucket", "rest", "node")
    met = stage_table(rows.mapInArrow(walk, "a long, b long, bucket long"), "met")
    pieces = met.filter("a = b").groupBy("bucket").agg(F.min("a").alias("a"), F.max("a").alias("b"), F.count(F.lit(1)).alias("n"))
    leads = (
        met.filter("a = b").select("bucket", "b").join(pieces.filter("n > 1").select("bucket", "a"), "bucket").select("a", "b")
    )
    pairs = met.filter("a <> b").select("a", "b").unionByName(leads.filter("a <> b"))
    # ``b`` meets two others a band at most, whatever the size of its buckets, so these windows are small.
    votes = pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("votes")).filter("votes > 1")
    best = Window.partitionBy("b").orderBy(F.desc("votes"), "a")
    chosen = votes.withColumn("_n", F.row_number().over(best)).filter(F.col("_n") <= FIRST_PAIRS)
    return chosen.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _linked(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [similar(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)) for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist())]
            yield batch.filter(pa.array(keep, pa.bool_())).select(["a", "b"])

    left, right = sets.withColumnsRenamed({"node": "a", "set": "x"}), sets.withColumnsRenamed({"node": "b", "set": "y"})
    return pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(confirm, "a long, b long")


def similar(x: np.ndarray, y: np.ndarray) -> bool:
    """100 * intersection >= 75 * union for two sorted sets."""
    if LEAST_PERCENT * max(len(x), len(y)) > 100 * min(len(x), len(y)):
        return False
    both = np.concatenate([x, y])
    both.sort()
    shared = int((both[1:] == both[:-1]).sum())
    return 100 * shared >= LEAST_PERCENT * (len(both) - shared)


def components(links: DataFrame) -> DataFrame:
    """(node, label) of every linked node; the label is the least node of its component.

    Every round a node takes the least label of its neighbours and then its label's label; both are aggregates and
    joins on narrow rows, and each round reads the written table of the one before.
    """
    both = stage_table(links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    labels = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("label")).withColumnRenamed("a", "node")
    while True:
        labels = stage_table(labels, "labels")
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("label").alias("least"))
        better = labels.join(near.withColumnRenamed("a", "node"), "node").select("node", "label", F.least("label", "least").alias("next"))
        jump = labels.select(F.col("node").alias("next"), F.col("label").alias("far"))
        moved = stage_table(better.join(jump, "next").select("node", "label", F.least("next", "far").alias("next")), "moved")
        if moved.filter("next <> label").isEmpty():
            return labels
        labels = moved.select("node", F.col("next").alias("label"))


def _label(rows: DataFrame, labels: DataFrame) -> DataFrame:
    return rows.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))


def _compare(exact: bool) -> Callable:
    """Members of different components in a block of a bucket: those that may link, or with ``exact`` the links."""

    def run(table: pa.Table) -> pa.Table:
        left = table.filter(pa.compute.equal(table.column("side"), 0))
        right = table.filter(pa.compute.equal(table.column("side"), 1))
        band = table.column("band")[0].as_py()

        def arrays(t: pa.Table) -> tuple:
            n = t.num_rows
            return (
                t.column("node").to_numpy(),
                t.column("label").to_numpy(),
                t.column("n_shingles").to_numpy(),
                np.frombuffer(b"".join(t.column("bytes").to_pylist()), np.uint8).reshape(n, 2 * PERMUTATIONS),
                np.frombuffer(b"".join(t.column("bands").to_pylist()), np.uint64).reshape(n, BANDS)[:, : band + 1].copy(),
            )

        node, label, size, low, keys = arrays(right)
        picked: set[tuple[int, int]] = set()
        links: list[tuple[int, int]] = []
        root: dict[int, int] = {}

        def top(x: int) -> int:
            while root.get(x, x) != x:
                x = root[x]
            return x

        sets = [np.frombuffer(s, np.uint64) for s in right.column("set").to_pylist()] if exact else []
        for i, (a, own, n, bytes_, bands) in enumerate(zip(*arrays(left))):
            may = (label != own) & (LEAST_PERCENT * np.maximum(size, n) <= 100 * np.minimum(size, n))
            at = np.flatnonzero(may)
            share = (low[at] == bytes_).mean(axis=1)
            at = at[share >= LEAST_SHARE]
            # A pair is looked at in the first band that it shares, and from its smaller node if both are on the left.
            at = at[~(keys[at, :band] == bands[:band]).any(axis=1)]
            if not exact:
                for j in at.tolist():
                    picked.add((1, int(node[j])))
                if len(at):
                    picked.add((0, int(a)))
                continue
            mine = np.frombuffer(left.column("set")[i].as_py(), np.uint64)
            for j in at.tolist():
                x, y = top(int(own)), top(int(label[j]))
                if x != y and similar(mine, sets[j]):
                    root[max(x, y)] = min(x, y)
                    links.append((int(a), int(node[j])))
        if exact:
            return pa.table([pa.array([x[k] for x in links], pa.int64()) for k in (0, 1)], ["a", "b"])
        rows = sorted(picked)
        same = [pa.array([table.column(c)[0].as_py()] * len(rows), table.schema.field(c).type) for c in ("bucket", "lb", "rb", "band")]
        return pa.table([*same, pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int64())], ["bucket", "lb", "rb", "band", "side", "node"])

    return run


def _between(bands: DataFrame, labels: DataFrame, nodes: DataFrame, sets: DataFrame) -> DataFrame:
    """Links between different components that share a bucket."""
    rows = stage_table(_label(bands.select("bucket", "band", "node"), labels), "labelled")
    crowded = rows.groupBy("bucket").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo <> hi").select("bucket")
    members = stage_table(rows.join(crowded, "bucket"), "members")
    counts = members.groupBy("bucket", "label").agg(F.count(F.lit(1)).alias("n"))
    # The largest component of a bucket is only ever compared with the other members.
    sizes = stage_table(
        counts.groupBy("bucket").agg(F.max_by("label", F.struct("n", "label")).alias("major"), F.sum("n").alias("all"), F.max("n").alias("most")),
        "sizes",
    )
    n = members.join(sizes, "bucket")
    parts = lambda c: F.ceil(c / BLOCK).cast("int")
    lefts, rights = parts(F.col("all") - F.col("most")), parts(F.col("all"))
    block = lambda k, salt: F.pmod(F.xxhash64("node", F.lit(salt)), k).cast("int")
    each = lambda k: F.explode(F.sequence(F.lit(0), k - 1))
    keep = ["bucket", "band", "node", "label"]
    left = n.filter("label <> major").select(*keep, F.lit(0).alias("side"), block(lefts, 1).alias("lb"), each(rights).alias("rb"))
    right = n.select(*keep, F.lit(1).alias("side"), each(lefts).alias("lb"), block(rights, 2).alias("rb"))
    facts = nodes.select("node", "n_shingles", "bytes", "bands")
    blocks = left.unionByName(right).join(facts, "node")
    group = ["bucket", "lb", "rb"]
    picked = stage_table(
        blocks.groupBy(*group).applyInArrow(_compare(False), "bucket long, lb int, rb int, band int, side int, node long"), "picked"
    )
    full = _label(picked.join(facts, "node").join(sets, "node"), labels)
    return full.groupBy(*group).applyInArrow(_compare(True), "a long, b long")


def link_documents(docs: DataFrame) -> DataFrame:
    """Per row of ``docs`` (from ``located``): ``__file``, ``__row``, n_shingles, component_id, kept and label.

    A document without words has no shingles and links with nothing. Rows with equal sets are one node, whatever
    their ids. The component of a row is the smallest document id it reaches; a null id is none, so a
    component of null ids has a null id, and its rows are kept. ``label`` tells components apart; it is null without words.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "__file", "__row", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    sketches = stage_table(rows.mapInArrow(_sketch, f"doc_id long, __file long, __row long, {SKETCH}"), "sketches")
    place = F.struct("__file", "__row")
    # One row of each different set stands for it.
    nodes = stage_table(
        sketches.filter("node IS NOT NULL")
        .groupBy("node", "check")
        .agg(F.min("doc_id").alias("least_id"), F.min(place).alias("place"), *[F.first(c).alias(c) for c in ("n_shingles", "bands", "bytes")]),
        "nodes",
    )
    bands = stage_table(_bands(nodes), "bands")
    crowded = bands.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("bucket")
    bands = stage_table(bands.join(crowded, "bucket"), "crowded")
    wanted = nodes.join(bands.select("node").distinct(), "node").select("node", "place.__file", "place.__row")
    sets = stage_table(rows.join(wanted, ["__file", "__row"]).select("node", "text").mapInArrow(_sets, "node long, set binary"), "sets")
    first = stage_table(_linked(_first_pairs(bands), sets), "first")
    more = _between(bands, components(first), nodes, sets)
    labels = components(first.unionByName(stage_table(more, "more")))
    owned = _label(nodes.select("node", "least_id"), labels)
    least = stage_table(owned.groupBy("label").agg(F.min("least_id").alias("component_id")), "components")
    owner = stage_table(owned.select("node", "label").join(least, "label").select("node", "label", "component_id"), "owners")
    found = sketches.select("doc_id", "__file", "__row", "n_shingles", "node").join(owner, "node", "left")
    component: Column = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return found.select(
        "doc_id", "__file", "__row", "n_shingles", component.alias("component_id"), component.eqNullSafe(F.col("doc_id")).alias("kept"), "label"
    )


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for table in batches_of(batches, "text", TEXT_BYTES_AT_ONCE):
        sets = [s.tobytes() for s in shingle_hashes(texts_of(table.column("text")))]
        yield pa.RecordBatch.from_arrays([table.column("node").combine_chunks(), pa.array(sets, pa.binary())], ["node", "set"])


def mark_near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row."""
    return link_documents(located(docs)).drop("__file", "__row", "label")


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """The rows and columns of ``docs``, one row of each group of near-duplicates: one with the smallest id.

    Of rows that repeat that id, or if all ids of a group are null, the first by file and row stays. Rows without words
    are in no group and all stay.
    """
    rows = located(docs)
    alone = [F.when(F.col("label").isNull(), F.col(c)).alias(f"_{c}") for c in ("__file", "__row")]
    first = link_documents(rows).filter("kept").groupBy("label", *alone).agg(F.min(F.struct("__file", "__row")).alias("place"))
    kept = stage_table(first.select("place.__file", "place.__row"), "kept")
    return rows.join(kept, ["__file", "__row"]).select(*docs.columns)
