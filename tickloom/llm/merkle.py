"""A Merkle manifest of a table, with a proof for every row, by a butterfly exchange of subtree roots.

Rows of a source, in order, are the leaves of the source's tree; the roots of the sources are the leaves of one more
tree, whose root stands for the table. ``FANOUT`` consecutive nodes, the last of a level fewer, hash to one node above.

1. Leaves are hashed, sorted and numbered, and cut into aligned blocks, each a whole subtree of ``LEVELS`` levels. A
   block hashes its own subtree.
2. In each round the blocks whose subtrees lie under one node swap roots: a block meets one member of every sibling
   group, appends their roots to its own proof and hashes them to the ancestor, which all members do alike. After the last
   round every block knows the roots and the upper part of its proofs, so nothing has to travel down again.
3. A block completes the proofs of its rows from its own leaves.

A group with fewer members than its siblings (the end of a source, a small source) answers several of theirs, so each
swap has one row of every group, 16 at most, whatever the share of the largest source.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.llm.common import shuffle_width, stage_table
from tickloom.plans import Series, attach, running
from tickloom.plans.settings import BROADCAST_SLICES

FANOUT = 16
# Levels that a block hashes by itself: 16 ** 3 = 4096 leaves, some 16 MB of proofs.
LEVELS = 3
BLOCK = (
    "number long, block long, source string, n_leaves long, n_blocks long, blocks_before long, ids array<long>, "
    "leaves binary, presented binary, node string"
)
PROOF = "source string, doc_id long, leaf string, presented string, subroot string, root string, levels array<struct<left string, right string>>"


def leaf_digest(columns: Sequence[Column]) -> Column:
    """SHA-256 of a row: of each value its length in UTF-8 bytes, ``:`` and the value, or ``-`` for null, one after the other."""
    texts = [c.cast("string") for c in columns]
    whole = [F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]
    return F.sha2(F.concat(*whole), 256)


def _numbered(leaves: DataFrame) -> DataFrame:
    """Each leaf's source number, its position in the source, and the counts of the source; no source is sorted in one task."""
    order = [F.col("source").asc_nulls_first(), F.col("doc_id").asc_nulls_first(), F.col("leaf")]
    width = shuffle_width(leaves.sparkSession)
    # Within a sorted partition this id is (partition << 33) + position.
    laid = stage_table(
        leaves.repartitionByRange(width, *order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()),
        "leaves",
    ).withColumn("part", F.shiftright("at", 33))
    # One row for each source and partition it reaches into.
    spans = stage_table(laid.groupBy("source", "part").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n")), "spans")
    sources = spans.groupBy("source").agg(F.sum("n").alias("n_leaves"))
    sources = sources.withColumns({"n_blocks": F.ceil(F.col("n_leaves") / FANOUT**LEVELS).cast("long"), "all": F.lit(0)})
    sources = running(sources, Series.of("all", "source"), {"number": F.lit(1).cast("long"), "blocks_to": F.col("n_blocks")})
    sources = sources.select(
        "source", "n_leaves", "n_blocks", (F.col("number") - 1).alias("number"), (F.col("blocks_to") - F.col("n_blocks")).alias("blocks_before")
    )
    earlier = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.select("source", "part", "first", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    spans = attach(spans, sources, ["source"], null_safe=True)
    rows = attach(laid, spans, ["source", "part"], null_safe=True, bound=BROADCAST_SLICES)
    return rows.withColumn("position", F.col("before") + F.col("at") - F.col("first"))


def local_levels(n_leaves: int) -> int:
    """The levels above the leaves that a block hashes: up to the root of a small source, else ``LEVELS``."""
    levels = 0
    while levels < LEVELS and FANOUT**levels < n_leaves:
        levels += 1
    return levels


def subtree(leaves: list[bytes], levels: int) -> list[list[bytes]]:
    """All levels of a subtree as hexadecimal digests, leaves first."""
    out = [leaves]
    for _ in range(levels):
        below = out[-1]
        out.append([hashlib.sha256(b"".join(below[i : i + FANOUT])).hexdigest().encode() for i in range(0, len(below), FANOUT)])
    return out


def _hex(digests: bytes) -> list[bytes]:
    text = digests.hex().encode()
    return [text[i : i + 64] for i in range(0, len(text), 64)]


def _blocks() -> Callable:
    def build(table: pa.Table) -> pa.Table:
        table = table.sort_by([("position", "ascending")])
        leaves = b"".join(table.column("leaf").to_pylist())
        # A digest for each row that presents another leaf, nothing for the others.
        presented = b"".join(b"\0" if p is None else b"\1" + p for p in table.column("presented").to_pylist())
        first = {name: table.column(name).slice(0, 1) for name in ("number", "block", "source", "n_leaves", "n_blocks", "blocks_before")}
        (node,) = subtree(_hex(leaves), local_levels(first["n_leaves"][0].as_py()))[-1]
        ids = table.column("doc_id").combine_chunks()
        made = {
            "ids": pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids),
            "leaves": pa.array([leaves], pa.binary()),
            "presented": pa.array([presented], pa.binary()),
            "node": pa.array([node.decode()], pa.string()),
        }
        return pa.table(first | made)

    return build


def _swap(blocks: DataFrame, parent: list[Column], digit: Column, offset: Column, size: Column, lanes: Column, active: Column) -> DataFrame:
    """One round: each block meets one member of every group under ``parent`` and becomes a holder of the parent's node.

    A block is the member ``offset`` of the ``size`` members of its group ``digit``; the largest group has ``lanes``.
    """
    names = [f"_parent{i}" for i in range(len(parent))]
    own = F.col("_lane") == F.col("_offset")
    sent = (
        blocks.withColumns({**dict(zip(names, parent)), "_digit": digit, "_offset": offset, "_active": active, "_size": size, "_lanes": lanes})
        .withColumn("_lane", F.explode(F.sequence("_offset", F.col("_lanes") - 1, "_size")))
        .withColumn("upper", F.when(own, F.col("upper")))
    )
    met = F.sort_array(F.collect_list(F.struct("_digit", "node")).over(Window.partitionBy(*names, "_lane")))
    side = lambda test: F.array_join(F.transform(F.filter("_met", test), lambda x: x["node"]), "")
    # The row's own digit stands beside the array, so that the filters need no outer column by name.
    rows = sent.withColumn("_met", met).filter(own)
    sibling = F.struct(side(lambda x: x["_digit"] < F.col("_digit")).alias("left"), side(lambda x: x["_digit"] > F.col("_digit")).alias("right"))
    whole = F.sha2(F.array_join(F.col("_met.node"), ""), 256)
    rows = rows.withColumns(
        {"upper": F.when(F.col("_active"), F.array_append("upper", sibling)).otherwise(F.col("upper")), "node": F.when(F.col("_active"), whole).otherwise(F.col("node"))}
    )
    return rows.select(*blocks.columns)


def _rounds(n: int) -> int:
    """Levels above ``n`` nodes."""
    rounds = 0
    while FANOUT**rounds < n:
        rounds += 1
    return rounds


def _exchange(blocks: DataFrame) -> DataFrame:
    """Each block's subroot, root and upper proof: ``number``, ``block``, ``subroot``, ``root``, ``upper``."""
    none = F.array().cast("array<struct<left string, right string>>")
    held = blocks.select("number", "block", "n_blocks", "blocks_before", "node").withColumn("upper", none)
    sources = blocks.filter("block = 0").select("number", "n_blocks", "blocks_before")
    largest, n_sources = sources.agg(F.max("n_blocks"), F.count(F.lit(1))).first()
    count, at = F.col("n_blocks"), F.col("block")
    for r in range(_rounds(largest or 0)):
        width, above = FANOUT**r, FANOUT ** (r + 1)
        start, top = at - at % width, at - at % above
        group = F.least(F.lit(width), count - start)
        widest = F.least(F.lit(width), count - top)
        held = _swap(held, [F.col("number"), top], F.floor(at / width) % FANOUT, at % width, group, widest, count > width)
    held = held.withColumn("subroot", F.col("node"))
    for r in range(_rounds(n_sources)):
        # The members of a group of sources are all their blocks, in order.
        groups = sources.groupBy(F.floor(F.col("number") / FANOUT**r).alias("_group")).agg(
            F.sum("n_blocks").alias("_members"), F.min("blocks_before").alias("_first")
        )
        parent = F.floor(F.col("_group") / FANOUT)
        groups = groups.withColumn("_widest", F.max("_members").over(Window.partitionBy(parent)))
        placed = attach(held.withColumn("_group", F.floor(F.col("number") / FANOUT**r)), groups, ["_group"])
        offset = F.col("blocks_before") + at - F.col("_first")
        swapped = _swap(placed, [parent], F.col("_group") % FANOUT, offset, F.col("_members"), F.col("_widest"), F.lit(True))
        held = swapped.select(*held.columns)
    return held.select("number", "block", "subroot", F.col("node").alias("root"), "upper")


def manifest(docs: DataFrame, columns: Sequence[str], source: str, order: str, presented: Column | None = None) -> DataFrame:
    """The manifest, one row for each block: its source, ids and leaves, the roots, and the siblings above it.

    A leaf is ``leaf_digest`` of ``columns``; leaves of a source ascend by ``order``, an integer (nulls first, rows of equal
    order by their digest), sources by their UTF-8 bytes (null first). ``presented`` may give another leaf digest to be
    checked in place of the row's own (null: its own). Equal rows are separate leaves. Nulls and texts of any length are
    values like others; columns not named are not read. An empty table gives a manifest without rows.
    """
    other = F.lit(None).cast("string") if presented is None else presented
    leaves = docs.select(
        F.col(source).cast("string").alias("source"),
        F.col(order).cast("long").alias("doc_id"),
        F.unhex(leaf_digest([F.col(c) for c in columns])).alias("leaf"),
        F.unhex(other).alias("presented"),
    )
    # Hashed once; the texts are not read again.
    rows = _numbered(stage_table(leaves, "leaf_digests"))
    rows = rows.withColumn("block", F.floor(F.col("position") / FANOUT**LEVELS))
    named = ["number", "block", "source", "n_leaves", "n_blocks", "blocks_before", "doc_id", "leaf", "presented", "position"]
    blocks = stage_table(rows.select(*named).groupBy("number", "block").applyInArrow(_blocks(), BLOCK), "blocks")
    uppers = _exchange(blocks)
    return blocks.drop("node").join(uppers.hint("shuffle_merge"), ["number", "block"])


def _prove() -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                leaves, given = _hex(row["leaves"]), row["presented"]
                levels = local_levels(row["n_leaves"])
                tree = subtree(leaves, levels)
                # The siblings of each node of the subtree, left and right of it; one pair for a run of leaves above.
                sides = []
                for nodes in tree[:levels]:
                    level = []
                    for at in range(len(nodes)):
                        first = at - at % FANOUT
                        run = nodes[first : first + FANOUT]
                        level.append({"left": b"".join(run[: at - first]).decode(), "right": b"".join(run[at - first + 1 :]).decode()})
                    sides.append(level)
                shown, at = [], 0
                for leaf in leaves:
                    other = given[at]
                    shown.append(given[at + 1 : at + 33].hex() if other else leaf.decode())
                    at += 33 if other else 1
                proofs = [[sides[k][j // FANOUT**k] for k in range(levels)] + row["upper"] for j in range(len(leaves))]
                n = len(leaves)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([row["source"]] * n, pa.string()),
                        pa.array(row["ids"], pa.int64()),
                        pa.array([x.decode() for x in leaves], pa.string()),
                        pa.array(shown, pa.string()),
                        pa.array([row["subroot"]] * n, pa.string()),
                        pa.array([row["root"]] * n, pa.string()),
                        pa.array(proofs, pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))),
                    ],
                    ["source", "doc_id", "leaf", "presented", "subroot", "root", "levels"],
                )

    return run


def proofs(blocks: DataFrame) -> DataFrame:
    """One row for each leaf of a manifest: source, doc_id, leaf, the presented leaf, subroot, root, and ``levels``.

    ``levels`` has the siblings left and right of the path's node at each level, joined, from the leaf up to the root.
    """
    return blocks.select("source", "n_leaves", "ids", "leaves", "presented", "subroot", "root", "upper").mapInArrow(_prove(), PROOF)


def proof_digest(levels: str) -> Column:
    """SHA-256 of all siblings of a proof, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(levels, lambda x: F.concat(x["left"], x["right"])), ""), 256)


def folded(leaf: str, levels: str) -> Column:
    """The root that a leaf and the siblings of a proof give."""
    return F.aggregate(levels, F.col(leaf), lambda node, x: F.sha2(F.concat(x["left"], node, x["right"]), 256))
