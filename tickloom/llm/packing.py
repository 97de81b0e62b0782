"""Sum-of-squares packing of documents into sequences of a fixed number of tokens.

A document of more than one window is cut into whole windows, each a sequence of its own, and a
rest. Rests are packed online: with N(h) windows filled to level h, the next piece goes to the level
that makes the sum of squares of N smallest (Csirik, Johnson, Kenyon, Orlin, Shor and Weber 2006).
The counts lie in an array of ``window + 1`` levels; only they decide, so the work for a piece
is one vector operation however many windows are open.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import as_text, batches_of, texts_of
from tickloom.llm.encode import encode_texts

WINDOW = 2048
# Most rests that one packing task places, some 80 bytes each.
PIECES_PER_BLOCK = 50_000
TEXT_BYTES_AT_ONCE = 1 << 20
# Sequence ids of whole windows start here, beyond those of any block.
WHOLE_WINDOWS = 1 << 62
PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def cut_pieces(docs: DataFrame, tokenizer: str, end_id: int, window: int = WINDOW) -> DataFrame:
    """Encode whole texts and cut them into pieces of ``window`` ids and a rest, with CRC-32 digests.

    A null text is empty: one piece of the end id. Columns but ``doc_id`` and ``text`` are not read.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end = np.array([end_id], "<u4").tobytes()
        for table in batches_of(batches, "text", TEXT_BYTES_AT_ONCE):
            out: list[list] = [[], [], [], [], []]
            for doc, ids in zip(table.column("doc_id").to_pylist(), encode_texts(texts_of(table.column("text")), tokenizer)):
                ids += end
                total = len(ids) // 4
                for start in range(0, total, window):
                    piece = ids[4 * start : 4 * (start + window)]
                    for column, value in zip(out, (doc, start, len(piece) // 4, zlib.crc32(piece), total)):
                        column.append(value)
            yield pa.RecordBatch.from_arrays(
                [pa.array(column, pa.int64()) for column in out],
                ["doc_id", "start", "length", "ids_crc32", "doc_tokens"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), as_text("text").alias("text")).mapInArrow(cut, PIECE)


def place(lengths: list[int], window: int) -> tuple[np.ndarray, np.ndarray]:
    """The window and the offset of each piece, in order of arrival, by the sum-of-squares rule.

    Filling level h to h + s changes the sum of squares by 2 (N(h+s) - N(h) + 1); a window that
    becomes full no longer counts, nor does an empty one. Ties go to the fullest level.
    """
    counts = np.zeros(window + 1, np.int64)
    held: list[list[int]] = [[] for _ in range(window + 1)]
    sequence = np.zeros(len(lengths), np.int64)
    offset = np.zeros(len(lengths), np.int64)
    opened = 0
    for i, size in enumerate(lengths):
        rest = window - size
        # Index h: the change of the sum for the levels 0 (a new window) to rest (one that becomes full).
        cost = 2 * (counts[size:] - counts[: rest + 1] + 1)
        cost[rest] = 1 - 2 * counts[rest]
        cost[counts[: rest + 1] == 0] = np.iinfo(np.int64).max
        cost[0] = 2 * counts[size] + 1 if rest else 0
        level = rest - int(np.argmin(cost[::-1]))
        if level:
            counts[level] -= 1
            at = held[level].pop()
        else:
            at = opened
            opened += 1
        sequence[i], offset[i] = at, level
        if level + size < window:
            counts[level + size] += 1
            held[level + size].append(at)
    return sequence, offset


def pack(pieces: DataFrame, window: int = WINDOW, per_block: int = PIECES_PER_BLOCK) -> DataFrame:
    """Give each piece a ``sequence_id`` and an ``offset``; offsets of a sequence have no gaps.

    Whole windows keep their place in the stream of pieces; rests are dealt into blocks by a hash of
    the piece, with enough blocks for ``per_block`` rests each, and every block is packed in document
    order. Ids of sequences are the block's number and the window's number in it. Equal rows are
    packed one by one. An empty table gives an empty table. ``pieces`` is read more than once: pass a
    table, not a costly plan.
    """
    rests = pieces.filter(F.col("length") < window)
    blocks = max(1, -(-rests.count() // per_block))
    keys = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]

    def packed(table: pa.Table) -> pa.Table:
        table = table.sort_by([(k, "ascending") for k in keys])
        sequence, offset = place(table.column("length").to_pylist(), window)
        block = table.column("block").cast(pa.int64()).to_numpy()
        return (
            table.select(keys)
            .append_column("sequence_id", pa.array((block << 32) + sequence))
            .append_column("offset", pa.array(offset))
        )

    # The row number spreads equal rows; it takes no part in the order within a block.
    salted = rests.withColumn("block", F.pmod(F.xxhash64(*keys, F.monotonically_increasing_id()), F.lit(blocks)).cast("int"))
    placed = salted.groupBy("block").applyInArrow(packed, f"{PIECE}, sequence_id long, offset long")
    full = pieces.filter(F.col("length") == window).select(
        *keys,
        (F.monotonically_increasing_id() + F.lit(WHOLE_WINDOWS)).alias("sequence_id"),
        F.lit(0).cast("long").alias("offset"),
    )
    return placed.unionByName(full)
