"""Token ids as ORC files: run-length encoded integers, row indexes and Bloom filters on document ids.

A row is a document: its id, its ids, the part of the order it lies in and the ids before it in that
part. Parts are ranges of document ids, one sorted file each, so stripes and row groups hold narrow
id ranges: a reader skips files and stripes by their minimum and maximum, row groups by the row
index, and the rest by the Bloom filter. Spark splits large files between stripes.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickloom.llm.common import shuffles_removed, as_text, batches_of, shuffle_width, texts_of
from tickloom.llm.encode import encode_joined

STRIPE_BYTES = 64 << 20
ROWS_PER_INDEX_ENTRY = 1_000
BLOOM_FALSE_POSITIVES = 0.01
TEXT_BYTES_AT_ONCE = 1 << 20
FILE_COLUMNS = "doc_id long, part int, before long, n_ids int, ids array<int>"


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int, parts: int | None = None) -> None:
    """Encode ``text`` of every document and write ids in ascending document order.

    ``docs`` needs ``doc_id`` and ``text``; other columns are not read. A null text is empty and
    gives the end id alone. Null document ids come first. Rows of equal id are all kept, ordered by
    their text. An empty table gives a readable path without rows.
    """
    spark = docs.sparkSession
    parts = parts or shuffle_width(spark)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, before = TaskContext.get().partitionId(), 0
        for table in batches_of(batches, "text", TEXT_BYTES_AT_ONCE):
            ids, ends = encode_joined(texts_of(table.column("text")), tokenizer, (end_id,))
            yield pa.RecordBatch.from_arrays(
                [
                    table.column("doc_id").combine_chunks().cast(pa.int64()),
                    pa.array(np.full(table.num_rows, part, np.int32)),
                    pa.array(before + ends[:-1]),
                    pa.array(np.diff(ends).astype(np.int32)),
                    pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids.view("<i4"))),
                ],
                ["doc_id", "part", "before", "n_ids", "ids"],
            )
            before += int(ends[-1])

    ordered = (
        docs.select("doc_id", as_text("text").alias("text"))
        # The beginning of the text parts rows of one id, in the order that they are sorted in.
        .repartitionByRange(parts, "doc_id", F.substring("text", 1, 64))
        .sortWithinPartitions("doc_id", "text")
    )
    with shuffles_removed(spark):
        (
            ordered.mapInArrow(encode, FILE_COLUMNS)
            .write.option("orc.stripe.size", STRIPE_BYTES)
            .option("orc.create.index", "true")
            .option("orc.row.index.stride", ROWS_PER_INDEX_ENTRY)
            .option("orc.bloom.filter.columns", "doc_id")
            .option("orc.bloom.filter.fpp", BLOOM_FALSE_POSITIVES)
            .orc(path)
        )


def read_tokens(spark: SparkSession, path: str, doc_ids: list[int] | None = None) -> DataFrame:
    """Documents with their ids and ``start``, the ids of all documents before them.

    With ``doc_ids`` the filter reaches the ORC scan, where statistics and Bloom filters prune;
    starts still count every document, from the narrow columns only.
    """
    rows = spark.read.schema(FILE_COLUMNS).orc(path)
    ends = rows.groupBy("part").agg(F.max(F.col("before") + F.col("n_ids")).alias("n"))
    # One row for each file: this window and the broadcast hold as many rows as there are files.
    base = ends.select(
        "part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("base")
    )
    if doc_ids is not None:
        rows = rows.filter(F.col("doc_id").isin(doc_ids))
    return rows.join(F.broadcast(base), "part").select(
        "doc_id", (F.col("base") + F.col("before")).alias("start"), "ids"
    )


def digest_tokens(tokens: DataFrame) -> DataFrame:
    """Per document: its number of ids and the CRC-32 of them as little-endian 32-bit integers."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("ids")
            flat = ids.values.to_numpy(zero_copy_only=False)
            ends = ids.offsets.to_numpy()
            crc = [zlib.crc32(flat[a:b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("start"), pa.array(np.diff(ends).astype(np.int64)), pa.array(crc, pa.int64())],
                ["doc_id", "start", "n_tokens", "ids_crc32"],
            )

    return tokens.mapInArrow(digest, "doc_id long, start long, n_tokens long, ids_crc32 long")
