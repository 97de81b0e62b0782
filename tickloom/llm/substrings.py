"""Repeated passages: Rabin-Karp hashes of every window of words, counted in Spark.

1. Each task hashes all windows of a chunk of documents. A window that starts again in the chunk counts as
   repeated there and then; one entry for each different window goes on, so a passage shared by a third of
   all documents is one entry a chunk and not one a document.
2. Entries are shuffled by a second, independent hash, packed in arrays. Windows met in several chunks are
   repeated everywhere but in the smallest document.
3. Repeated windows return to their chunk, merge into maximal intervals of words, one row a document, and
   join the texts.

Windows are equal if a 64-bit hash and the bucket from another hash agree: with ``n`` different windows and ``b``
buckets some n * n / (2^65 * b) pairs are expected to agree by chance, far below one at any size tested here.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import (
    batches_of,
    fresh_name,
    located,
    mixed,
    rolling,
    shuffle_width,
    stage_table,
    texts_of,
    whole_windows,
    word_edges,
    word_hashes,
)

WINDOW = 20
# Text that a task hashes at once; it sets the memory of a chunk, some 20 bytes a byte.
CHUNK_BYTES = 2 << 20
# Text whose windows go to one bucket, on average: 8 MB of text have some 1.3 million windows, 14 MB as packed entries.
BUCKET_BYTES = 8 << 20
# Buckets for each shuffle partition at least: some, so that their sizes even out.
BUCKETS_PER_PARTITION = 2
BASE, OTHER_BASE = 0x2545F4914F6CDD1D, 0xD6E8FEB86659FD93
ENTRIES = "bucket int, chunk long, hashes binary, docs binary, counts binary, places binary, kind int"


def planes(values: np.ndarray) -> bytes:
    """An integer array with equal byte positions side by side, so that zero bytes compress."""
    values = np.ascontiguousarray(values)
    return np.ascontiguousarray(values.view(np.uint8).reshape(len(values), values.itemsize).T).tobytes()


def from_planes(data: bytes, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(size, -1).T).reshape(-1).view(kind)


def _hash_windows(width: int, buckets: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        chunk = TaskContext.get().partitionId() << 32
        for table in batches_of(batches, "text", CHUNK_BYTES):
            table = table.sort_by([("doc_id", "ascending"), ("__file", "ascending"), ("__row", "ascending")])
            data, starts, ends, counts = word_edges(texts_of(table.column("text")))
            words = word_hashes(data, starts, ends)
            at, own = whole_windows(counts, width)
            hashes = rolling(words, width, BASE)[at]
            order = np.argsort(hashes, kind="stable")
            again = np.zeros(len(hashes), bool)
            again[order[1:]] = hashes[order[1:]] == hashes[order[:-1]]
            place = np.flatnonzero(~again)
            hashes = hashes[place]
            bucket = (mixed(rolling(words, width, OTHER_BASE)[at][place]) % np.uint64(buckets)).astype(np.int32)
            ids = table.column("doc_id").to_numpy()
            document = np.repeat(np.arange(len(own)), own)[place]
            order = np.argsort(bucket, kind="stable")
            edges = np.searchsorted(bucket[order], np.arange(buckets + 1))
            rows = []
            for b in np.flatnonzero(np.diff(edges)).tolist():
                pick = order[edges[b] : edges[b + 1]]
                docs, n = np.unique(document[pick], return_counts=True)
                rows.append((b, chunk, hashes[pick].tobytes(), planes(ids[docs]), planes(n.astype(np.int32)), planes(place[pick].astype(np.uint32)), 0))
            # The chunk's own row: its documents, their windows and what is repeated within the chunk.
            rows.append(
                (
                    chunk % buckets,
                    chunk,
                    planes(table.column("__file").to_numpy()),
                    planes(table.column("__row").to_numpy()),
                    planes(own.astype(np.int32)),
                    np.packbits(again).tobytes(),
                    1,
                )
            )
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(zip(*rows), (pa.int32(), pa.int64(), *[pa.binary()] * 4, pa.int32()))],
                ["bucket", "chunk", "hashes", "docs", "counts", "places", "kind"],
            )
            chunk += 1

    return run


def _repeated(table: pa.Table) -> pa.Table:
    """Of a bucket's entries, those whose window is also in a smaller document; the chunks' own rows pass."""
    names = ["chunk", "hashes", "docs", "counts", "places", "kind"]
    own = table.filter(pa.compute.equal(table.column("kind"), 1)).select(names)
    entries = table.filter(pa.compute.equal(table.column("kind"), 0)).to_pylist()
    rows = []
    if entries:
        hashes = np.concatenate([np.frombuffer(e["hashes"], np.uint64) for e in entries])
        chunks = np.repeat([e["chunk"] for e in entries], [len(e["hashes"]) // 8 for e in entries])
        docs = np.concatenate([np.repeat(from_planes(e["docs"], np.int64), from_planes(e["counts"], np.int32)) for e in entries])
        places = np.concatenate([from_planes(e["places"], np.uint32) for e in entries])
        order = np.argsort(hashes)
        same = hashes[order[1:]] == hashes[order[:-1]]
        shared = np.zeros(len(order), bool)
        shared[1:] |= same
        shared[:-1] |= same
        pick = order[shared]
        pick = pick[np.lexsort((chunks[pick], docs[pick], hashes[pick]))]
        later = np.zeros(len(pick), bool)
        later[1:] = hashes[pick[1:]] == hashes[pick[:-1]]
        pick = pick[later]
        pick = pick[np.lexsort((places[pick], chunks[pick]))]
        found, first = np.unique(chunks[pick], return_index=True)
        for chunk, part in zip(found.tolist(), np.split(places[pick], first[1:])):
            rows.append((chunk, b"", b"", b"", planes(part), 0))
    made = pa.table([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 6, own.schema.types)], schema=own.schema)
    return pa.concat_tables([own, made])


def _spans(width: int) -> Callable:
    def merge(table: pa.Table) -> pa.Table:
        """All repeated windows of a chunk as maximal intervals of words [start, end), flat, for each document."""
        own, places = None, []
        for row in table.to_pylist():
            if row["kind"] == 1:
                own = row
            else:
                places.append(from_planes(row["places"], np.uint32))
        counts = from_planes(own["counts"], np.int32)
        repeated = np.unpackbits(np.frombuffer(own["places"], np.uint8))[: counts.sum()].astype(bool)
        for part in places:
            repeated[part] = True
        files, rows = from_planes(own["hashes"], np.int64), from_planes(own["docs"], np.int64)
        at = np.flatnonzero(repeated)
        ends = np.cumsum(counts)
        document = np.searchsorted(ends, at, side="right")
        start = at - (ends - counts)[document]
        # A window opens a new interval if it is another document's or leaves a gap to the one before.
        new = np.ones(len(at), bool)
        new[1:] = (document[1:] != document[:-1]) | (start[1:] > start[:-1] + width)
        first = np.flatnonzero(new)
        last = np.concatenate([first[1:] - 1, [len(at) - 1]]) if len(at) else first
        flat = np.stack([start[first], start[last] + width], axis=1).astype(np.int32)
        found, offset = np.unique(document[first], return_index=True)
        offsets = 2 * np.concatenate([offset, [len(flat)]]).astype(np.int32)
        spans = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat.reshape(-1)))
        return pa.table([pa.array(files[found]), pa.array(rows[found]), spans], ["__file", "__row", "spans"])

    return merge


def bucket_count(docs: DataFrame) -> int:
    """As many buckets as keep each of them at ``BUCKET_BYTES`` of text, whatever the number of tasks."""
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0))).first()[0]
    return max(BUCKETS_PER_PARTITION * shuffle_width(docs.sparkSession), -(-size // BUCKET_BYTES))


def repeated_spans(docs: DataFrame, width: int = WINDOW) -> DataFrame:
    """Per document with repeated windows: ``__file``, ``__row`` and ``spans``, its intervals of words to remove.

    ``docs`` comes from ``located``. A window is repeated if its words also start in a smaller document (null ids
    are the smallest; rows of equal id count in the order of the table) or earlier in the same one.
    """
    buckets = bucket_count(docs)
    narrow = docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("doc_id"), "__file", "__row", F.coalesce("text", F.lit("")).alias("text")
    )
    entries = narrow.mapInArrow(_hash_windows(width, buckets), ENTRIES)
    marked = entries.groupBy("bucket").applyInArrow(
        _repeated, "chunk long, hashes binary, docs binary, counts binary, places binary, kind int"
    )
    marked = stage_table(marked, "repeated")
    return marked.groupBy("chunk").applyInArrow(_spans(width), "__file long, __row long, spans array<int>")


def with_spans(docs: DataFrame, width: int = WINDOW, name: str = "spans") -> DataFrame:
    """All rows of ``docs`` and their ``spans`` (null: nothing is repeated)."""
    docs = located(docs)
    spans = stage_table(repeated_spans(docs, width), "spans").withColumnRenamed("spans", name)
    # The spans grow with the corpus: one way of joining them at every size.
    return docs.join(spans.hint("shuffle_merge"), ["__file", "__row"], "left").drop("__file", "__row")


def digest_kept(docs: DataFrame, width: int = WINDOW) -> DataFrame:
    """Per row: doc_id, n_words, n_removed and the SHA-256 of the kept words joined by one space.

    A null or empty text has no words, and the digest of the empty string.
    """

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, removed, sha = [], [], []
            for text, spans in zip(texts_of(batch.column("text")), batch.column("spans").to_pylist()):
                words = text.encode().split()
                total = len(words)
                for end, start in zip(reversed((spans or [])[1::2]), reversed((spans or [])[::2])):
                    del words[start:end]
                n.append(total)
                removed.append(total - len(words))
                sha.append(hashlib.sha256(b" ".join(words)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(sha, pa.string())],
                ["doc_id", "n_words", "n_removed", "kept_sha256"],
            )

    rows = with_spans(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), width)
    return rows.mapInArrow(digest, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def cut_words(text: str, spans: list[int]) -> str:
    """The text without the words in ``spans``; the white space before each kept word stays."""
    data = text.encode()
    _, starts, ends, _ = word_edges([text])
    kept, at = [], 0
    for first, last in zip(spans[::2], spans[1::2]):
        kept.append(data[at : ends[first - 1] if first else 0])
        at = int(ends[last - 1])
    kept.append(data[at:])
    return b"".join(kept).decode()


def remove_repeats(docs: DataFrame, width: int = WINDOW) -> DataFrame:
    """All rows and columns of ``docs``, texts without their repeated passages and ``n_chars``, if there, made anew.

    Rows are kept even if nothing is left of their text; texts without repeats stay as they are.
    """

    @F.pandas_udf("string")
    def cut(text: pd.Series, spans: pd.Series) -> pd.Series:
        return pd.Series([t if p is None else cut_words(t, p.tolist()) for t, p in zip(text, spans)], dtype=object)

    spans = fresh_name(docs, "spans")
    rows = with_spans(docs, width, spans)
    changed = F.col(spans).isNotNull()
    out = rows.withColumn("text", cut("text", spans))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(changed, F.length("text").cast(kind)).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)
