"""Small helpers of the text operators: intermediate tables, Arrow columns, words, per-worker stores."""

from __future__ import annotations

import ctypes
import sys
import types
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.plans.settings import scratch_path

CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
# Fixed value: the white space that ends a word (the pattern [^\x20\x09-\x0D]+ finds the words).
# bytes.split() without arguments cuts at exactly these six bytes.
WORD_BREAKS = " \t\n\v\f\r"
# The same as a regular expression for Spark and DuckDB.
WORD = r"[^\x20\x09-\x0D]+"


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of the queries run inside go when each query has ended."""
    before = spark.conf.get(CLEAN_UP, "false")
    spark.conf.set(CLEAN_UP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEAN_UP, before)


def stage_table(df: DataFrame, name: str) -> DataFrame:
    """Write a frame as Parquet into the shared folder and read it back; its shuffle files go at once.

    What follows reads the table, so a lost executor costs a new scan and not the whole lineage.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    with shuffles_removed(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def worker_store(name: str) -> dict:
    """A dict that lives as long as the Python worker, for what is costly to load."""
    home = sys.modules.get("_tickloom_worker")
    if home is None:
        home = sys.modules["_tickloom_worker"] = types.ModuleType("_tickloom_worker")
    return home.__dict__.setdefault(name, {})


def fresh_name(df: DataFrame, name: str) -> str:
    """A column name that the frame does not have (names compare without case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def as_text(column: str | Column) -> Column:
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def texts_of(column: pa.Array | pa.ChunkedArray) -> list[str]:
    """The strings of an Arrow column; null gives the empty string."""
    return [t or "" for t in column.to_pylist()]


def words_of(text: str) -> list[bytes]:
    return text.encode().split()


def give_back_freed_memory() -> None:
    """Return to the system what this process has freed.

    A Python worker goes on with the tasks of later steps. What its allocators hold of large arrays that are gone would
    count on top of what those tasks need.
    """
    pa.default_memory_pool().release_unused()
    # glibc only; other C libraries have no such function.
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def batches_of(batches: Iterable[pa.RecordBatch], column: str, most_bytes: int) -> Iterator[pa.Table]:
    """Join Arrow batches until their text column holds ``most_bytes``; one row may exceed that alone.

    Memory that earlier tasks of the worker have freed is given back first.
    """
    give_back_freed_memory()
    held, size = [], 0
    for batch in batches:
        if batch.num_rows == 0:
            continue
        for part in _cut(batch, column, most_bytes):
            held.append(part)
            size += part.column(column).nbytes
            if size >= most_bytes:
                yield pa.Table.from_batches(held)
                held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


def _cut(batch: pa.RecordBatch, column: str, most_bytes: int) -> Iterator[pa.RecordBatch]:
    while batch.num_rows > 1 and batch.column(column).nbytes > most_bytes:
        half = batch.num_rows // 2
        yield from _cut(batch.slice(0, half), column, most_bytes)
        batch = batch.slice(half)
    yield batch


def lists_of_ints(parts: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    """An Arrow list column from one integer array a row."""
    ends = np.zeros(len(parts) + 1, np.int32)
    np.cumsum([len(p) for p in parts], out=ends[1:])
    flat = np.concatenate(parts) if parts else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat).cast(kind))


def located(df: DataFrame) -> DataFrame:
    """Add ``__file`` and ``__row``, which tell every row apart, equal ones too.

    They are the file and the row number of a Parquet table; any other frame is written as one first. So a task that
    runs again finds the same rows under the same names.
    """
    place = [F.xxhash64("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").alias("__row")]
    try:
        return df.select("*", *place)
    except AnalysisException:
        return stage_table(df, "located").select("*", *place)


def word_edges(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of many texts at once: the bytes, where words start and end in them, and the number of words a text."""
    coded = [t.encode() for t in texts]
    data = np.frombuffer(b" ".join(coded) + b" ", np.uint8)
    breaks = np.zeros(256, bool)
    breaks[[ord(c) for c in WORD_BREAKS]] = True
    gap = breaks[data]
    starts = np.flatnonzero(~gap[1:] & gap[:-1]) + 1
    if not gap[0]:
        starts = np.concatenate([[0], starts])
    ends = np.flatnonzero(gap[1:] & ~gap[:-1]) + 1
    first = np.concatenate([[0], np.cumsum([len(c) + 1 for c in coded])])
    counts = np.diff(np.searchsorted(starts, first))
    return data, starts, ends, counts


def mixed(x: np.ndarray) -> np.ndarray:
    """The finishing steps of a 64-bit hash (public constants of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


# Bytes of words that are hashed at a time: some ten times as much memory.
BYTES_HASHED_AT_ONCE = 1 << 18


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit polynomial hash of the bytes of each word."""
    symbol = mixed(np.arange(1, 257, dtype=np.uint64))
    out, first = np.zeros(len(starts), np.uint64), 0
    while first < len(starts):
        # At least one word, however long.
        last = max(first + 1, int(np.searchsorted(ends, starts[first] + BYTES_HASHED_AT_ONCE)))
        lengths = ends[first:last] - starts[first:last]
        edges = np.concatenate([[0], np.cumsum(lengths)])
        within = np.arange(edges[-1]) - np.repeat(edges[:-1], lengths)
        power = np.cumprod(np.full(int(lengths.max()), 0x9E3779B97F4A7C15, np.uint64))
        terms = symbol[data[within + np.repeat(starts[first:last], lengths)]] * power[within]
        out[first:last] = mixed(np.add.reduceat(terms, edges[:-1]))
        first = last
    return out


def rolling(words: np.ndarray, width: int, base: int) -> np.ndarray:
    """Rabin-Karp: the polynomial hash modulo 2^64 of every ``width`` consecutive words."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for k in range(width):
        total = total * np.uint64(base) + words[k : k + n]
    return total


def whole_windows(counts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Of the windows over joined texts, those within one text; and how many each text has."""
    own = np.maximum(counts - width + 1, 0)
    first = np.concatenate([[0], np.cumsum(counts)])[:-1]
    ends = np.cumsum(own)
    within = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - own, own)
    return within + np.repeat(first, own), own
