"""Exact duplicates by a tree merge of sorted digest runs.

1. Each task turns a chunk of documents into a run: one entry for each different text, in digest order, with the
   row that stays so far and how many rows there are. Texts are compared as bytes here, so a group of copies is one
   entry a chunk however large it is.
2. Lanes exchange runs in binomial rounds. In a round the lanes whose numbers differ in one digit form a group; each
   member cuts its run by that digit of the digests and sends every member its slice, which merges all it gets. After
   the last digit a lane holds all entries whose digests begin with its number, each once.
3. Entries met in more than one chunk return to their chunks (an entry remembers them), where every row is answered.

Entries are merged if SHA-256 and a second, independent digest of 64 bits agree; were only one of them equal, the
entries would stay apart. Only runs cross the network, never texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import as_text, batches_of, fresh_name, located, shuffle_width, stage_table, texts_of

# Text that a task turns into one run.
CHUNK_BYTES = 8 << 20
# Lanes that exchange slices in a round; a run has at most this many slices.
FANOUT = 16
# Entries that a lane holds at the end, on average, some 150 bytes each while they merge.
ENTRIES_PER_LANE = 100_000
# Stands for a null id in packed arrays; a null id is smaller than all others.
NO_ID = -(1 << 63)

# A run as arrays: five 64-bit words of the two digests, the row that stays (its id, chunk and row in the chunk), the
# number of rows, and the entries of chunks it was made of (how many, and for each its chunk and its number there).
KINDS = {"keys": "<u8", "best": "<i8", "home": "<i8", "at": "<i4", "counts": "<i8", "links": "<i4", "chunks": "<i8", "entries": "<i4"}
PER_ENTRY = ("best", "home", "at", "counts", "links")
WORDS = 5
Run = dict[str, np.ndarray]

CHUNK = "chunk long, n_entries int, keys binary, best binary, at binary, counts binary, ids array<long>, entry binary, files binary, rows binary"
MESSAGE = "lane int, " + ", ".join(f"{name} binary" for name in KINDS)
ANSWER = "chunk long, entries binary, best binary, home binary, at binary, counts binary"
MARKS = "__file long, __row long, doc_id long, keep_id long, group_size long, kept boolean, text_sha256 string"


def _column(values: list, kind: pa.DataType) -> pa.Array:
    return pa.array(values, kind)


def _chunk_runs() -> Callable:
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        chunk = TaskContext.get().partitionId() << 32
        for table in batches_of(batches, "text", CHUNK_BYTES):
            found: dict[bytes, int] = {}
            # bytes.lower() lowers A to Z only.
            entry = np.array([found.setdefault(t.encode().lower(), len(found)) for t in texts_of(table.column("text"))], np.int32)
            packed = b"".join(hashlib.sha256(t).digest() + hashlib.blake2b(t, digest_size=8).digest() for t in found)
            keys = np.frombuffer(packed, ">u8").astype("<u8").reshape(-1, WORDS)
            order = np.lexsort(keys.T[::-1])
            rank = np.empty(len(order), np.int32)
            rank[order] = np.arange(len(order))
            entry, keys = rank[entry], keys[order]
            ids = table.column("doc_id").combine_chunks()
            filled = ids.fill_null(NO_ID).to_numpy()
            # The largest id of each entry stays, and of equal ids the first row.
            by = np.lexsort((~filled, entry))
            first = np.flatnonzero(np.r_[True, entry[by][1:] != entry[by][:-1]])
            at = by[first].astype(np.int32)
            arrays = [keys, filled[at], at, np.bincount(entry).astype("<i8")]
            values = [chunk, len(keys), *[a.tobytes() for a in arrays]]
            kinds = [pa.int64(), pa.int32(), *[pa.binary()] * 4]
            places = [entry.tobytes(), *[table.column(c).to_numpy().astype("<i8").tobytes() for c in ("__file", "__row")]]
            listed = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids.cast(pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [*[_column([v], k) for v, k in zip(values, kinds)], listed, *[_column([p], pa.binary()) for p in places]],
                ["chunk", "n_entries", "keys", "best", "at", "counts", "ids", "entry", "files", "rows"],
            )
            chunk += 1

    return make


def _ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The numbers of all ranges [start, start + length), one range after the other."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - lengths), lengths)


def take(run: Run, index: np.ndarray) -> Run:
    """The entries at ``index``, in that order, with their links."""
    first = np.cumsum(run["links"]) - run["links"]
    links = _ranges(first[index], run["links"][index])
    out = {name: run[name][index] for name in ("keys", *PER_ENTRY)}
    return out | {name: run[name][links] for name in ("chunks", "entries")}


def merge(runs: list[Run]) -> Run:
    """One run of all entries; entries with equal keys become one, with the largest id and all rows and links."""
    run = {name: np.concatenate([r[name] for r in runs]) for name in KINDS}
    # A stable sort of joined sorted runs merges them; equal first words with unequal others need all words.
    order = np.argsort(run["keys"][:, 0], kind="stable")
    keys = run["keys"][order]
    if np.any((keys[1:, 0] == keys[:-1, 0]) & np.any(keys[1:] != keys[:-1], axis=1)):
        order = np.lexsort(run["keys"].T[::-1])
        keys = run["keys"][order]
    new = np.ones(len(keys), bool)
    new[1:] = np.any(keys[1:] != keys[:-1], axis=1)
    if new.all():
        return take(run, order)
    # Of equal keys the row that stays comes first: the largest id, then the smallest chunk.
    group = np.cumsum(new)
    order = order[np.lexsort((run["home"][order], ~run["best"][order], group))]
    run, first = take(run, order), np.flatnonzero(new)
    sums = {name: np.add.reduceat(run[name], first) for name in ("counts", "links")}
    return {name: a if name in ("chunks", "entries") else a[first] for name, a in run.items()} | sums


def _unpacked(table: pa.Table) -> list[Run]:
    runs = []
    for row in table.to_pylist():
        run = {name: np.frombuffer(row[name], kind) for name, kind in KINDS.items()}
        runs.append(run | {"keys": run["keys"].reshape(-1, WORDS)})
    return runs


def _digits(lanes: int, fanout: int) -> list[tuple[int, int]]:
    """The exchange rounds: for each its lowest bit in a lane's number and its number of bits."""
    left, width, rounds = lanes.bit_length() - 1, fanout.bit_length() - 1, []
    while left:
        bits = min(width, left)
        left -= bits
        rounds.append((left, bits))
    return rounds


def slices(run: Run, lane: int, lanes: int, digit: tuple[int, int]) -> Iterator[tuple[int, Run]]:
    """The parts of a lane's run for each member of its group: all entries, cut by one digit of their home lane."""
    low, bits = digit
    total = lanes.bit_length() - 1
    home = (run["keys"][:, 0] >> np.uint64(64 - total)).astype(np.int64)
    want = (home >> low) & ((1 << bits) - 1)
    others = lane & ~(((1 << bits) - 1) << low)
    for d in np.unique(want).tolist():
        yield others | (d << low), take(run, np.flatnonzero(want == d))


def _messages(parts: Iterator[tuple[int, Run]]) -> pa.Table:
    rows = [(lane, *[part[name].astype(kind).tobytes() for name, kind in KINDS.items()]) for lane, part in parts]
    columns = list(zip(*rows)) if rows else [[]] * (1 + len(KINDS))
    kinds = [pa.int32(), *[pa.binary()] * len(KINDS)]
    return pa.table([_column(c, k) for c, k in zip(columns, kinds)], ["lane", *KINDS])


def _first_messages(lanes: int, digit: tuple[int, int]) -> Callable:
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                run = {name: np.frombuffer(row[name], KINDS[name]) for name in ("keys", "best", "at", "counts")}
                n = row["n_entries"]
                run |= {"keys": run["keys"].reshape(-1, WORDS), "links": np.ones(n, np.int32), "entries": np.arange(n, dtype=np.int32)}
                run |= {name: np.full(n, row["chunk"], np.int64) for name in ("home", "chunks")}
                yield from _messages(slices(run, row["lane"], lanes, digit)).to_batches()

    return send


def _exchange(lanes: int, digit: tuple[int, int]) -> Callable:
    def step(table: pa.Table) -> pa.Table:
        return _messages(slices(merge(_unpacked(table)), table.column("lane")[0].as_py(), lanes, digit))

    return step


def _answers(table: pa.Table) -> pa.Table:
    """Of a lane's final run, the entries of several chunks, as one row for each of these chunks."""
    run = merge(_unpacked(table))
    run = take(run, np.flatnonzero(run["links"] > 1))
    entry = np.repeat(np.arange(len(run["links"])), run["links"])
    order = np.argsort(run["chunks"], kind="stable")
    chunks, first = np.unique(run["chunks"][order], return_index=True)
    rows = []
    for chunk, pick in zip(chunks.tolist(), np.split(order, first[1:])):
        of = entry[pick]
        rows.append((chunk, run["entries"][pick].tobytes(), *[run[name][of].tobytes() for name in ("best", "home", "at", "counts")]))
    columns = list(zip(*rows)) if rows else [[]] * 6
    kinds = [pa.int64(), *[pa.binary()] * 5]
    return pa.table([_column(c, k) for c, k in zip(columns, kinds)], ["chunk", "entries", "best", "home", "at", "counts"])


def _mark(chunk: pa.Table, answers: pa.Table) -> pa.Table:
    """All rows of a chunk with what became of their texts."""
    (row,) = chunk.to_pylist()
    keys = np.frombuffer(row["keys"], KINDS["keys"]).reshape(-1, WORDS)
    state = {name: np.frombuffer(row[name], KINDS[name]).copy() for name in ("best", "at", "counts")}
    state["home"] = np.full(len(keys), row["chunk"], np.int64)
    for answer in answers.to_pylist():
        where = np.frombuffer(answer["entries"], KINDS["entries"])
        for name in state:
            state[name][where] = np.frombuffer(answer[name], KINDS[name])
    entry = np.frombuffer(row["entry"], np.int32)
    keep = state["best"][entry]
    kept = (state["home"][entry] == row["chunk"]) & (state["at"][entry] == np.arange(len(entry)))
    digests = [k.astype(">u8").tobytes().hex() for k in keys[:, :4]]
    places = [pa.array(np.frombuffer(row[name], "<i8")) for name in ("files", "rows")]
    return pa.table(
        [
            *places,
            chunk.column("ids").combine_chunks().values,
            pa.array(keep, pa.int64(), mask=keep == NO_ID),
            pa.array(state["counts"][entry]),
            pa.array(kept),
            pa.array([digests[e] for e in entry.tolist()], pa.string()),
        ],
        ["__file", "__row", "doc_id", "keep_id", "group_size", "kept", "text_sha256"],
    )


def mark_exact_duplicates(docs: DataFrame, lanes: int | None = None, fanout: int = FANOUT) -> DataFrame:
    """One row for each row of ``docs`` (from ``located``): ``__file``, ``__row``, doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal if they are after lower-casing A to Z; a null text is the empty one. Of each group the row with the
    largest id stays; null ids are smaller than all others (keep_id is null if a group has no other), and of rows with
    equal ids exactly one stays. An empty table gives an empty table; columns other than ``doc_id`` and ``text`` are not read.

    ``lanes`` and ``fanout`` are powers of two; by default lanes grow with the entries.
    """
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "__file", "__row", as_text(F.col("text").cast("string")).alias("text"))
    runs = stage_table(narrow.mapInArrow(_chunk_runs(), CHUNK), "digest_runs")
    if lanes is None:
        entries = runs.agg(F.coalesce(F.sum("n_entries"), F.lit(0))).first()[0]
        lanes = 1 << (max(shuffle_width(docs.sparkSession), -(-entries // ENTRIES_PER_LANE), 2) - 1).bit_length()
    first, *later = _digits(lanes, fanout)
    given = runs.select("chunk", "n_entries", "keys", "best", "at", "counts", F.pmod(F.xxhash64("chunk"), F.lit(lanes)).cast("int").alias("lane"))
    sent = given.mapInArrow(_first_messages(lanes, first), MESSAGE)
    for digit in later:
        sent = sent.groupBy("lane").applyInArrow(_exchange(lanes, digit), MESSAGE)
    answers = stage_table(sent.groupBy("lane").applyInArrow(_answers, ANSWER), "digest_answers")
    whole = runs.select("chunk", "keys", "best", "at", "counts", "ids", "entry", "files", "rows")

    def mark(chunk: pa.Table, found: pa.Table) -> pa.Table:
        return _mark(chunk, found)

    return whole.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(mark, MARKS)


def drop_exact_duplicates(docs: DataFrame) -> DataFrame:
    """The rows and columns of ``docs`` without all but one row of each text, by the rules of ``mark_exact_duplicates``."""
    rows = located(docs)
    kept = fresh_name(rows, "kept")
    marks = mark_exact_duplicates(rows).select("__file", "__row", F.col("kept").alias(kept))
    # The marks grow with the corpus: one way of joining them at every size.
    joined = rows.join(stage_table(marks, "marks").filter(kept).hint("shuffle_merge"), ["__file", "__row"])
    return joined.select(*docs.columns)
