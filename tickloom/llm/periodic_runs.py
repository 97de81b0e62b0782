"""Periodic runs in word sequences, found on a grammar of the words.

A run is a stretch of words that repeats every ``period`` words, at least ``TIMES`` periods and ``LEAST`` words long, and
that no neighbouring word extends. Each text is worked on alone, so Spark spreads texts and nothing is shuffled.

1. Every place of a run lies in a window of ``window_width`` words that the text has twice. Windows are hashed for whole batches
   of texts; words outside such windows, most of a corpus, go no further.
2. The word ids of what is left become a grammar by Re-Pair (Larsson and Moffat 2000): the most frequent pair of
   neighbours is replaced by a new symbol until no pair occurs twice; of equally frequent pairs the shortest goes first, which keeps
   the grammar flat. What remains of a stretch is halved down to single symbols, so every node has two children.
3. The runs that cross the boundary between a node's children are computed once for each symbol, in its expansion,
   and moved to all places that derive it. A run is whole in the least node that holds it; other nodes see
   parts of it, so intervals of one period that overlap by a period are merged.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.llm.common import WORD, as_text, batches_of, mixed, rolling, texts_of, whole_windows, word_edges, word_hashes

LEAST = 24
TIMES = 3
TEXT_BYTES_AT_ONCE = 1 << 20
BASE = 0x2545F4914F6CDD1D
RUNS = "array<struct<start: long, length: long, period: long>>"
RUN_TYPE = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
Interval = tuple[int, int, int]


def window_width(least: int = LEAST, times: int = TIMES) -> int:
    """Words of a run of period q that come again q words on: max(least, times q) - q, at its smallest."""
    return min(max(least, times * q) - q for q in range(1, least + 1))


def _seed_width(least: int, times: int) -> int:
    """Words that the longer side of a run, seen from any place inside, shares with itself a period further."""
    return min(-(-max(least, times * q) // 2) - q for q in range(1, least + 1))


def _repeated_pairs(words: np.ndarray) -> dict[tuple[int, int], list[int]]:
    """The places of each pair of neighbours that occurs twice or more."""
    if len(words) < 2:
        return {}
    size = int(words.max()) + 1
    keys = words[:-1] * size + words[1:]
    order = np.argsort(keys, kind="stable")
    found, first, counts = np.unique(keys[order], return_index=True, return_counts=True)
    many = counts > 1
    spans = zip(found[many].tolist(), first[many].tolist(), counts[many].tolist())
    return {divmod(key, size): order[at : at + n].tolist() for key, at, n in spans}


class Grammar:
    """Re-Pair of a sequence of small non-negative integers.

    ``rules`` has for each new symbol the length of its left child, its own length and the places where it stands in the
    derivation; ``starts`` the places of the symbols that remain.
    """

    def __init__(self, words: np.ndarray):
        n = len(words)
        symbol, after, before = words.tolist(), list(range(1, n + 1)), list(range(-1, n - 1))
        new = int(words.max()) + 1 if n else 0
        length: dict[int, int] = {}
        places = _repeated_pairs(words)
        heap = [(-len(at), 2, pair) for pair, at in places.items()]
        heapq.heapify(heap)
        self.rules: list[tuple[int, int, list[int]]] = []
        while heap:
            count, size, pair = heapq.heappop(heap)
            left, right = pair
            valid, free = [], -1
            # Places that other replacements took are stale; of "aaa" only one pair counts.
            for p in sorted(places.pop(pair)):
                q = after[p]
                if p >= free and symbol[p] == left and q < n and symbol[q] == right:
                    valid.append(p)
                    free = q + 1
            if len(valid) < 2:
                continue
            if len(valid) < -count:
                places[pair] = valid if left != right else [p for p in _all_places(symbol, after, left, valid, n)]
                heapq.heappush(heap, (-len(valid), size, pair))
                continue
            touched: dict[tuple[int, int], list[int]] = {}
            for p in valid:
                q = after[p]
                r = after[q]
                symbol[p], symbol[q] = new, -1
                after[p] = r
                if r < n:
                    before[r] = p
                    touched.setdefault((new, symbol[r]), []).append(p)
                if before[p] >= 0:
                    touched.setdefault((symbol[before[p]], new), []).append(before[p])
            length[new] = size
            self.rules.append((length.get(left, 1), size, valid))
            for made, at in touched.items():
                if len(at) > 1:
                    places[made] = at
                    heapq.heappush(heap, (-len(at), length.get(made[0], 1) + length.get(made[1], 1), made))
            new += 1
        self.starts, p = [], 0
        while p < n:
            self.starts.append(p)
            p = after[p]


def _all_places(symbol: list[int], after: list[int], one: int, valid: list[int], n: int) -> Iterator[int]:
    """All places of a pair of equal symbols, overlapping ones too, from the places that do not overlap."""
    last = -1
    for p in valid:
        while p > last and symbol[p] == one and after[p] < n and symbol[after[p]] == one:
            yield p
            last, p = p, after[p]


def _common(u: np.ndarray, v: np.ndarray) -> int:
    """How many first elements two arrays share."""
    n, at, step = min(len(u), len(v)), 0, 32
    while at < n:
        unequal = u[at : min(at + step, n)] != v[at : min(at + step, n)]
        if unequal.any():
            return at + int(unequal.argmax())
        at, step = at + step, step * 4
    return n


def crossing_runs(x: np.ndarray, a: int, m: int, b: int, least: int = LEAST, times: int = TIMES) -> list[Interval]:
    """The runs (start, end, period) of ``x[a:b]`` that have words on both sides of ``m``.

    One side of such a run is at least half of it; there the words next to ``m`` come again a period further out, which
    leaves few periods to try. Multiples of a period found for the same stretch are not tried.
    """
    seed, most = _seed_width(least, times), (b - a) // times
    out: list[Interval] = []
    if b - a < least:
        return out
    for right in (True, False):
        limit = min(most, (b - m if right else m - a) - seed)
        if limit < 1:
            continue
        ok = np.ones(limit, bool)
        for k in range(seed):
            if right:
                ok &= x[m + 1 + k : m + 1 + k + limit] == x[m + k]
            else:
                ok &= x[m - 1 - k - limit : m - 1 - k][::-1] == x[m - 1 - k]
        for q in (np.flatnonzero(ok) + 1).tolist():
            # From here on, words q apart are compared to both sides.
            at = m if right else m - q
            if any(q % p == 0 and s <= at and at + q < e for s, e, p in out):
                continue
            s = at - _common(x[a:at][::-1], x[a + q : at + q][::-1])
            e = at + q + _common(x[at : b - q], x[at + q : b])
            if s < m < e and e - s >= max(least, times * q):
                out.append((s, e, q))
    return out


def _halves(edges: list[int]) -> Iterator[tuple[int, int, int]]:
    """The nodes of a balanced tree over consecutive symbols: first place, boundary, end."""
    open_ = [(0, len(edges) - 1)]
    while open_:
        i, j = open_.pop()
        if j - i > 1:
            middle = (i + j) // 2
            yield edges[i], edges[middle], edges[j]
            open_ += [(i, middle), (middle, j)]


def merged(intervals: Iterable[Interval]) -> list[Interval]:
    """Maximal intervals of each period; of equal intervals the least period."""
    whole: dict[tuple[int, int], int] = {}
    start = end = period = -1
    for q, s, e in [*sorted((q, s, e) for s, e, q in set(intervals)), (0, 0, 0)]:
        if q == period and s <= end - q:
            end = max(end, e)
            continue
        # Periods ascend, so the first one stays.
        if period > 0:
            whole.setdefault((start, end), period)
        start, end, period = s, e, q
    return sorted((s, e, q) for (s, e), q in whole.items())


def runs_of(stretches: list[np.ndarray], least: int = LEAST, times: int = TIMES) -> list[Interval]:
    """All runs of the stretches of one text, as (start, end, period) in the joined stretches.

    Each stretch is followed there by one place that is no word. The grammar is one for all stretches.
    """
    n_words = max((int(s.max()) + 1 for s in stretches if len(s)), default=0)
    x = np.concatenate([part for i, s in enumerate(stretches) for part in (s, [n_words + i])]).astype(np.int64)
    grammar = Grammar(x)
    found: list[Interval] = []
    for left, size, places in grammar.rules:
        if size < least:
            continue
        at = places[0]
        here = crossing_runs(x, at, at + left, at + size, least, times)
        found += [(s + p - at, e + p - at, q) for s, e, q in here for p in places]
    symbols = np.array(grammar.starts)
    ends = np.cumsum([len(s) + 1 for s in stretches]) - 1
    first = 0
    for end in ends.tolist():
        inside = symbols[np.searchsorted(symbols, first) : np.searchsorted(symbols, end)].tolist()
        for a, m, b in _halves([*inside, end]):
            if b - a >= least:
                found += crossing_runs(x, a, m, b, least, times)
        first = end + 1
    return merged(found)


def _covered(counts: np.ndarray, words: np.ndarray, width: int) -> np.ndarray:
    """For the words of many texts: whether a window around the word occurs twice in its text (or seems to, by a hash)."""
    at, own = whole_windows(counts, width)
    text = np.repeat(np.arange(len(own), dtype=np.uint64), own)
    hashes = mixed(rolling(words, width, BASE)[at] + text * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(hashes)
    same = hashes[order[1:]] == hashes[order[:-1]]
    twice = np.unique(np.concatenate([order[1:][same], order[:-1][same]])) if len(order) else order
    steps = np.zeros(len(words) + 1, np.int64)
    np.add.at(steps, at[twice], 1)
    np.add.at(steps, at[twice] + width, -1)
    return np.cumsum(steps[:-1]) > 0


def text_runs(words: list[bytes], covered: np.ndarray, least: int = LEAST, times: int = TIMES) -> list[Interval]:
    """The runs of one text, as (start, end, period); ``covered`` marks the words that may lie in one."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], covered.astype(np.int8), [0]])))
    spans = [(a, b) for a, b in zip(edges[::2].tolist(), edges[1::2].tolist()) if b - a >= least]
    if not spans:
        return []
    ids: dict[bytes, int] = {}
    stretches = [np.array([ids.setdefault(w, len(ids)) for w in words[a:b]], np.int64) for a, b in spans]
    firsts = np.cumsum([0, *[b - a + 1 for a, b in spans]])
    shift = [a - f for (a, _), f in zip(spans, firsts.tolist())]
    of = lambda s: int(np.searchsorted(firsts, s, side="right")) - 1
    return sorted((s + shift[of(s)], e + shift[of(s)], q) for s, e, q in runs_of(stretches, least, times))


def without_repeats(words: list[bytes], runs: list[Interval]) -> list[bytes]:
    """The words that no run holds after its first period."""
    gone = np.zeros(len(words) + 1, np.int64)
    for s, e, q in runs:
        gone[s + q] += 1
        gone[e] -= 1
    dropped = np.cumsum(gone[:-1]) > 0
    return [w for w, d in zip(words, dropped.tolist()) if not d]


def _find(least: int, times: int) -> Callable:
    width = window_width(least, times)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in batches_of(batches, "text", TEXT_BYTES_AT_ONCE):
            texts = texts_of(table.column("text"))
            data, starts, ends, counts = word_edges(texts)
            covered = _covered(counts, word_hashes(data, starts, ends), width)
            edge = np.concatenate([[0], np.cumsum(counts)]).tolist()
            seen = np.concatenate([[0], np.cumsum(covered)])[edge]
            runs, kept = [], []
            for i, text in enumerate(texts):
                words = text.encode().split()
                found: list[Interval] = []
                if seen[i + 1] > seen[i]:
                    found = text_runs(words, covered[edge[i] : edge[i + 1]], least, times)
                    words = without_repeats(words, found) if found else words
                runs.append([{"start": s, "length": e - s, "period": q} for s, e, q in found])
                kept.append(b" ".join(words).decode())
            made = [pa.array(counts.astype(np.int64)), pa.array(runs, RUN_TYPE), pa.array(kept, pa.string())]
            out = pa.table([*table.drop_columns(["text"]).columns, *made], [*table.drop_columns(["text"]).column_names, "n_words", "runs", "collapsed"])
            yield from out.to_batches()

    return run


def find_runs(docs: DataFrame, keys: list[str], least: int = LEAST, times: int = TIMES) -> DataFrame:
    """One row for each row of ``docs``: ``keys``, n_words, ``runs`` (start, length, period, by start and period), collapsed.

    Words are what lies between ASCII white space, numbered from 0. ``collapsed`` is the text's words joined by one space, without
    those that lie in a run after its first period. A null or empty text has no words and no runs; equal rows are answered
    alike; texts of any length are taken whole. Other columns, and keys that are null, are not looked at.
    ``times`` is 3 at least.
    """
    if times < 3:
        raise ValueError("runs of fewer than three periods are not found")
    rows = docs.select(*keys, as_text(F.col("text").cast("string")).alias("text"))
    if "text" in keys:
        raise ValueError("the text cannot be a key")
    made = T._parse_datatype_string(f"n_words long, runs {RUNS}, collapsed string")
    return rows.mapInArrow(_find(least, times), T.StructType([*rows.drop("text").schema.fields, *made.fields]))


def looped(text: Column, digest: Column) -> Column:
    """Texts whose ``digest`` is divisible by 10 with their end made to repeat, as words joined by a space; others as they are.

    With g = digest / 10 and n words, the words from a = g % n on repeat with period 1 + (n - a) / (3 + g % 8).
    """
    g = F.floor(digest / 10)
    divided = lambda x, y: F.floor(x / y).cast("long")

    def one(words: Column) -> Column:
        n = F.size(words).cast("long")
        a = g % n
        p = 1 + divided(n - a, 3 + g % 8)
        at = lambda i: F.when(i >= a, a + (i - a) % p).otherwise(i)
        return F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.get(words, at(i).cast("int"))), " ")

    # In an array of one, the words are computed once.
    made = F.transform(F.array(F.regexp_extract_all(text, F.lit(f"({WORD})"), 1)), one)[0]
    return F.when((digest % 10 == 0) & F.regexp_like(text, F.lit(WORD)), made).otherwise(text)


def greatest_run(runs: str) -> Column:
    """The run of the greatest length / period, compared without rounding; of equal ones the first; null if there is none."""
    more = lambda best, x: x["length"] * best["period"] > best["length"] * x["period"]
    none = F.lit(None).cast(RUNS.removeprefix("array<").removesuffix(">"))
    return F.aggregate(runs, none, lambda best, x: F.when(best.isNull() | more(best, x), x).otherwise(best))
