import random
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import SCHEMA, prose
from tickloom.llm.periodic_runs import (
    Grammar,
    crossing_runs,
    find_runs,
    greatest_run,
    looped,
    merged,
    runs_of,
    window_width,
    without_repeats,
)


def brute(words, least=24, times=3):
    """All runs (start, end, period) by trying every period."""
    n, found = len(words), {}
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            s = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            if i + q - s >= max(least, times * q):
                found.setdefault((s, i + q), q)
    return sorted((s, e, q) for (s, e), q in found.items())


def sequences():
    rng = random.Random(11)
    yield [0] * 100
    yield [0, 1] * 12
    yield [0, 1] * 11 + [0]
    yield list(range(8)) * 3
    yield (list(range(8)) * 3)[:-1]
    yield list(range(40)) * 4 + [99] + list(range(40)) * 3
    yield [0] * 30 + [1] + [0] * 30 + [1] + [0] * 30 + [1]
    yield ([0] * 25 + [1]) * 4
    for _ in range(120):
        words = []
        while len(words) < rng.randrange(30, 400):
            unit = [rng.randrange(rng.choice([1, 2, 3, 30])) for _ in range(rng.randrange(1, 40))]
            words += (unit * rng.randrange(1, 7))[: rng.randrange(1, 200)]
        yield words
    # Fibonacci words have as many runs as a word may have.
    a, b = [0], [0, 1]
    while len(b) < 600:
        a, b = b, b + a
    yield b


@pytest.mark.parametrize("least, times", [(24, 3), (6, 3), (10, 4)])
def test_grammar_runs_equal_brute_force(least, times):
    for words in sequences():
        assert runs_of([np.array(words)], least, times) == brute(words, least, times), words


def test_stretches_share_a_grammar_but_no_run():
    parts = [[0, 1, 2] * 10, [0, 1, 2] * 9, [5], [2, 0, 1] * 8]
    want, first = [], 0
    for p in parts:
        want += [(s + first, e + first, q) for s, e, q in brute(p)]
        first += len(p) + 1
    assert runs_of([np.array(p) for p in parts]) == want


def test_grammar_expands_to_its_words_and_repeats_no_pair():
    rng = np.random.default_rng(4)
    for n, size in ((300, 3), (500, 40), (200, 1), (1, 1), (2, 1)):
        words = rng.integers(0, size, n)
        grammar = Grammar(words)
        edges = [*grammar.starts, n]
        assert edges[0] == 0 and sorted(set(edges)) == edges
        for left, length, places in grammar.rules:
            assert 0 < left < length and len(places) > 1
            assert all(b - a >= length for a, b in zip(places, places[1:]))
            assert len({words[p : p + length].tobytes() for p in places}) == 1
        whole = [words[a:b].tobytes() for a, b in zip(edges, edges[1:])]
        pairs = {}
        for i, pair in enumerate(zip(whole, whole[1:])):
            pairs.setdefault(pair, []).append(i)
        assert all(at[-1] - at[0] < 2 for at in pairs.values())


def test_crossing_runs_are_those_on_both_sides():
    for words in sequences():
        x = np.array(words)
        for m in (1, len(x) // 3, len(x) // 2, len(x) - 1):
            assert sorted(merged(crossing_runs(x, 0, m, len(x)))) == [r for r in brute(words) if r[0] < m < r[1]]


def test_windows_cover_every_run():
    assert window_width() == 16
    for words in sequences():
        covered = np.zeros(len(words), bool)
        seen = {}
        for i in range(len(words) - 15):
            seen.setdefault(tuple(words[i : i + 16]), []).append(i)
        for at in seen.values():
            for i in at if len(at) > 1 else []:
                covered[i : i + 16] = True
        assert all(covered[s:e].all() for s, e, _ in brute(words))


def test_rows(spark, documents):
    texts = [prose(i, 60) for i in range(20)]
    texts += [" ".join(w for i in range(30) for w in ("a", "b\tc")) + " " + prose(3, 40) + " x" * 50]
    texts += [" ".join(str(w) for w in words) for words in sequences()]
    docs = documents([*enumerate(texts), (900, None), (901, ""), (None, " \n "), (902, texts[20]), (902, texts[20])])
    got = find_runs(docs, ["doc_id"]).collect()
    assert len(got) == docs.count()
    for r in got:
        words = (texts[r.doc_id] if r.doc_id in range(900) else texts[20] if r.doc_id == 902 else "").split()
        want = brute(words)
        assert [(x.start, x.start + x.length, x.period) for x in r.runs] == want
        assert r.n_words == len(words)
        gone = {i for s, e, q in want for i in range(s + q, e)}
        assert r.collapsed == " ".join(w for i, w in enumerate(words) if i not in gone)


def test_odd_and_empty_tables(spark, odd_documents):
    rows = find_runs(odd_documents, ["doc_id", "source"]).collect()
    assert len(rows) == odd_documents.count() and not any(r.runs for r in rows)
    assert find_runs(spark.createDataFrame([], SCHEMA), ["doc_id"]).count() == 0


def test_greatest_run(spark):
    kind = "runs array<struct<start: long, length: long, period: long>>"
    cases = [([(0, 30, 10), (9, 60, 20), (40, 31, 10)], 40), ([(3, 30, 10), (5, 24, 8)], 3), ([], None)]
    df = spark.createDataFrame([(runs,) for runs, _ in cases], kind)
    assert [r.s for r in df.select(greatest_run("runs")["start"].alias("s")).collect()] == [want for _, want in cases]


def test_looped_texts(spark):
    rows = [(i, None if i % 9 == 0 else " \t".join(f"w{k}" for k in range(i % 50))) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = df.select("doc_id", looped(F.col("text"), F.crc32(F.col("doc_id").cast("string"))).alias("text")).collect()
    given, changed = dict(rows), 0
    for r in out:
        h, words = zlib.crc32(str(r.doc_id).encode()), (given[r.doc_id] or "").split()
        if h % 10 or not words:
            assert r.text == given[r.doc_id]
            continue
        g, n = h // 10, len(words)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        assert r.text == " ".join(words[a + (i - a) % p] if i >= a else words[i] for i in range(n))
        changed += 1
    assert changed > 10


def test_long_texts_take_time_in_proportion():
    def took(n):
        words = np.array([(i * i) % 1009 for i in range(n // 4)] * 4)
        start = time.perf_counter()
        assert len(runs_of([words])) >= 1
        return time.perf_counter() - start

    took(4_000)
    assert took(40_000) < 25 * max(took(4_000), 0.02)


def test_without_repeats():
    assert without_repeats(list("xabababy"), [(1, 7, 2)]) == list("xaby")
    assert without_repeats([], []) == []
