import hashlib
from collections import defaultdict

import numpy as np
import pytest

from tests.llm.conftest import SCHEMA, prose
from tickloom.llm import exact_dups
from tickloom.llm.common import located
from tickloom.llm.exact_dups import WORDS, _digits, drop_exact_duplicates, mark_exact_duplicates, merge, slices, take

LOWER = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def brute(rows):
    """doc_id, keep_id, group_size, text_sha256 of each row, sorted, and the number of different texts."""
    groups = defaultdict(list)
    for doc, text in rows:
        groups[(text or "").translate(LOWER)].append(doc)
    out = []
    for text, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        sha = hashlib.sha256(text.encode()).hexdigest()
        out += [(i, keep, len(ids), sha) for i in ids]
    return sorted(out, key=repr), len(groups)


def check(df, rows):
    got = df.collect()
    want, n_texts = brute(rows)
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=repr) == want
    assert all(r.doc_id == r.keep_id for r in got if r.kept)
    stays = [r.text_sha256 for r in got if r.kept]
    assert len(stays) == len(set(stays)) == n_texts


def many(n=600):
    """A third of the rows is one text in changing case, others are pairs or alone."""
    rows = []
    for i in range(n):
        text = "Hot TEXT Ä of Many" if i % 3 == 0 else prose(i // 2, 12)
        rows.append((i * 7 % n, text.upper() if i % 2 and i % 3 == 0 and "Ä" not in text else text))
    return rows


@pytest.mark.parametrize("lanes, fanout", [(2, 2), (8, 2), (16, 4), (64, 16), (None, 16)])
def test_every_tree_equals_brute_force(spark, documents, monkeypatch, lanes, fanout):
    monkeypatch.setattr(exact_dups, "CHUNK_BYTES", 900)
    rows = many()
    docs = located(documents(rows).repartition(5))
    check(mark_exact_duplicates(docs, lanes, fanout), rows)


def test_odd_rows(spark, odd_documents):
    rows = [(r.doc_id, r.text) for r in odd_documents.collect()]
    check(mark_exact_duplicates(located(odd_documents)), rows)


def test_only_ascii_letters_are_lowered(spark, documents):
    rows = [(1, "ÄB"), (2, "äb"), (3, "Äb"), (4, "a b"), (5, "A B "), (6, "İ"), (7, "i̇"), (8, None), (9, "")]
    check(mark_exact_duplicates(located(documents(rows))), rows)


def test_null_ids_are_smallest(spark, documents):
    rows = [(None, "x"), (None, "X"), (-(1 << 62), "x"), (None, "y"), (None, "Y")]
    check(mark_exact_duplicates(located(documents(rows))), rows)


def test_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert mark_exact_duplicates(located(empty)).count() == 0
    assert drop_exact_duplicates(empty).count() == 0


def test_drop_keeps_columns_and_one_row_of_equal_ids(spark, odd_documents):
    out = drop_exact_duplicates(odd_documents)
    assert out.columns == odd_documents.columns
    texts = sorted((r.text or "").translate(LOWER) for r in out.collect())
    assert texts == sorted({(r.text or "").translate(LOWER) for r in odd_documents.collect()})


def run_of(words, ids, chunk):
    n = len(words)
    keys = np.zeros((n, WORDS), np.uint64)
    keys[:, 0], keys[:, 1] = [w[0] for w in words], [w[1] for w in words]
    one, zero = np.ones(n, np.int64), np.zeros(n, np.int32)
    home = np.full(n, chunk, np.int64)
    return {"keys": keys, "best": np.array(ids), "home": home, "at": zero, "counts": one, "links": zero + 1, "chunks": home, "entries": np.arange(n, dtype=np.int32)}


def test_equal_first_words_with_unequal_others_stay_apart():
    out = merge([run_of([(5, 1), (5, 2), (9, 0)], [1, 2, 3], 0), run_of([(5, 1), (5, 2), (5, 3)], [4, 1, 8], 1)])
    assert out["keys"][:, :2].tolist() == [[5, 1], [5, 2], [5, 3], [9, 0]]
    assert out["best"].tolist() == [4, 2, 8, 3]
    assert out["counts"].tolist() == [2, 2, 1, 1]
    assert out["links"].tolist() == [2, 2, 1, 1]
    assert sorted(zip(out["chunks"][:2].tolist(), out["entries"][:2].tolist())) == [(0, 0), (1, 0)]


def test_slices_are_whole_and_reach_their_home_lane():
    assert _digits(64, 16) == [(2, 4), (0, 2)] and _digits(8, 2) == [(2, 1), (1, 1), (0, 1)]
    rng = np.random.default_rng(3)
    run = run_of([(int(w), 0) for w in np.sort(rng.integers(0, 1 << 63, 200, dtype=np.uint64) * 2)], list(range(200)), 0)
    at = {11: [run]}
    for digit in _digits(16, 4):
        sent = defaultdict(list)
        for lane, held in at.items():
            for to, part in slices(merge(held), lane, 16, digit):
                sent[to].append(part)
        at = sent
    assert sum(len(r["best"]) for held in at.values() for r in held) == 200
    for lane, held in at.items():
        assert all((k >> np.uint64(60)) == lane for r in held for k in r["keys"][:, 0])
    assert take(run, np.array([3, 1]))["best"].tolist() == [3, 1]
