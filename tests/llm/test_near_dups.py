import math

import numpy as np

from tests.llm.conftest import prose
from tickloom.llm import near_dups
from tickloom.llm.common import stage_table


def sets_of(rows):
    out = {}
    for doc, text in rows:
        words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
        grams = set(zip(*[words[k:] for k in range(5)])) if len(words) >= 5 else {tuple(words)} if words else set()
        out[doc] = grams
    return out


def brute(rows):
    sets = sets_of(rows)
    top = {d: d for d in sets}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                    x, y = find(a), find(b)
                    top[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d), find(d) == d) for d in sets}


def changed(text, seed, n):
    words = text.split()
    for k in range(n):
        words[(seed * 31 + k * 17) % len(words)] = f"new{seed}x{k}"
    return " ".join(words)


def corpus():
    """Families of copies of all grades, some near the threshold, chains, and short texts."""
    rows = [(i, prose(i, 60)) for i in range(20)]
    base = prose(500, 150)
    rows += [(100 + i, changed(base, i, i % 9)) for i in range(60)]
    chain = prose(600, 120)
    for i in range(12):
        chain = changed(chain, i + 70, 2)
        rows.append((200 + i, chain))
    rows += [(300, "One two"), (301, "one TWO"), (302, "one two three four five"), (303, "x"), (304, None), (305, " \n"), (306, base.upper())]
    return rows


def test_against_brute_force(documents, monkeypatch):
    monkeypatch.setattr(near_dups, "BLOCK", 3)
    rows = corpus()
    docs = stage_table(documents(rows).repartition(3), "docs")
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dups.mark_near_duplicates(docs).collect()}
    assert got == brute(rows)
    left = near_dups.drop_near_duplicates(docs)
    assert left.columns == docs.columns
    assert {r.doc_id for r in left.collect()} == {d for d, r in got.items() if r[2]}


def test_links_between_components_are_found_without_first_pairs(documents, monkeypatch):
    """The step between components alone finds every link."""
    monkeypatch.setattr(near_dups, "FIRST_PAIRS", 0)
    rows = corpus()
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dups.mark_near_duplicates(documents(rows)).collect()}
    assert got == brute(rows)


def test_components_of_a_long_chain(spark):
    n = 200
    links = spark.createDataFrame([((i * 37) % n, ((i + 1) * 37) % n) for i in range(n - 1)] + [(900, 901)], "a long, b long")
    labels = {r.node: r.label for r in near_dups.components(links).collect()}
    assert labels == {**{i: 0 for i in range(n)}, 900: 900, 901: 900}


def test_odd_rows_and_empty_table(documents, odd_documents):
    got = near_dups.mark_near_duplicates(odd_documents).collect()
    assert len(got) == odd_documents.count()
    assert sorted((r.doc_id, r.component_id, r.kept) for r in got if r.doc_id in (1, 2, 3, 5, 7)) == [
        (1, 1, True), (2, 2, True), (3, 3, True), (5, 1, False), (5, 1, False), (7, 7, True),
    ]
    assert near_dups.drop_near_duplicates(odd_documents).columns == odd_documents.columns
    assert near_dups.mark_near_duplicates(documents([])).count() == 0


def test_a_band_takes_its_values_from_different_permutations():
    n = 2 * near_dups.PERMUTATIONS
    plain = np.zeros((n + 1, n), np.uint64)
    plain[np.arange(n), np.arange(n)] = 1
    keys = near_dups.band_keys(plain)
    for band in range(near_dups.BANDS):
        columns = np.flatnonzero(keys[:n, band] != keys[n, band])
        assert len(set((columns % near_dups.PERMUTATIONS).tolist())) == len(columns) == near_dups.ROWS


def test_looking_at_signatures_first_loses_less_than_the_bands():
    n, s = 2 * near_dups.PERMUTATIONS, near_dups.LEAST_PERCENT / 100
    lost = sum(math.comb(n, k) * s**k * (1 - s) ** (n - k) for k in range(n + 1) if k / n < near_dups.LEAST_SHARE)
    assert lost < (1 - s**near_dups.ROWS) ** near_dups.BANDS


def test_one_row_of_each_group_stays(documents):
    """Repeated rows of the smallest id and copies without ids are one group; texts without words are in none."""
    a, b, c = prose(1, 100), prose(2, 100), prose(3, 100)
    rows = [(1, a), (1, a), (1, changed(a, 5, 1)), (9, a), (None, b), (None, b), (None, changed(b, 6, 1)), (None, c), (3, ""), (3, ""), (None, None)]
    left = [(r.doc_id, (r.text or "")[-20:]) for r in near_dups.drop_near_duplicates(documents(rows).repartition(3)).collect()]
    assert sorted(d for d, t in left if d is not None) == [1, 3, 3]
    assert sorted(t == c[-20:] for d, t in left if d is None and t) == [False, True]
    assert sum(d is None and not t for d, t in left) == 1
