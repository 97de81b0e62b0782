import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm.conftest import prose
from tickloom.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    words = WORD.findall(text)
    grams = Counter(zip(words, words[1:], words[2:]))
    covered = [any(0 <= i - k and i - k + 2 < len(words) and grams[tuple(words[i - k : i - k + 3])] > 1 for k in range(3)) for i in range(len(words))]
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, sum(covered)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab \n\t#| é\x85", max_size=60))
def test_counts(text):
    assert quality.text_counts(text)[:5] == brute(text)


def test_chi_square():
    assert quality.chi_square_quantile(0.95, 4) == pytest.approx(9.4877, abs=1e-3)
    assert quality.chi_square_quantile(0.975, 2) == pytest.approx(7.3778, abs=1e-3)


@pytest.fixture
def corpus(documents):
    rng = np.random.default_rng(1)
    rows = []
    for i in range(240):
        words = prose(i, int(rng.integers(60, 200))).split()
        lines = [" ".join(words[k : k + 12]) for k in range(0, len(words), 12)]
        rows.append((i, "\n".join(lines), "en" if i % 3 else "de", f"s{i % 2}"))
    for i in range(240, 260):  # junk: symbols between the words
        rows.append((i, prose(i, 100).replace(" ", " ### $$$ "), "en", "s0"))
    rows.append((260, " ".join(["spam egg ham"] * 40), "en", "s1"))
    rows.append((261, "too short", "en", "s1"))
    return documents(rows)


def test_outliers_go_and_clean_documents_stay(corpus):
    got = {r.doc_id: r for r in quality.judge(corpus, ["doc_id"]).collect()}
    assert all(got[i].kept for i in range(240))
    assert not any(got[i].kept for i in range(240, 262))
    assert got[260].base_failed and got[261].base_failed and not got[245].base_failed
    kept = quality.judge(corpus, corpus.columns, only_kept=True)
    assert kept.columns == corpus.columns and {r.doc_id for r in kept.collect()} == set(range(240))


def test_estimate_against_concentration_steps(corpus):
    """A group's verdict distance follows the plain estimate of its concentrated part, up to pooling."""
    got = [r for r in quality.judge(corpus, ["doc_id"]).collect() if not r.base_failed]
    clean = [r.distance for r in got if r.doc_id < 240]
    junk = [r.distance for r in got if 240 <= r.doc_id < 260]
    assert max(clean) < 5 < 10 < min(junk)


def test_reruns_agree(corpus):
    first = quality.judge(corpus, ["doc_id"]).orderBy("doc_id").collect()
    assert first == quality.judge(corpus.repartition(7), ["doc_id"]).orderBy("doc_id").collect()


def test_odd_rows_and_empty_table(documents, odd_documents):
    got = quality.judge(odd_documents, ["doc_id", "kept"]).toDF("doc_id", "given", *quality.COUNTS, "base_failed", "distance", "kept").collect()
    assert len(got) == odd_documents.count()
    assert {(r.doc_id, r.kept) for r in got} == {(1, True), (2, False), (3, False), (4, got[[g.doc_id for g in got].index(4)].kept), (5, True), (None, True), (7, False), (8, False)}
    assert quality.judge(odd_documents, odd_documents.columns, only_kept=True).columns == odd_documents.columns
    assert quality.judge(documents([]), ["doc_id"]).count() == 0


def test_each_statistic_rejects_alone(corpus, documents):
    """Ordinary in all but one statistic; short clean texts with a repeated line or passage stay."""
    rng = np.random.default_rng(2)
    small = prose(900, 30).split()
    passage = prose(901, 40)
    short = prose(902, 60).split()
    lines = [" ".join(short[k : k + 12]) for k in range(0, 60, 12)]
    rows = [
        (900, " ".join(w * 3 for w in prose(903, 120).split()), "en", "s0"),
        (901, prose(904, 120).replace(" ", " # "), "en", "s0"),
        (902, "\n".join(small[i] for i in rng.integers(0, 30, 150)), "en", "s0"),
        (903, " ".join([prose(905, 60), passage, prose(906, 40), passage]), "en", "s0"),
        (910, "\n".join([*lines, lines[0]]), "en", "s0"),
        (911, " ".join([*short, *short[:6]]), "en", "s0"),
    ]
    got = {r.doc_id: r for r in quality.judge(corpus.filter("doc_id < 240").unionByName(documents(rows)), ["doc_id"]).collect()}
    assert not any(r.base_failed for r in got.values())
    assert got[902].n_dup_lines > 100 and got[902].n_repeat_words < 40 and got[903].n_dup_lines == 0
    assert {i for i, r in got.items() if not r.kept} == {900, 901, 902, 903}
