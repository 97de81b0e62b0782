import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm.conftest import prose
from tickloom.llm import substrings
from tickloom.llm.common import stage_table


def brute(rows, width):
    seen, out = set(), {}
    for doc, text in rows:
        words = (text or "").encode().split()
        gone = [False] * len(words)
        for i in range(len(words) - width + 1):
            window = tuple(words[i : i + width])
            if window in seen:
                gone[i : i + width] = [True] * width
            seen.add(window)
        kept = b" ".join(w for w, g in zip(words, gone) if not g)
        out.setdefault(doc, []).append((len(words), sum(gone), hashlib.sha256(kept).hexdigest()))
    return out


def corpus():
    shared, other = prose(900, 60), prose(901, 25)
    rows = [(i, prose(i, 40) + f"\n{shared}\n" + prose(i + 100, 30)) for i in range(12)]
    rows += [(20, shared), (21, shared + " " + shared), (22, other + " x " + other), (23, prose(23, 500)), (24, prose(23, 500)), (25, None), (26, ""), (27, "one two")]
    rows += [(i, "la " * (i % 50)) for i in range(30, 60)]
    return rows


@pytest.mark.parametrize("chunk", [200, 1 << 22])
def test_against_brute_force(documents, monkeypatch, chunk):
    monkeypatch.setattr(substrings, "CHUNK_BYTES", chunk)
    rows = corpus()
    docs = stage_table(documents(rows).repartition(5), "docs")
    got = {r.doc_id: [(r.n_words, r.n_removed, r.kept_sha256)] for r in substrings.digest_kept(docs).collect()}
    assert got == brute(sorted(rows), substrings.WINDOW)


def test_texts_and_columns(documents):
    rows = corpus()
    docs = documents(rows)
    out = substrings.remove_repeats(docs)
    assert out.columns == docs.columns
    want, given_ = brute(sorted(rows), substrings.WINDOW), dict(rows)
    for r in out.collect():
        n, removed, sha = want[r.doc_id][0]
        assert hashlib.sha256(b" ".join((r.text or "").encode().split())).hexdigest() == sha
        assert r.text == given_[r.doc_id] if not removed else r.n_chars == len(r.text)


@pytest.mark.parametrize("buckets", [1, 7, 500])
def test_the_number_of_buckets_does_not_matter(documents, monkeypatch, buckets):
    monkeypatch.setattr(substrings, "CHUNK_BYTES", 900)
    monkeypatch.setattr(substrings, "bucket_count", lambda docs: buckets)
    rows = corpus()
    docs = stage_table(documents(rows).repartition(5), "docs")
    got = {r.doc_id: [(r.n_words, r.n_removed, r.kept_sha256)] for r in substrings.digest_kept(docs).collect()}
    assert got == brute(sorted(rows), substrings.WINDOW)


def test_buckets_grow_with_the_text(documents, monkeypatch):
    docs = documents(corpus())
    least = substrings.bucket_count(docs)
    monkeypatch.setattr(substrings, "BUCKET_BYTES", 100)
    size = sum(len((text or "").encode()) for _, text in corpus())
    assert substrings.bucket_count(docs) == -(-size // 100) > least
    assert substrings.bucket_count(docs.limit(0)) == least



@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab é\n\t", max_size=40), st.data())
def test_cut_words(text, data):
    n = len(text.encode().split())
    ends = sorted(data.draw(st.sets(st.integers(0, n), max_size=6)))
    spans = ends[: len(ends) // 2 * 2]
    gone = {i for a, b in zip(spans[::2], spans[1::2]) for i in range(a, b)}
    kept = [w for i, w in enumerate(text.encode().split()) if i not in gone]
    assert substrings.cut_words(text, spans).encode().split() == kept


def test_odd_rows_and_empty_table(documents, odd_documents):
    out = substrings.remove_repeats(odd_documents)
    assert out.columns == odd_documents.columns and out.count() == odd_documents.count()
    got = substrings.digest_kept(odd_documents).collect()
    removed = sorted((r.doc_id, r.n_removed) for r in got if r.doc_id in (1, 5))
    assert removed == [(1, 0), (5, 80), (5, 80)]
    assert substrings.digest_kept(documents([])).count() == 0
