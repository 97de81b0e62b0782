import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tests.llm.conftest import prose
from tickloom.llm import encode, token_files
from tickloom.llm.encode import encode_texts

FILES = ["byte_bpe_50k.json", "word_bpe_49k.json"]
PATHS = {f: public_tokenizers.path(f) for f in FILES}
TOKENIZERS = {f: Tokenizer.from_file(p) for f, p in PATHS.items()}
TRICKY = [
    "", " ", "a ", " a", "a  b", "a   b\n\n c", "it's he'll. O'Neill's'", "x\x1cy \x85z w", "<|endoftext|> a<|endoftext|>b", "1.5e3, (ok)!?",
    "é ́x", "ΑΣ ΑΣ.", "don't\n'tis", "a\tb\r\nc", "한국어 中文。 x", "A1b2 C3", "!!! ... ---\n", "ǅx İ",
]


@pytest.mark.parametrize("name", FILES)
def test_pieces_make_the_ids_of_whole_texts(name):
    texts = TRICKY + [prose(s, 50) for s in range(5)]
    want = [e.ids for e in TOKENIZERS[name].encode_batch(texts, add_special_tokens=False)]
    for _ in range(2):  # the second time from the cache
        assert [np.frombuffer(b, "<u4").tolist() for b in encode_texts(texts, PATHS[name])] == want


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(" \n\t \x1c'.,áésB1<|>"), st.characters(exclude_categories=["Cs"])), max_size=40))
def test_pieces_hold_for_any_text(text):
    for name in FILES:
        want = TOKENIZERS[name].encode(text, add_special_tokens=False).ids
        assert np.frombuffer(encode_texts([text], PATHS[name])[0], "<u4").tolist() == want


@pytest.mark.parametrize("name", FILES)
def test_words_of_latin_letters_hold(name):
    """They go to the merge model alone: each letter in, before and after others, in both cases, with and without signs."""
    letters = [chr(c) for c in range(0x41, 0x250) if chr(c).isalpha()] + ["\u0130", "\u0301", "\u1e9e", "\u017f"]
    texts = [f"{c} {c}a x{c} {c}{c} the{c}n, {c.upper()}{c.lower()}. O{c}!{c}'s" for c in letters]
    texts += [" ".join(f"{a}{b}ing{a}" for b in letters[::7]) for a in letters[::5]]
    want = [e.ids for e in TOKENIZERS[name].encode_batch(texts, add_special_tokens=False)]
    assert [np.frombuffer(b, "<u4").tolist() for b in encode_texts(texts, PATHS[name])] == want


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from(" \n\r\t\x1c\x85\u2028'.,!$`~3aZ\u00e9\u0301\u4e2ds"), max_size=30))
def test_pieces_hold_beside_any_white_space(text):
    for name in FILES:
        want = TOKENIZERS[name].encode(text, add_special_tokens=False).ids
        assert np.frombuffer(encode_texts([text], PATHS[name])[0], "<u4").tolist() == want


@pytest.mark.parametrize("name", FILES)
def test_signs_and_line_breaks_make_no_further_pieces(name):
    """A word is remembered once, whatever follows it, and once more for where no space is before it."""
    words = sorted({w.rstrip("0123456789") + c for w in prose(3, 200).split() for c in "xyz"})
    text = " ".join(f"{w} {w}, {w}. {w}; {w}$$$ {w}\n{w}" for w in words)
    known = encode._loaded(PATHS[name])[1]
    known.clear()
    assert np.frombuffer(encode_texts([text], PATHS[name])[0], "<u4").tolist() == TOKENIZERS[name].encode(text, add_special_tokens=False).ids
    assert len(known) <= 2 * len(words) + 6


class _Counted(dict):
    asked = 0

    def get(self, *args):
        self.asked += 1
        return super().get(*args)


@pytest.mark.parametrize("name", FILES)
def test_a_batch_looks_each_different_piece_up_once(name, monkeypatch):
    texts = [prose(s % 3, 300) for s in range(60)]
    loaded, known = list(encode._loaded(PATHS[name])), _Counted()
    loaded[1] = known
    monkeypatch.setitem(encode.worker_store("tokenizers"), PATHS[name], tuple(loaded))
    want = [e.ids for e in TOKENIZERS[name].encode_batch(texts, add_special_tokens=False)]
    assert [np.frombuffer(b, "<u4").tolist() for b in encode_texts(texts, PATHS[name])] == want
    assert 0 < known.asked <= len(known) + 1


@pytest.mark.parametrize("name", FILES)
def test_doubled_white_space_makes_no_further_pieces(name):
    words = sorted({w.rstrip("0123456789") + c for w in prose(3, 200).split() for c in "xyz"})
    text = "  ".join(f"{w} \n{w}\n\n{w}.\n\n{w}\t{w}" for w in words)
    known = encode._loaded(PATHS[name])[1]
    known.clear()
    assert np.frombuffer(encode_texts([text], PATHS[name])[0], "<u4").tolist() == TOKENIZERS[name].encode(text, add_special_tokens=False).ids
    assert len(known) <= 3 * len(words) + 6


SPACES = [chr(c) for c in range(0x3001) if chr(c).isspace()] + ["\u180e", "\u200b", "\ufeff"]


@settings(max_examples=300, deadline=None)
@given(
    st.lists(
        st.text(alphabet=st.one_of(st.sampled_from([*SPACES, *" \n<|'.,aZ1\u00e9\u00d7\u0130\u024f\u0250\u0301\u2014\u3002"]), st.characters(exclude_categories=["Cs"])), max_size=12),
        max_size=8,
    )
)
def test_texts_of_a_batch_do_not_touch(texts):
    for name in FILES:
        want = [e.ids + [2] for e in TOKENIZERS[name].encode_batch(texts, add_special_tokens=False)]
        flat, ends = encode.encode_joined(texts, PATHS[name], (2,))
        assert [flat[a:b].tolist() for a, b in zip(ends[:-1], ends[1:])] == want and ends[0] == 0 and ends[-1] == len(flat)


@pytest.mark.parametrize("name", FILES)
def test_every_white_space_beside_line_breaks_and_spaces(name):
    texts = [f"{a}{s}{b}" for s in SPACES for a in ("", "x", ". ", "\n", " ", "é\n") for b in ("", "x", " y", "\ny", "'s")]
    want = [e.ids for e in TOKENIZERS[name].encode_batch(texts, add_special_tokens=False)]
    assert [np.frombuffer(b, "<u4").tolist() for b in encode_texts(texts, PATHS[name])] == want


def _expected(rows):
    start, out = 0, []
    for doc, text in rows:
        ids = TOKENIZERS[FILES[0]].encode(text or "", add_special_tokens=False).ids + [2]
        out.append((doc, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_round_trip_in_document_order(spark, documents, tmp_path):
    rows = [(i * 3 % 41, prose(i, i % 7 * 10)) for i in range(40)]
    token_files.write_tokens(documents(rows), str(tmp_path / "t"), PATHS[FILES[0]], 2, parts=5)
    got = token_files.digest_tokens(token_files.read_tokens(spark, str(tmp_path / "t"))).collect()
    assert sorted(map(tuple, got)) == _expected(sorted(rows))


def test_odd_rows(spark, odd_documents, tmp_path):
    token_files.write_tokens(odd_documents, str(tmp_path / "t"), PATHS[FILES[0]], 2)
    got = token_files.digest_tokens(token_files.read_tokens(spark, str(tmp_path / "t"))).collect()
    rows = [(r.doc_id, r.text) for r in odd_documents.collect()]
    rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    assert sorted(map(tuple, got), key=lambda r: r[1]) == _expected(rows)


def test_pruned_read_keeps_starts(spark, documents, tmp_path):
    rows = [(i, prose(i, 20)) for i in range(60)]
    path = str(tmp_path / "t")
    token_files.write_tokens(documents(rows), path, PATHS[FILES[0]], 2, parts=3)
    some = token_files.read_tokens(spark, path, [7, 33])
    plan = some._jdf.queryExecution().toString()
    assert "PushedFilters: [In(doc_id" in plan or "In(doc_id" in plan
    want = {r[0]: r[1] for r in _expected(rows)}
    assert {r.doc_id: r.start for r in some.collect()} == {7: want[7], 33: want[33]}


def test_files_have_indexes_and_bloom_filters(spark, documents, tmp_path):
    from pyarrow import orc

    path = tmp_path / "t"
    token_files.write_tokens(documents([(i, prose(i, 5)) for i in range(3000)]), str(path), PATHS[FILES[0]], 2, parts=1)
    file = next(f for f in path.iterdir() if f.suffix == ".orc" and f.stat().st_size > 1000)
    reader = orc.ORCFile(str(file))
    assert reader.row_index_stride == token_files.ROWS_PER_INDEX_ENTRY and reader.nstripes >= 1
    assert reader.stripe_statistics_length > 0


def test_empty_table(spark, documents, tmp_path):
    token_files.write_tokens(documents([]), str(tmp_path / "t"), PATHS[FILES[0]], 2)
    assert token_files.read_tokens(spark, str(tmp_path / "t")).count() == 0
