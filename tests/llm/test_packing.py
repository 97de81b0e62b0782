import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from tests.llm.conftest import prose
from tickloom.llm import packing
from tickloom.llm.common import stage_table

PATH = public_tokenizers.path("word_bpe_49k.json")




def test_rule_against_its_definition():
    rng = np.random.default_rng(3)
    for window in (8, 17, 50):
        lengths = rng.integers(1, window, 150).tolist()
        sequence, offset = packing.place(lengths, window)
        fills = defaultdict(int)
        counts = lambda: sum(v * v for v in np.unique([f for f in fills.values() if 0 < f < window], return_counts=True)[1])
        for s, o, n in zip(sequence.tolist(), offset.tolist(), lengths):
            assert fills[s] == o and o + n <= window
            options = []
            for level in {0, *fills.values()}:
                if level + n <= window and level < window:
                    trial = dict(fills)
                    key = next((k for k, f in trial.items() if f == level), "new") if level else "new"
                    trial[key] = level + n
                    kinds = np.unique([f for f in trial.values() if 0 < f < window], return_counts=True)[1]
                    options.append(sum(int(v) ** 2 for v in kinds))
            fills[s] += n
            assert counts() == min(options)


def check(rows, window, out):
    tokenizer = Tokenizer.from_file(PATH)
    want = sorted((d is not None, d or 0, tuple(tokenizer.encode(t or "", add_special_tokens=False).ids + [1])) for d, t in rows)
    pieces, used = defaultdict(list), defaultdict(list)
    for r in out:
        pieces[(r.doc_id, r.doc_tokens)].append(r)
        used[r.sequence_id].append((r.offset, r.length))
    assert sum(r.length for r in out) == sum(len(w[2]) for w in want)
    for known, doc, ids in want:
        own = [r for r in pieces[(doc if known else None, len(ids))]]
        for start in range(0, len(ids), window):
            part = np.array(ids[start : start + window], "<u4")
            assert any(r.start == start and r.length == len(part) and r.ids_crc32 == zlib.crc32(part.tobytes()) for r in own)
    for parts in used.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= window


def test_every_id_once_in_gapless_sequences(documents):
    rows = [(i, prose(i, (i * 37) % 200)) for i in range(60)]
    pieces = stage_table(packing.cut_pieces(documents(rows), PATH, 1, window=128), "pieces")
    for per_block in (7, 10_000):
        check(rows, 128, packing.pack(pieces, 128, per_block).collect())


def test_odd_rows_and_empty_table(documents, odd_documents):
    rows = [(r.doc_id, r.text) for r in odd_documents.collect()]
    out = packing.pack(stage_table(packing.cut_pieces(odd_documents, PATH, 1), "pieces")).collect()
    check(rows, packing.WINDOW, out)
    assert packing.pack(packing.cut_pieces(documents([]), PATH, 1)).count() == 0
