"""Token ids of whole texts by a public tokenizer file, with a bounded cache of what recurs.

Byte-pair encoders cut a text before they merge. A space before a character that is no white
space always starts a new cut in the tokenizers used here, and so does a line break there, which is a cut of its own,
and an ASCII character other than a letter or an apostrophe starts one after a Latin letter. So a text is encoded as the
pieces between these places. Texts that contain a special token's opening ``<|`` are encoded whole. Tests hold the ids to
those of whole texts.

The places are found by vector operations on the bytes of many texts at once, and Arrow tells the different pieces of them
apart. Each of these is looked up in a cache once; what was not seen yet goes through the tokenizer in one batch.

A piece of Latin letters is one word to these tokenizers, so it goes to the library's merge model at once; splitting and
normalising it there costs several times the merges. Other pieces, and other tokenizers, take the library's whole way.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
from array import array
from collections.abc import Callable
from itertools import compress, pairwise

import numpy as np
import pyarrow as pa

from tickloom.llm.common import worker_store

# Most pieces that a worker remembers (some 200 bytes each); the cache starts anew beyond it.
CACHED_PIECES = 800_000
# Latin letters, without the one whose small form is a letter and a mark.
LETTERS = r"A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f"
WORD_PIECE = re.compile(rf" ?[{LETTERS}]+")
SPECIAL = b"<|"
# Stands between texts: a byte that UTF-8 does not have.
TEXT_BREAK = b"\xff"
# Fixed value: the pattern of one tokenizer that lowers and drops white space; the other kind is the library's own default.
LOWERED_WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
LOWERING = [
    {"type": "NFC"},
    {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "},
    {"type": "Lowercase"},
]


def _byte_names() -> dict[int, str]:
    """The character that byte-level models have for each byte: printable bytes stand for themselves, others follow from 256 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = (b for b in range(256) if b not in printable)
    return {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(others)}


def _word_form(settings: dict) -> Callable[[str], str] | None:
    """How a tokenizer hands a piece of letters to its model, if it is of a kind known here."""
    names = _byte_names()
    space = names[32]

    def as_bytes(word: str) -> str:
        # ASCII letters stand for themselves.
        return word.replace(" ", space) if word.isascii() else word.encode().decode("latin-1").translate(names)

    normalizer, splitter = settings.get("normalizer"), settings.get("pre_tokenizer") or {}
    if settings["model"].get("type") != "BPE":
        return None
    if normalizer is None and splitter.get("type") == "ByteLevel" and splitter["use_regex"] and not splitter["add_prefix_space"]:
        return as_bytes
    parts = splitter.get("pretokenizers") or [{}]
    lowers = normalizer is not None and normalizer.get("normalizers") == LOWERING
    by_words = parts[0].get("pattern") == {"Regex": LOWERED_WORDS} and parts[0]["behavior"] == "Removed" and parts[0]["invert"]
    if lowers and by_words and [p["type"] for p in parts[1:]] == ["ByteLevel"] and not (parts[1]["use_regex"] or parts[1]["add_prefix_space"]):
        return lambda text: as_bytes(unicodedata.normalize("NFC", text.strip(" ")).lower())
    return None


def _loaded(path: str):
    held = worker_store("tokenizers")
    if path not in held:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        held[path] = (tokenizer, {}, _word_form(json.loads(tokenizer.to_str())), tokenizer.model)
    return held[path]


def _ids(tokenizer, texts: list[str]) -> list[bytes]:
    return [array("I", e.ids).tobytes() for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]


def _is_word(piece: bytes) -> bool:
    return piece[piece[:1] == b" " :].isalpha() or not piece.isascii() and WORD_PIECE.fullmatch(piece.decode()) is not None


def _coded(path: str, pieces: list[bytes]) -> dict[bytes, bytes]:
    """The ids of each piece, by the merge model if it is a word."""
    tokenizer, _, form, model = _loaded(path)
    words = [p for p in pieces if _is_word(p)] if form else []
    ids, ends, tokenize = [], [0], model.tokenize
    for word in words:
        ids += [t.id for t in tokenize(form(word.decode()))]
        ends.append(4 * len(ids))
    flat = array("I", ids).tobytes()
    coded = dict(zip(words, [flat[a:b] for a, b in pairwise(ends)]))
    others = [p for p in pieces if p not in coded]
    coded.update(zip(others, _ids(tokenizer, [p.decode() for p in others])))
    return coded


# Kinds of bytes, as bits. A byte that starts a character is visible if the character is no white space for certain.
VISIBLE, MAYBE_SPACE, ASCII_LETTER, SIGN, LATIN_START = 1, 2, 4, 8, 16


def _kind(byte: int) -> int:
    if byte < 0x80:
        visible = VISIBLE if 33 <= byte < 127 else 0
        return visible | (ASCII_LETTER if chr(byte).isalpha() else 0 if byte == ord("'") else SIGN)
    kind = LATIN_START if 0xC3 <= byte <= 0xC9 else 0
    if byte in (0xC2, 0xE1, 0xE2, 0xE3):
        return kind | MAYBE_SPACE
    return kind | (VISIBLE if 0xC3 <= byte <= 0xF4 else 0)


KINDS = bytes(map(_kind, range(256)))
WIDE_SPACES = np.array(
    [int.from_bytes(chr(c).encode().ljust(3, b"\0")) for c in (0x85, 0xA0, 0x1680, 0x180E, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)]
)


def _after_letter(data: np.ndarray, kinds: np.ndarray) -> np.ndarray:
    """Whether the character before each byte is a Latin letter (one of ``LETTERS``)."""
    after = np.zeros(len(data), bool)
    after[1:] = kinds[:-1] & ASCII_LETTER
    at = np.flatnonzero(kinds & LATIN_START)
    first, second = data[at], data[at + 1]
    other = (first == 0xC3) & ((second == 0x97) | (second == 0xB7)) | (first == 0xC4) & (second == 0xB0) | (first == 0xC9) & (second > 0x8F)
    after[at[~other] + 2] = True
    return after


def _visible(data: np.ndarray, kinds: np.ndarray) -> np.ndarray:
    """Whether a character that is no white space starts at each byte."""
    visible = (kinds & VISIBLE).astype(bool)
    at = np.flatnonzero(kinds & MAYBE_SPACE)
    first, second, third = (data[at + i].astype(np.int64) for i in range(3))
    visible[at] = ~np.isin(first << 16 | second << 8 | np.where(first == 0xC2, 0, third), WIDE_SPACES)
    return visible


def _piece_starts(joined: bytes) -> np.ndarray:
    """Whether a piece starts at each byte of texts that have a ``TEXT_BREAK`` before and after them."""
    data, kinds = np.frombuffer(joined, np.uint8), np.frombuffer(joined.translate(KINDS), np.uint8)
    visible, after = _visible(data, kinds), _after_letter(data, kinds)
    starts = (kinds & SIGN).astype(bool) & after
    starts[:-1] |= (data[:-1] == ord(" ")) & visible[1:]
    line = np.flatnonzero((data[:-1] == ord("\n")) & visible[1:])
    starts[line] = starts[line + 1] = True
    return starts


def encode_joined(texts: list[str], path: str, end: tuple[int, ...] = ()) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all texts, each followed by ``end``, in one array, and where each text's ids end in it (a 0 first)."""
    known = _loaded(path)[1]
    if len(known) > CACHED_PIECES:
        known.clear()
    coded = [t.encode() for t in texts]
    joined = TEXT_BREAK.join([b"", *coded, b""])
    breaks = np.concatenate([[0], np.cumsum([len(c) + 1 for c in coded], dtype=np.int64)])
    starts = _piece_starts(joined)
    if SPECIAL in joined:
        for i, c in enumerate(coded):
            if SPECIAL in c:
                starts[breaks[i] + 1 : breaks[i + 1]] = False
    starts[breaks] = starts[breaks[:-1] + 1] = True
    edges = np.append(np.flatnonzero(starts), len(joined))
    pieces = pa.Array.from_buffers(pa.large_binary(), len(edges) - 1, [None, pa.py_buffer(edges), pa.py_buffer(joined)]).dictionary_encode()

    # The first piece is a text break, which stands for ``end``.
    keys = pieces.dictionary.to_numpy(zero_copy_only=False).tolist()
    ids = [array("I", end).tobytes(), *map(known.get, keys[1:])]
    missing = [i for i, c in enumerate(ids) if c is None]
    new = _coded(path, [keys[i] for i in missing])
    for i in missing:
        ids[i] = new[keys[i]]
    known.update(new if SPECIAL not in joined else {p: c for p, c in new.items() if SPECIAL not in p})
    sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
    places = pieces.indices.to_numpy()[1:]
    size = sizes[places]
    ends = np.cumsum(size)
    from_place = np.repeat((np.cumsum(sizes) - sizes)[places] - (ends - size), size)
    flat = np.frombuffer(b"".join(ids), "<u4")[from_place + np.arange(len(from_place))]
    return flat, np.concatenate([[0], ends[places == 0]])


def encode_texts(texts: list[str], path: str) -> list[bytes]:
    """The ids of each text as little-endian unsigned 32-bit integers."""
    flat, ends = encode_joined(texts, path)
    raw = flat.tobytes()
    return [raw[4 * a : 4 * b] for a, b in pairwise(ends.tolist())]
