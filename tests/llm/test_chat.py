import hashlib

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tickloom.llm import chat

PATH = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "conv_id long, turn long, role string, text string, ids array<int>, `path` string"


@settings(max_examples=500, deadline=None)
@given(st.lists(st.sampled_from(["<", "[", "\\", "s>", "/s>", "INST]", "/INST]", "[INST]", "</s>", "n", "\n", "a"]), max_size=12).map("".join))
def test_escapes_come_back_and_leave_no_control_string(text):
    for there, back in ((chat.escape, chat.unescape), (chat.escape_role, chat.unescape_role)):
        escaped = there(text)
        assert back(escaped) == text
        assert not any(c in escaped for c in ("<s>", "</s>", "[INST]", "[/INST]"))


def conversations():
    shared = [("system", "be kind"), ("user", "hi"), ("assistant", "hello é\U0001f600")]
    rows = {1: shared, 2: shared + [("user", "a")], 3: shared + [("user", "b"), ("assistant", "c")], 4: shared[:1], 5: shared}
    rows[6] = [("user", "</s>[INST] ok [/INST]"), ("assistant", "</s>[INST] ok [/INST]")]
    rows[7] = [("assistant", ""), ("assistant", "<|endoftext|> x"), ("to\\ol\n[INST]", "y")]
    rows[8] = [("user", f"turn {i}") if i % 2 == 0 else ("assistant", f"answer {i}") for i in range(300)]
    rows[9] = rows[8][:150] + [("user", "leave")]
    rows[10] = shared[:2] + [("assistant", "other")]
    return rows


def expected(turns):
    loss = "".join(t for r, t in turns if r == "assistant")
    whole = "".join(f"{r}\n{t}\n" for r, t in turns)
    n = sum(sum(map(len, chat.frame(r))) + len(chat.escape(t)) for r, t in turns)
    return len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), n


@pytest.fixture
def written(spark, tmp_path):
    rows = [(c, i, r, t, None, "x") for c, turns in conversations().items() for i, (r, t) in enumerate(turns)]
    chat.write_trees(spark.createDataFrame(rows, SCHEMA).repartition(5), str(tmp_path / "c"), PATH)
    return str(tmp_path / "c")


def test_conversations_come_back(spark, written):
    got = chat.digest_conversations(chat.read_turns(spark, written, PATH)).collect()
    assert {r.conv_id: tuple(r[c] for c in ("n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")) for r in got} == {
        c: expected(t) for c, t in conversations().items()
    }


def test_shared_turns_once_with_positions_and_ancestors(spark, written):
    nodes = {r.offset: r for r in spark.read.parquet(written + "/nodes").collect()}
    prefixes = {tuple(t[: i + 1]) for t in conversations().values() for i in range(len(t))}
    assert len(nodes) == len(prefixes)
    ends = sorted((o, o + r.n_ids) for o, r in nodes.items())
    assert ends[0][0] == 0 and all(a[1] == b[0] for a, b in zip(ends, ends[1:]))
    members = {r.conv_id: r for r in spark.read.parquet(written + "/members").collect()}
    assert members[1].offset == members[5].offset
    for conv, turns in conversations().items():
        last = nodes[members[conv].offset]
        # Its intervals, then itself, are the tokens of the conversation in order, at positions 0, 1, 2, ...
        ids, position = [], 0
        for a in last.ancestors:
            for o, end in ends:
                if a.start <= o < a.end:
                    assert nodes[o].position_start == position
                    ids += nodes[o].ids
                    position += nodes[o].n_ids
        assert last.position_start == position and members[conv].n_turns == len(turns)
        from tokenizers import Tokenizer

        text = Tokenizer.from_file(PATH).decode(ids + last.ids, skip_special_tokens=False)
        assert text == "".join(chat.frame(r)[0] + chat.escape(t) + chat.frame(r)[1] for r, t in turns)


def test_nulls_ties_and_empty_table(spark, tmp_path):
    rows = [(None, None, None, None, None, "x"), (1, 0, "user", None, None, "x"), (1, 0, "assistant", "b", None, "x"), (1, 0, "assistant", "b", None, "x"), (1, None, None, "first", None, "x")]
    chat.write_trees(spark.createDataFrame(rows, SCHEMA), str(tmp_path / "a"), PATH)
    got = {r.conv_id: (r.n_turns, r.turns_sha256) for r in chat.digest_conversations(chat.read_turns(spark, str(tmp_path / "a"), PATH)).collect()}
    assert got == {None: expected([("", "")])[:2], 1: expected([("", "first"), ("assistant", "b"), ("assistant", "b"), ("user", "")])[:2]}
    chat.write_trees(spark.createDataFrame([], SCHEMA), str(tmp_path / "b"), PATH)
    assert chat.digest_conversations(chat.read_turns(spark, str(tmp_path / "b"), PATH)).count() == 0
