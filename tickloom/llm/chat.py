"""Conversations as prefix trees: shared first turns are emitted once, depth first.

A node is a turn after given earlier turns. Nodes that follow each other without a branch make a run. The path of a run is
the string of 8-byte hashes of the runs that lead to it, so sorting nodes by path and place in the run is the depth-first
order, whatever the size of a tree; no task ever holds one, and a long conversation costs no more than its turns. Tokens of
all nodes make one stream. Each node has its offset there, the position id of its first token (the tokens of its ancestors)
and the intervals of the stream that its tokens may attend to besides its own: one for each run above it and one for
what comes before it in its run.

Template: ``[INST] role, line feed, text, [/INST]``; an assistant's turn is ``role, line feed, text, </s>``. Control strings
inside roles and texts get a backslash after their first character, one more if there are some, so they come back exactly.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickloom.llm.common import batches_of, lists_of_ints, shuffle_width, stage_table, worker_store
from tickloom.llm.encode import encode_texts
from tickloom.plans import attach

# Fixed values of the template.
ASSISTANT = "assistant"
OPEN, CLOSE, END = "[INST] ", " [/INST]", "</s>"
CONTROL = re.compile(r"([<\[])(\\*)(/?s>|/?INST\])")
ESCAPED = re.compile(r"([<\[])\\(\\*)(/?s>|/?INST\])")
TEXT_BYTES_AT_ONCE = 1 << 20
HASH_BYTES = 8


def escape(text: str) -> str:
    return CONTROL.sub(r"\1\2\\\3", text)


def unescape(text: str) -> str:
    return ESCAPED.sub(r"\1\2\3", text)


def escape_role(role: str) -> str:
    return escape(role).replace("\\", "\\\\").replace("\n", "\\n")


def unescape_role(role: str) -> str:
    return unescape(re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], role))


def frame(role: str) -> tuple[str, str]:
    """What stands before and after the text of a turn."""
    before, after = ("", END) if role == ASSISTANT else (OPEN, CLOSE)
    return f"{before}{escape_role(role)}\n", after


def _chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each turn: its node's key, a hash of all turns up to it, and the key before."""
    for batch in batches:
        rows: list[tuple] = []
        for conv, turns in zip(batch.column("conv_id").to_pylist(), batch.column("turns").to_pylist()):
            key = b""
            for i, turn in enumerate(turns):
                role, text = turn["role"].encode(), turn["text"].encode()
                before, key = key, hashlib.blake2b(key + len(role).to_bytes(8, "big") + role + text, digest_size=16).digest()
                rows.append((conv, i, before, key, turn["role"], turn["text"], i == len(turns) - 1))
        kinds = (pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.string(), pa.string(), pa.bool_())
        names = ["conv_id", "at", "before", "key", "role", "text", "last"]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * 7, kinds)], names)


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The path of the run and the place in it for each node of a conversation."""
    for batch in batches:
        rows: list[tuple] = []
        for nodes in batch.column("nodes").to_pylist():
            path, place = b"", 0
            for node in nodes:
                if node["opens"]:
                    path, place = path + node["key"][:HASH_BYTES], 0
                rows.append((node["key"], path, place))
                place += 1
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * 3, (pa.binary(), pa.binary(), pa.int32()))], ["key", "path", "place"]
        )


NODE = "key binary, path binary, part int, before long, n_ids int, loss_start int, loss_end int, body_start int, body_end int, ids array<int>"


def _encode(tokenizer: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        from pyspark import TaskContext

        part, before = TaskContext.get().partitionId(), 0
        for table in batches_of(batches, "text", TEXT_BYTES_AT_ONCE):
            roles, texts = table.column("role").to_pylist(), table.column("text").to_pylist()
            frames = [frame(r) for r in roles]
            heads, feet = encode_texts([f[0] for f in frames], tokenizer), encode_texts([f[1] for f in frames], tokenizer)
            bodies = encode_texts([escape(t) for t in texts], tokenizer)
            out: list[tuple] = []
            ids = []
            for role, head, body, foot in zip(roles, heads, bodies, feet):
                ids.append(np.frombuffer(head + body + foot, "<i4"))
                first, last, n = len(head) // 4, (len(head) + len(body)) // 4, len(ids[-1])
                loss = (first, last) if role == ASSISTANT else (0, 0)
                out.append((part, before, n, *loss, first, last))
                before += n
            kinds = (pa.int32(), pa.int64(), *[pa.int32()] * 5)
            yield pa.RecordBatch.from_arrays(
                [*(table.column(c).combine_chunks() for c in ("key", "path")), *(pa.array(c, k) for c, k in zip(zip(*out), kinds)), lists_of_ints(ids, pa.int32())],
                ["key", "path", "part", "before", "n_ids", "loss_start", "loss_end", "body_start", "body_end", "ids"],
            )

    return run


def write_trees(conversations: DataFrame, path: str, tokenizer: str) -> None:
    """Format all conversations as prefix trees: two Parquet tables below ``path``.

    ``nodes``: offset, run (the offset of its run), n_ids, ids, position_start, ancestors (array of start, end; from the
    root), body_start, body_end, loss_start, loss_end (ranges of the node's own ids). ``members``: conv_id, n_turns and the
    offset of its last node.

    ``conversations`` has conv_id, turn, role and text; other columns are not read. Rows are ordered by turn, then role
    and text, nulls first; null roles and texts are empty. Rows with a null conv_id are one conversation. Equal
    conversations share all nodes. A conversation is an example and so small enough for a task. An empty table gives two
    empty tables.
    """
    turn = F.struct("turn", "role", "text")
    turns = (
        conversations.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
        .groupBy("conv_id")
        .agg(F.sort_array(F.collect_list(turn)).alias("turns"))
        .withColumn(
            "turns",
            F.transform("turns", lambda t: F.struct(F.coalesce(t.role, F.lit("")).alias("role"), F.coalesce(t.text, F.lit("")).alias("text"))),
        )
    )
    placed = stage_table(
        turns.mapInArrow(_chain, "conv_id long, at int, before binary, key binary, role string, text string, last boolean"), "turns"
    )
    children = placed.filter("at > 0").select("before", "key").distinct().groupBy("before").agg(F.count(F.lit(1)).alias("n"))
    forks = children.filter("n > 1").select("before", F.lit(True).alias("fork"))
    opens = (F.col("at") == 0) | F.coalesce("fork", F.lit(False))
    node = F.struct("at", "key", opens.alias("opens"))
    # Many conversations may share a fork: its one row goes to all of them, or to salted parts of them.
    gathered = attach(placed.select("conv_id", "at", "before", "key"), forks, ["before"]).groupBy("conv_id").agg(F.sort_array(F.collect_list(node)).alias("nodes"))
    runs = gathered.mapInArrow(_runs, "key binary, path binary, place int").groupBy("key").agg(F.first("path").alias("path"), F.first("place").alias("place"))
    texts = placed.groupBy("key").agg(F.first("role").alias("role"), F.first("text").alias("text"))
    different = stage_table(texts.join(runs, "key"), "different")
    ordered = different.repartitionByRange(shuffle_width(conversations.sparkSession), "path", "place").sortWithinPartitions("path", "place")
    coded = stage_table(ordered.mapInArrow(_encode(tokenizer), NODE), "coded")
    ends = coded.groupBy("part").agg(F.max(F.col("before") + F.col("n_ids")).alias("n"))
    # A row for each part.
    base = ends.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("base"))
    streamed = coded.join(F.broadcast(base), "part").withColumn("offset", F.col("base") + F.col("before"))
    spans = stage_table(
        streamed.groupBy("path").agg(F.min("offset").alias("start"), F.max(F.col("offset") + F.col("n_ids")).alias("end")), "runs"
    )
    depth = (F.length("path") / HASH_BYTES).cast("int")
    above = spans.filter(depth > 1).select("path", F.explode(F.sequence(F.lit(1), depth - 1)).alias("depth")).select(
        F.col("path").alias("below"), F.substring("path", F.lit(1), F.col("depth") * HASH_BYTES).alias("path")
    )
    ancestors = above.join(spans, "path").groupBy(F.col("below").alias("path")).agg(
        F.sort_array(F.collect_list(F.struct("start", "end"))).alias("above"), F.sum(F.col("end") - F.col("start")).alias("tokens_above")
    )
    none = F.array().cast("array<struct<start:bigint,end:bigint>>")
    facts = spans.join(ancestors, "path", "left").select(
        "path", F.col("start").alias("run"), F.coalesce("above", none).alias("above"), F.coalesce("tokens_above", F.lit(0)).alias("tokens_above")
    )
    own = F.when(F.col("offset") > F.col("run"), F.array(F.struct(F.col("run").alias("start"), F.col("offset").alias("end")))).otherwise(none)
    nodes = streamed.join(facts, "path").select(
        "key",
        "offset",
        "run",
        "n_ids",
        "ids",
        (F.col("tokens_above") + F.col("offset") - F.col("run")).alias("position_start"),
        F.concat("above", own).alias("ancestors"),
        "body_start",
        "body_end",
        "loss_start",
        "loss_end",
    )
    nodes = stage_table(nodes, "nodes")
    last = placed.filter("last").select("conv_id", "key", (F.col("at") + 1).alias("n_turns"))
    last.join(nodes.select("key", "offset"), "key").drop("key").write.parquet(f"{path}/members")
    nodes.drop("key").write.parquet(f"{path}/nodes")


def read_turns(spark: SparkSession, path: str, tokenizer: str) -> DataFrame:
    """Every turn of every conversation from the files: conv_id, at (its place), role, text, under_loss, n_chars."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tokenizers import Tokenizer

        held = worker_store("decoders")
        if tokenizer not in held:
            held[tokenizer] = Tokenizer.from_file(tokenizer)
        reader = held[tokenizer]
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                ids, first, last = r["ids"], r["body_start"], r["body_end"]
                head, body, foot = reader.decode_batch([ids[:first], ids[first:last], ids[last:]], skip_special_tokens=False)
                masked = reader.decode(ids[r["loss_start"] : r["loss_end"]], skip_special_tokens=False)
                role = unescape_role((head.removeprefix(OPEN) if foot == CLOSE else head)[:-1])
                rows.append((r["offset"], role, unescape(body), unescape(masked), len(head) + len(body) + len(foot)))
            kinds = (pa.int64(), *[pa.string()] * 3, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * 5, kinds)], ["offset", "role", "text", "under_loss", "n_chars"]
            )

    nodes, members = spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/members")
    decoded = nodes.select("offset", "ids", "body_start", "body_end", "loss_start", "loss_end").mapInArrow(
        decode, "offset long, role string, text string, under_loss string, n_chars long"
    )
    leaves = members.join(nodes.select("offset", "run", "ancestors"), "offset")
    # The conversation's nodes lie in the runs that its last node may attend to, and in its own run up to it.
    starts = F.array_union(F.transform("ancestors", lambda a: a.start), F.array("run"))
    steps = leaves.select("conv_id", F.col("offset").alias("last"), F.explode(starts).alias("run"))
    found = steps.join(nodes.select("run", "offset"), "run").filter("offset <= last").select("conv_id", "offset")
    return found.join(decoded, "offset").withColumnRenamed("offset", "at")


def digest_conversations(turns: DataFrame) -> DataFrame:
    """Per conversation: n_turns, turns_sha256, loss_chars, loss_sha256 and formatted_chars."""
    row = F.struct("at", "role", "text", "under_loss")
    held = turns.groupBy("conv_id").agg(
        F.count(F.lit(1)).alias("n_turns"), F.sum("n_chars").alias("formatted_chars"), F.sort_array(F.collect_list(row)).alias("t")
    )
    whole = F.array_join(F.transform("t", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), "")
    loss = F.array_join(F.transform("t", lambda t: t.under_loss), "")
    return held.select(
        "conv_id",
        "n_turns",
        F.sha2(whole, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        "formatted_chars",
    )
