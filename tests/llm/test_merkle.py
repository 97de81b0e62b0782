import hashlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import SCHEMA, prose
from tickloom.llm import merkle
from tickloom.llm.merkle import folded, leaf_digest, manifest, proof_digest, proofs

COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def brute_leaf(row):
    values = [row[c] for c in COLUMNS]
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def brute_tree(nodes, fanout):
    """The root, and the siblings of each node, bottom up, as (left, right)."""
    paths, members = [[] for _ in nodes], [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        above, held = [], []
        for first in range(0, len(nodes), fanout):
            run = nodes[first : first + fanout]
            for k in range(len(run)):
                for i in members[first + k]:
                    paths[i].append(("".join(run[:k]), "".join(run[k + 1 :])))
            above.append(sha("".join(run)))
            held.append([i for m in members[first : first + fanout] for i in m])
        nodes, members = above, held
    return nodes[0], paths


def brute(rows, fanout):
    """For each row, as a sorted list: doc_id, leaf, subroot, root and the digest of its proof."""
    sources = defaultdict(list)
    for row in rows:
        sources[row["source"]].append((row["doc_id"] is not None, row["doc_id"] or 0, brute_leaf(row), row["doc_id"]))
    names = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for name in names:
        leaves = sorted(sources[name], key=lambda x: x[:3])
        trees[name] = (leaves, *brute_tree([x[2] for x in leaves], fanout))
    root, tops = brute_tree([trees[n][1] for n in names], fanout)
    out = []
    for name, top in zip(names, tops):
        leaves, subroot, paths = trees[name]
        for leaf, path in zip(leaves, paths):
            out.append((leaf[3], leaf[2], subroot, root, sha("".join(a + b for a, b in path + top))))
    return sorted(out, key=repr)


def proved(docs, presented=None):
    return proofs(manifest(docs, COLUMNS, "source", "doc_id", presented)).withColumns(
        {"proof": proof_digest("levels"), "folded": folded("presented", "levels")}
    )


def check(docs, fanout=16):
    got = proved(docs).collect()
    assert sorted(((r.doc_id, r.leaf, r.subroot, r.root, r.proof) for r in got), key=repr) == brute(docs.collect(), fanout)
    assert all(r.folded == r.root for r in got)


@pytest.fixture
def small_trees(monkeypatch):
    """Blocks of four leaves, so that few rows make many rounds."""

    def use(fanout, levels):
        monkeypatch.setattr(merkle, "FANOUT", fanout)
        monkeypatch.setattr(merkle, "LEVELS", levels)

    return use


@pytest.mark.parametrize("fanout, levels", [(2, 1), (2, 2), (3, 1), (16, 3)])
def test_proofs_equal_brute_force(spark, documents, small_trees, fanout, levels):
    small_trees(fanout, levels)
    sizes = {"hot": 90, None: 5, "a": 1, "é": 2, "Z": 9, "z": 33, "b": 1, "": 3}
    rows = [(i * 37 % 1009, prose(i, 3), "en", s) for i, s in enumerate(s for s, n in sizes.items() for _ in range(n))]
    check(documents(rows).repartition(7), fanout)


def test_odd_rows(spark, odd_documents, small_trees):
    check(odd_documents)
    small_trees(2, 1)
    check(odd_documents, 2)


def test_one_leaf_is_its_own_root(documents):
    docs = documents([(3, "alone")])
    (row,) = proved(docs).collect()
    assert row.root == row.subroot == row.leaf == brute_leaf(docs.first()) and row.levels == [] and row.proof == sha("")


def test_empty_table(spark):
    assert proved(spark.createDataFrame([], SCHEMA)).count() == 0


def test_a_changed_row_does_not_fold_to_the_root(documents, small_trees):
    small_trees(2, 1)
    docs = documents([(i, f"Text {i}", "en", f"s{i % 3}") for i in range(40)])
    values = [F.lower("text") if c == "text" else F.col(c) for c in COLUMNS]
    changed = F.when(F.col("doc_id") % 5 == 0, leaf_digest(values))
    rows = proved(docs, changed).collect()
    assert {r.doc_id for r in rows if r.folded != r.root} == {i for i in range(40) if i % 5 == 0}
    assert all((r.leaf != r.presented) == (r.doc_id % 5 == 0) for r in rows)


def test_each_swap_has_one_row_of_every_group(spark, small_trees):
    """Groups of unequal size: the smaller answers several members of the larger, no lane has two of a group."""
    small_trees(16, 3)
    blocks = spark.createDataFrame([(g, o, s, f"n{g}") for g, s in ((0, 7), (1, 3), (2, 1)) for o in range(s)], "g int, o long, s long, node string")
    blocks = blocks.withColumn("upper", F.array().cast("array<struct<left string, right string>>"))
    out = merkle._swap(blocks, [F.lit(0)], F.col("g"), F.col("o"), F.col("s"), F.lit(7).cast("long"), F.lit(True)).collect()
    assert len(out) == 11 and {r.node for r in out} == {sha("n0n1n2")}
    assert {(r.g, r.upper[0].left, r.upper[0].right) for r in out} == {(0, "", "n1n2"), (1, "n0", "n2"), (2, "n0n1", "")}
