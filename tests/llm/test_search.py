import math

import numpy as np
import pytest

from tickloom.llm import search


def brute(vectors, queries, k):
    out = {}
    for q, x in queries:
        scored = sorted((-sum(a * b for a, b in zip(x, y)), i) for i, y in vectors if i != q and len(x) == len(y))
        out[q] = [(r + 1, i, -s) for r, (s, i) in enumerate(scored[:k])]
    return out


def ask(vectors, queries, **kw):
    out = {}
    for r in search.search(vectors, queries, **kw).collect():
        out.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    return {q: sorted(rows) for q, rows in out.items()}


@pytest.mark.parametrize("per_shard", [37, 10_000])
def test_against_brute_force(spark, monkeypatch, per_shard):
    monkeypatch.setattr(search, "QUERIES_PER_BLOCK", 4)
    monkeypatch.setattr(search, "LEAF", 8)
    rng = np.random.default_rng(2)
    rows = [(i, rng.integers(-3, 4, 5).tolist()) for i in range(200)]  # many ties
    rows += [(200 + i, [1, 2, 3, 4, 5]) for i in range(30)]
    table = spark.createDataFrame(rows, "vec_id long, v array<bigint>")
    got = ask(table, table.filter("vec_id % 20 = 0"), k=7, per_shard=per_shard)
    assert got == brute(rows, [r for r in rows if r[0] % 20 == 0], 7)


def test_bounds_skip_leaves():
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(20, 8)) * 1000
    rows = (np.repeat(centres, 100, axis=0) + rng.normal(size=(2000, 8))).astype(np.int64)
    tree, looked = search.BallTree(rows), []
    plain = tree.leaf_products
    tree.leaf_products = lambda first, last, *rest: looked.append(last - first) or plain(first, last, *rest)
    search.search_tree(tree, np.arange(2000), rows[:1], np.array([0]), [None], 10, None)
    assert 0 < sum(looked) < 600


def test_vectors_that_take_no_part(spark):
    rows = [(1, [1.0, 0.5]), (2, None), (3, [1.0, None]), (4, [math.nan, 1.0]), (5, [math.inf, 1.0]), (6, [-0.0001, 0.9999]), (None, [1.0, 1.0]), (7, []), (8, [1e300, -1e300])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 AS v", "2 AS dim")
    got = {r.vec_id: r.v for r in search.integer_vectors(table).collect()}
    assert got == {1: [1024, 512], 6: [-1, 1023], None: [1024, 1024], 7: [], 8: [2**62, -(2**62)]}
    found = ask(search.integer_vectors(table), search.integer_vectors(table).filter("vec_id = 1"))
    assert found == {1: [(1, 8, 2**63 - 1), (2, 6, 512 * 1023 - 1024)]}


def test_repeated_rows_few_rows_and_empty_table(spark):
    rows = [(1, [1]), (2, [3]), (2, [3]), (100, [2])]
    table = spark.createDataFrame(rows, "vec_id long, v array<bigint>")
    assert ask(table, table.filter("vec_id = 100")) == {100: [(1, 2, 6), (2, 2, 6), (3, 1, 2)]}
    empty = table.filter("vec_id > 1000")
    assert ask(empty, empty) == {} and ask(table, empty) == {} and ask(empty, table) == {}


def test_products_in_doubles_and_beyond():
    rng = np.random.default_rng(3)
    for scale in (1000, 1 << 28, 1 << 45):
        rows, queries = rng.integers(-scale, scale, (300, 8)), rng.integers(-scale, scale, (5, 8))
        tree = search.BallTree(rows)
        assert tree.exact_in_doubles(queries.astype(float)).all() == (scale == 1000)
        found = search.search_tree(tree, np.arange(300), queries, np.full(5, -1), [None] * 5, 10, None)
        for query, best in zip(queries, found):
            scores = [min(max(sum(int(a) * int(b) for a, b in zip(row, query)), -(1 << 63)), (1 << 63) - 1) for row in rows]
            assert best == sorted(((s, -i) for i, s in enumerate(scores)), reverse=True)[:10]


def test_a_repeated_query_asks_the_vector_that_sorts_first(spark):
    rows = spark.createDataFrame([(1, [1, 0]), (2, [0, 1]), (3, [2, 2])], "vec_id long, v array<long>")
    asked = spark.createDataFrame([(9, [0, 5]), (9, [5, 0]), (9, [0, 5])], "vec_id long, v array<long>")
    assert [(r.vec_id, r.score) for r in search.search(rows, asked, k=2).orderBy("rank").collect()] == [(3, 10), (2, 5)]
