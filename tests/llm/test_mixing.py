from collections import defaultdict

import numpy as np
import pytest

from tests.llm.conftest import prose
from tickloom.llm import mixing
from tickloom.llm.common import stage_table


def shared(sizes):
    """Targets by reshare after reshare."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    stopped = {}
    while True:
        rest = sum(sizes.values()) - sum(stopped.values())
        total = sum(weight[s] for s in names if s not in stopped)
        open_ = {s: rest * weight[s] / total for s in names if s not in stopped}
        over = [s for s in open_ if open_[s] > 3 * sizes[s] + 1e-9]
        if not over:
            return {**stopped, **open_}
        stopped.update({s: 3.0 * sizes[s] for s in over})


@pytest.mark.parametrize("sizes", [{"a": 10}, {"a": 1, "b": 100, "c": 50}, {"b": 3, "B": 5, "é": 1, None: 2, "z": 90}, {"a": 0, "b": 4, "c": 0}])
def test_targets_against_repeated_sharing(spark, sizes):
    table = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r.source: r.target for r in mixing.targets(table).collect()}
    assert got == pytest.approx(shared(sizes))


def test_flight_keeps_both_totals():
    rng = np.random.default_rng(0)
    size = rng.integers(0, 1000, 500)
    out = mixing.fly(np.full(500, 0.37), size, land=False)
    open_ = (out > 0) & (out < 1)
    assert open_.sum() <= 2
    assert out.sum() == pytest.approx(0.37 * 500) and (out * size).sum() == pytest.approx(0.37 * size.sum())
    landed = mixing.fly(np.full(500, 0.37), size, land=True)
    assert set(landed) == {0.0, 1.0} and abs(landed.sum() - 185) <= 1


def test_chances_are_kept_on_average():
    rng = np.random.default_rng(5)
    size = rng.integers(1, 50, 12)
    taken = np.zeros(12)
    for k in range(600):
        order = rng.permutation(12)
        taken[order] += mixing.fly(np.full(12, 0.4), size[order] + 0 * k, land=True)
    assert np.abs(taken / 600 - 0.4).max() < 0.12


@pytest.mark.parametrize("most", [7, 10_000])
def test_blocks_and_totals(spark, most):
    rows = spark.range(300).selectExpr(
        "id AS key", "if(id < 200, 'hot', if(id < 290, 'b', NULL)) AS source", "id * 37 % 101 AS size", "id * 7919 % 1009 AS order", "if(id < 200, 0.25, 0.5D) AS chance"
    ).withColumn("chance", __import__("pyspark.sql.functions", fromlist=["col"]).col("chance").cast("double"))
    got = mixing.sample(rows, most)
    assert got.count() == 300 and got.select("key").distinct().count() == 300
    joined = got.join(rows, "key").collect()
    for source, want in (("hot", 0.25), ("b", 0.5)):
        own = [r for r in joined if r.source == source]
        assert abs(sum(r.extra for r in own) - want * len(own)) <= 2
        assert abs(sum(r.extra * r["size"] for r in own) - want * sum(r["size"] for r in own)) <= 220
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, mixing.sample(rows.repartition(5), most).collect()))


def test_mix_and_copies(spark, documents):
    rows = [(i, prose(i, 20 + i * 31 % 90), "en", f"s{i % 4}") for i in range(120)]
    docs = stage_table(documents(rows), "docs")
    out = mixing.mix(docs, ["doc_id", "source"]).collect()
    totals, targets = defaultdict(int), {}
    for r in out:
        assert 0 <= r.copies <= 3
        totals[r.source] += r["size"] * r.copies
        targets[r.source] = r.target
    assert all(abs(totals[s] - targets[s]) <= 110 for s in targets)
    taken = mixing.take(docs)
    assert taken.columns == docs.columns
    copies = {r.doc_id: r.copies for r in out}
    counts = {r.doc_id: r["count"] for r in taken.groupBy("doc_id").count().collect()}
    assert counts == {d: n for d, n in copies.items() if n}


def test_odd_rows_and_empty_table(documents, odd_documents):
    out = mixing.mix(odd_documents, ["doc_id"]).collect()
    assert len(out) == odd_documents.count() and all(r.copies <= 3 for r in out)
    assert mixing.take(odd_documents).columns == odd_documents.columns
    assert mixing.mix(documents([]), ["doc_id"]).count() == 0
