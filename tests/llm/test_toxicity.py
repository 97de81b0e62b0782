import zlib

import numpy as np
from pyspark.sql import functions as F

from tests.llm.conftest import prose
from tickloom.llm import toxicity


def corpus():
    rows, labels = [], []
    for i in range(400):
        toxic = int(i % 5 == 0)
        words = prose(i, 60).split()
        if toxic:
            for k in range(3):
                words[(i * 13 + k * 17) % 60] = ("grubworm", "Grubface", "GRUBLING")[(i + k) % 3]
        rows.append((i, " ".join(words), "en", f"s{i % 3}"))
        labels.append((i, 1, toxic))
    return rows, labels


def test_held_out_accuracy(spark, documents):
    rows, labels = corpus()
    table = spark.createDataFrame([*labels, (None, 0, 1), (3, None, None), (9999, 1, 1)], "doc_id long, quality int, toxic int")
    docs = documents([*rows, (1000, None), (1001, ""), (None, "grubworm " * 40)])
    got = toxicity.score(docs, toxicity.fit(docs, table)).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == 403 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    for i, _, toxic in labels:
        assert by[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2)
    held = [(by[i].predicted, toxic) for i, _, toxic in labels if by[i].held_out]
    assert len(held) > 60 and sum(p == t for p, t in held) / len(held) > 0.97
    assert by[None].predicted == 1 and by[1000].score == by[1001].score


def test_held_out_labels_are_never_learnt(spark, documents):
    rows, labels = corpus()
    schema = "doc_id long, quality int, toxic int"
    turned = [(i, q, 1 - t if zlib.crc32(str(i).encode()) % 4 == 2 else t) for i, q, t in labels]
    docs = documents(rows)
    first, second = (toxicity.fit(docs, spark.createDataFrame(x, schema)) for x in (labels, turned))
    assert np.array_equal(first.ids, second.ids) and np.array_equal(first.weights, second.weights)


def test_one_class_and_empty_tables(spark, documents):
    schema = "doc_id long, quality int, toxic int"
    rows, labels = corpus()
    docs = documents(rows[:20])
    one = toxicity.fit(docs, spark.createDataFrame([(i, 1, 0) for i in range(20)], schema))
    scores = {r.score for r in toxicity.score(docs, one).collect()}
    assert len(scores) == 1 and 0 < scores.pop() < 0.3
    assert toxicity.score(documents([]), toxicity.fit(documents([]), spark.createDataFrame([], schema))).count() == 0


def test_odd_rows(spark, odd_documents):
    table = spark.createDataFrame([(1, 1, 0), (4, 1, 1), (5, 1, 0)], "doc_id long, quality int, toxic int")
    got = toxicity.score(odd_documents, toxicity.fit(odd_documents, table))
    assert got.count() == odd_documents.count() and got.filter(F.col("score").isNull()).count() == 0


def test_labels_that_contradict_and_repeated_documents(spark, documents):
    rows, labels = corpus()
    schema = "doc_id long, quality int, toxic int"
    both = [(i, 1, 1 - t) for i, _, t in labels if t]
    plain = toxicity.fit(documents(rows), spark.createDataFrame(labels, schema))
    # Labels of both kinds count as toxic, and a repeated document is learnt once.
    twice = [r for r in rows if r[0] < 50] * 3
    again = toxicity.fit(documents([*rows, *twice]), spark.createDataFrame([*both, *labels, *both], schema))
    assert np.array_equal(plain.ids, again.ids) and np.allclose(plain.weights, again.weights)


def test_slices_of_rows_change_nothing(monkeypatch):
    rng = np.random.default_rng(5)
    lengths = rng.integers(0, 9, 60)
    column, values, labels = rng.integers(0, 20, lengths.sum()).astype(np.int32), rng.normal(size=20), (rng.random(60) < 0.4).astype(float)
    whole = toxicity._logistic(lengths, column, values, labels, 20)
    for size in (1, 7, 50):
        monkeypatch.setattr(toxicity, "ENTRIES_AT_ONCE", size)
        parts = toxicity._logistic(lengths, column, values, labels, 20)
        assert np.allclose(parts[0], whole[0]) and np.isclose(parts[1], whole[1])


def test_against_plain_naive_bayes_and_logistic_regression(spark, documents):
    texts = [f"{'grub' if i % 3 == 0 else 'fine'} {'worm' if i % 4 == 0 else 'day'} {'abcdefgh'[i % 8]}" for i in range(48)]
    toxic = [int(i % 3 == 0 or i % 4 == 0) for i in range(48)]
    docs = documents([(i, t) for i, t in enumerate(texts)])
    labels = spark.createDataFrame([(i, 1, t) for i, t in enumerate(toxic)], "doc_id long, quality int, toxic int")
    learnt = [i for i in range(48) if zlib.crc32(str(i).encode()) % 4 != 2]
    grams = [{f" {t} "[a:a + n] for n in (3, 4, 5, 6) for a in range(len(t) + 3 - n)} for t in texts]
    names = sorted(set().union(*(grams[i] for i in learnt)))
    present = np.array([[float(g in grams[i]) for g in names] for i in range(48)])
    y = np.array([toxic[i] for i in learnt], float)
    counts = lambda label: present[learnt][y == label].sum(axis=0)
    ratio = np.log((counts(1) + 1) / ((y == 1).sum() + 2)) - np.log((counts(0) + 1) / ((y == 0).sum() + 2))
    x = present * ratio
    # Plain gradient descent on the same penalised loss, far past the steps of the fit.
    w, b = np.zeros(len(names)), 0.0
    for _ in range(40_000):
        error = (1 / (1 + np.exp(-(x[learnt] @ w + b))) - y) / len(y)
        w, b = w - 0.05 * (x[learnt].T @ error + toxicity.PENALTY * w), b - 0.05 * error.sum()
    expected = 1 / (1 + np.exp(-(x @ w + b)))
    got = {r.doc_id: r.score for r in toxicity.score(docs, toxicity.fit(docs, labels)).collect()}
    assert max(abs(got[i] - expected[i]) for i in range(48)) < 0.02
