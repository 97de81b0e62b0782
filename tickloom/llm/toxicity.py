"""Toxicity: a linear classifier of character n-grams scaled by naive Bayes log-count ratios.

N-grams of 3 to 6 characters of the lower-case text, runs of white space as one space, are hashed into
2^20 features. A feature present in a text has the value of its log-count ratio between the classes (Wang and Manning 2012);
a logistic regression on these values gives the score.

The model is fitted on a bounded sample of labelled rows (``SAMPLE_ROWS``, taken by a hash of the document id); every row
is scored on its whole text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import batches_of, mixed, rolling, stage_table, texts_of, whole_windows

ORDERS = (3, 4, 5, 6)
FEATURE_BITS = 20
# Most labelled rows that the model is fitted on, and the parts that count them.
SAMPLE_ROWS = 20_000
SAMPLE_PARTS = 16
# Features with the largest log-likelihood ratio between the classes that get a weight.
FEATURES = 6_000
SMOOTHING = 1.0
PENALTY = 1e-4
STEPS = 600
# Features of the sample's rows that a step of the fit works on at once.
ENTRIES_AT_ONCE = 1 << 21
PREDICT_FROM = 0.3
BASE = 0x9E3779B97F4A7C15
TEXT_BYTES_AT_ONCE = 1 << 19
CHUNKS = 64


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows whose labels are never learnt: crc32 of the id as text leaves 2 by 4."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def features(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(text, feature) of every n-gram of many texts, repeats included, in order of n and then of text."""
    clean = [" " + " ".join(t.lower().split()) + " " for t in texts]
    points = mixed(np.frombuffer("".join(clean).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1))
    lengths = np.array([len(c) for c in clean], np.int64)
    where, found = [], []
    for n in ORDERS:
        at, own = whole_windows(lengths, n)
        where.append(np.repeat(np.arange(len(texts)), own))
        found.append((mixed(rolling(points, n, BASE)[at] + np.uint64(n)) >> np.uint64(64 - FEATURE_BITS)).astype(np.int64))
    return np.concatenate(where), np.concatenate(found)


def _present(where: np.ndarray, found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each feature of a text once."""
    codes = np.unique((where << FEATURE_BITS) | found)
    return codes >> FEATURE_BITS, codes & ((1 << FEATURE_BITS) - 1)


@dataclass
class Model:
    """The features with a weight, their weights (ratios included) and the intercept."""

    ids: np.ndarray
    weights: np.ndarray
    intercept: float

    def table(self) -> np.ndarray:
        """The weight of every feature, 0 for those without one."""
        table = np.zeros(1 << FEATURE_BITS, np.float64)
        table[self.ids] = self.weights
        return table

    def scores(self, texts: list[str], table: np.ndarray | None = None) -> np.ndarray:
        table = self.table() if table is None else table
        total = np.full(len(texts), self.intercept)
        where, found = features(texts)
        some = table[found] != 0
        where, found = _present(where[some], found[some])
        np.add.at(total, where, table[found])
        return 1 / (1 + np.exp(-np.clip(total, -500, 500)))


def _class_counts(sample: DataFrame) -> DataFrame:
    """(feature, pos, neg): in how many texts of each class a feature is. Parts send arrays, not rows."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((2, 1 << FEATURE_BITS), np.uint32)
        for table in batches_of(batches, "text", TEXT_BYTES_AT_ONCE):
            toxic = table.column("toxic").to_numpy()
            where, found = _present(*features(texts_of(table.column("text"))))
            for label in (0, 1):
                counts[label] += np.bincount(found[toxic[where] == label], minlength=1 << FEATURE_BITS).astype(np.uint32)
        parts = counts.reshape(2, CHUNKS, -1)
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(CHUNKS), pa.int32()), *(pa.array([c.tobytes() for c in parts[label]]) for label in (1, 0))], ["chunk", "pos", "neg"]
        )

    def total(table: pa.Table) -> pa.Table:
        pos, neg = (np.sum([np.frombuffer(b, np.uint32) for b in table.column(c).to_pylist()], axis=0, dtype=np.int64) for c in ("pos", "neg"))
        some = np.flatnonzero(pos + neg)
        ids = some + table.column("chunk")[0].as_py() * len(pos)
        return pa.table([pa.array(ids), pa.array(pos[some]), pa.array(neg[some])], ["feature", "pos", "neg"])

    parts = sample.mapInArrow(count, "chunk int, pos binary, neg binary")
    return parts.groupBy("chunk").applyInArrow(total, "feature long, pos long, neg long")


def _chosen(counts: DataFrame, n_pos: int, n_neg: int) -> DataFrame:
    """The ``FEATURES`` with the largest log-likelihood ratio and their log-count ratio (feature, ratio)."""
    a, b = F.col("pos").cast("double"), F.col("neg").cast("double")
    rows = [(a, n_pos), (b, n_neg), (n_pos - a, n_pos), (n_neg - b, n_neg)]
    n = n_pos + n_neg
    both = a + b
    expected = [both * n_pos / n, both * n_neg / n, (n - both) * n_pos / n, (n - both) * n_neg / n]
    gain = sum((F.when(x > 0, x * F.log(x / e)).otherwise(0.0) for (x, _), e in zip(rows, expected)), F.lit(0.0))
    ratio = F.log((a + SMOOTHING) / (n_pos + 2 * SMOOTHING)) - F.log((b + SMOOTHING) / (n_neg + 2 * SMOOTHING))
    return counts.select("feature", ratio.alias("ratio"), gain.alias("gain")).orderBy(F.desc("gain"), "feature").limit(FEATURES)


def _logistic(lengths: np.ndarray, column: np.ndarray, values: np.ndarray, labels: np.ndarray, width: int) -> tuple[np.ndarray, float]:
    """Weights and intercept by accelerated gradient steps; the rows' features follow each other in ``column``, ``lengths`` to a row.

    Rows are taken in slices of about ``ENTRIES_AT_ONCE`` features, so what a step holds besides ``column`` is bounded.
    """
    n = len(labels)
    ends = np.cumsum(lengths)
    cuts = np.unique(np.concatenate([[0], np.searchsorted(ends, np.arange(ENTRIES_AT_ONCE, int(ends[-1]), ENTRIES_AT_ONCE)), [n]]))
    parts = [(slice(a, b), slice(int(ends[a] - lengths[a]), int(ends[b - 1]))) for a, b in zip(cuts, cuts[1:])]

    def rows(part: tuple[slice, slice]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        own = lengths[part[0]]
        return np.repeat(np.arange(len(own)), own), column[part[1]], values[column[part[1]]]

    weights, bias = np.zeros(width), 0.0
    ahead, ahead_bias = weights.copy(), bias
    # A bound of the curvature from the squared length of the rows.
    step = 4.0 / (sum(float(x @ x) for _, _, x in map(rows, parts)) / n + 1.0)
    for k in range(STEPS):
        slope, bias_slope = PENALTY * ahead, 0.0
        for part in parts:
            where, at, x = rows(part)
            total = np.bincount(where, x * ahead[at], minlength=len(lengths[part[0]])) + ahead_bias
            error = (1 / (1 + np.exp(-np.clip(total, -500, 500))) - labels[part[0]]) / n
            slope += np.bincount(at, x * error[where], minlength=width)
            bias_slope += error.sum()
        new, new_bias = ahead - step * slope, ahead_bias - step * bias_slope
        speed = k / (k + 3)
        ahead, ahead_bias = new + speed * (new - weights), new_bias + speed * (new_bias - bias)
        weights, bias = new, new_bias
    return weights, float(bias)


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Fit on at most some ``SAMPLE_ROWS`` labelled documents that are not held out.

    ``labels`` has doc_id and toxic (0 or 1; null labels and ids are not learnt from). An id with labels of both kinds counts as
    toxic; of repeated documents of an id the text that sorts first is learnt, so repeats do not widen the sample. Without
    labels of both classes every text gets the same score, the share of toxic labels.
    """
    usable = labels.filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out())
    usable = usable.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    usable = stage_table(usable.groupBy("doc_id").agg(F.max("toxic").alias("toxic")), "usable")
    share = SAMPLE_ROWS / max(1, usable.count())
    # The sample has SAMPLE_ROWS rows but for chance, and so a bound to broadcast.
    picked = usable.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(min(1.0, share) * (1 << 30)))
    sample = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    sample = sample.join(F.broadcast(picked), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    sample = stage_table(sample.select("doc_id", "text", "toxic").repartition(SAMPLE_PARTS, "doc_id"), "sample")
    sizes = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    n_pos, n_neg = sizes.get(1, 0), sizes.get(0, 0)
    if not n_pos or not n_neg:
        prior = (n_pos + SMOOTHING) / (n_pos + n_neg + 2 * SMOOTHING)
        return Model(np.zeros(0, np.int64), np.zeros(0), float(np.log(prior / (1 - prior))))
    chosen = _chosen(_class_counts(sample), n_pos, n_neg).collect()  # FEATURES rows at most
    ids = np.array([r["feature"] for r in chosen], np.int64)
    ratios = np.array([r["ratio"] for r in chosen])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        column = np.full(1 << FEATURE_BITS, -1, np.int32)
        column[ids] = np.arange(len(ids))
        for table in batches_of(batches, "text", TEXT_BYTES_AT_ONCE):
            where, found = features(texts_of(table.column("text")))
            some = column[found] >= 0
            where, found = _present(where[some], found[some])
            parts = np.split(column[found], np.searchsorted(where, np.arange(1, table.num_rows)))
            yield pa.RecordBatch.from_arrays(
                [table.column("doc_id").combine_chunks(), table.column("toxic").combine_chunks(), pa.array([p.astype(np.int32).tobytes() for p in parts])],
                ["doc_id", "toxic", "columns"],
            )

    # The sample's bound and FEATURES bound what comes here.
    got = sample.mapInArrow(rows, "doc_id long, toxic int, columns binary").toArrow().sort_by("doc_id")
    lengths = pc.binary_length(got.column("columns")).to_numpy() // 4
    column = np.concatenate([np.frombuffer(b.as_buffer(), np.int32) for b in got.column("columns")])
    weights, bias = _logistic(lengths, column, ratios, got.column("toxic").to_numpy().astype(float), len(ids))
    return Model(ids, weights * ratios, bias)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score and predicted of every row, whole texts of any length; a null text counts as empty.

    Rows with a null id are scored and are not held out; repeated rows are scored each.
    """

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = model.table()
        for table in batches_of(batches, "text", TEXT_BYTES_AT_ONCE):
            scores = model.scores(texts_of(table.column("text")), weights)
            yield pa.RecordBatch.from_arrays(
                [table.column("doc_id").combine_chunks(), pa.array(scores)], ["doc_id", "score"]
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rated = rows.mapInArrow(rate, "doc_id long, score double")
    return rated.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= PREDICT_FROM).cast("int").alias("predicted"))
