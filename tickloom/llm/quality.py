"""Quality rules: base rules, then robust multivariate outliers for each language and source.

Each document gives a vector of transformed statistics. For every (language, source) the centre and
scatter of the vectors are estimated by the minimum covariance determinant: concentration steps
(Rousseeuw and Van Driessen 1999) from two deterministic starts (Hubert, Rousseeuw and Verdonck
2012), the one with the smaller determinant winning, then one reweighted step. Documents far from
their group by Mahalanobis distance are rejected.

Everything is one aggregate per step: distances fall into logarithmic bins, each (group, bin) gives
its count and sums, and the bins of the nearest documents make the next estimate. Statistics are
rounded to 1/1024, so sums are exact integers and a rerun gives the same verdicts in any order.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.llm.common import batches_of, stage_table, texts_of
from tickloom.plans import attach

# Fixed values of the base rules.
SYMBOLS = re.compile(r"[#*$%&|<>]")
LEAST_WORDS = 50
MOST_REPEATED_PERCENT = 50
# The method's parameters. Share of a group's documents in the concentrated subset; steps from each
# start; chance that a clean vector of a normal group lies beyond the cut.
SUBSET = 0.75
STEPS = 4
BEYOND_CUT = 1e-6
# A group's estimate counts its parent's (language, then all) as so many documents, at any size.
PARENT_DOCUMENTS = 50.0
# Least spread of each statistic, in place of a smaller one only: many documents have none of it at all, and no scatter
# to invert. All are below 1/5.8 of what the statistic can reach, so each can pass the cut alone.
LEAST_SPREAD = (0.05, 0.25, 0.25, 0.2)
# Shares of repeated lines and words count so many clean ones more, so a few repeats in a short text say little.
CLEAN_LINES = 10
CLEAN_WORDS = 60
STATISTICS = ("q_length", "q_symbols", "q_lines", "q_repeats")
P = len(STATISTICS)
UNIT = 1024
BINS_PER_OCTAVE = 8
TEXT_BYTES_AT_ONCE = 1 << 20
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")


def text_counts(text: str) -> tuple[int, int, int, int, int, int]:
    """The counts of one text, in the order of ``COUNTS``."""
    words = text.encode().split()
    n = len(words)
    if not n:
        return 0, 0, len(SYMBOLS.findall(text)), 0, 0, 0
    joined = b"".join(words)
    chars = len(joined.decode())
    lines = [line for line in text.split("\n") if line.encode().split()]
    repeats = 0
    if n >= 3:
        seen: dict[bytes, int] = {}
        ids = np.array([seen.setdefault(w, len(seen)) for w in words])
        # Pairs are numbered anew, so codes stay far below 64 bits for any vocabulary.
        pairs = np.unique(ids[:-1] * len(seen) + ids[1:], return_inverse=True)[1]
        _, code, count = np.unique(pairs[:-1] * len(seen) + ids[2:], return_inverse=True, return_counts=True)
        starts = count[code] > 1
        covered = np.zeros(n, bool)
        for k in range(3):
            covered[k : n - 2 + k] |= starts
        repeats = int(covered.sum())
    return n, chars, len(SYMBOLS.findall(text)), len(lines) - len(set(lines)), repeats, len(lines)


def add_counts(docs: DataFrame, keys: list[str]) -> DataFrame:
    """The columns ``keys`` and the counts of every whole text; a null text counts as empty."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in batches_of(batches, "text", TEXT_BYTES_AT_ONCE):
            rows = [text_counts(t) for t in texts_of(table.column("text"))]
            columns = [pa.array(c, pa.int64()) for c in zip(*rows)]
            for name, column in zip(COUNTS, columns):
                table = table.append_column(name, column)
            yield from table.select([*keys, *COUNTS]).to_batches()

    rows = docs.select(*keys, F.col("text").cast("string").alias("text"))
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name != "text"]
    return rows.mapInArrow(count, ", ".join([*fields, *(f"{c} long" for c in COUNTS)]))


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED_PERCENT * F.col("n_words"))


def _quantised(value: Column) -> Column:
    return F.round(value * UNIT).cast("long")


def _statistics() -> list[Column]:
    n = F.greatest(F.col("n_words"), F.lit(1))
    return [
        _quantised(F.log((F.col("word_chars") + 1) / n)).alias("q_length"),
        _quantised(F.log1p(100 * F.col("n_symbols") / n)).alias("q_symbols"),
        _quantised(F.log1p(10 * F.col("n_dup_lines") / (F.col("n_lines") + CLEAN_LINES))).alias("q_lines"),
        _quantised(F.log1p(10 * F.col("n_repeat_words") / (F.col("n_words") + CLEAN_WORDS))).alias("q_repeats"),
    ]


def chi_square(x: float, k: int) -> float:
    """The distribution function for ``k`` degrees of freedom, by its series."""
    term = total = 1.0 / math.gamma(k / 2 + 1)
    i = 1
    while term > 1e-17 * total:
        term *= x / 2 / (k / 2 + i)
        total += term
        i += 1
    return min(1.0, total * math.exp(-x / 2) * (x / 2) ** (k / 2))


def chi_square_quantile(share: float, k: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if chi_square(middle, k) < share else (low, middle)
    return (low + high) / 2


def _consistency(share: float) -> float:
    """Makes the scatter of the nearest ``share`` of a normal sample that of the whole sample."""
    return share / chi_square(chi_square_quantile(share, P), P + 2)


GROUP = ["g_lang", "g_source"]
PAIRS = [(i, j) for i in range(P) for j in range(i, P)]
SUMS = [f"s{i}" for i in range(P)] + [f"s{i}{j}" for i, j in PAIRS]


def _sums() -> list[Column]:
    q = [F.col(c) for c in STATISTICS]
    return [F.sum(q[i]).alias(f"s{i}") for i in range(P)] + [
        F.sum((q[i] * q[j]).cast("decimal(20,0)")).cast("double").alias(f"s{i}{j}") for i, j in PAIRS
    ]


def _solve(rows: DataFrame, factor: float) -> DataFrame:
    """From sums of a group, its language and all to centre, inverse scatter and log determinant."""
    least = np.array(LEAST_SPREAD)
    upper = [(i, j) for i in range(P) for j in range(i, P)]

    def moments(n: np.ndarray, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = np.maximum(n, 1.0)[:, None]
        mean = sums[:, :P] / n / UNIT
        scatter = np.zeros((len(n), P, P))
        for k, (i, j) in enumerate(upper):
            scatter[:, i, j] = scatter[:, j, i] = sums[:, P + k] / n[:, 0] / UNIT**2 - mean[:, i] * mean[:, j]
        return mean, scatter

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            def level(prefix: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
                n = batch.column(prefix + "n").to_numpy(zero_copy_only=False).astype(float)
                sums = np.array([batch.column(prefix + s).to_numpy(zero_copy_only=False).astype(float) for s in SUMS]).T
                return (n, *moments(n, sums.reshape(len(n), len(SUMS))))

            _, mean, scatter = level("a_")
            for prefix in ("l_", "g_"):
                n, own, spread = level(prefix)
                w = (n / (n + PARENT_DOCUMENTS))[:, None]
                gap = own - mean
                # Pooled second moments, with the part that comes from the distance of the centres.
                scatter = w[..., None] * spread + (1 - w)[..., None] * scatter
                scatter += (w * (1 - w))[..., None] * gap[:, :, None] * gap[:, None, :]
                mean = mean + w * gap
            # In units of the least spreads no direction has less than one; directions with more stay as they are.
            values, axes = np.linalg.eigh(factor * scatter / np.outer(least, least))
            values = np.maximum(values, 1.0)
            inverse = (axes / values[:, None, :]) @ axes.transpose(0, 2, 1) / np.outer(least, least)
            inverse = inverse.reshape(len(mean), P * P)
            logdet = np.log(values).sum(axis=1) + 2 * np.log(least).sum()
            names = ["g_lang", "g_source", "start"]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in names), pa.array(list(mean), pa.list_(pa.float64())), pa.array(list(inverse), pa.list_(pa.float64())), pa.array(logdet)],
                [*names, "centre", "inverse", "logdet"],
            )

    return rows.mapInArrow(solve, "g_lang string, g_source string, start int, centre array<double>, inverse array<double>, logdet double")


def _distance() -> Column:
    gap = [F.col(c) / UNIT - F.col("centre")[i] for i, c in enumerate(STATISTICS)]
    total = F.lit(0.0)
    for i in range(P):
        for j in range(i, P):
            total = total + gap[i] * gap[j] * F.col("inverse")[i * P + j] * (1 if i == j else 2)
    return total


def _bin(distance: Column) -> Column:
    return F.floor(F.log2(F.greatest(distance, F.lit(2.0**-20))) * BINS_PER_OCTAVE).cast("int")


def _with_parents(sums: DataFrame) -> DataFrame:
    """Add the sums of a group's language and of all groups; these tables have a row a group."""
    total = [F.sum(c).alias(c) for c in ("n", *SUMS)]
    named = lambda df, p: df.withColumnsRenamed({c: p + c for c in ("n", *SUMS)})
    lang = named(sums.groupBy("g_lang", "start").agg(*total), "l_")
    everything = named(sums.groupBy("start").agg(*total), "a_")
    return named(sums, "g_").join(lang, ["g_lang", "start"]).join(everything, ["start"])


def _starts(vectors: DataFrame) -> DataFrame:
    """Two starts for each group: medians and quartile ranges of the group, and those of all documents.

    Medians and ranges come from counts in bins of 1/16, as moments of 100 documents at the centre.
    """
    long = vectors.select(
        *GROUP,
        F.posexplode(F.array(*[F.floor(F.col(c) / (UNIT // 16)).cast("int") for c in STATISTICS])).alias("dim", "bin"),
    )
    counts = stage_table(long.groupBy(*GROUP, "dim", "bin").agg(F.count(F.lit(1)).alias("n")), "bins")

    def quartiles(rows: DataFrame, keys: list[str]) -> DataFrame:
        within = Window.partitionBy(*keys, "dim")
        running = rows.withColumn("upto", F.sum("n").over(within.orderBy("bin"))).withColumn("all", F.sum("n").over(within))
        at = lambda q: F.min(F.when(F.col("upto") >= q * F.col("all"), F.col("bin")))
        found = running.groupBy(*keys, "dim").agg(
            F.first("all").alias("n"), at(0.25).alias("low"), at(0.5).alias("mid"), at(0.75).alias("high")
        )
        middle, spread = (F.col("mid") + 0.5) * (UNIT / 16), (F.col("high") - F.col("low") + 1) * (UNIT / 16) / 1.349
        picks = [F.first("n").alias("n")]
        for i in range(P):
            picks.append(F.max(F.when(F.col("dim") == i, middle)).alias(f"s{i}"))
            picks.append(F.max(F.when(F.col("dim") == i, spread)).alias(f"r{i}"))
        means = found.groupBy(*keys).agg(*picks)
        moments = [
            (F.col(f"s{i}") * F.col(f"s{j}") + (F.col(f"r{i}") * F.col(f"r{i}") if i == j else F.lit(0.0))).alias(f"s{i}{j}")
            for i, j in PAIRS
        ]
        wide = means.select(*keys, "n", *[f"s{i}" for i in range(P)], *moments)
        return wide.withColumns({c: F.col(c) * F.col("n") for c in SUMS})

    own = quartiles(counts, GROUP).withColumn("start", F.lit(0))
    pooled = counts.groupBy("dim", "bin").agg(F.sum("n").alias("n"))
    whole = quartiles(pooled.withColumn("_all", F.lit(1)), ["_all"]).drop("n")
    groups = counts.filter("dim = 0").groupBy(*GROUP).agg(F.sum("n").alias("n"))
    # One row for all groups, joined by a constant.
    shared = groups.withColumn("_all", F.lit(1)).join(F.broadcast(whole), "_all")
    return own.unionByName(shared.withColumn("start", F.lit(1)).select(own.columns))


def fit(vectors: DataFrame) -> DataFrame:
    """Centre, inverse scatter and start of each (language, source) by minimum covariance determinant.

    ``vectors`` has ``g_lang``, ``g_source`` and the rounded statistics; it is read once a step.
    """
    params = _solve(_with_parents(_starts(vectors)), 1.0)
    factor = _consistency(SUBSET)
    for _ in range(STEPS):
        params = _solve(_with_parents(_nearest(vectors, params, None)), factor)
    best = Window.partitionBy(*GROUP).orderBy("logdet", "start")
    params = params.withColumn("_n", F.row_number().over(best)).filter("_n = 1").drop("_n")
    cut = chi_square_quantile(0.975, P)
    return _solve(_with_parents(_nearest(vectors, params, cut)), _consistency(0.975))


def _nearest(vectors: DataFrame, params: DataFrame, cut: float | None) -> DataFrame:
    """Sums over the documents of each group and start that are nearest to its centre.

    Without ``cut`` the fewest whole bins that hold the share ``SUBSET`` of the group, else the bins up to ``cut``.
    """
    keys = [*GROUP, "start"]
    rows = attach(vectors, params, GROUP, how="inner").withColumn("bin", _bin(_distance()))
    bins = rows.groupBy(*keys, "bin").agg(F.count(F.lit(1)).alias("n"), *_sums())
    if cut is None:
        # At most some hundred bins a group, of any size.
        within = Window.partitionBy(*keys)
        bins = (
            bins.withColumn("upto", F.sum("n").over(within.orderBy("bin")))
            .withColumn("all", F.sum("n").over(within))
            .filter(F.col("upto") - F.col("n") < SUBSET * F.col("all"))
        )
    else:
        bins = bins.withColumn("nearest", F.min("bin").over(Window.partitionBy(*keys))).filter(
            F.col("bin") <= F.greatest(F.lit(math.floor(math.log2(cut) * BINS_PER_OCTAVE)), F.col("nearest"))
        )
    return bins.groupBy(*keys).agg(F.sum("n").alias("n"), *[F.sum(c).alias(c) for c in SUMS])


def judge(docs: DataFrame, keys: list[str], only_kept: bool = False) -> DataFrame:
    """The columns ``keys``, the counts, ``base_failed``, ``distance`` and ``kept`` for each row.

    With ``only_kept`` the columns ``keys`` of the rows that are kept.

    Null languages and sources are groups of their own. A null text is empty, so it fails the base rules. Documents that
    fail them take no part in the estimates and have a null distance. Equal rows are judged alike. An
    empty table gives an empty table.
    """
    group = [
        F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("")).alias(g)
        for c, g in zip(("lang", "source"), GROUP)
    ]
    internal = [f"_k{i}" for i in range(len(keys))]
    rows = docs.select(*[F.col(k).alias(i) for k, i in zip(keys, internal)], *group, "text")
    narrow = [i for k, i in zip(keys, internal) if k != "text"]
    rated = lambda df: df.withColumn("base_failed", base_failed()).select("*", *_statistics())
    counted = stage_table(add_counts(rows, [*narrow, *GROUP]), "counts")
    params = fit(rated(counted).filter(~F.col("base_failed")).select(*GROUP, *STATISTICS))
    if "text" in keys:
        # Counting once more is cheaper than a second copy of all texts on disk.
        counted = add_counts(rows, [*internal, *GROUP])
    cut = chi_square_quantile(1 - BEYOND_CUT, P)
    judged = attach(rated(counted), params, GROUP).withColumn(
        "distance", F.when(~F.col("base_failed"), F.sqrt(_distance()))
    )
    kept = ~F.col("base_failed") & F.coalesce(F.col("distance") * F.col("distance") <= cut, F.lit(True))
    if only_kept:
        return judged.filter(kept).select(*[F.col(i).alias(k) for k, i in zip(keys, internal)])
    return judged.select(
        *[F.col(i).alias(k) for k, i in zip(keys, internal)], *COUNTS, "base_failed", "distance", kept.alias("kept")
    )
