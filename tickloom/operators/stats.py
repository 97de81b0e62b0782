"""Per-feature statistics, scaling by them, and comparison of two tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.functions.columns import clip, ratio
from tickloom.plans import Series, attach, running

# Added to divisors, and the range under which a feature is constant.
EPSILON = 1e-8
SHARPE_EPSILON = 1e-6
PERIODS_PER_YEAR = 252


def _by_feature(
    df: DataFrame, key: Sequence[str], features: Sequence[str], measures: Mapping[str, object]
) -> DataFrame:
    """Aggregate every feature in one pass, then turn the few result rows to (key, feature)."""
    wide = df.groupBy(*key).agg(
        *[make(F.col(f)).alias(f"{f}__{m}") for f in features for m, make in measures.items()]
    )
    entries = F.array(
        *[
            F.struct(F.lit(f).alias("feature"), *[F.col(f"{f}__{m}").alias(m) for m in measures])
            for f in features
        ]
    )
    return wide.select(*key, F.explode(entries).alias("_e")).select(*key, "_e.*")


def feature_stats(df: DataFrame, key: Sequence[str], features: Sequence[str]) -> DataFrame:
    """Mean, sample deviation, minimum and maximum per key and feature."""
    return _by_feature(
        df, key, features,
        {"mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max},
    )


def norm_stats(df: DataFrame, key: Sequence[str], features: Sequence[str]) -> DataFrame:
    """Mean, population deviation and largest absolute value per key and feature."""
    return _by_feature(
        df, key, features,
        {"mean": F.avg, "std": F.stddev_pop, "max_abs": lambda c: F.max(F.abs(c))},
    )


def minmax_stats(df: DataFrame, key: Sequence[str], features: Sequence[str]) -> DataFrame:
    """Range per key and feature, flagged when it is (nearly) one value."""
    ranges = _by_feature(df, key, features, {"min": F.min, "max": F.max})
    return ranges.withColumn("is_constant", F.col("max") - F.col("min") < EPSILON)


def _wide(df: DataFrame, key: Sequence[str], features: Sequence[str], measures: Mapping[str, object]) -> DataFrame:
    return df.groupBy(*key).agg(
        *[make(F.col(f)).alias(f"_{m}_{f}") for f in features for m, make in measures.items()]
    )


def standard_scale(df: DataFrame, key: Sequence[str], column: str, name: str = "scaled") -> DataFrame:
    """(x - mean) / population deviation per key over rows that have the column."""
    present = df.dropna(subset=[column])
    stats = present.groupBy(*key).agg(F.avg(column).alias("_mean"), F.stddev_pop(column).alias("_std"))
    rows = attach(present, stats, key, null_safe=True)
    by = F.when(F.col("_std") == 0, F.lit(1.0)).otherwise(F.col("_std"))
    return rows.withColumn(name, (F.col(column) - F.col("_mean")) / by).drop("_mean", "_std")


def minmax_scale(df: DataFrame, key: Sequence[str], features: Sequence[str]) -> DataFrame:
    """Each feature to [-1, 1] per key; the ranges stay in ``_min_*`` / ``_max_*`` for the inverse."""
    rows = attach(df, _wide(df, key, features, {"min": F.min, "max": F.max}), key, null_safe=True)

    def scaled(f: str) -> Column:
        low, high = F.col(f"_min_{f}"), F.col(f"_max_{f}")
        return clip(2 * (F.col(f) - low) / (high - low + EPSILON) - 1, -1.0, 1.0)

    return rows.withColumns({f: scaled(f) for f in features})


def minmax_inverse(scaled: DataFrame, features: Sequence[str]) -> DataFrame:
    """Undo ``minmax_scale``; features without a range stay as they are."""

    def original(f: str) -> Column:
        low, high = F.col(f"_min_{f}"), F.col(f"_max_{f}")
        return F.when(F.abs(high - low) > EPSILON, (F.col(f) + 1) / 2 * (high - low) + low).otherwise(F.col(f))

    restored = scaled.withColumns({f: original(f) for f in features})
    return restored.drop(*[f"_{m}_{f}" for f in features for m in ("min", "max")])


def normalise(
    rows: DataFrame, key: Sequence[str], features: Sequence[str], stats_of: DataFrame | None = None
) -> DataFrame:
    """Add z-score and value / max-abs of each feature, from ``stats_of`` (default: the rows).

    Without statistics for a key both are 0.
    """
    measures = {"mean": F.avg, "std": F.stddev_pop, "max_abs": lambda c: F.max(F.abs(c))}
    stats = _wide(stats_of if stats_of is not None else rows, key, features, measures)
    out = attach(rows, stats, key, null_safe=True)
    columns = {}
    for f in features:
        mean, std, top = (F.col(f"_{m}_{f}") for m in measures)
        columns[f"{f}_zscore"] = F.coalesce((F.col(f) - mean) / (std + EPSILON), F.lit(0.0))
        columns[f"{f}_norm"] = F.coalesce(F.col(f) / (top + EPSILON), F.lit(0.0))
    return out.withColumns(columns).drop(*[f"_{m}_{f}" for f in features for m in measures])


def distribution_compare(
    real: DataFrame, synth: DataFrame, key: Sequence[str], features: Sequence[str]
) -> DataFrame:
    """Mean, population deviation, minimum and maximum of two tables side by side."""
    measures = {"mean": F.avg, "std": F.stddev_pop, "min": F.min, "max": F.max}

    def one(df: DataFrame, tag: str) -> DataFrame:
        out = _by_feature(df, key, features, measures)
        return out.withColumnsRenamed({m: f"{tag}_{m}" for m in measures})

    return one(real, "real").join(one(synth, "synth"), [*key, "feature"], "inner")


def ks_2sample(real: DataFrame, synth: DataFrame, key: Sequence[str], features: Sequence[str]) -> DataFrame:
    """Two-sample Kolmogorov-Smirnov distance and asymptotic p-value per key and feature.

    Equal values are merged before the running counts, so both the shuffle and
    the sort see distinct values only.
    """

    def tagged(df: DataFrame, real_one: int) -> DataFrame:
        pairs = F.array(
            *[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("value")) for f in features]
        )
        return df.select(
            *key, F.explode(pairs).alias("_p"), F.lit(real_one).alias("_a"), F.lit(1 - real_one).alias("_b")
        ).select(*key, "_p.*", "_a", "_b")

    pooled = tagged(real, 1).unionByName(tagged(synth, 0)).filter(F.col("value").isNotNull())
    merged = pooled.groupBy(*key, "feature", "value").agg(F.sum("_a").alias("_a"), F.sum("_b").alias("_b"))
    group = [*key, "feature"]
    totals = pooled.groupBy(*group).agg(F.sum("_a").alias("n_real"), F.sum("_b").alias("n_synth"))
    counted = running(
        merged, Series.of(group, "value"), {"_ca": F.col("_a"), "_cb": F.col("_b")}, measure=pooled
    )
    gaps = attach(counted, totals, group, null_safe=True)
    gap = F.abs(ratio(F.col("_ca"), F.col("n_real")) - ratio(F.col("_cb"), F.col("n_synth")))
    out = gaps.groupBy(*group).agg(
        F.max(gap).alias("ks_statistic"), F.first("n_real").alias("n_real"), F.first("n_synth").alias("n_synth")
    )
    size = F.sqrt(ratio(F.col("n_real") * F.col("n_synth"), F.col("n_real") + F.col("n_synth")))
    return out.withColumn("p_value", kolmogorov_tail(size * F.col("ks_statistic")))


def kolmogorov_tail(x: Column) -> Column:
    """2 * sum of (-1)^(k-1) exp(-2 k^2 x^2); 1 where x is too small for the series."""
    terms = F.transform(
        F.sequence(F.lit(1), F.lit(100)),
        lambda k: F.when(k % 2 == 1, 1.0).otherwise(-1.0) * F.exp(-2.0 * k * k * x * x),
    )
    total = 2 * F.aggregate(terms, F.lit(0.0), lambda s, t: s + t)
    return F.when(x < 0.2, F.lit(1.0)).otherwise(clip(total, 0.0, 1.0))


def distinct_products(*frames: DataFrame) -> DataFrame:
    """Sorted product names over all frames."""
    names = [f.select("product") for f in frames]
    return reduce(DataFrame.unionByName, names).distinct().orderBy("product")


def distinct_times(df: DataFrame, time: str = "timestamp") -> DataFrame:
    return df.select(time).distinct().orderBy(time)


def row_counts(df: DataFrame, key: Sequence[str]) -> DataFrame:
    return df.groupBy(*key).agg(F.count(F.lit(1)).alias("n_rows"))


def min_rows_report(
    df: DataFrame, key: Sequence[str], features: Sequence[str], length: int, min_features: int = 5, min_sequences: int = 10
) -> DataFrame:
    """Per key: rows, sequences of ``length``, and whether both counts suffice for training."""
    from tickloom.operators.sequences import sequence_length

    counts = row_counts(df, key)
    usable = sequence_length(F.col("n_rows"), length)
    return counts.withColumns(
        {
            "n_features": F.lit(len(features)).cast("long"),
            "n_sequences": F.coalesce(F.col("n_rows") - usable + 1, F.lit(0)).cast("long"),
        }
    ).withColumn(
        "is_enough", (F.col("n_features") >= min_features) & (F.col("n_sequences") >= min_sequences)
    )


def missing_products(asked: DataFrame, df: DataFrame) -> DataFrame:
    """Asked-for products without a row."""
    return asked.join(df.select("product").distinct(), "product", "left_anti")


def sharpe(reward: Column) -> Column:
    return F.avg(reward) / (F.stddev_pop(reward) + SHARPE_EPSILON) * F.sqrt(F.lit(float(PERIODS_PER_YEAR)))


def by_product_parameters(df: DataFrame, params: DataFrame, defaults: Mapping[str, object]) -> DataFrame:
    """Add each product's parameters, the defaults for products without any."""
    names = list(defaults)
    out = attach(df, params.select("product", *names), ["product"])
    return out.withColumns({n: F.coalesce(F.col(n), F.lit(v)) for n, v in defaults.items()})
