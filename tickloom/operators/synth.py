"""Synthetic feature rows from per-feature statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.functions.columns import clip, plus_minutes
from tickloom.operators.stats import distribution_compare, feature_stats, ks_2sample
from tickloom.plans import attach

# Ticks between synthetic rows, rows made by one task step.
TICK = 100
ROWS_PER_CHUNK = 100_000


def normal_draw(*parts: Column) -> Column:
    """A standard normal number fixed by its parts, so a rerun task draws the same."""
    text = F.concat_ws("|", *[p.cast("string") for p in parts])

    def uniform(salt: int) -> Column:
        # 48 bits of a digest that every engine has.
        bits = F.conv(F.substring(F.md5(F.concat(text, F.lit(f"|{salt}"))), 1, 12), 16, 10).cast("double")
        return (bits + 0.5) / 2.0**48

    return F.sqrt(-2.0 * F.ln(uniform(1))) * F.cos(2.0 * F.pi() * uniform(2))


def gaussian_synth(
    df: DataFrame, key: Sequence[str], features: Sequence[str], n_rows: int, seed: int = 0, time: str = "timestamp"
) -> DataFrame:
    """``n_rows`` rows per key: independent normals by mean and deviation, kept in the real range."""
    stats = feature_stats(df, key, features)
    wide = stats.groupBy(*key).pivot("feature", list(features)).agg(
        F.first(F.struct("mean", "std", "min", "max"))
    ) if len(features) > 1 else stats.select(
        *key, F.struct("mean", "std", "min", "max").alias(features[0])
    )
    # Rows grow out of the statistics in two steps, so a large set is made by many tasks.
    if n_rows <= 0:
        wide = wide.limit(0)
    chunks = wide.withColumn(
        "_chunk", F.explode(F.sequence(F.lit(0), F.lit(max(0, (n_rows - 1) // ROWS_PER_CHUNK))))
    )
    if n_rows > ROWS_PER_CHUNK:
        chunks = chunks.repartition(*key, "_chunk")
    start = F.col("_chunk").cast("long") * ROWS_PER_CHUNK
    stop = F.least(start + ROWS_PER_CHUNK, F.lit(max(n_rows, 1)).cast("long")) - 1
    rows = chunks.withColumn("_i", F.explode(F.sequence(start, stop)))

    def value(f: str) -> Column:
        drawn = normal_draw(F.lit(seed), F.lit(f), *[F.col(k) for k in key], F.col("_i"))
        return clip(
            F.col(f)["mean"] + F.coalesce(F.col(f)["std"], F.lit(0.0)) * drawn, F.col(f)["min"], F.col(f)["max"]
        ).alias(f)

    return rows.select(
        *key, *[value(f) for f in features if f != time], (F.col("_i") * TICK).alias(time)
    )


def synth_validate(
    real: DataFrame, synth: DataFrame, key: Sequence[str], features: Sequence[str]
) -> DataFrame:
    """Moments, ranges and Kolmogorov-Smirnov test of real against synthetic, per feature."""
    compared = distribution_compare(real, synth, key, features)
    tested = ks_2sample(real, synth, key, features)
    return compared.join(tested, [*key, "feature"], "inner")


def synthetic_time(
    synth: DataFrame,
    row_number: str,
    real: DataFrame,
    time: str,
    after_last: bool = False,
    key: Sequence[str] = (),
) -> DataFrame:
    """A minute per synthetic row from the last real time on (or one minute after it).

    With ``key`` every product goes on from its own last time; one without real rows gets NULL.
    """
    minutes = F.col(row_number) + (1 if after_last else 0)
    last = F.max(time).alias("_last")
    if key:
        out = attach(synth, real.groupBy(*key).agg(last), key)
    else:
        out = synth.withColumn("_last", real.agg(last).scalar())
    return out.withColumn(time, plus_minutes(F.col("_last"), minutes)).drop("_last")


def carry_constants(
    synth: DataFrame,
    real: DataFrame,
    columns: Sequence[str],
    order: Sequence[str],
    day: str | None = None,
    key: Sequence[str] = (),
) -> DataFrame:
    """Give synthetic rows the first real value of each other column, and the day after the last.

    All come from one scan of ``real``. With ``key`` every product has its own; one without real rows gets NULL.
    """
    picks = [F.min_by(F.struct(*columns), F.struct(*order)).alias("_first")] if columns else []
    if day is not None:
        picks.append((F.max(day) + 1).alias("_day"))
    if not picks:
        return synth
    if key:
        out = attach(synth, real.groupBy(*key).agg(*picks), key)
    else:
        # One scalar of one struct, so one scan.
        out = synth.withColumn("_real", real.agg(*picks).select(F.struct("*")).scalar()).select("*", "_real.*").drop("_real")
    out = out.withColumns({c: F.col("_first")[c] for c in columns}) if columns else out
    out = out.withColumn(day, F.col("_day")) if day is not None else out
    return out.drop("_first", "_day")


def training_table(real: DataFrame, synth: DataFrame, order: Sequence[str]) -> DataFrame:
    """Real and synthetic rows together, by column name, in time order."""
    return real.unionByName(synth, allowMissingColumns=True).orderBy(*order)
