"""Scoring actions and labelling directions over tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.functions.columns import dot, feature_vector, log_ratio, ratio
from tickloom.operators.sequences import last_row
from tickloom.operators.stats import normalise
from tickloom.plans import Series, arrange, attach


def q_scores(features: Column, weights: Sequence[Sequence[float]]) -> Column:
    """One linear score per action: weights[action] . features."""
    rows = [F.array(*[F.lit(float(w)) for w in row]) for row in weights]
    return F.array(*[dot(row, features) for row in rows])


def best_action(scores: Column) -> Column:
    """The highest score's action, the first on a tie."""
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("long")


def mask_scores(scores: Column, position: Column, limit: Column) -> Column:
    """Bar buys (actions 3, 4) at the upper limit and sells (0, 1) at the lower."""
    barred = F.lit(float("-inf"))
    return F.transform(
        scores,
        lambda s, a: F.when((position >= limit) & (a >= 3), barred)
        .when((position <= -limit) & (a < 2), barred)
        .otherwise(s),
    )


def direction_labels(df: DataFrame, series: Series, price: str = "price") -> DataFrame:
    """Log return to each row from the one before, and 1 where it is positive.

    Rows without a return are left out.
    """
    layout = arrange(df, series, back=1)
    returned = layout.df.withColumn("r", log_ratio(F.col(price), F.lag(price).over(layout.window)))
    labelled = layout.finish(returned).filter(F.col("r").isNotNull())
    return labelled.withColumn("direction", F.when(F.col("r") > 0, 1).otherwise(0).cast("long"))


def direction_reward(action: Column, direction: Column, r: Column) -> Column:
    """+|r| for the right direction, -|r| for the wrong one."""
    return F.when(action == direction, F.abs(r)).otherwise(-F.abs(r))


def feature_momentum(df: DataFrame, series: Series, features: Sequence[str]) -> DataFrame:
    """Each feature minus its previous value; 0 on the first row."""
    layout = arrange(df, series, back=1)
    moves = {
        f"{f}_momentum": F.coalesce(F.col(f) - F.lag(f).over(layout.window), F.lit(0.0)) for f in features
    }
    return layout.finish(layout.df.withColumns(moves))


def agent_features(
    df: DataFrame, series: Series, features: Sequence[str], position: Column, limit: Column
) -> DataFrame:
    """One vector per row: features; then value, z-score, norm and momentum of each; then position."""
    rows = normalise(feature_momentum(df, series, features), series.key, features)
    indicators = [c for f in features for c in (f, f"{f}_zscore", f"{f}_norm", f"{f}_momentum")]
    held = F.array(
        ratio(position, limit),
        F.when(position > 0, 1.0).otherwise(0.0),
        F.when(position < 0, 1.0).otherwise(0.0),
    )
    return rows.withColumn(
        "feature_vector", F.concat(feature_vector(features), feature_vector(indicators), held)
    )


def observation(features: Sequence[str], position: Column, limit: Column, pnl: Column) -> Column:
    """Feature row, position share and profit so far as a float vector."""
    return F.concat(
        feature_vector(features), F.array(ratio(position, limit).cast("double"), pnl.cast("double"))
    ).cast("array<float>")


def last_observations(
    stepped: DataFrame, df: DataFrame, series: Series, features: Sequence[str], limit: Column
) -> DataFrame:
    """The observation after the last step of each key: its last row of ``df`` with the position and ``pnl`` its steps have left.

    Keys without a step have none.
    """
    order = F.struct(*series.order_names)
    ended = stepped.groupBy(*series.key).agg(*[F.max_by(c, order).alias(f"_{c}") for c in ("position", "pnl")])
    last = attach(last_row(df, series), ended, series.key, how="inner", null_safe=True)
    return last.withColumn("observation", observation(features, F.col("_position"), limit, F.col("_pnl"))).drop("_position", "_pnl")
