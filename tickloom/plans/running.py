"""Running totals and last-seen values over series of any length."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.plans.joins import match
from tickloom.plans.series import Layout, Series, arrange
from tickloom.plans.settings import BROADCAST_SLICES, settle, size_setting


def running(
    df: DataFrame,
    series: Series,
    sums: Mapping[str, Column] | None = None,
    lasts: Mapping[str, Column] | None = None,
    measure: DataFrame | None = None,
) -> DataFrame:
    """Add inclusive running sums and the last non-NULL value so far."""
    return run_over(arrange(df, series, measure=measure).owned(), sums, lasts).rows()


def run_over(
    layout: Layout,
    sums: Mapping[str, Column] | None = None,
    lasts: Mapping[str, Column] | None = None,
    before: Mapping[str, Column] | None = None,
) -> Layout:
    """The same over a layout without context copies.

    ``before`` gives the last non-NULL value of the rows before the current one.
    A long series is summed block by block; one small table of block totals
    carries what came before each block.
    """
    sums, lasts, before = dict(sums or {}), dict(lasts or {}), dict(before or {})
    so_far = layout.window.rowsBetween(Window.unboundedPreceding, 0)
    till_now = layout.window.rowsBetween(Window.unboundedPreceding, -1)
    local = {n: F.sum(c).over(so_far) for n, c in sums.items()}
    local |= {n: F.last(c, ignorenulls=True).over(so_far) for n, c in lasts.items()}
    local |= {n: F.last(c, ignorenulls=True).over(till_now) for n, c in before.items()}
    if not layout.split:
        return layout.with_df(layout.df.withColumns(local))

    series = layout.series
    if any(c.startswith("-") for c in series.order):
        raise ValueError("running values need an ascending order")
    at = F.struct(*series.order_names)
    carried = lasts | before
    totals = layout.df.groupBy(*layout.parts).agg(
        *[F.sum(c).alias(f"_p_{n}") for n, c in sums.items()],
        *[F.max_by(c, F.when(c.isNotNull(), at)).alias(f"_p_{n}") for n, c in carried.items()],
    )
    earlier = Window.partitionBy(*series.key).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(
        *layout.parts,
        *[F.sum(f"_p_{n}").over(earlier).alias(f"_p_{n}") for n in sums],
        *[F.last(f"_p_{n}", ignorenulls=True).over(earlier).alias(f"_p_{n}") for n in carried],
    ).filter(F.col("_block") > 0)
    totals = settle(totals)
    if totals.count() <= size_setting(layout.df.sparkSession, BROADCAST_SLICES):
        totals = F.broadcast(totals)
    rows = match(layout.df.withColumns(local), totals, layout.parts, "left", True)
    whole = {n: F.coalesce(F.col(n) + F.col(f"_p_{n}"), F.col(n), F.col(f"_p_{n}")) for n in sums}
    whole |= {n: F.coalesce(F.col(n), F.col(f"_p_{n}")) for n in carried}
    return layout.with_df(rows.withColumns(whole).drop(*[f"_p_{n}" for n in whole]))
