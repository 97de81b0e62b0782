"""Positions under a limit, their rewards, trades and profit and loss.

A clamped position is no window sum: a blocked step forgets what it clipped.
But each step is a function ``x -> min(hi, max(lo, x + shift))``, and running
one such function after another gives one of the same form, so positions are a
scan (``plans/scan.py``) over blocks. Orders that fill, and orders that are refused whole, are
scans too, with other functions (``fills.py``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.functions.columns import ratio
from tickloom.operators.stats import sharpe
from tickloom.plans import Layout, Series, arrange, attach, run_over
from tickloom.plans.scan import Clamps, scan

# Position change per action, in lots of an agent and in halves of a limit.
AGENT_LOTS = (-10, -5, 0, 5, 10)
LIMIT_HALVES = (-2, -1, 0, 1, 2)


def action_lots(action: Column) -> Column:
    """Action 0..4 as a position change in lots; anything else holds."""
    lots = F.when(action == 0, AGENT_LOTS[0])
    for a in (1, 3, 4):
        lots = lots.when(action == a, AGENT_LOTS[a])
    return lots.otherwise(0).cast("long")


def action_limit_steps(action: Column, limit: Column) -> Column:
    """Action 0..4 as a position change in halves of the limit."""
    return (action.cast("long") - 2) * F.floor(limit / 2)


def clamped_position(
    df: DataFrame, series: Series, delta: Column, limit: Column, start: DataFrame | None = None
) -> DataFrame:
    """Add ``position_before``, ``position`` and ``change`` of a position kept within ±limit.

    The limit may change from row to row; each row's own limit holds when it is applied.
    ``start`` may hold a position per key (columns: key, ``position``) to go on from.
    """
    return hold(arrange(df, series), delta, limit, start).rows()


def hold(layout: Layout, delta: Column, limit: Column, start: DataFrame | None = None) -> Layout:
    """``clamped_position`` over a layout, which later steps can go on using."""
    return scan(layout, Clamps(), {"delta": delta, "limit": limit}, start)


def trade_side(change: Column) -> Column:
    return F.when(change > 0, "BUY").when(change < 0, "SELL").otherwise("HOLD")


def executed_trades(positions: DataFrame, price: str = "price") -> DataFrame:
    """Rows whose position moved, as trades: side, quantity, price."""
    moved = positions.filter(F.col("change") != 0)
    return moved.withColumns(
        {
            "trade_side": trade_side(F.col("change")),
            "trade_quantity": F.abs("change"),
            "trade_price": F.col(price),
        }
    )


def position_features(position: Column, limit: Column) -> dict[str, Column]:
    return {
        "position_share": ratio(position, limit),
        "is_long": F.when(position > 0, 1.0).otherwise(0.0),
        "is_short": F.when(position < 0, 1.0).otherwise(0.0),
    }


def pair_profit(side: str, price: str, quantity: str, prev: str) -> Column:
    """Profit of a trade that reverses the one before it, over the smaller quantity."""
    before_side, before_price, before_quantity = (F.col(f"{prev}.{n}") for n in ("side", "price", "quantity"))
    size = F.least(F.col(quantity), before_quantity)
    return (
        F.when((before_side == "BUY") & (F.col(side) == "SELL"), (F.col(price) - before_price) * size)
        .when((before_side == "SELL") & (F.col(side) == "BUY"), (before_price - F.col(price)) * size)
        .otherwise(F.lit(0.0))
    )


def _trade_so_far(price: str) -> Column:
    """The row's trade as a struct; NULL where the position did not move."""
    return F.when(
        F.col("change") != 0,
        F.struct(
            trade_side(F.col("change")).alias("side"),
            F.col(price).cast("double").alias("price"),
            F.abs("change").alias("quantity"),
        ),
    )


def _with_gain(held: Layout, price: str, opening: DataFrame | None = None) -> Layout:
    """Add the last trade so far, the one before this row's, and this row's realized gain.

    ``opening`` holds a last trade (``last_trade``) and profit (``realized``) per
    key from an earlier part of the series.
    """
    trade = _trade_so_far(price)
    # Read twice when split: for the totals of the blocks and for the rows.
    seen = run_over(held.settled("positions"), lasts={"_last": trade}, before={"_prev": trade})
    df = seen.df
    if opening is not None:
        df = attach(df, opening, held.series.key, null_safe=True)
        df = df.withColumns(
            {"_last": F.coalesce("_last", "last_trade"), "_prev": F.coalesce("_prev", "last_trade")}
        )
    df = df.withColumns({"_side": trade_side(F.col("change")), "_size": F.abs("change")})
    gain = F.when(F.col("change") != 0, pair_profit("_side", price, "_size", "_prev")).otherwise(F.lit(0.0))
    return seen.with_df(df.withColumn("_gain", gain).drop("_prev", "_side", "_size"))


def realized_pnl(held: Layout, price: str = "price") -> DataFrame:
    """Profit over consecutive opposite trades and the number of trades, per key."""
    gains = _with_gain(held, price).df
    return gains.groupBy(*held.series.key).agg(
        F.sum("_gain").alias("realized_pnl"), F.count_if(F.col("change") != 0).alias("n_trades")
    )


def mark_to_market(held: Layout, price: str = "price", opening: DataFrame | None = None) -> Layout:
    """Add realized, open and total profit and the last trade after each row of ``hold``."""
    gains = _with_gain(held, price, opening)
    summed = run_over(gains, sums={"realized_pnl": F.col("_gain")})
    df = summed.df
    realized = F.col("realized_pnl")
    if opening is not None:
        realized = realized + F.coalesce("realized", F.lit(0.0))
    position, last = F.col("position"), F.col("_last")
    gain = (
        F.when((position == 0) | last.isNull(), F.lit(0.0))
        .when(last["side"] == "BUY", (F.col(price) - last["price"]) * position)
        .otherwise((last["price"] - F.col(price)) * F.abs(position))
    )
    df = df.withColumn("realized_pnl", realized).withColumns(
        {"unrealized_pnl": gain, "pnl": F.col("realized_pnl") + gain, "last_trade": last}
    )
    return summed.with_df(df.drop("_last", "_gain", "realized"))


def step_rewards(
    df: DataFrame,
    series: Series,
    action: str = "action",
    price: str = "mid_price",
    limit: int = 100,
    cost: float = 0.001,
    history_window: int = 10,
) -> Layout:
    """One row per step: position, reward, and the next row's time and price.

    The first ``history_window`` rows and the last row of a series have no step.
    """
    layout = arrange(df, series, back=history_window, ahead=1)
    time = series.order_names[0]
    looked = layout.with_df(
        layout.df.withColumns(
            {
                "_seen": F.count(F.lit(1)).over(layout.last(history_window + 1)),
                "next_price": F.lead(price).over(layout.window),
                f"next_{time}": F.lead(time).over(layout.window),
                "_has_next": F.lead(F.lit(True)).over(layout.window),
            }
        )
    ).owned()
    steps = looked.df.filter((F.col("_seen") > history_window) & F.col("_has_next"))
    bound = F.lit(limit).cast("long")
    held = hold(
        looked.with_df(steps.drop("_seen", "_has_next")), action_limit_steps(F.col(action), bound), bound
    )
    reward = F.col("position") * (F.col("next_price") - F.col(price)) - F.abs("change") * F.col(price) * cost
    return held.with_df(held.df.withColumn("reward", reward))


def cumulative_pnl(stepped: Layout, reward: str = "reward", name: str = "pnl") -> Layout:
    return run_over(stepped.settled("rewards"), sums={name: F.col(reward)})


def trade_log(stepped: Layout) -> DataFrame:
    """Steps that moved the position, with the time and price of the row after."""
    time = stepped.series.order_names[0]
    moved = stepped.rows().filter(F.col("change") != 0)
    return moved.withColumns({"trade_time": F.col(f"next_{time}"), "trade_price": F.col("next_price")})


def _n_changes(series: Series) -> Column:
    """Rows whose position differs from the row before; the first row has none before it."""
    first_moved = F.min_by(F.col("change") != 0, F.struct(*series.order_names)).cast("long")
    return F.count_if(F.col("change") != 0) - first_moved


def position_changes(stepped: Layout) -> DataFrame:
    """Position changes per key, by partial aggregation."""
    rows = stepped.rows()
    return rows.groupBy(*stepped.series.key).agg(_n_changes(stepped.series).alias("n_changes"))


def backtest_summary(stepped: Layout) -> DataFrame:
    """Total reward, yearly Sharpe ratio, largest position and position changes per key."""
    rows = stepped.rows()
    return rows.groupBy(*stepped.series.key).agg(
        F.sum("reward").alias("total_reward"),
        sharpe(F.col("reward")).alias("sharpe_ratio"),
        F.max(F.abs("position")).alias("max_position"),
        _n_changes(stepped.series).alias("n_changes"),
        F.count(F.lit(1)).alias("n_steps"),
    )


def signals_per_product(held: Layout, price: str = "price") -> DataFrame:
    """Non-hold signals (side, quantity) in order, numbered from 0 per key."""
    moved = F.when(F.col("change") != 0, 1).otherwise(0).cast("long")
    numbered = run_over(held.settled("positions"), sums={"signal_number": moved}).rows()
    return executed_trades(numbered, price).withColumn("signal_number", F.col("signal_number") - 1)
