"""Rule-based fair prices, target sizes and orders from a book's recent mids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.functions.columns import clip, ratio, truncate
from tickloom.operators.book import two_sided
from tickloom.operators.fills import filled_positions
from tickloom.operators.stats import by_product_parameters
from tickloom.plans import Layout, Series, arrange

# Fixed values of the rules: rows of history, of the short and the long mean.
HISTORY, SHORT, LONG = 30, 5, 15
TREND_THRESHOLD = 0.2
BASE_SIZE = 15
MOMENTUM_SCALING = 2.0
MIN_FACTOR, MAX_FACTOR = 0.7, 3.0
DEFAULTS = {
    "momentum_weight": 0.6,
    "min_position": 15,
    "volatility_threshold": 1.2,
    "zscore_threshold": 0.5,
    "position_limit": 50,
}


def history_columns(at: Layout, price: str = "mid_price") -> dict[str, Column]:
    """Mean and deviation of the last 30 prices, short and long means, short volatility."""
    history, short, long = at.last(HISTORY), at.last(SHORT), at.last(LONG)
    n = F.count(price).over(history)
    spread = F.stddev_pop(price).over(history)
    return {
        "history_rows": n,
        "history_mean": F.avg(price).over(history),
        "history_std": F.when((n > 1) & (spread > 0), spread).otherwise(F.lit(1.0)),
        "short_ma": F.when(n >= LONG, F.avg(price).over(short)),
        "long_ma": F.when(n >= LONG, F.avg(price).over(long)),
        "short_volatility": F.when(n >= SHORT, F.stddev_pop(price).over(short)),
    }


def history_of(prices: Column) -> dict[str, Column]:
    """``history_columns`` for rows that carry their last prices as an array, their own last."""
    n = F.size(prices).cast("long")
    short, long = F.slice(prices, -SHORT, SHORT), F.slice(prices, -LONG, LONG)
    spread = _deviation(prices)
    return {
        "history_rows": n,
        "history_mean": _mean(prices),
        "history_std": F.when((n > 1) & (spread > 0), spread).otherwise(F.lit(1.0)),
        "short_ma": F.when(n >= LONG, _mean(short)),
        "long_ma": F.when(n >= LONG, _mean(long)),
        "short_volatility": F.when(n >= SHORT, _deviation(short)),
    }


def _mean(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda total, v: total + v) / F.size(values)


def _deviation(values: Column) -> Column:
    """Population deviation by running moments, so equal values give exactly 0."""
    moments = lambda n, mean, squares: F.struct(n.alias("n"), mean.alias("mean"), squares.alias("squares"))

    def add(m: Column, v: Column) -> Column:
        n = m["n"] + 1
        mean = m["mean"] + (v - m["mean"]) / n
        return moments(n, mean, m["squares"] + (v - m["mean"]) * (v - mean))

    zero = F.lit(0.0)
    return F.aggregate(values, moments(zero, zero, zero), add, lambda m: F.sqrt(m["squares"] / m["n"]))


def price_history(
    df: DataFrame, series: Series, price: str = "mid_price", measure: DataFrame | None = None
) -> DataFrame:
    layout = arrange(df, series, back=HISTORY - 1, measure=measure)
    return layout.finish(layout.df.withColumns(history_columns(layout, price)))


def zscore(price: str = "mid_price") -> Column:
    return (F.col(price) - F.col("history_mean")) / F.col("history_std")


def from_zscore(z: Column) -> Column:
    return z * F.col("history_std") + F.col("history_mean")


def trend_over_volatility() -> Column:
    """(short - long) / volatility, 0 without volatility."""
    gap = F.col("short_ma") - F.col("long_ma")
    return F.when(F.col("short_volatility") == 0, F.lit(0.0)).otherwise(ratio(gap, F.col("short_volatility")))


def trend_over_mean() -> Column:
    """(short - long) / long; 0 before the long mean exists."""
    return F.coalesce(ratio(F.col("short_ma") - F.col("long_ma"), F.col("long_ma")), F.lit(0.0))


def signal_columns(price: str = "mid_price") -> dict[str, Column]:
    """Signal from trend and reversion to the mean, and the price it makes acceptable."""
    weight = F.col("momentum_weight")
    signal = F.when(
        F.col("long_ma").isNotNull(), weight * trend_over_mean() + (1 - weight) * -zscore(price)
    ).otherwise(F.lit(0.0))
    return {"signal": signal, "acceptable_price": F.col(price) + signal * F.col("history_std")}


def target_size() -> Column:
    """Order size from signal strength, trend and volatility, within the position limit."""
    trend = F.abs(trend_over_mean())
    volatility = F.when(
        F.col("short_volatility") > 0, ratio(F.col("short_volatility"), F.col("volatility_threshold"))
    ).otherwise(F.lit(1.0))
    factor = (
        (1 + F.abs("signal") * MOMENTUM_SCALING)
        * F.when(trend > TREND_THRESHOLD, 1 + trend * 0.5).otherwise(F.lit(1.0))
        * (1 / F.sqrt(volatility))
    )
    base = F.greatest(F.col("min_position"), F.lit(BASE_SIZE))
    sized = F.least(truncate(base * clip(factor, MIN_FACTOR, MAX_FACTOR)), F.col("position_limit"))
    return F.when(F.col("history_rows") < SHORT, F.col("min_position")).otherwise(sized).cast("long")


def book_mid() -> Column:
    return (F.col("bid_price_1") + F.col("ask_price_1")) / 2


def fair_prices(
    books: DataFrame, series: Series, params: DataFrame | None = None, measure: DataFrame | None = None
) -> DataFrame:
    """Signals and target sizes for every two-sided book; one-sided books are no part of the history."""
    rows = books.filter(two_sided()).withColumn("mid_price", book_mid())
    return _with_signals(price_history(rows, series, measure=measure), params)


def priced_by_history(books: DataFrame, mids: Column, params: DataFrame | None = None) -> DataFrame:
    """``fair_prices`` of two-sided books with ``mid_price`` that carry the last mids of their product as an array."""
    return _with_signals(books.withColumns(history_of(mids)), params)


def _with_signals(priced: DataFrame, params: DataFrame | None) -> DataFrame:
    if params is None:
        priced = priced.withColumns({n: F.lit(v) for n, v in DEFAULTS.items()})
    else:
        priced = by_product_parameters(priced, params, DEFAULTS)
    return priced.withColumns(signal_columns()).withColumn("target_size", target_size())


def _wants_to_buy() -> Column:
    return truncate(F.col("ask_price_1")) < F.col("acceptable_price")


def _wants_to_sell() -> Column:
    return truncate(F.col("bid_price_1")) > F.col("acceptable_price")


def quote_orders(priced: DataFrame, position: Column | None = None) -> DataFrame:
    """Orders at the best quotes that beat the acceptable price, one row each.

    Buys carry a positive quantity, sells a negative one.
    """
    held = position if position is not None else F.lit(0)
    room_to_buy = F.least(F.col("position_limit") - held, F.col("target_size"))
    room_to_sell = F.least(F.col("position_limit") + held, F.col("target_size"))
    buy = F.when(
        (room_to_buy > 0) & _wants_to_buy(),
        F.struct(
            F.lit("BUY").alias("order_side"),
            F.col("ask_price_1").alias("order_price"),
            F.least(F.col("ask_volume_1"), room_to_buy).cast("long").alias("quantity"),
        ),
    )
    sell = F.when(
        (room_to_sell > 0) & _wants_to_sell(),
        F.struct(
            F.lit("SELL").alias("order_side"),
            F.col("bid_price_1").alias("order_price"),
            (-F.least(F.col("bid_volume_1"), room_to_sell)).cast("long").alias("quantity"),
        ),
    )
    orders = priced.withColumn("_order", F.explode(F.filter(F.array(buy, sell), lambda o: o.isNotNull())))
    return orders.select(*priced.columns, "_order.*")


def fill_room() -> tuple[Column, Column, Column]:
    """The most that each row of ``fair_prices`` may buy and sell, and its limit; NULL where it does not want to.

    A buy takes at most the best ask's volume, a sell the best bid's, and both at most the target size.
    """
    most = lambda volume: F.least(F.col(volume), F.col("target_size")).cast("long")
    return (
        F.when(_wants_to_buy(), most("ask_volume_1")),
        F.when(_wants_to_sell(), most("bid_volume_1")),
        F.col("position_limit"),
    )


def hold_filled(priced: Layout, start: DataFrame | None = None) -> Layout:
    """The position before and after each row of ``fair_prices`` if its orders fill at the quotes they are placed at (see ``fill_room``)."""
    return filled_positions(priced, *fill_room(), start)


def filled_orders(priced: DataFrame, series: Series, start: DataFrame | None = None, measure: DataFrame | None = None) -> DataFrame:
    """Orders of ``quote_orders`` where each fill moves the position that the next row's orders know.

    ``position_before`` and ``position`` are those of the row; its buy and its sell see the same position before.
    """
    held = hold_filled(arrange(priced, series, measure=measure), start)
    return quote_orders(held.rows(), F.col("position_before"))
