"""Technical features of a price series.

Each feature is a set of column expressions in up to two window stages, plus
how many rows back it looks. ``add_features`` joins the stages of all features
asked for, so a whole feature table costs one shuffle and one sort.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.functions.columns import fold_prefix, log_ratio, ratio
from tickloom.operators import book
from tickloom.plans import Layout, Series, arrange

Columns = Mapping[str, Column]
Stage = Callable[[Layout], Columns]


def _none(_: Layout) -> Columns:
    return {}


@dataclass(frozen=True)
class Feature:
    """Window columns that read the input, columns from those, then the same once more."""

    back: int
    first: Stage
    derived: Callable[[], Columns] = dict
    second: Stage = _none
    final: Callable[[], Columns] = dict


def log_return(price: str = "mid_price") -> Feature:
    return Feature(
        back=1,
        first=lambda at: {"lag_mid_price": F.lag(price).over(at.window)},
        derived=lambda: {"log_return": log_ratio(price, "lag_mid_price")},
    )


def rolling_zscore(price: str = "mid_price", window: int = 10) -> Feature:
    return Feature(
        back=window - 1,
        first=lambda at: {
            "rolling_mean": F.avg(price).over(at.last(window)),
            "rolling_stddev": F.stddev_samp(price).over(at.last(window)),
        },
        derived=lambda: {
            "rolling_zscore": ratio(F.col(price) - F.col("rolling_mean"), F.col("rolling_stddev"))
        },
    )


def volume_weighted_return(
    price: str = "mid_price", volume: str = "trade_volume_best", window: int = 10
) -> Feature:
    base = log_return(price)
    return Feature(
        back=window,
        first=base.first,
        derived=base.derived,
        second=lambda at: {
            "volume_weighted_return": ratio(
                F.sum(F.col("log_return") * F.col(volume)).over(at.last(window)),
                F.sum(volume).over(at.last(window)),
            )
        },
    )


def depth_volatility(window: int = 10) -> Feature:
    both = F.col("bid_volume_1") + F.col("ask_volume_1")
    return Feature(
        back=window - 1,
        first=lambda at: {"depth_volatility": F.stddev_samp(both).over(at.last(window))},
    )


def macd(price: str = "mid_price", fast: int = 12, slow: int = 26, signal: int = 9) -> Feature:
    """Difference of two simple means, and its own mean."""
    return Feature(
        back=slow + signal - 2,
        first=lambda at: {
            "fast_ma": F.avg(price).over(at.last(fast)),
            "slow_ma": F.avg(price).over(at.last(slow)),
        },
        derived=lambda: {"macd_line": F.col("fast_ma") - F.col("slow_ma")},
        second=lambda at: {"macd_signal": F.avg("macd_line").over(at.last(signal))},
    )


def rsi(price: str = "mid_price", window: int = 14) -> Feature:
    """Relative strength from mean gain and loss; NULL without a loss in the window."""

    def moves() -> Columns:
        diff = F.col(price) - F.col("prev_mid_price")
        return {
            "diff": diff,
            "gain": F.when(diff > 0, diff).otherwise(F.lit(0.0)),
            "loss": F.when(diff < 0, -diff).otherwise(F.lit(0.0)),
        }

    return Feature(
        back=window,
        first=lambda at: {"prev_mid_price": F.lag(price).over(at.window)},
        derived=moves,
        second=lambda at: {
            "avg_gain": F.avg("gain").over(at.last(window)),
            "avg_loss": F.avg("loss").over(at.last(window)),
        },
        final=lambda: {
            "rs": ratio(F.col("avg_gain"), F.col("avg_loss")),
            "rsi": 100 - 100 / (1 + ratio(F.col("avg_gain"), F.col("avg_loss"))),
        },
    )


def cci(price: str = "mid_price", window: int = 20) -> Feature:
    """Distance from the moving mean in mean deviations, each row against its own mean."""
    return Feature(
        back=2 * (window - 1),
        first=lambda at: {"sma": F.avg(price).over(at.last(window))},
        second=lambda at: {"mad": F.avg(F.abs(F.col(price) - F.col("sma"))).over(at.last(window))},
        final=lambda: {"cci": ratio(F.col(price) - F.col("sma"), 0.015 * F.col("mad"))},
    )


def rolling_volatility(price: str = "mid_price", window: int = 10) -> Feature:
    base = log_return(price)
    return Feature(
        back=window,
        first=base.first,
        derived=base.derived,
        second=lambda at: {"rolling_volatility": F.stddev_samp("log_return").over(at.last(window))},
    )


def price_change(price: str = "mid_price") -> Feature:
    return Feature(back=1, first=lambda at: {"price_change": F.col(price) - F.lag(price).over(at.window)})


def _full(value: Callable[[Column], Column], source: Column, at: Layout, window: int) -> Column:
    """An aggregate over a full window of non-NULL values, else NULL."""
    frame = at.last(window)
    return F.when(F.count(source).over(frame) >= window, value(source).over(frame))


def volatility_full(price: str = "mid_price", window: int = 10) -> Feature:
    return Feature(
        back=window - 1,
        first=lambda at: {"volatility": _full(F.stddev_samp, F.col(price), at, window)},
    )


def momentum(price: str = "mid_price", window: int = 10) -> Feature:
    """Mean price change over a full window of changes."""
    base = price_change(price)
    return Feature(
        back=window,
        first=base.first,
        second=lambda at: {"momentum": _full(F.avg, F.col("price_change"), at, window)},
    )


def volume_trend(total: Column, window: int = 10) -> Feature:
    return Feature(
        back=window - 1, first=lambda at: {"volume_trend": _full(F.avg, total, at, window)}
    )


def add_features(
    df: DataFrame, series: Series, features: Sequence[Feature], measure: DataFrame | None = None
) -> DataFrame:
    """All columns of the features asked for; ``measure`` is as in ``arrange``."""
    layout = arrange(df, series, back=max(f.back for f in features), measure=measure)
    out = layout.df
    for stage in (
        lambda f: f.first(layout),
        lambda f: f.derived(),
        lambda f: f.second(layout),
        lambda f: f.final(),
    ):
        columns: dict[str, Column] = {}
        for feature in features:
            columns.update(stage(feature))
        if columns:
            out = out.withColumns(columns)
    return layout.finish(out)


def price_file_features(
    prices: DataFrame,
    key: str | Sequence[str] = "product",
    ties: Sequence[str] = (),
    fold_prefixes: Sequence[str] = (),
    window: int = 10,
    measure: DataFrame | None = None,
) -> DataFrame:
    """The whole feature table of 17-column price rows, 31 columns added.

    Pass ``key="base_product"`` to run the windows over folded products; name
    ``ties`` that order its rows. ``measure`` is as in ``arrange``.
    """
    filled = book.cast_fill(prices).withColumns(
        {
            "round_timestamp": book.round_timestamp(),
            "base_product": fold_prefix("product", fold_prefixes),
            **book.volume_columns(),
            "bid_ask_spread": book.spread(),
            "order_book_imbalance": book.imbalance(),
        }
    )
    return add_features(
        filled,
        Series.of(key, ("round_timestamp", *ties)),
        [
            log_return(),
            rolling_zscore(window=window),
            volume_weighted_return(window=window),
            depth_volatility(window=window),
            macd(),
            rsi(),
            cci(),
            rolling_volatility(window=window),
        ],
        measure,
    )


def quote_book_features(
    books: DataFrame,
    key: str | Sequence[str] = "product",
    time: str = "timestamp",
    window: int = 10,
    measure: DataFrame | None = None,
) -> DataFrame:
    """The smaller feature set of pivoted quotes: full windows only, missing values as 0."""
    sizes = ("bid_size_1", "ask_size_1")
    base = book.to_numeric(books, ["bid_price_1", "bid_size_1", "ask_price_1", "ask_size_1"])
    total = F.coalesce(F.col(sizes[0]), F.lit(0.0)) + F.coalesce(F.col(sizes[1]), F.lit(0.0))
    base = base.withColumns(
        {
            "mid_price": book.mid_filled(),
            "spread": book.spread(fill=True),
            "imbalance": book.imbalance(*sizes, fill=True),
        }
    )
    out = add_features(
        base,
        Series.of(key, time),
        [price_change(), volatility_full(window=window), momentum(window=window), volume_trend(total, window)],
        measure,
    )
    return out.fillna(0.0)
