"""Order books: quotes to levels, levels to prices, spreads and volumes."""

from __future__ import annotations

import sys
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions.columns import number, ratio
from tickloom.plans import Series, arrange
from tickloom.schema import LEVELS, PRICE_NUMBERS


# Levels that a table of one row per book may have as columns, four each.
MOST_WIDE_LEVELS = 500
# Quotes on a page of a book.
PAGE_LEVELS = 1_000


def level_rank(quotes: DataFrame, time: str = "timestamp", ties: Sequence[str] = ()) -> DataFrame:
    """Number each quote within its side: bids from the highest price, asks from the lowest.

    Equal prices stay separate levels. Any depth; a very deep book is cut into
    blocks of prices.
    """
    # A quote without a price ranks last, as it does in top_levels.
    signed = quotes.withColumn("_rank_price", F.coalesce(_rank_price(), F.lit(sys.float_info.max)))
    series = Series.of(("product", time, "side"), ("_rank_price", *ties))
    layout = arrange(signed, series)
    ranked = layout.df.withColumn("level", layout.index + 1)
    return layout.finish(ranked).drop("_rank_price")


def _rank_price() -> Column:
    return F.when(F.col("side") == "BID", -F.col("price")).otherwise(F.col("price"))


def top_levels(
    quotes: DataFrame, levels: int, time: str = "timestamp", ties: Sequence[str] = (), extra_key: Sequence[str] = ()
) -> DataFrame:
    """The best ``levels`` quotes of each side, with their level number.

    The rank filter sits on the window, so each task keeps only its best rows
    before the shuffle and a crowded instant stays small. Time leads the key: it
    has the most values, which lets the sort compare by prefix.
    """
    best = Window.partitionBy(time, "product", *extra_key, "side").orderBy(_rank_price().asc_nulls_last(), *ties)
    return quotes.withColumn("level", F.row_number().over(best)).filter(F.col("level") <= levels)


def book_depth(quotes: DataFrame, time: str = "timestamp", extra_key: Sequence[str] = ()) -> int:
    """Quotes on the deepest side of any book."""
    sides = quotes.groupBy("product", time, *extra_key, "side").agg(F.count(F.lit(1)).alias("n"))
    return sides.agg(F.max("n")).first()[0] or 0


def l2_pivot(
    quotes: DataFrame,
    levels: int | None = None,
    time: str = "timestamp",
    ties: Sequence[str] = (),
    size_name: str = "volume",
    extra_key: Sequence[str] = (),
) -> DataFrame:
    """Long quotes to one row per (product, time) with price and size columns per level.

    Every quote is a level: there are as many as the deepest book has, unless ``levels`` asks for the
    best few only. A table of more than ``MOST_WIDE_LEVELS`` levels is refused; deeper books fit ``full_books`` or
    ``book_pages``. ``extra_key`` (say a source file) keeps books of several files apart.
    """
    if levels is None:
        levels = book_depth(quotes, time, extra_key)
    if levels > MOST_WIDE_LEVELS:
        raise ValueError(f"{levels} levels are too many columns: use full_books or book_pages, or ask for the best levels only")
    ranked = top_levels(quotes, levels, time, ties, extra_key)
    # An instant with quotes of an unknown side only still gives a (bare) row.
    cells = []
    for side in ("bid", "ask"):
        for i in range(1, levels + 1):
            here = (F.col("side") == side.upper()) & (F.col("level") == i)
            cells.append(F.max(F.when(here, F.col("price"))).alias(f"{side}_price_{i}"))
            cells.append(F.max(F.when(here, F.col("quantity"))).alias(f"{side}_{size_name}_{i}"))
    return ranked.groupBy(time, "product", *extra_key).agg(*cells)


def full_books(
    quotes: DataFrame, time: str = "timestamp", ties: Sequence[str] = (), extra_key: Sequence[str] = ()
) -> DataFrame:
    """Long quotes to one row per (product, time) with every quote: arrays ``bids`` and ``asks``, best first.

    Entries are (price, quantity). One exchange; a book as a row has to fit one task, see ``level_rank`` for the long form.
    """
    order = [F.coalesce(_rank_price(), F.lit(sys.float_info.max)).alias("_rank"), *[F.col(c).alias(f"_tie{i}") for i, c in enumerate(ties)]]
    entry = F.struct(*order, F.col("price"), F.col("quantity"))

    def side(name: str) -> Column:
        sorted_ = F.sort_array(F.collect_list(F.when(F.col("side") == name, entry)))
        return F.transform(sorted_, lambda e: F.struct(e["price"].alias("price"), e["quantity"].alias("quantity")))

    return quotes.groupBy(time, "product", *extra_key).agg(side("BID").alias("bids"), side("ASK").alias("asks"))


def book_pages(
    quotes: DataFrame, time: str = "timestamp", ties: Sequence[str] = (), page_levels: int = PAGE_LEVELS
) -> DataFrame:
    """Books of any depth: a row for each page of a side, with ``page`` (from 0), ``first_level`` and ``levels``.

    ``levels`` are the page's (level, price, quantity), best first; every page but a side's last is full. Ranks come from blocks of
    prices and pages are put together by their own key, so no task holds a book, however crowded its instant is.
    Quotes without a price are a side's last levels.
    """
    ranked = level_rank(quotes.select("product", time, "side", *dict.fromkeys(["price", "quantity", *ties])), time, ties)
    page = F.floor((F.col("level") - 1) / page_levels)
    entry = F.struct(F.col("level").cast("long").alias("level"), "price", "quantity")
    pages = ranked.groupBy(time, "product", "side", page.alias("page")).agg(F.sort_array(F.collect_list(entry)).alias("levels"))
    return pages.select("product", time, "side", "page", F.col("levels")[0]["level"].alias("first_level"), "levels")


def book_mid() -> Column:
    """Mean of the best prices, or the one that exists."""
    return F.coalesce(
        (F.col("bid_price_1") + F.col("ask_price_1")) / 2, F.col("bid_price_1"), F.col("ask_price_1")
    )


def cast_fill(df: DataFrame, columns: Sequence[str] = PRICE_NUMBERS) -> DataFrame:
    """Columns to double, missing or unreadable values to 0."""
    return df.withColumns({c: F.coalesce(number(c), F.lit(0.0)) for c in columns})


def to_numeric(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Columns to double, unreadable values to NULL."""
    return df.withColumns({c: number(c) for c in columns})


def round_timestamp(day: str = "day", timestamp: str = "timestamp") -> Column:
    """One time axis over days of at most a million ticks."""
    return F.col(timestamp).try_cast("long") + 1_000_000 * F.col(day).try_cast("long")


def trade_volume_best() -> Column:
    return F.least(F.col("bid_volume_1"), F.col("ask_volume_1"))


def side_volume(side: str) -> Column:
    first, second, third = (F.col(f"{side}_volume_{i}") for i in LEVELS)
    return first + second + third


def volume_columns() -> dict[str, Column]:
    """Tradable volume at the best level, per side, and over all levels."""
    return {
        "trade_volume_best": trade_volume_best(),
        "total_bid_volume": side_volume("bid"),
        "total_ask_volume": side_volume("ask"),
        "trade_volume_total": F.least(side_volume("bid"), side_volume("ask")),
    }


def spread(fill: bool = False) -> Column:
    ask, bid = F.col("ask_price_1"), F.col("bid_price_1")
    if fill:
        ask, bid = F.coalesce(ask, F.lit(0.0)), F.coalesce(bid, F.lit(0.0))
    return ask - bid


def imbalance(bid_size: str = "bid_volume_1", ask_size: str = "ask_volume_1", fill: bool = False) -> Column:
    """(bid - ask) / (bid + ask) of the best sizes: NULL without size, or 0 with ``fill``."""
    bid, ask = F.col(bid_size), F.col(ask_size)
    if not fill:
        return ratio(bid - ask, bid + ask)
    bid, ask = F.coalesce(bid, F.lit(0.0)), F.coalesce(ask, F.lit(0.0))
    return F.coalesce(ratio(bid - ask, bid + ask), F.lit(0.0))


def mid_filled() -> Column:
    """Mean of the best prices, a missing one counted as 0."""
    bid = F.coalesce(F.col("bid_price_1"), F.lit(0.0))
    ask = F.coalesce(F.col("ask_price_1"), F.lit(0.0))
    return (bid + ask) / 2


def two_sided() -> Column:
    return F.col("bid_price_1").isNotNull() & F.col("ask_price_1").isNotNull()


def depth_map(side: str) -> Column:
    """Price to volume over the levels that exist; of equal prices the deepest level counts."""
    levels = F.array(
        *[
            F.struct(F.col(f"{side}_price_{i}").alias("price"), F.col(f"{side}_volume_{i}").alias("volume"))
            for i in LEVELS
        ]
    )
    present = F.filter(levels, lambda x: x["price"].isNotNull())
    # A repeated price would be a repeated map key: keep the last entry of each.
    unique = F.filter(
        present,
        lambda x, i: ~F.exists(F.slice(present, i + 2, F.size(present)), lambda y: y["price"] == x["price"]),
    )
    return F.map_from_entries(unique)


def best_of_map(side: str, depth: Column) -> Column:
    """Best price of a depth map: highest bid or lowest ask."""
    prices = F.map_keys(depth)
    return F.array_max(prices) if side == "bid" else F.array_min(prices)
