"""Orders against the book: fills, limit checks, and positions that fills move.

``filled_positions`` and ``accepted_orders`` are scans: what an order may do depends on the position that earlier orders
have left. A quote that fills as far as the limit allows bends the position's line, at four places at most; an
order that is refused whole breaks it at two.
"""

from __future__ import annotations

import sys
from collections.abc import Sequence

import numpy as np
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.plans import Layout, join_on
from tickloom.plans.scan import HIGH, NO_LIMIT, Pieces, Rows, scan

# Task functions travel by value, so executors need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

BOOK_QUOTES = ("bid_price_1", "ask_price_1")


def order_fill(
    orders: DataFrame,
    books: DataFrame,
    on: Sequence[str] = ("product", "timestamp"),
    book_order: Sequence[str] | None = None,
) -> DataFrame:
    """Match each order with its book row and add ``fill_price`` (NULL: not filled).

    A buy fills at the best ask if its price reaches it, a sell at the best bid.
    ``book_order`` picks the first row where a book has several.
    """
    quotes = books.select(*dict.fromkeys([*on, *BOOK_QUOTES, *(book_order or ())]))
    if book_order:
        quotes = quotes.groupBy(*on).agg(
            *[F.min_by(c, F.struct(*book_order)).alias(c) for c in BOOK_QUOTES]
        )
    joined = join_on(orders, quotes, on, "inner")
    return joined.withColumn("fill_price", fill_price())


def fill_price() -> Column:
    buys = (F.col("quantity") > 0) & (F.col("price") >= F.col("ask_price_1"))
    sells = (F.col("quantity") < 0) & (F.col("price") <= F.col("bid_price_1"))
    return F.when(buys, F.col("ask_price_1")).when(sells, F.col("bid_price_1"))


def within_limit(quantity: Column, limit: Column, position: Column | None = None) -> Column:
    """Whether an order keeps the position within its limit."""
    held = position if position is not None else F.lit(0)
    return F.abs(held + quantity) <= limit


def _fill_steps(rows: Rows) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """x + min(limit - x, buy) - min(limit + x, sell), neither part below 0, as slopes and offsets between cuts."""
    limit = rows["limit"]
    buy, sell = np.maximum(rows["buy"], 0), np.maximum(rows["sell"], 0)
    cuts = np.sort(np.stack([limit - buy, limit, -limit, sell - limit], axis=1), axis=1)
    # Each interval starts at a cut; the first one below all of them.
    at = np.concatenate([np.full((len(cuts), 1), -HIGH), cuts], axis=1)
    limit, buy, sell = limit[:, None], buy[:, None], sell[:, None]
    buy_bends, sell_bends = (at >= limit - buy) & (at < limit), (at >= -limit) & (at < sell - limit)
    bought = np.where(at < limit - buy, buy, np.where(buy_bends, limit, 0))
    sold = np.where(at < -limit, 0, np.where(sell_bends, limit, sell))
    return cuts, 1 - buy_bends.astype(np.int64) - sell_bends, bought - sold


def filled_positions(layout: Layout, buy: Column, sell: Column, limit: Column, start: DataFrame | None = None) -> Layout:
    """Add ``position_before``, ``position`` and ``change`` where each row may buy up to ``buy`` and sell up to ``sell``.

    Both are cut to the room that the position before the row leaves below ``limit`` and above ``-limit``; both fill in
    whole. Quantities and limits are integers of less than 2^38; a missing quantity is 0, a missing limit none. ``start``
    may hold a position per key (columns: key, ``position``).
    """
    family = Pieces(_fill_steps, {"buy": 0, "sell": 0, "limit": NO_LIMIT})
    return scan(layout, family, {"buy": buy, "sell": sell, "limit": limit}, start)


def _reject_steps(rows: Rows) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """x + quantity while that keeps within the limit, else x."""
    quantity, limit = rows["quantity"], rows["limit"]
    cuts = np.sort(np.stack([-limit - quantity, limit - quantity + 1], axis=1), axis=1)
    offsets = np.zeros((len(cuts), 3), np.int64)
    offsets[:, 1] = np.where(limit >= 0, quantity, 0)
    return cuts, np.ones((len(cuts), 3), np.int64), offsets


def accepted_orders(layout: Layout, quantity: Column, limit: Column, start: DataFrame | None = None) -> Layout:
    """Add ``position_before``, ``position``, ``change`` and ``accepted`` where an order beyond the limit is refused whole.

    An order is accepted if the position with it keeps within its own row's ``±limit``; a missing quantity is 0, a missing
    limit none. ``start`` may hold a position per key (columns: key, ``position``).
    """
    family = Pieces(_reject_steps, {"quantity": 0, "limit": NO_LIMIT})
    held = scan(layout, family, {"quantity": quantity, "limit": limit}, start)
    within = within_limit(F.coalesce(quantity.cast("long"), F.lit(0)), F.coalesce(limit.cast("long"), F.lit(NO_LIMIT)), F.col("position_before"))
    return held.with_df(held.df.withColumn("accepted", within))
