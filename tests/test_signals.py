import math

import pytest
from pyspark.sql import functions as F

from tickloom.operators import fills, signals
from tickloom.plans import Series

SERIES = Series.of("product", "t")
PARAMS = "product string, momentum_weight double, min_position int, volatility_threshold double, zscore_threshold double, position_limit int"


def _books(spark, mids, product="a"):
    rows = [(product, i, m - 1.0, 5.0, m + 1.0, 6.0) for i, m in enumerate(mids)]
    return spark.createDataFrame(rows, "product string, t long, bid_price_1 double, bid_volume_1 double, ask_price_1 double, ask_volume_1 double")


def _spread(values):
    mean = sum(values) / len(values)
    return math.sqrt(sum((v - mean) ** 2 for v in values) / len(values))


@pytest.mark.parametrize("n", [4, 5, 14, 15, 31])
def test_history_thresholds(spark, n):
    mids = [100 + 3 * math.sin(i) + i for i in range(n)]
    rows = signals.fair_prices(_books(spark, mids), SERIES).orderBy("t").collect()
    for i, row in enumerate(rows):
        past = mids[max(0, i - 29): i + 1]
        std = _spread(past) if len(past) > 1 and _spread(past) > 0 else 1.0
        assert row.history_rows == len(past)
        if len(past) < 15:
            assert row.signal == 0 and row.acceptable_price == pytest.approx(mids[i])
            assert row.short_ma is None
            signal = trend = 0.0
        else:
            short, long = sum(past[-5:]) / 5, sum(past[-15:]) / 15
            trend = (short - long) / long
            signal = 0.6 * trend - 0.4 * (mids[i] - sum(past) / len(past)) / std
            assert row.signal == pytest.approx(signal)
            assert row.acceptable_price == pytest.approx(mids[i] + signal * std)
        if len(past) < 5:
            assert row.target_size == 15
        else:
            factor = (1 + 2 * abs(signal)) / math.sqrt(_spread(past[-5:]) / 1.2)
            factor *= 1 + abs(trend) / 2 if abs(trend) > 0.2 else 1
            assert row.target_size == min(50, int(15 * max(0.7, min(3.0, factor))))


def test_one_sided_books_are_skipped(spark):
    books = _books(spark, [10.0] * 3).withColumn("bid_price_1", F.when(F.col("t") != 1, F.col("bid_price_1")))
    rows = signals.fair_prices(books, SERIES).orderBy("t").collect()
    assert [(r.t, r.history_rows) for r in rows] == [(0, 1), (2, 2)]


def test_parameters_by_product(spark):
    params = spark.createDataFrame([("a", 0.8, 20, 0.8, 0.4, 30)], PARAMS)
    books = _books(spark, [10.0], "a").unionByName(_books(spark, [10.0], "b"))
    sizes = {r.product: (r.target_size, r.position_limit) for r in signals.fair_prices(books, SERIES, params).collect()}
    assert sizes == {"a": (20, 30), "b": (15, 50)}


def test_orders_beat_the_acceptable_price(spark):
    priced = spark.createDataFrame(
        [("a", 10.0, 40.0, 9.9, 8.0, 12, 11.0, 50), ("a", 10.0, 40.0, 10.5, 4.0, 12, 9.0, 50), ("a", 10.0, 1.0, 12.0, 1.0, 12, 10.5, 50)],
        "product string, ask_price_1 double, ask_volume_1 double, bid_price_1 double, bid_volume_1 double, target_size long, acceptable_price double, position_limit int",
    )
    rows = signals.quote_orders(priced).collect()
    assert [(r.order_side, r.order_price, r.quantity) for r in rows] == [
        ("BUY", 10.0, 12), ("SELL", 10.5, -4), ("BUY", 10.0, 1), ("SELL", 12.0, -1)
    ]
    full = signals.quote_orders(priced, F.lit(50)).collect()
    assert all(r.order_side == "SELL" for r in full)


def test_fills_and_limits(spark, small_blocks):
    orders = spark.createDataFrame(
        [(i, "a", 1, p, q) for i, (p, q) in enumerate([(11.0, 5), (10.0, 5), (9.0, -5), (9.5, -5), (12.0, 0)] * 40)],
        "id long, product string, timestamp long, price double, quantity long",
    )
    books = spark.createDataFrame(
        [("a", 1, 9.0, 11.0, 1), ("a", 1, 5.0, 50.0, 2)],
        "product string, timestamp long, bid_price_1 double, ask_price_1 double, line int",
    )
    out = fills.order_fill(orders, books, book_order=["line"]).orderBy("id").collect()
    assert len(out) == 200
    assert [r.fill_price for r in out[:5]] == [11.0, None, 9.0, None, None]
    kept = orders.filter(fills.within_limit(F.col("quantity"), F.lit(50), F.lit(48)))
    assert kept.filter("quantity > 0").count() == 0
