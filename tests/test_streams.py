"""Streams give what the batch operators give on the same rows."""

import math

import pytest
from pyspark.sql import functions as F

from tickloom.operators import positions, signals
from tickloom.plans import Series, arrange
from tickloom.streaming import batches, stored

SERIES = Series.of("product", "t")


def _feed(spark, parts, path, start):
    inbox = f"{path}/in"
    for part in parts:
        part.write.mode("append").parquet(inbox)
        start(spark.readStream.schema(part.schema).parquet(inbox)).awaitTermination()


def _ticks(spark, n=120):
    rows = [("hot" if i % 3 else "cold", i, (i * 7) % 5, 100 + math.sin(i)) for i in range(n)]
    return spark.createDataFrame(rows, "product string, t long, action long, price double")


def _rows(df, *columns):
    return sorted(tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in df.select(*columns).collect())


@pytest.mark.parametrize("block", [25, 100000])
def test_positions(spark, small_blocks, tmp_path, block):
    small_blocks(rowsPerBlock=block)
    df = _ticks(spark)
    delta, limit, path = positions.action_lots(F.col("action")), F.lit(20), str(tmp_path)
    parts = [df.filter("t < 50"), df.filter("t >= 50 AND t < 55"), df.filter("t >= 55")]
    _feed(spark, parts, path, lambda s: batches.stream_positions(s, SERIES, path, delta, limit))
    columns = ["product", "t", "position", "change", "realized_pnl", "unrealized_pnl", "pnl"]
    expected = positions.mark_to_market(positions.hold(arrange(df, SERIES), delta, limit)).rows()
    assert _rows(spark.read.parquet(f"{path}/positions"), *columns) == _rows(expected, *columns)
    assert spark.read.parquet(f"{path}/late").count() == 0


def test_signals_and_late_rows(spark, tmp_path):
    rows = [("a" if i % 3 else "b", i, 100 + 5 * math.sin(i) - 1, 9.0, 100 + 5 * math.sin(i) + 1, 9.0) for i in range(150)]
    df = spark.createDataFrame(
        rows, "product string, t long, bid_price_1 double, bid_volume_1 double, ask_price_1 double, ask_volume_1 double"
    )
    path = str(tmp_path)
    late = df.filter("t = 10")
    parts = [df.filter("t < 40"), df.filter("t >= 40 AND t < 100"), df.filter("t >= 100").unionByName(late)]
    _feed(spark, parts, path, lambda s: batches.stream_signals(s, SERIES, path))
    columns = ["product", "t", "order_side", "order_price", "quantity"]
    expected = signals.quote_orders(signals.fair_prices(df, SERIES))
    assert expected.count() > 0
    assert _rows(spark.read.parquet(f"{path}/orders"), *columns) == _rows(expected, *columns)
    assert [r.t for r in spark.read.parquet(f"{path}/late").collect()] == [10]


def _books(spark):
    rows = [
        ("a" if i % 3 else "b", i, 100 + 5 * math.sin(i) - 1, 9.0 + i % 4, 100 + 5 * math.sin(i) + 1, 12.0 + i % 5)
        for i in range(150)
    ]
    return spark.createDataFrame(
        rows, "product string, t long, bid_price_1 double, bid_volume_1 double, ask_price_1 double, ask_volume_1 double"
    )


@pytest.mark.parametrize("opening", [None, [("a", 40), ("z", 7)]])
def test_positions_that_fills_move_go_on_from_batch_to_batch(spark, tmp_path, opening):
    df, path = _books(spark), str(tmp_path)
    start = None if opening is None else spark.createDataFrame(opening, "product string, position int")
    # The second part has no book of "b".
    parts = [df.filter("t < 40"), df.filter("t >= 40 AND t < 44 AND product = 'a'"), df.filter("t >= 44")]
    _feed(spark, parts, path, lambda s: batches.stream_signals(s, SERIES, path, fills=True, opening=start))
    given = df.filter("t < 40 OR t >= 44 OR product = 'a'")
    expected = signals.filled_orders(signals.fair_prices(given, SERIES), SERIES, start)
    columns = ["product", "t", "order_side", "order_price", "quantity", "position_before", "position"]
    assert expected.filter("position_before <> 0").count() > 20
    assert _rows(spark.read.parquet(f"{path}/orders"), *columns) == _rows(expected, *columns)
    assert spark.read.parquet(f"{path}/books").count() == given.count()


ORDERS = ["product", "t", "order_side", "order_price", "quantity"]


def _stored(path, **options):
    return lambda s: stored.stored_signals(s, SERIES, path, F.timestamp_seconds(F.col("t") + 1), **options)


@pytest.mark.parametrize("opening", [None, [("a", 40), ("z", 7)]])
def test_stored_state_gives_the_orders_of_the_batch_form(spark, tmp_path, opening):
    df, path = _books(spark), str(tmp_path)
    start = None if opening is None else spark.createDataFrame(opening, "product string, position int")
    # Each part stops the query and starts it again; the second part has no book of "b".
    parts = [df.filter("t < 40"), df.filter("t >= 40 AND t < 44 AND product = 'a'"), df.filter("t >= 44")]
    _feed(spark, parts, path, _stored(path, fills=True, opening=start))
    given = df.filter("t < 40 OR t >= 44 OR product = 'a'")
    expected = signals.filled_orders(signals.fair_prices(given, SERIES), SERIES, start)
    columns = [*ORDERS, "position_before", "position"]
    assert expected.filter("position_before <> 0").count() > 20
    assert _rows(spark.read.parquet(f"{path}/orders"), *columns) == _rows(expected, *columns)


def test_stored_books_wait_for_the_watermark_and_come_out_in_order(spark, tmp_path):
    df, path = _books(spark), str(tmp_path)
    # Every part holds books that belong between those of the part before; t = 5 comes far too late.
    parts = [df.filter("t < 60 AND t % 7 <> 0"), df.filter("t < 60 AND t % 7 = 0 AND t >= 35"), df.filter("t >= 60 AND t <> 5"), df.filter("t = 5").withColumn("bid_volume_1", F.lit(1.0))]
    _feed(spark, parts, path, _stored(path, patience="30 seconds"))
    given = df.filter("t >= 35 OR t % 7 <> 0")
    # Books of the last 30 seconds still wait.
    expected = signals.quote_orders(signals.fair_prices(given, SERIES)).filter("t <= 119")
    assert expected.count() > 0
    assert _rows(spark.read.parquet(f"{path}/orders"), *ORDERS) == _rows(expected, *ORDERS)


def test_stored_history_is_forgotten_after_silence(spark, tmp_path):
    df, path = _books(spark).filter("product = 'a'"), str(tmp_path)
    gap = df.filter("t < 60 OR t >= 90")
    _feed(spark, [gap.filter("t < 60"), gap.filter("t >= 90")], path, _stored(path, forget_ms=20_000))
    halves = [signals.quote_orders(signals.fair_prices(df.filter(f), SERIES)) for f in ("t < 60", "t >= 90")]
    expected = halves[0].unionByName(halves[1])
    assert _rows(spark.read.parquet(f"{path}/orders"), *ORDERS) == _rows(expected, *ORDERS)


def test_history_columns_of_arrays_equal_those_of_windows(spark):
    df = _books(spark).withColumn("bid_price_1", F.when(F.col("t") < 70, F.lit(99.1)).otherwise(F.col("bid_price_1")))
    df = df.withColumn("ask_price_1", F.when(F.col("t") < 70, F.lit(99.3)).otherwise(F.col("ask_price_1")))
    plain = signals.fair_prices(df, SERIES)
    at = arrange(df.withColumn("mid_price", signals.book_mid()), SERIES, back=signals.HISTORY - 1)
    listed = at.finish(at.df.withColumn("mids", F.collect_list("mid_price").over(at.last(signals.HISTORY))))
    columns = ["product", "t", "history_rows", "history_mean", "history_std", "short_ma", "long_ma", "short_volatility", "target_size"]
    assert _rows(signals.priced_by_history(listed, F.col("mids")), *columns) == _rows(plain, *columns)
