"""Blocked plans give what plain windows give, whatever the shape of the series."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tickloom.plans import Series, arrange, row_index, running

SERIES = Series.of("product", ("t", "id"))


def _rows(shape, n=600, seed=3):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        product = "hot" if i % 3 else f"p{i % 7}"
        if shape == "even":
            t = i
        elif shape == "burst":  # a third of all rows on one instant
            t = 50 if rng.random() < 0.4 else rng.randrange(200)
        elif shape == "skewed":  # half of the time axis holds a handful of rows
            t = int(1.05 ** (i % 200))
        else:  # one instant only
            t = 7
        rows.append((product, t, i, float(rng.randrange(1000))))
    rng.shuffle(rows)
    return rows


def _frame(spark, shape):
    return spark.createDataFrame(_rows(shape), "product string, t long, id long, v double").repartition(5)


def _collect(df):
    return sorted(map(tuple, df.collect()), key=repr)


def _windows(layout):
    return layout.finish(
        layout.df.select(
            *layout.df.columns,
            F.avg("v").over(layout.last(9)).alias("mean"),
            F.lag("v", 3).over(layout.window).alias("before"),
            F.sum("v").over(layout.next(5)).alias("ahead"),
            F.lead("id").over(layout.window).alias("following"),
        )
    )


@pytest.mark.parametrize("shape", ["even", "burst", "skewed", "instant"])
@pytest.mark.parametrize("block", [9, 150])
def test_bounded_frames(spark, small_blocks, shape, block):
    df = _frame(spark, shape)
    spark.conf.set("spark.tickloom.rowsPerBlock", "1000000")
    plain = arrange(df, SERIES, back=8, ahead=4)
    assert not plain.split
    expected = _collect(_windows(plain))
    small_blocks(rowsPerBlock=block)
    cut = arrange(df, SERIES, back=8, ahead=4)
    assert cut.split
    assert _collect(_windows(cut)) == expected


@pytest.mark.parametrize("shape", ["even", "burst", "skewed", "instant"])
def test_row_index_and_running(spark, small_blocks, shape):
    df = _frame(spark, shape)
    w = Window.partitionBy("product").orderBy("t", "id")
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    some = F.when(F.col("id") % 4 == 0, F.col("v"))
    expected = _collect(
        df.select("id", (F.row_number().over(w) - 1).alias("i"), F.sum("v").over(so_far), F.last(some, True).over(so_far))
    )
    indexed = row_index(df, SERIES, "i")
    got = running(indexed, SERIES, sums={"s": F.col("v")}, lasts={"l": some}).select("id", "i", "s", "l")
    assert _collect(got) == expected


def test_side_tables_too_large_to_broadcast(spark, small_blocks):
    df = _frame(spark, "even")
    expected = _collect(row_index(df, SERIES))
    small_blocks(broadcastSlices=1)
    assert _collect(row_index(df, SERIES)) == expected


@pytest.mark.parametrize("slices", [8, 60])
def test_blocks_grow_when_there_are_too_many(spark, small_blocks, slices):
    df = _frame(spark, "skewed")
    spark.conf.set("spark.tickloom.rowsPerBlock", "1000000")
    expected = _collect(_windows(arrange(df, SERIES, back=8, ahead=4)))
    small_blocks(rowsPerBlock=9, broadcastSlices=slices)
    assert _collect(_windows(arrange(df, SERIES, back=8, ahead=4))) == expected


def test_missing_times_and_descending_order(spark, small_blocks):
    rows = [("a", None if i % 10 == 0 else i, i, 0.0) for i in range(300)]
    df = spark.createDataFrame(rows, "product string, t long, id long, v double")
    for order in (("t", "id"), ("-t", "id")):
        series = Series.of("product", order)
        w = Window.partitionBy("product").orderBy(*series.sort)
        expected = _collect(df.select("id", (F.row_number().over(w) - 1).alias("i")))
        assert _collect(row_index(df, series, "i").select("id", "i")) == expected


def test_text_order_and_missing_key(spark, small_blocks):
    rows = [(None if i % 2 else "a", f"{i:05d}", i, 0.0) for i in range(200)]
    df = spark.createDataFrame(rows, "product string, t string, id long, v double")
    got = {r.id: r.row_index for r in row_index(df, Series.of("product", "t")).collect()}
    assert got == {i: i // 2 for i in range(200)}


def test_time_axes(spark, small_blocks):
    base = spark.range(150).select(
        F.lit("a").alias("product"), "id",
        (F.lit("2024-01-01").cast("timestamp_ntz") + F.make_interval(mins=F.col("id").cast("int"))).alias("ntz"),
        (F.lit("2024-01-01").cast("timestamp") + F.make_interval(mins=F.col("id").cast("int"))).alias("ts"),
        F.date_add(F.lit("2024-01-01"), F.col("id").cast("int")).alias("d"),
        (F.col("id") / 7).alias("x"),
    )
    for axis in ("ntz", "ts", "d", "x"):
        out = row_index(base, Series.of("product", axis))
        assert out.filter("row_index <> id").count() == 0
        assert out.count() == 150


def test_only_keys_with_a_burst_are_sorted_and_written(spark, small_blocks, monkeypatch):
    """A row far away costs its key nothing, and a burst costs no other key its slices."""
    from tickloom.plans import series as module

    written = []
    settle_table = module.settle_table
    monkeypatch.setattr(module, "settle_table", lambda df, name: written.append((name, df.count())) or settle_table(df, name))
    rows = [("far", 0 if i == 0 else 10**12 + i, i, 1.0) for i in range(400)]
    rows += [("log", int(1.1**i), i, 1.0) for i in range(200)] + [("short", i, i, 1.0) for i in range(30)]
    small_blocks(rowsPerBlock=40)
    frame = lambda r: spark.createDataFrame(r, "product string, t long, id long, v double").repartition(5)
    far = arrange(frame(rows), SERIES, back=8, ahead=4)
    assert far.split and not written and "_index" not in far.helpers
    burst = [("burst", 7 if i % 2 else i, i, 1.0) for i in range(300)]
    df = frame(rows + burst)
    laid = arrange(df, SERIES, back=8, ahead=4)
    assert written == [("ordered", 300)]
    sliced = laid.df.filter("_index IS NULL").select("product").distinct().collect()
    assert sorted(r.product for r in sliced) == ["far", "log", "short"]
    sizes = laid.df.filter("_own").groupBy("product", "_block").count()
    assert sizes.agg(F.max("count")).first()[0] <= 80
    got = _collect(_windows(laid))
    spark.conf.set("spark.tickloom.rowsPerBlock", "1000000")
    assert got == _collect(_windows(arrange(df, SERIES, back=8, ahead=4)))


def test_nan_and_missing_places(spark, small_blocks):
    rows = [("a", None if i % 10 == 0 else float("nan") if i % 10 == 1 else float(i * i), i) for i in range(300)]
    df = spark.createDataFrame(rows, "product string, t double, id long")
    for order in (("t", "id"), ("-t", "id")):
        series = Series.of("product", order)
        w = Window.partitionBy("product").orderBy(*series.sort)
        expected = _collect(df.select("id", (F.row_number().over(w) - 1).alias("i")))
        assert _collect(row_index(df, series, "i").select("id", "i")) == expected


def test_keys_without_any_place(spark, small_blocks):
    df = spark.createDataFrame([("a" if i % 2 else None, None, i) for i in range(200)], "product string, t long, id long")
    out = row_index(df, Series.of("product", ("t", "id")))
    assert {r.id: r.row_index for r in out.collect()} == {i: i // 2 for i in range(200)}
