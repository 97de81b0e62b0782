import math
import os
import random
import statistics as st

import pytest
from pyspark.sql import functions as F

from tickloom.functions.columns import plus_minutes
from tickloom.operators import stats, synth
from tickloom.plans import settings

KEY, FEATURES = ["product"], ["x", "y"]


def _table(spark, n=300, seed=1, shift=0.0):
    rng = random.Random(seed)
    rows = [("hot" if i % 3 else f"p{i % 2}", i, round(rng.gauss(5 + shift, 2), 2), float(rng.randrange(4))) for i in range(n)]
    return spark.createDataFrame(rows, "product string, t long, x double, y double")


def _values(df, product, column):
    return [r[column] for r in df.filter(F.col("product") == product).collect()]


def test_statistics_per_feature(spark):
    df = _table(spark)
    out = {(r.product, r.feature): r for r in stats.feature_stats(df, KEY, FEATURES).collect()}
    norm = {(r.product, r.feature): r for r in stats.norm_stats(df, KEY, FEATURES).collect()}
    for key in (("hot", "x"), ("p0", "y")):
        values = _values(df, *key)
        assert (out[key].mean, out[key].std) == pytest.approx((st.mean(values), st.stdev(values)))
        assert (out[key].min, out[key].max) == (min(values), max(values))
        assert (norm[key].std, norm[key].max_abs) == pytest.approx((st.pstdev(values), max(map(abs, values))))


def test_minmax_scale_and_back(spark):
    df = _table(spark).withColumn("flat", F.lit(3.0))
    names = [*FEATURES, "flat"]
    scaled = stats.minmax_scale(df, KEY, names)
    assert scaled.filter((F.abs("x") > 1) | (F.abs("y") > 1)).count() == 0
    assert scaled.filter("flat <> -1").count() == 0
    back = stats.minmax_inverse(scaled, FEATURES).join(df.select("t", F.col("x").alias("x0"), F.col("y").alias("y0")), "t")
    assert back.filter((F.abs(F.col("x") - F.col("x0")) > 1e-6) | (F.abs(F.col("y") - F.col("y0")) > 1e-6)).count() == 0


def test_standard_scale(spark):
    df = _table(spark).withColumn("x", F.when(F.col("t") != 7, F.col("x")))
    out = stats.standard_scale(df, KEY, "x")
    assert out.count() == 299
    row = out.groupBy().agg(F.avg("scaled").alias("m")).first()
    assert row.m == pytest.approx(0, abs=1e-9)
    flat = spark.createDataFrame([("a", 2.0), ("a", 2.0)], "product string, x double")
    assert [r.scaled for r in stats.standard_scale(flat, KEY, "x").collect()] == [0.0, 0.0]


def test_statistics_of_another_table(spark):
    rows = spark.createDataFrame([("a", 4.0), ("b", 4.0)], "product string, x double")
    train = spark.createDataFrame([("a", 1.0), ("a", 3.0)], "product string, x double")
    out = {r.product: r for r in stats.normalise(rows, KEY, ["x"], stats_of=train).collect()}
    assert out["a"].x_zscore == pytest.approx(2.0) and out["a"].x_norm == pytest.approx(4 / 3)
    assert (out["b"].x_zscore, out["b"].x_norm) == (0.0, 0.0)


def _distance(a, b):
    return max(abs(sum(x <= v for x in a) / len(a) - sum(x <= v for x in b) / len(b)) for v in {*a, *b})


@pytest.mark.parametrize("block", [20, 100000])
def test_kolmogorov_smirnov(spark, small_blocks, block):
    small_blocks(rowsPerBlock=block)
    real, other = _table(spark), _table(spark, n=210, seed=2, shift=0.7)
    out = {(r.product, r.feature): r for r in stats.ks_2sample(real, other, KEY, FEATURES).collect()}
    for key in (("hot", "x"), ("hot", "y"), ("p1", "x")):
        a, b = _values(real, *key), _values(other, *key)
        d = _distance(a, b)
        assert out[key].ks_statistic == pytest.approx(d)
        lam = d * math.sqrt(len(a) * len(b) / (len(a) + len(b)))
        tail = 2 * sum((-1) ** (k - 1) * math.exp(-2 * k * k * lam * lam) for k in range(1, 200))
        assert out[key].p_value == pytest.approx(min(1.0, tail) if lam >= 0.2 else 1.0, abs=1e-9)
    same = stats.ks_2sample(real, real, KEY, FEATURES).collect()
    assert all(r.ks_statistic == 0 and r.p_value == 1 for r in same)


def test_reports(spark):
    df = _table(spark, n=90)
    asked = spark.createDataFrame([("hot",), ("gone",)], "product string")
    assert [r.product for r in stats.missing_products(asked, df).collect()] == ["gone"]
    report = {r.product: r for r in stats.min_rows_report(df, KEY, ["x", "y", "z", "u", "v"], 50).collect()}
    assert (report["hot"].n_rows, report["hot"].n_sequences, report["hot"].is_enough) == (60, 11, True)
    assert (report["p0"].n_sequences, report["p0"].is_enough) == (11, True) if report["p0"].n_rows == 20 else True
    assert [r.product for r in stats.distinct_products(df, asked).collect()] == ["gone", "hot", "p0", "p1"]


def test_synthetic_rows_stay_in_range_and_repeat(spark):
    df = _table(spark, n=3000)
    made = synth.gaussian_synth(df, KEY, FEATURES, 500, seed=4)
    again = synth.gaussian_synth(df.repartition(7), KEY, FEATURES, 500, seed=4)
    assert made.count() == 1500
    ranges = stats.minmax_stats(df, KEY, FEATURES)
    lows = {(r.product, r.feature): (r.min, r.max) for r in ranges.collect()}
    rows = made.collect()
    assert all(lows[r.product, f][0] <= r[f] <= lows[r.product, f][1] for r in rows for f in FEATURES)
    assert sorted(r.timestamp for r in rows if r.product == "hot") == [100 * i for i in range(500)]
    near = {(r.product, r.timestamp): r.x for r in again.collect()}
    assert all(near[r.product, r.timestamp] == pytest.approx(r.x) for r in rows)
    checked = {(r.product, r.feature): r for r in synth.synth_validate(df, made, KEY, FEATURES).collect()}
    assert checked["hot", "x"].ks_statistic < 0.08
    assert checked["hot", "x"].synth_mean == pytest.approx(checked["hot", "x"].real_mean, abs=0.3)


def test_large_synthetic_sets_are_made_in_chunks(spark):
    df = _table(spark, n=30).filter("product = 'hot'")
    out = synth.gaussian_synth(df, KEY, ["x"], synth.ROWS_PER_CHUNK + 5)
    row = out.agg(F.count("x").alias("n"), F.max("timestamp").alias("last"), F.countDistinct("timestamp").alias("d")).first()
    assert (row.n, row.d, row.last) == (synth.ROWS_PER_CHUNK + 5, synth.ROWS_PER_CHUNK + 5, 100 * (synth.ROWS_PER_CHUNK + 4))


def test_no_synthetic_rows_and_times_per_product(spark):
    real = spark.createDataFrame([("a", 1.0, 10), ("a", 3.0, 30), ("b", 5.0, 7)], "product string, price double, day int")
    assert synth.gaussian_synth(real, ["product"], ["price"], 0).count() == 0
    assert synth.gaussian_synth(real, ["product"], ["price"], 1).count() == 2
    made = spark.createDataFrame([("a", 0), ("b", 1), ("c", 2)], "product string, n int")
    out = synth.carry_constants(made, real, ["price"], ["day"], day="day", key=["product"])
    assert {(r["product"], r.price, r.day) for r in out.collect()} == {("a", 1.0, 31), ("b", 5.0, 8), ("c", None, None)}
    whole = synth.carry_constants(made, real, ["price"], ["day"], day="day")
    assert {(r.price, r.day) for r in whole.collect()} == {(5.0, 31)}
    times = real.selectExpr("product", "timestamp_ntz'2024-01-01 00:00:00' + make_interval(0, 0, 0, day) AS time")
    later = synth.synthetic_time(made, "n", times, "time", key=["product"])
    assert {(r["product"], str(r.time)) for r in later.collect()} == {("a", "2024-01-31 00:00:00"), ("b", "2024-01-08 00:01:00"), ("c", "None")}
    far = spark.range(1).select(plus_minutes(F.lit("2024-01-01").cast("timestamp_ntz"), F.lit(3_000_000_000)).alias("t")).first().t
    assert far.year == 7727


def test_remove_scratch(spark, tmp_path):
    path = settings.scratch_path(spark, "x")
    spark.range(1).write.parquet(path)
    settings.remove_scratch(spark)
    assert not os.path.exists(path.removeprefix("file:"))
