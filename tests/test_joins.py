from pyspark.sql import functions as F

from tickloom.plans import attach, join_on


def _tables(spark):
    rows = spark.range(500).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), (F.col("id") % 9).cast("string"))).alias("k"), "id"
    )
    side = spark.createDataFrame([("hot", 1)] + [(f"k{i}", i) for i in range(0, 9, 2)], "k string, v int")
    return rows, side


def test_salted_join_equals_plain(spark, small_blocks):
    rows, side = _tables(spark)
    for how in ("left", "inner"):
        expected = sorted(map(tuple, rows.join(side, "k", how).select("k", "id", "v").collect()), key=repr)
        for wide in (100000, 0):
            small_blocks(broadcastRows=wide)
            salted = join_on(rows, side, ["k"], how).select("k", "id", "v")
            assert sorted(map(tuple, salted.collect()), key=repr) == expected


def test_attach_above_the_broadcast_bound(spark, small_blocks):
    rows, side = _tables(spark)
    small_blocks(broadcastRows=2)
    out = attach(rows, side, ["k"])
    assert out.count() == 500
    assert out.filter("k = 'hot' AND v <> 1").count() == 0
    assert "BroadcastHashJoin" not in attach(rows, side, ["k"])._jdf.queryExecution().optimizedPlan().toString()


def test_null_keys_match_when_asked(spark):
    rows = spark.createDataFrame([(None, 1), ("a", 2)], "k string, id int")
    side = spark.createDataFrame([(None, 10), ("a", 20)], "k string, v int")
    assert {(r.id, r.v) for r in attach(rows, side, ["k"], null_safe=True).collect()} == {(1, 10), (2, 20)}
    assert {(r.id, r.v) for r in attach(rows, side, ["k"]).collect()} == {(1, None), (2, 20)}


def test_wide_sides_and_map_columns(spark, small_blocks):
    rows, side = _tables(spark)
    rows = rows.withColumn("m", F.create_map(F.lit("x"), F.col("id")))
    side = side.withColumn("long", F.repeat(F.lit("y"), 1000))
    want = sorted((r.id, r.v) for r in rows.join(side, "k").collect())
    for most in (100, 64_000_000):
        spark.conf.set("spark.tickloom.broadcastBytes", most)
        out = attach(rows, side, ["k"], how="inner")
        assert sorted((r.id, r.v) for r in out.collect()) == want
    spark.conf.unset("spark.tickloom.broadcastBytes")
