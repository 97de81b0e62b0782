import pytest
from pyspark.sql import functions as F

from tickloom.functions import columns as C
from tickloom.operators import book

QUOTES = "timestamp long, product string, side string, price double, quantity double, id long"


def _quotes(spark):
    rows = [
        (1, "a", "BID", 10.0, 1.0, 1), (1, "a", "BID", 12.0, 2.0, 2), (1, "a", "BID", 12.0, 3.0, 3),
        (1, "a", "ASK", 15.0, 4.0, 4), (1, "a", "ASK", 13.0, 5.0, 5),
        (2, "a", "ASK", 14.0, 6.0, 6),
        (1, "b", "BID", None, 7.0, 7), (1, "b", "BID", 3.0, 8.0, 8),
    ]
    return spark.createDataFrame(rows, QUOTES)


def test_levels_keep_equal_prices_apart(spark):
    out = {(r.product, r.timestamp): r for r in book.l2_pivot(_quotes(spark), 3, ties=["id"]).collect()}
    first = out["a", 1]
    assert (first.bid_price_1, first.bid_volume_1, first.bid_price_2, first.bid_volume_2) == (12, 2, 12, 3)
    assert (first.bid_price_3, first.ask_price_1, first.ask_price_2, first.ask_price_3) == (10, 13, 15, None)
    assert out["a", 2].bid_price_1 is None and out["a", 2].ask_volume_1 == 6
    assert (out["b", 1].bid_price_1, out["b", 1].bid_volume_2) == (3, 7)


def test_depth_follows_the_deepest_book(spark):
    out = book.l2_pivot(_quotes(spark), None, ties=["id"], size_name="size")
    assert book.book_depth(_quotes(spark)) == 3
    assert [c for c in out.columns if c.startswith("bid_size")] == ["bid_size_1", "bid_size_2", "bid_size_3"]


def test_a_source_file_may_join_the_key(spark):
    both = _quotes(spark).withColumn("file", F.lit("x")).unionByName(_quotes(spark).withColumn("file", F.lit("y")))
    assert book.l2_pivot(both, 3, ties=["id"], extra_key=["file"]).count() == 6
    assert book.l2_pivot(both, 3, ties=["id"]).count() == 3


def test_ranks_of_any_depth(spark, small_blocks):
    rows = [(1, "a", "BID", float(i // 2), 1.0, i) for i in range(150)] + [(1, "a", "ASK", float(i), 1.0, i) for i in range(5)]
    out = book.level_rank(spark.createDataFrame(rows, QUOTES), ties=["id"])
    bids = sorted((r for r in out.collect() if r.side == "BID"), key=lambda r: r.level)
    assert [r.level for r in bids] == list(range(1, 151))
    assert [(-r.price, r.id) for r in bids] == sorted((-r.price, r.id) for r in bids)


def test_pages_of_one_crowded_instant(spark, small_blocks):
    small_blocks(rowsPerBlock=50_000)
    n = 1_000_000
    crowded = spark.range(n).select(
        F.lit(1).cast("long").alias("timestamp"), F.lit("a").alias("product"), F.lit("BID").alias("side"),
        F.floor((F.col("id") * 7919 % n) / 3).cast("double").alias("price"), F.lit(2.0).alias("quantity"), "id",
    )
    small = spark.createDataFrame([(1, "a", "ASK", 5.0, 1.0, 1), (2, "b", "BID", None, 3.0, 2), (2, "b", "BID", 4.0, 1.0, 3)], QUOTES)
    pages = book.book_pages(crowded.unionByName(small), ties=["id"]).cache()
    deep = pages.filter("side = 'BID' AND product = 'a'")
    assert deep.agg(F.count("page"), F.min(F.size("levels")), F.max(F.size("levels")), F.max("page")).first()[:] == (1000, 1000, 1000, 999)
    assert deep.filter("first_level <> page * 1000 + 1 OR levels[999].level <> first_level + 999").count() == 0
    edges = sorted((r.page, r.levels[0].price, r.levels[-1].price) for r in deep.collect())
    assert all(a[1] >= a[2] >= b[1] for a, b in zip(edges, edges[1:])) and edges[0][1] == n // 3 and edges[-1][2] == 0
    rest = {(r.product, r.side): [tuple(x) for x in r.levels] for r in pages.filter("product = 'b' OR side = 'ASK'").collect()}
    assert rest == {("a", "ASK"): [(1, 5.0, 1.0)], ("b", "BID"): [(1, 4.0, 1.0), (2, None, 3.0)]}
    pages.unpersist()


def test_very_wide_books_are_refused(spark):
    with pytest.raises(ValueError, match="book_pages"):
        book.l2_pivot(_quotes(spark), 501)
    assert book.book_pages(_quotes(spark).limit(0), ties=["id"]).count() == 0


def _book(spark, **values):
    names = [f"{s}_{k}_{i}" for s in ("bid", "ask") for k in ("price", "volume") for i in (1, 2, 3)]
    schema = ", ".join(f"{n} double" for n in names)
    return spark.createDataFrame([tuple(values.get(n) for n in names)], schema)


def test_missing_level_in_the_middle(spark):
    df = _book(spark, bid_price_1=10.0, bid_volume_1=1.0, bid_price_3=8.0, bid_volume_3=3.0, ask_price_1=11.0, ask_volume_1=2.0)
    row = df.select(
        book.depth_map("bid").alias("buy"), book.depth_map("ask").alias("sell"),
        book.best_of_map("bid", book.depth_map("bid")).alias("best"), book.side_volume("bid").alias("total"),
    ).first()
    assert row.buy == {10.0: 1.0, 8.0: 3.0} and row.sell == {11.0: 2.0}
    assert row.best == 10.0 and row.total is None


def test_repeated_price_keeps_the_deeper_level(spark):
    df = _book(spark, bid_price_1=10.0, bid_volume_1=1.0, bid_price_2=10.0, bid_volume_2=5.0)
    assert df.select(book.depth_map("bid").alias("m")).first().m == {10.0: 5.0}


def test_empty_book_side(spark):
    row = _book(spark, ask_price_1=11.0, ask_volume_1=2.0).select(
        book.spread().alias("s"), book.spread(fill=True).alias("sf"), book.mid_filled().alias("m"),
        book.book_mid().alias("bm"), book.imbalance(fill=True).alias("i"),
    ).first()
    assert tuple(row) == (None, 11.0, 5.5, 11.0, -1.0)
    empty = _book(spark).select(book.imbalance(fill=True).alias("i"), book.imbalance().alias("n")).first()
    assert tuple(empty) == (0.0, None)


def test_scalar_columns(spark):
    df = spark.createDataFrame([("OPT_10", "x1", "2.5"), ("OTHER", None, "bad")], "product string, buyer string, n string")
    rows = df.select(
        C.fold_prefix("product", ["OPT_"]).alias("base"), C.number("n").alias("n"),
        C.trade_text("product", "buyer", F.lit("s"), F.lit(3), F.lit(-2), F.lit(100)).alias("text"),
        C.order_text("product", F.lit(3), F.lit(-2)).alias("order"),
    ).collect()
    assert [tuple(r) for r in rows] == [
        ("OPT", 2.5, "(OPT_10, x1 << s, 3, -2, 100)", "(OPT_10, 3, -2)"),
        ("OTHER", None, "(OTHER,  << s, 3, -2, 100)", "(OTHER, 3, -2)"),
    ]
