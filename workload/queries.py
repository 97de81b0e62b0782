"""One query per operator over the given tables."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.functions import columns as C
from tickloom.operators import book, features, fills, policy, positions, sequences, signals, stats, synth
from tickloom.plans import Layout, Series, arrange, row_index, running
from tickloom.plans.settings import scratch_path
from tickloom.schema import PRICE_COLUMNS
from tickloom.sources import readers, writers
from tickloom.streaming import batches, stored
from workload import views as V

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(name: str) -> Callable[[Query], Query]:
    def register(make: Query) -> Query:
        QUERIES[name] = make
        return make

    return register


def rounded(places: int, *names: str) -> list[Column]:
    """Columns rounded for comparison, so the last bits of a sum do not matter."""
    return [F.round(F.col(n), places).alias(n) for n in names]


# ---------------------------------------------------------------- flagship


@query("book_features")
def book_features(spark: SparkSession, folder: str) -> DataFrame:
    """Quotes to book to spread, imbalance, log return and rolling z-score."""
    filled = V.book_wide(spark, folder).fillna(0.0)
    filled = filled.withColumns(
        {"bid_ask_spread": book.spread(), "order_book_imbalance": book.imbalance()}
    )
    out = features.add_features(filled, V.BOOK_SERIES, [features.log_return(), features.rolling_zscore()], V.quote_products(spark, folder))
    return out.select(
        "product", "t", "mid_price", "bid_ask_spread",
        *rounded(6, "order_book_imbalance", "log_return", "rolling_mean", "rolling_zscore"),
        *rounded(4, "rolling_stddev"),
    )


# ---------------------------------------------------------------- sources and unions


def _price_files(spark: SparkSession, folder: str) -> str:
    """The book as ``;`` files, each with a header line."""
    path = scratch_path(spark, "prices")
    V.prices17(spark, folder).write.option("sep", ";").option("header", True).csv(path)
    return path


def _typed_prices(text: DataFrame) -> DataFrame:
    keys = {c: F.col(c).cast("long") for c in ("day", "timestamp")}
    return book.to_numeric(text.withColumns(keys), PRICE_COLUMNS[3:])


@query("scan_prices_csv")
def scan_prices_csv(spark: SparkSession, folder: str) -> DataFrame:
    return _typed_prices(readers.scan_prices(spark, _price_files(spark, folder)))


@query("scan_folder")
def scan_folder(spark: SparkSession, folder: str) -> DataFrame:
    return _typed_prices(readers.scan_price_folder(spark, _price_files(spark, folder)))


@query("scan_prices_header")
def scan_prices_header(spark: SparkSession, folder: str) -> DataFrame:
    return readers.scan_prices_header(spark, _price_files(spark, folder))


@query("scan_quotes")
def scan_quotes(spark: SparkSession, folder: str) -> DataFrame:
    """Quote files, those of bids with ``symbol`` and those of asks with ``product``."""
    path = scratch_path(spark, "quotes")
    quotes = V.quotes_long(spark, folder).select(F.col("t").alias("timestamp"), "product", "side", "price", "quantity")
    quotes.filter("side = 'ASK'").select("price", "side", "quantity", "product", "timestamp").write.option("header", True).option("quoteAll", True).csv(path)
    bids = quotes.filter("side = 'BID'").withColumnRenamed("product", "symbol")
    bids.write.mode("append").option("header", True).csv(path)
    read = readers.scan_quotes(spark, path)
    return read.select("product", F.col("timestamp").cast("long").alias("t"), "side", "price", "quantity")


@query("scan_features")
def scan_features(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch_path(spark, "features")
    rows = V.ticks(spark, folder).select("event_id", "price", F.concat("product", F.lit(readers.FEATURE_SUFFIX)).alias("product"))
    rows.filter("event_id % 2 = 0").write.partitionBy("product").option("header", True).csv(path)
    rows.filter("event_id % 2 = 1").select("price", "product", "event_id").write.mode("append").partitionBy("product").option("header", True).csv(path)
    return readers.scan_features(spark, path, T.StructType.fromDDL("event_id bigint, price double"))


@query("write_split")
def write_split(spark: SparkSession, folder: str) -> DataFrame:
    """Price features written by product in one job and read back."""
    path = scratch_path(spark, "split")
    out = features.price_file_features(V.prices17(spark, folder), measure=V.quote_products(spark, folder))
    wanted = out.select("base_product", "round_timestamp", "mid_price", "bid_ask_spread", *rounded(6, "log_return"))
    writers.write_split(wanted, path, by="base_product")
    schema = "round_timestamp bigint, mid_price double, bid_ask_spread double, log_return double, base_product string"
    return spark.read.schema(schema).option("header", True).csv(path)


@query("split_raw")
def split_raw(spark: SparkSession, folder: str) -> DataFrame:
    """Quotes written by product and read back."""
    path = scratch_path(spark, "raw")
    writers.write_split(V.quotes_long(spark, folder).select("product", "t", "side", "price", "quantity"), path)
    return spark.read.schema("t bigint, side string, price double, quantity double, product string").option("header", True).csv(path)


@query("write_tables")
def write_tables(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch_path(spark, "table")
    writers.write_table(V.book_wide(spark, folder), path)
    return spark.read.parquet(path)


@query("default_timestamp")
def default_timestamp(spark: SparkSession, folder: str) -> DataFrame:
    out = sequences.default_timestamp(V.ticks(spark, folder).drop("time"), Series.of("product", "event_id"))
    return out.select("event_id", "product", F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss").alias("timestamp"))


@query("train_table")
def train_table(spark: SparkSession, folder: str) -> DataFrame:
    real = V.real_ticks(spark, folder).select("product", "time", "event_id", "price", "size")
    extra = V.synth_ticks(spark, folder).select("product", "time", "event_id", "price")
    return synth.training_table(real, extra, ["time", "event_id"]).select("event_id", "product", "price", "size")


@query("concat_by_name")
def concat_by_name(spark: SparkSession, folder: str) -> DataFrame:
    left = V.orders_sim(spark, folder).select("product", "t", "price", "quantity")
    right = V.quotes_long(spark, folder).select("product", "t", "price", "side")
    return left.unionByName(right, allowMissingColumns=True)


@query("union_all_positional")
def union_all_positional(spark: SparkSession, folder: str) -> DataFrame:
    left = V.orders_sim(spark, folder).select("product", "t", "price")
    return left.union(V.quotes_long(spark, folder).select("product", "t", F.col("price").alias("p")))


@query("product_set")
def product_set(spark: SparkSession, folder: str) -> DataFrame:
    return stats.distinct_products(V.quotes_long(spark, folder), V.orders_sim(spark, folder), V.ticks(spark, folder))


@query("state_json")
def state_json(spark: SparkSession, folder: str) -> DataFrame:
    """Book state written as JSON and read back."""
    books = V.book_wide(spark, folder)
    text = books.select("product", "t", writers.state_to_json("product", "t", "bid_price_1", "ask_price_1").alias("state"))
    schema = "ask_price_1 double, bid_price_1 double, product string, t bigint"
    back = text.withColumn("s", writers.state_from_json(F.col("state"), schema))
    return back.select(
        "product", "t", F.col("s.bid_price_1").alias("bid_price_1"), F.col("s.ask_price_1").alias("ask_price_1"),
        F.col("s.product").alias("state_product"), F.col("s.t").alias("state_t"),
    )


@query("trading_states")
def trading_states(spark: SparkSession, folder: str) -> DataFrame:
    """Each instant's depths, trades and traded totals by product, written as JSON and read back."""
    levels = lambda side: F.transform_keys(book.depth_map(side), lambda p, _: p.cast("long").cast("string"))
    depths = V.book_wide(spark, folder).select(
        "product", "t", F.struct(levels("bid").alias("buy_orders"), levels("ask").alias("sell_orders")).alias("order_depths")
    )
    trade = F.struct("o_orderkey", F.col("price"), F.col("quantity").cast("double").alias("quantity"))
    trades = V.orders_sim(spark, folder).groupBy("product", "t").agg(
        F.array_sort(F.collect_list(trade)).alias("own_trades"), F.sum("quantity").cast("long").alias("traded")
    )
    rows = depths.join(trades, ["product", "t"], "full")
    text = writers.trading_states(rows, "t", "product", ["order_depths", "own_trades", "traded"])
    schema = (
        "t bigint, order_depths map<string, struct<buy_orders: map<string, double>, sell_orders: map<string, double>>>, "
        "own_trades map<string, array<struct<o_orderkey: bigint, price: double, quantity: double>>>, traded map<string, bigint>"
    )
    back = text.select("t", writers.state_from_json(F.col("state"), schema).alias("s"))
    products = F.array_union(F.map_keys("s.order_depths"), F.map_keys("s.own_trades"))
    back = back.select("t", "s", F.explode(products).alias("product"))
    entry = lambda part, price, quantity: F.struct(F.lit(part).alias("part"), price.cast("double").alias("price"), quantity.cast("double").alias("quantity"))
    depth, own, traded = (F.try_element_at(F.col(f"s.{f}"), F.col("product")) for f in ("order_depths", "own_trades", "traded"))
    levels_of = lambda part, side: F.coalesce(F.transform(F.map_entries(depth[side]), lambda e: entry(part, e["key"], e["value"])), F.array())
    found = F.concat(
        levels_of("BUY", "buy_orders"),
        levels_of("SELL", "sell_orders"),
        F.coalesce(F.transform(own, lambda o: entry("TRADE", o["price"], o["quantity"])), F.array()),
        F.array(entry("TRADED", F.lit(None), F.coalesce(traded, F.lit(0)))),
    )
    return back.select("t", "product", F.inline(found))


# ---------------------------------------------------------------- projections


@query("name_columns")
def name_columns(spark: SparkSession, folder: str) -> DataFrame:
    prices = V.prices17(spark, folder)
    unnamed = prices.toDF(*[f"_c{i}" for i in range(len(PRICE_COLUMNS))])
    return unnamed.toDF(*PRICE_COLUMNS)


@query("cast_fill")
def cast_fill(spark: SparkSession, folder: str) -> DataFrame:
    prices = V.prices17(spark, folder)
    # Missing numbers are written in several ways.
    missing = F.when(F.col("day") % 3 == 0, "NaN").when(F.col("day") % 3 == 1, "")
    text = prices.select(*[
        (F.coalesce(F.col(c).cast("string"), missing) if c in PRICE_COLUMNS[3:] else F.col(c).cast("string")).alias(c)
        for c in prices.columns
    ])
    return book.cast_fill(text).select("product", F.col("day").cast("long").alias("day"),
                                       F.col("timestamp").cast("long").alias("timestamp"), *PRICE_COLUMNS[3:])


@query("to_numeric")
def to_numeric(spark: SparkSession, folder: str) -> DataFrame:
    """Text with bad numbers: those become NULL."""
    text = V.quotes_long(spark, folder).select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "t",
        F.when(F.col("l_linenumber") == 1, "n/a").when(F.col("l_linenumber") == 2, "NaN").otherwise(F.col("price").cast("string")).alias("price"),
    )
    return book.to_numeric(text, ["price"])


@query("round_timestamp")
def round_timestamp(spark: SparkSession, folder: str) -> DataFrame:
    return V.prices17(spark, folder).select("product", "day", "timestamp", book.round_timestamp().alias("round_timestamp"))


@query("base_product")
def base_product(spark: SparkSession, folder: str) -> DataFrame:
    brands = V.table(spark, folder, "part")
    return brands.select("p_partkey", "p_brand", C.fold_prefix("p_brand", ["Brand#1", "Brand#2"]).alias("base_product"))


@query("trade_volume_best")
def trade_volume_best(spark: SparkSession, folder: str) -> DataFrame:
    return V.book_wide(spark, folder).select("product", "t", book.trade_volume_best().alias("trade_volume_best"))


@query("total_volumes")
def total_volumes(spark: SparkSession, folder: str) -> DataFrame:
    out = book.cast_fill(V.prices17(spark, folder)).withColumns(book.volume_columns())
    return out.select("product", "day", "timestamp", "total_bid_volume", "total_ask_volume", "trade_volume_total")


@query("bid_ask_spread")
def bid_ask_spread(spark: SparkSession, folder: str) -> DataFrame:
    return V.book_wide(spark, folder).select(
        "product", "t", book.spread().alias("bid_ask_spread"), book.spread(fill=True).alias("spread_filled")
    )


@query("order_book_imbalance")
def order_book_imbalance(spark: SparkSession, folder: str) -> DataFrame:
    out = V.book_wide(spark, folder).withColumns(
        {"order_book_imbalance": book.imbalance(), "imbalance_filled": book.imbalance(fill=True)}
    )
    return out.select("product", "t", *rounded(6, "order_book_imbalance", "imbalance_filled"))


@query("mid_price")
def mid_price(spark: SparkSession, folder: str) -> DataFrame:
    two_sided = F.when(book.two_sided(), (F.col("bid_price_1") + F.col("ask_price_1")) / 2)
    return V.book_wide(spark, folder).select(
        "product", "t", book.mid_filled().alias("mid_filled"), two_sided.alias("mid_two_sided")
    )


@query("numeric_only")
def numeric_only(spark: SparkSession, folder: str) -> DataFrame:
    return sequences.numeric_only(V.quotes_long(spark, folder), ["product"])


@query("feature_columns")
def feature_columns(spark: SparkSession, folder: str) -> DataFrame:
    books = V.book_wide(spark, folder)
    return books.select(*sequences.feature_columns(books, "t"))


@query("alias_symbol")
def alias_symbol(spark: SparkSession, folder: str) -> DataFrame:
    """One table names its instruments ``symbol``, the other ``product``."""
    alias = readers.alias_symbol
    symbols = V.orders_sim(spark, folder).withColumnRenamed("product", "symbol").select("symbol", "t", "price")
    names = V.quotes_long(spark, folder).select("product", "t", "price")
    return alias(symbols).unionByName(alias(names))


@query("synthetic_time")
def synthetic_time(spark: SparkSession, folder: str) -> DataFrame:
    real, made = V.real_ticks(spark, folder), V.synth_ticks(spark, folder).drop("time")
    numbered = row_index(made, Series.of("product", "event_id"), "n")
    out = synth.synthetic_time(numbered, "n", real, "time", key=["product"])
    after = synth.synthetic_time(numbered, "n", real, "time", after_last=True, key=["product"]).select("event_id", F.col("time").alias("later"))
    text = "yyyy-MM-dd HH:mm:ss"
    return out.join(after, "event_id").select(
        "event_id", "product", F.date_format("time", text).alias("time"), F.date_format("later", text).alias("later")
    )


@query("carry_constants")
def carry_constants(spark: SparkSession, folder: str) -> DataFrame:
    real = V.prices17(spark, folder)
    made = V.orders_sim(spark, folder).select("o_orderkey", "price", "product")
    out = synth.carry_constants(made, real, ["mid_price", "profit_and_loss"], ["day", "timestamp"], day="day", key=["product"])
    return out.select("o_orderkey", "price", "product", "mid_price", "profit_and_loss", "day")


@query("action_delta")
def action_delta(spark: SparkSession, folder: str) -> DataFrame:
    return V.ticks(spark, folder).select(
        "event_id", "action", positions.action_lots(F.col("action")).alias("agent_delta"),
        positions.action_limit_steps(F.col("action"), F.lit(50)).alias("env_delta"),
    )


@query("feature_vector")
def feature_vector(spark: SparkSession, folder: str) -> DataFrame:
    """Feature, indicator and position vector of every tick."""
    held = agent_positions(spark, folder).rows()
    out = policy.agent_features(held, V.TICK_SERIES, V.FEATURES, F.col("position"), F.lit(50))
    vector = F.col("feature_vector")
    return out.select(
        "event_id", F.size(vector).cast("long").alias("n"),
        *[F.round(vector[i], 6).alias(f"v{i}") for i in range(13)],
    )


@query("q_scores")
def q_scores(spark: SparkSession, folder: str) -> DataFrame:
    vectors = V.table(spark, folder, "embeddings")
    scores = policy.q_scores(F.col("embedding").cast("array<double>"), V.ACTION_WEIGHTS)
    out = vectors.withColumn("s", scores)
    return out.select(
        "vec_id", *[F.round(F.col("s")[a], 6).alias(f"q{a}") for a in range(5)], policy.best_action(F.col("s")).alias("action")
    )


@query("q_mask")
def q_mask(spark: SparkSession, folder: str) -> DataFrame:
    vectors = V.table(spark, folder, "embeddings")
    scores = policy.q_scores(F.col("embedding").cast("array<double>"), V.ACTION_WEIGHTS)
    held = (F.col("vec_id") % 5 - 2) * 25
    out = vectors.withColumn("position", held).withColumn("s", scores)
    masked = policy.mask_scores(F.col("s"), F.col("position"), F.lit(50))
    return out.select("vec_id", "position", policy.best_action(masked).alias("action"))


@query("order_depth")
def order_depth(spark: SparkSession, folder: str) -> DataFrame:
    out = V.book_wide(spark, folder).withColumns({"buy": book.depth_map("bid"), "sell": book.depth_map("ask")})
    total = lambda m: F.aggregate(F.map_values(m), F.lit(0.0), lambda s, v: s + v)
    entry = lambda x: F.concat(x["key"].cast("long").cast("string"), F.lit(":"), x["value"].cast("long").cast("string"))
    listed = lambda m: F.array_join(F.transform(F.array_sort(F.map_entries(m)), entry), ",")
    return out.select(
        "product", "t", F.size("buy").cast("long").alias("n_buy"), F.size("sell").cast("long").alias("n_sell"),
        total(F.col("buy")).alias("buy_volume"), total(F.col("sell")).alias("sell_volume"),
        listed("buy").alias("buy_levels"), listed("sell").alias("sell_levels"),
    )


@query("best_level")
def best_level(spark: SparkSession, folder: str) -> DataFrame:
    out = V.book_wide(spark, folder).withColumns({"buy": book.depth_map("bid"), "sell": book.depth_map("ask")})
    return out.select(
        "product", "t", book.best_of_map("bid", F.col("buy")).alias("best_bid"),
        book.best_of_map("ask", F.col("sell")).alias("best_ask"),
    )


@query("trade_string")
def trade_string(spark: SparkSession, folder: str) -> DataFrame:
    orders = V.orders_sim(spark, folder).withColumn("whole", F.col("price").cast("long"))
    return orders.select(
        "o_orderkey", C.order_text("product", "whole", "quantity").alias("order_text"),
        C.trade_text("product", F.lit("me"), F.lit(None).cast("string"), "whole", "quantity", "t").alias("trade_text"),
    )


# ---------------------------------------------------------------- filters


@query("drop_header_rows")
def drop_header_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Price rows with a header row per product among them."""
    prices = V.prices17(spark, folder).select(F.col("day").cast("string").alias("day"), "product", "mid_price")
    headers = V.prices17(spark, folder).select(F.lit("day").alias("day"), "product", "mid_price")
    return readers.drop_header_rows(prices.unionByName(headers)).select(F.col("day").try_cast("long").alias("day"), "product", "mid_price")


@query("by_product")
def by_product(spark: SparkSession, folder: str) -> DataFrame:
    return V.ticks(spark, folder).filter(F.col("product") == "click").select("event_id", "product", "price")


@query("time_window")
def time_window(spark: SparkSession, folder: str) -> DataFrame:
    return sequences.time_window(V.book_wide(spark, folder), "t", 100, 400).select("product", "t", "mid_price")


@query("drop_null_returns")
def drop_null_returns(spark: SparkSession, folder: str) -> DataFrame:
    out = features.add_features(V.ticks(spark, folder), V.TICK_SERIES, [features.log_return("price")])
    return out.dropna(subset=["log_return"]).select("event_id", *rounded(6, "log_return"))


@query("two_sided")
def two_sided(spark: SparkSession, folder: str) -> DataFrame:
    return V.book_wide(spark, folder).filter(book.two_sided()).select("product", "t", "bid_price_1", "ask_price_1")


@query("side_split")
def side_split(spark: SparkSession, folder: str) -> DataFrame:
    bid, ask = F.col("side") == "BID", F.col("side") == "ASK"
    return V.quotes_long(spark, folder).groupBy("product", "t").agg(
        F.count_if(bid).alias("n_bid"), F.count_if(ask).alias("n_ask"),
        F.sum(F.when(bid, F.col("quantity"))).alias("bid_quantity"), F.sum(F.when(ask, F.col("quantity"))).alias("ask_quantity"),
    )


@query("non_hold")
def non_hold(spark: SparkSession, folder: str) -> DataFrame:
    lots = positions.action_lots(F.col("action"))
    return V.ticks(spark, folder).withColumn("quantity", F.abs(lots)).filter(F.col("quantity") > 0).select("event_id", "quantity")


@query("limit_reject")
def limit_reject(spark: SparkSession, folder: str) -> DataFrame:
    limited = stats.by_product_parameters(V.orders_sim(spark, folder), V.params(spark), {"position_limit": 10})
    ok = fills.within_limit(F.col("quantity"), F.col("position_limit"))
    return limited.filter(ok).select("o_orderkey", "product", "quantity")


@query("limit_reject_held")
def limit_reject_held(spark: SparkSession, folder: str) -> DataFrame:
    """Orders in their sequence; one that would leave the limit, given what was accepted before, is refused whole."""
    limited = stats.by_product_parameters(V.orders_sim(spark, folder), V.params(spark), {"position_limit": 10})
    laid = arrange(limited, Series.of("product", ("t", "o_orderkey")), measure=V.orders_sim(spark, folder))
    out = fills.accepted_orders(laid, F.col("quantity"), F.col("position_limit")).rows()
    return out.select("o_orderkey", "product", "quantity", "position_before", "position", "accepted")


@query("min_rows_guard")
def min_rows_guard(spark: SparkSession, folder: str) -> DataFrame:
    return stats.min_rows_report(V.ticks(spark, folder), ["product"], ["price", "size", "mid_price", "action", "event_id"], 50)


@query("empty_products")
def empty_products(spark: SparkSession, folder: str) -> DataFrame:
    """Products of the order table that the tick table lacks."""
    asked = V.orders_sim(spark, folder).select("product").distinct()
    return stats.missing_products(asked, V.ticks(spark, folder))


@query("drop_first_return")
def drop_first_return(spark: SparkSession, folder: str) -> DataFrame:
    out = policy.direction_labels(V.ticks(spark, folder), V.TICK_SERIES)
    return out.select("event_id", *rounded(6, "r"))


# ---------------------------------------------------------------- joins


@query("order_fill")
def order_fill(spark: SparkSession, folder: str) -> DataFrame:
    out = fills.order_fill(V.orders_sim(spark, folder), V.book_wide(spark, folder), ["product", "t"])
    return out.select("o_orderkey", "product", "t", "quantity", "price", "fill_price")


@query("product_params")
def product_params(spark: SparkSession, folder: str) -> DataFrame:
    out = stats.by_product_parameters(V.orders_sim(spark, folder), V.params(spark), signals.DEFAULTS)
    return out.select(
        "o_orderkey", "product", "momentum_weight", F.col("min_position").cast("long").alias("min_position"),
        "volatility_threshold", "zscore_threshold", F.col("position_limit").cast("long").alias("position_limit"),
    )


@query("stats_back_join")
def stats_back_join(spark: SparkSession, folder: str) -> DataFrame:
    out = stats.normalise(V.ticks(spark, folder), ["product"], V.FEATURES)
    return out.select("event_id", *rounded(6, "price_zscore", "price_norm", "size_zscore", "size_norm"))


@query("train_test_stats")
def train_test_stats(spark: SparkSession, folder: str) -> DataFrame:
    split = sequences.split_rows(V.ticks(spark, folder), V.TICK_SERIES)
    train, test = split.filter("is_train"), split.filter("NOT is_train")
    out = stats.normalise(test, ["product"], V.FEATURES, stats_of=train)
    return out.select("event_id", *rounded(6, "price_zscore", "price_norm", "size_zscore", "size_norm"))


@query("real_vs_synth")
def real_vs_synth(spark: SparkSession, folder: str) -> DataFrame:
    out = stats.distribution_compare(V.real_ticks(spark, folder), V.synth_ticks(spark, folder), ["product"], V.FEATURES)
    return out.select("product", "feature", *rounded(6, "real_mean", "synth_mean"))


# ---------------------------------------------------------------- aggregations


@query("l2_pivot")
def l2_pivot(spark: SparkSession, folder: str) -> DataFrame:
    """Whole books, every quote of both sides, best first, as text."""
    books = book.full_books(V.quotes_long(spark, folder), "t", V.QUOTE_TIES)

    def listed(side: str, field: str):
        return F.array_join(F.transform(side, lambda e: e[field].cast("long").cast("string")), ",")

    return books.select(
        "product", "t", F.size("bids").cast("long").alias("n_bids"), F.size("asks").cast("long").alias("n_asks"),
        *[listed(s, f).alias(f"{s}_{f}") for s in ("bids", "asks") for f in ("price", "quantity")],
    )


@query("book_pages")
def book_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Each side in pages of two levels, as text."""
    pages = book.book_pages(V.quotes_long(spark, folder), "t", V.QUOTE_TIES, page_levels=2)
    entry = lambda e: F.concat(e["price"].cast("long").cast("string"), F.lit(":"), e["quantity"].cast("long").cast("string"))
    listed = F.array_join(F.transform("levels", entry), ",")
    return pages.select("product", "t", "side", "page", "first_level", listed.alias("levels"))


@query("l2_top")
def l2_top(spark: SparkSession, folder: str) -> DataFrame:
    """The best three levels of each side as columns."""
    return V.book_wide(spark, folder)


@query("distinct_products")
def distinct_products(spark: SparkSession, folder: str) -> DataFrame:
    return stats.distinct_products(V.quotes_long(spark, folder))


@query("distinct_times")
def distinct_times(spark: SparkSession, folder: str) -> DataFrame:
    return stats.distinct_times(V.quotes_long(spark, folder), "t")


@query("feature_stats")
def feature_stats(spark: SparkSession, folder: str) -> DataFrame:
    out = stats.feature_stats(V.ticks(spark, folder), ["product"], V.FEATURES)
    return out.select("product", "feature", *rounded(6, "mean", "std", "min", "max"))


@query("norm_stats")
def norm_stats(spark: SparkSession, folder: str) -> DataFrame:
    out = stats.norm_stats(V.ticks(spark, folder), ["product"], V.FEATURES)
    return out.select("product", "feature", *rounded(6, "mean", "std", "max_abs"))


@query("minmax_stats")
def minmax_stats(spark: SparkSession, folder: str) -> DataFrame:
    rows = V.ticks(spark, folder).withColumn("flat", F.lit(1.0))
    out = stats.minmax_stats(rows, ["product"], [*V.FEATURES, "flat"])
    return out.select("product", "feature", "min", "max", "is_constant")


@query("standard_scale")
def standard_scale(spark: SparkSession, folder: str) -> DataFrame:
    returns = features.add_features(V.ticks(spark, folder), V.TICK_SERIES, [features.log_return("price")])
    return stats.standard_scale(returns, ["product"], "log_return").select("event_id", *rounded(6, "scaled"))


@query("max_time")
def max_time(spark: SparkSession, folder: str) -> DataFrame:
    return V.ticks(spark, folder).agg(F.date_format(F.max("time"), "yyyy-MM-dd HH:mm:ss").alias("last_time"), F.max("event_id").alias("last_event"))


@query("row_counts")
def row_counts(spark: SparkSession, folder: str) -> DataFrame:
    return stats.row_counts(V.book_wide(spark, folder), ["product"])


@query("ks_2sample")
def ks_2sample(spark: SparkSession, folder: str) -> DataFrame:
    out = stats.ks_2sample(V.real_ticks(spark, folder), V.synth_ticks(spark, folder), ["product"], V.FEATURES)
    return out.select("product", "feature", "n_real", "n_synth", *rounded(6, "ks_statistic", "p_value"))


@query("distribution_compare")
def distribution_compare(spark: SparkSession, folder: str) -> DataFrame:
    out = stats.distribution_compare(V.real_ticks(spark, folder), V.synth_ticks(spark, folder), ["product"], V.FEATURES)
    measures = [f"{side}_{m}" for side in ("real", "synth") for m in ("mean", "std", "min", "max")]
    return out.select("product", "feature", *rounded(6, *measures))


# ---------------------------------------------------------------- window features


def _price_features(spark: SparkSession, folder: str, wanted: Sequence[features.Feature], *columns: Column | str) -> DataFrame:
    prices = book.cast_fill(V.prices17(spark, folder)).withColumns(
        {"round_timestamp": book.round_timestamp(), **book.volume_columns()}
    )
    out = features.add_features(prices, Series.of("product", "round_timestamp"), wanted, V.quote_products(spark, folder))
    return out.select("product", "round_timestamp", *columns)


@query("log_return")
def log_return(spark: SparkSession, folder: str) -> DataFrame:
    return _price_features(spark, folder, [features.log_return()], "lag_mid_price", *rounded(6, "log_return"))


@query("rolling_zscore")
def rolling_zscore(spark: SparkSession, folder: str) -> DataFrame:
    return _price_features(
        spark, folder, [features.rolling_zscore()], *rounded(4, "rolling_mean", "rolling_stddev"), *rounded(6, "rolling_zscore")
    )


@query("volume_weighted_return")
def volume_weighted_return(spark: SparkSession, folder: str) -> DataFrame:
    return _price_features(spark, folder, [features.volume_weighted_return()], *rounded(6, "volume_weighted_return"))


@query("depth_volatility")
def depth_volatility(spark: SparkSession, folder: str) -> DataFrame:
    return _price_features(spark, folder, [features.depth_volatility()], *rounded(6, "depth_volatility"))


@query("macd")
def macd(spark: SparkSession, folder: str) -> DataFrame:
    return _price_features(spark, folder, [features.macd()], *rounded(4, "fast_ma", "slow_ma", "macd_line", "macd_signal"))


@query("rsi")
def rsi(spark: SparkSession, folder: str) -> DataFrame:
    return _price_features(
        spark, folder, [features.rsi()], "diff", "gain", "loss", *rounded(6, "avg_gain", "avg_loss", "rs", "rsi")
    )


@query("cci")
def cci(spark: SparkSession, folder: str) -> DataFrame:
    return _price_features(spark, folder, [features.cci()], *rounded(6, "sma", "mad"), *rounded(4, "cci"))


@query("rolling_volatility")
def rolling_volatility(spark: SparkSession, folder: str) -> DataFrame:
    return _price_features(spark, folder, [features.rolling_volatility()], *rounded(6, "rolling_volatility"))


@query("feature_table")
def feature_table(spark: SparkSession, folder: str) -> DataFrame:
    """All features of a price file in one plan."""
    out = features.price_file_features(V.prices17(spark, folder), measure=V.quote_products(spark, folder))
    return out.select(
        "product", "round_timestamp", "base_product", "trade_volume_best", "trade_volume_total", "bid_ask_spread",
        *rounded(6, "order_book_imbalance", "log_return", "rolling_zscore", "volume_weighted_return", "depth_volatility",
                 "rsi", "rolling_volatility"),
        *rounded(4, "macd_line", "macd_signal", "cci"),
    )


@query("feature_table_folded")
def feature_table_folded(spark: SparkSession, folder: str) -> DataFrame:
    """All features with windows over folded products: what shares a prefix is one series, in order of time and product."""
    basket = F.when(F.col("product").isin("P0", "P1"), "LEFT_").otherwise("RIGHT_")
    prices = V.prices17(spark, folder).withColumn("product", F.concat(basket, F.col("product")))
    out = features.price_file_features(prices, key="base_product", ties=["product"], fold_prefixes=["LEFT", "RIGHT"])
    return out.select(
        "product", "round_timestamp", "base_product", "trade_volume_best", "trade_volume_total", "bid_ask_spread",
        *rounded(6, "order_book_imbalance", "log_return", "rolling_zscore", "volume_weighted_return", "depth_volatility",
                 "rsi", "rolling_volatility"),
        *rounded(4, "macd_line", "macd_signal", "cci"),
    )


def _quote_features(spark: SparkSession, folder: str, *columns: Column | str) -> DataFrame:
    out = features.quote_book_features(V.book_sizes(spark, folder), "product", "t", measure=V.quote_products(spark, folder))
    return out.select("product", "t", *columns)


@query("price_change")
def price_change(spark: SparkSession, folder: str) -> DataFrame:
    return _quote_features(spark, folder, "price_change")


@query("volatility_full")
def volatility_full(spark: SparkSession, folder: str) -> DataFrame:
    return _quote_features(spark, folder, *rounded(4, "volatility"))


@query("momentum")
def momentum(spark: SparkSession, folder: str) -> DataFrame:
    return _quote_features(spark, folder, *rounded(6, "momentum"))


@query("volume_trend")
def volume_trend(spark: SparkSession, folder: str) -> DataFrame:
    return _quote_features(spark, folder, *rounded(6, "volume_trend"))


@query("quote_feature_table")
def quote_feature_table(spark: SparkSession, folder: str) -> DataFrame:
    return _quote_features(
        spark, folder, "mid_price", "spread", "price_change", *rounded(6, "imbalance", "momentum", "volume_trend"),
        *rounded(4, "volatility"),
    )


@query("level_rank")
def level_rank(spark: SparkSession, folder: str) -> DataFrame:
    out = book.level_rank(V.quotes_long(spark, folder), "t", V.QUOTE_TIES)
    return out.select("product", "t", "side", "price", "quantity", "level")


def _flat_sequences(out: DataFrame) -> DataFrame:
    """Whole sequences as text: prices in hundredths, and sizes."""
    rows = F.col("sequence")
    listed = lambda i, scale: F.array_join(F.transform(rows, lambda r: F.round(r[i].cast("double") * scale).cast("long").cast("string")), ",")
    return out.select("event_id", F.size(rows).cast("long").alias("length"), listed(0, 100).alias("prices"), listed(1, 1).alias("sizes"))


@query("sequences")
def sequence_rows(spark: SparkSession, folder: str) -> DataFrame:
    return _flat_sequences(sequences.sequences(V.ticks(spark, folder), V.TICK_SERIES, V.FEATURES, 50))


@query("sequences_strided")
def sequence_rows_strided(spark: SparkSession, folder: str) -> DataFrame:
    """Every 25th sequence of each product."""
    return _flat_sequences(sequences.sequences(V.ticks(spark, folder), V.TICK_SERIES, V.FEATURES, 50, stride=25))


@query("direction_label")
def direction_label(spark: SparkSession, folder: str) -> DataFrame:
    return policy.direction_labels(V.ticks(spark, folder), V.TICK_SERIES).select("event_id", "direction")


def _history(spark: SparkSession, folder: str) -> DataFrame:
    rows = V.book_wide(spark, folder).filter(book.two_sided())
    rows = rows.withColumn("mid_price", (F.col("bid_price_1") + F.col("ask_price_1")) / 2)
    return signals.price_history(rows, V.BOOK_SERIES, measure=V.quote_products(spark, folder))


@query("history_stats")
def history_stats(spark: SparkSession, folder: str) -> DataFrame:
    return _history(spark, folder).select("product", "t", "history_rows", *rounded(4, "history_mean", "history_std"))


@query("moving_averages")
def moving_averages(spark: SparkSession, folder: str) -> DataFrame:
    return _history(spark, folder).select("product", "t", *rounded(4, "short_ma", "long_ma"))


@query("short_volatility")
def short_volatility(spark: SparkSession, folder: str) -> DataFrame:
    return _history(spark, folder).select("product", "t", *rounded(4, "short_volatility"))


@query("zscore_norm")
def zscore_norm(spark: SparkSession, folder: str) -> DataFrame:
    out = _history(spark, folder).withColumn("normalised", signals.zscore())
    out = out.withColumn("restored", signals.from_zscore(F.col("normalised")))
    return out.select("product", "t", *rounded(6, "normalised"), *rounded(4, "restored"))


@query("trend_strength")
def trend_strength(spark: SparkSession, folder: str) -> DataFrame:
    out = _history(spark, folder).withColumns(
        {"over_volatility": signals.trend_over_volatility(), "over_mean": signals.trend_over_mean()}
    )
    return out.select("product", "t", *rounded(6, "over_volatility", "over_mean"))


def _fair(spark: SparkSession, folder: str) -> DataFrame:
    return signals.fair_prices(
        V.book_wide(spark, folder), V.BOOK_SERIES, V.params(spark), measure=V.quote_products(spark, folder)
    )


@query("fair_price")
def fair_price(spark: SparkSession, folder: str) -> DataFrame:
    return _fair(spark, folder).select("product", "t", "mid_price", *rounded(6, "signal"), *rounded(4, "acceptable_price"))


@query("target_size")
def target_size(spark: SparkSession, folder: str) -> DataFrame:
    return _fair(spark, folder).select("product", "t", "target_size")


@query("quote_orders")
def quote_orders(spark: SparkSession, folder: str) -> DataFrame:
    out = signals.quote_orders(_fair(spark, folder))
    return out.select("product", "t", "order_side", "order_price", "quantity")


@query("quote_orders_held")
def quote_orders_held(spark: SparkSession, folder: str) -> DataFrame:
    """Orders that know the position held: it narrows the room on its side."""
    held = F.pmod(F.col("t"), F.lit(7)) * 10 - 30
    return signals.quote_orders(_fair(spark, folder), held).select("product", "t", "order_side", "order_price", "quantity")


@query("quote_orders_filled")
def quote_orders_filled(spark: SparkSession, folder: str) -> DataFrame:
    """Orders whose fills move the position that later orders have to fit."""
    out = signals.filled_orders(_fair(spark, folder), V.BOOK_SERIES, measure=V.quote_products(spark, folder))
    return out.select("product", "t", "order_side", "order_price", "quantity", "position_before", "position")


@query("train_test_split")
def train_test_split(spark: SparkSession, folder: str) -> DataFrame:
    return sequences.split_rows(V.ticks(spark, folder), V.TICK_SERIES).select("event_id", "row_index", "is_train")


@query("feature_momentum")
def feature_momentum(spark: SparkSession, folder: str) -> DataFrame:
    out = policy.feature_momentum(V.ticks(spark, folder), V.TICK_SERIES, V.FEATURES)
    return out.select("event_id", *rounded(6, "price_momentum", "size_momentum"))


@query("row_index")
def row_numbers(spark: SparkSession, folder: str) -> DataFrame:
    return row_index(V.ticks(spark, folder), V.TICK_SERIES).select("event_id", "row_index")


# ---------------------------------------------------------------- positions


def agent_positions(spark: SparkSession, folder: str) -> Layout:
    laid = arrange(V.ticks(spark, folder), V.TICK_SERIES)
    return positions.hold(laid, positions.action_lots(F.col("action")), F.lit(50))


def env_steps(spark: SparkSession, folder: str) -> Layout:
    return positions.step_rewards(V.ticks(spark, folder), V.TICK_SERIES, limit=50)


@query("clamped_position")
def clamped_position(spark: SparkSession, folder: str) -> DataFrame:
    return agent_positions(spark, folder).rows().select("event_id", "position_before", "position", "change")


@query("varying_limit_position")
def varying_limit_position(spark: SparkSession, folder: str) -> DataFrame:
    """Agent positions under a limit that changes over time."""
    limit = F.lit(20) + 10 * (F.floor(F.col("event_id") / 100) % 3)
    out = positions.clamped_position(V.ticks(spark, folder), V.TICK_SERIES, positions.action_lots(F.col("action")), limit)
    return out.select("event_id", "position_before", "position", "change")


@query("action_side")
def action_side(spark: SparkSession, folder: str) -> DataFrame:
    out = agent_positions(spark, folder).rows().withColumn("trade_side", positions.trade_side(F.col("change")))
    return out.select("event_id", "action", "trade_side", F.abs("change").alias("quantity"))


@query("position_features")
def position_features(spark: SparkSession, folder: str) -> DataFrame:
    out = agent_positions(spark, folder).rows().withColumns(positions.position_features(F.col("position"), F.lit(50)))
    return out.select("event_id", *rounded(6, "position_share"), "is_long", "is_short")


@query("executed_trades")
def executed_trades(spark: SparkSession, folder: str) -> DataFrame:
    out = positions.executed_trades(agent_positions(spark, folder).rows())
    return out.select("event_id", "product", "trade_side", "trade_quantity", "trade_price")


@query("signals_per_product")
def signals_per_product(spark: SparkSession, folder: str) -> DataFrame:
    out = positions.signals_per_product(agent_positions(spark, folder))
    return out.select("event_id", "product", "signal_number", "trade_side", "trade_quantity")


@query("realized_pnl")
def realized_pnl(spark: SparkSession, folder: str) -> DataFrame:
    out = positions.realized_pnl(agent_positions(spark, folder))
    return out.select("product", "n_trades", *rounded(4, "realized_pnl"))


@query("mark_to_market")
def mark_to_market(spark: SparkSession, folder: str) -> DataFrame:
    out = positions.mark_to_market(agent_positions(spark, folder)).rows()
    return out.select("event_id", "position", *rounded(4, "realized_pnl", "unrealized_pnl", "pnl"))


@query("step_reward")
def step_reward(spark: SparkSession, folder: str) -> DataFrame:
    return env_steps(spark, folder).rows().select("event_id", "position", "change", *rounded(6, "reward"))


@query("cumulative_pnl")
def cumulative_pnl(spark: SparkSession, folder: str) -> DataFrame:
    return positions.cumulative_pnl(env_steps(spark, folder)).rows().select("event_id", *rounded(6, "pnl"))


@query("trade_log")
def trade_log(spark: SparkSession, folder: str) -> DataFrame:
    out = positions.trade_log(positions.cumulative_pnl(env_steps(spark, folder)))
    return out.select(
        "event_id", "action", "change", F.date_format("trade_time", "yyyy-MM-dd HH:mm:ss").alias("trade_time"),
        "trade_price", *rounded(6, "pnl"),
    )


@query("observation")
def observation(spark: SparkSession, folder: str) -> DataFrame:
    """Feature row, share of the limit held and profit so far, before each step."""
    out = positions.cumulative_pnl(env_steps(spark, folder)).rows()
    seen = policy.observation(["price", "size"], F.col("position_before"), F.lit(50), F.col("pnl") - F.col("reward"))
    out = out.withColumn("o", seen)
    return out.select(
        "event_id", F.size("o").cast("long").alias("n"),
        *[F.round(F.col("o")[i].cast("double"), 2).alias(n) for i, n in enumerate(["price", "size", "share", "pnl"])],
    )


@query("last_observation")
def last_observation(spark: SparkSession, folder: str) -> DataFrame:
    """What an agent sees after its last step."""
    stepped = positions.cumulative_pnl(env_steps(spark, folder)).rows()
    out = policy.last_observations(stepped, V.ticks(spark, folder), V.TICK_SERIES, ["price", "size"], F.lit(50))
    return out.select(
        "product", "event_id",
        *[F.round(F.col("observation")[i].cast("double"), 2).alias(n) for i, n in enumerate(["price", "size", "share", "pnl"])],
    )


@query("direction_reward")
def direction_reward(spark: SparkSession, folder: str) -> DataFrame:
    labelled = policy.direction_labels(V.ticks(spark, folder), V.TICK_SERIES)
    out = labelled.withColumn("reward", policy.direction_reward(F.col("action") % 2, F.col("direction"), F.col("r")))
    return out.select("event_id", *rounded(6, "reward"))


@query("position_changes")
def position_changes(spark: SparkSession, folder: str) -> DataFrame:
    return positions.position_changes(env_steps(spark, folder))


@query("backtest_summary")
def backtest_summary(spark: SparkSession, folder: str) -> DataFrame:
    out = positions.backtest_summary(env_steps(spark, folder))
    return out.select("product", "max_position", "n_changes", "n_steps", *rounded(6, "total_reward", "sharpe_ratio"))


@query("total_pnl")
def total_pnl(spark: SparkSession, folder: str) -> DataFrame:
    return env_steps(spark, folder).rows().groupBy("product").agg(
        F.round(F.sum("reward"), 6).alias("total_pnl"), F.count_if(F.col("change") != 0).alias("n_trades")
    )


@query("backtest")
def backtest(spark: SparkSession, folder: str) -> DataFrame:
    """Position, reward and running profit of every step, in one job."""
    out = positions.cumulative_pnl(env_steps(spark, folder)).rows()
    return out.select("event_id", "product", "action", "position", "change", *rounded(6, "reward", "pnl"))


# ---------------------------------------------------------------- order and top-k


@query("sort_time")
def sort_time(spark: SparkSession, folder: str) -> DataFrame:
    return V.ticks(spark, folder).orderBy("time", "event_id").select("event_id", "product", "price")


@query("sort_levels")
def sort_levels(spark: SparkSession, folder: str) -> DataFrame:
    """All quotes of a side in level order."""
    out = book.level_rank(V.quotes_long(spark, folder), "t", V.QUOTE_TIES)
    return out.orderBy("product", "t", "side", "level").select("product", "t", "side", F.col("level").cast("long").alias("level"), "price")


@query("latest_n")
def latest_n(spark: SparkSession, folder: str) -> DataFrame:
    return sequences.latest_rows(V.ticks(spark, folder), V.TICK_SERIES, 5).select("event_id", "product", "price")


@query("head_n")
def head_n(spark: SparkSession, folder: str) -> DataFrame:
    return V.ticks(spark, folder).orderBy("time", "event_id").limit(10).select("event_id", "product", "price")


@query("last_row")
def last_row(spark: SparkSession, folder: str) -> DataFrame:
    return sequences.last_row(V.ticks(spark, folder), V.TICK_SERIES).select("event_id", "product", "price")


# ---------------------------------------------------------------- scaling and synthetic rows


@query("minmax_scale")
def minmax_scale(spark: SparkSession, folder: str) -> DataFrame:
    return stats.minmax_scale(V.ticks(spark, folder), ["product"], V.FEATURES).select("event_id", *rounded(6, *V.FEATURES))


@query("minmax_inverse")
def minmax_inverse(spark: SparkSession, folder: str) -> DataFrame:
    scaled = stats.minmax_scale(V.ticks(spark, folder), ["product"], V.FEATURES)
    return stats.minmax_inverse(scaled, V.FEATURES).select("event_id", *rounded(4, *V.FEATURES))


@query("gaussian_synth")
def gaussian_synth(spark: SparkSession, folder: str) -> DataFrame:
    return synth.gaussian_synth(V.ticks(spark, folder).filter(F.col("product") == "click"), ["product"], V.FEATURES, 1000).select("product", "timestamp", *rounded(6, *V.FEATURES))


def _synth_rows(spark: SparkSession, folder: str) -> DataFrame:
    return synth.gaussian_synth(V.ticks(spark, folder), ["product"], V.FEATURES, 1000)


@query("gaussian_synth_all")
def gaussian_synth_all(spark: SparkSession, folder: str) -> DataFrame:
    return _synth_rows(spark, folder).select("product", "timestamp", *rounded(6, *V.FEATURES))


@query("synth_validate")
def synth_validate(spark: SparkSession, folder: str) -> DataFrame:
    made = _synth_rows(spark, folder)
    out = synth.synth_validate(V.ticks(spark, folder), made, ["product"], V.FEATURES)
    return out.select("product", "feature", *rounded(5, *[c for c in out.columns if c not in ("product", "feature")]))


@query("running_totals")
def running_totals(spark: SparkSession, folder: str) -> DataFrame:
    out = running(V.ticks(spark, folder), V.TICK_SERIES, sums={"size_so_far": F.col("size")})
    return out.select("event_id", "size_so_far")


# ---------------------------------------------------------------- streams


def _replay(df: DataFrame, axis: Column, start: Callable[[DataFrame], object], parts: int = 3) -> None:
    """Feed a table to a streaming query in time order, stopping and resuming it between parts."""
    spark = df.sparkSession
    inbox = scratch_path(spark, "inbox")
    cuts = df.agg(F.percentile_approx(axis, [i / parts for i in range(1, parts)])).first()[0]
    bounds = [None, *cuts, None]
    for low, high in zip(bounds, bounds[1:]):
        part = df
        if low is not None:
            part = part.filter(axis > F.lit(low))
        if high is not None:
            part = part.filter(axis <= F.lit(high))
        part.write.mode("append").parquet(inbox)
        start(spark.readStream.schema(df.schema).parquet(inbox)).awaitTermination()


@query("stream_signals")
def stream_signals(spark: SparkSession, folder: str) -> DataFrame:
    """Orders from books that arrive in three batches."""
    path = scratch_path(spark, "signals")
    params = V.params(spark)
    _replay(
        V.book_wide(spark, folder), F.col("t"),
        lambda books: batches.stream_signals(books, V.BOOK_SERIES, path, params),
    )
    out = spark.read.parquet(f"{path}/orders")
    return out.select("product", "t", "order_side", "order_price", "quantity")


@query("stream_signals_held")
def stream_signals_held(spark: SparkSession, folder: str) -> DataFrame:
    """Orders from books that arrive in three batches, with fills that move the position from batch to batch."""
    path = scratch_path(spark, "signals")
    params = V.params(spark)
    _replay(
        V.book_wide(spark, folder), F.col("t"),
        lambda books: batches.stream_signals(books, V.BOOK_SERIES, path, params, fills=True),
    )
    out = spark.read.parquet(f"{path}/orders")
    return out.select("product", "t", "order_side", "order_price", "quantity", "position_before", "position")


@query("stream_signals_stored")
def stream_signals_stored(spark: SparkSession, folder: str) -> DataFrame:
    """The same orders with the last mids and the position as typed state in Spark's store."""
    day = F.date_add(F.lit("1995-01-01").cast("date"), F.col("t").cast("int")).cast("timestamp")
    path = scratch_path(spark, "signals")
    params = V.params(spark)
    _replay(
        V.book_wide(spark, folder), F.col("t"),
        lambda books: stored.stored_signals(books, V.BOOK_SERIES, path, day, params, fills=True),
    )
    out = spark.read.parquet(f"{path}/orders")
    return out.select("product", "t", "order_side", "order_price", "quantity", "position_before", "position")


@query("stream_positions")
def stream_positions(spark: SparkSession, folder: str) -> DataFrame:
    """Positions and profit of ticks that arrive in three batches."""
    path = scratch_path(spark, "positions")
    _replay(
        V.ticks(spark, folder), F.col("event_id"),
        lambda ticks: batches.stream_positions(
            ticks, V.TICK_SERIES, path, positions.action_lots(F.col("action")), F.lit(50)
        ),
    )
    out = spark.read.parquet(f"{path}/positions")
    return out.select("event_id", "position", *rounded(4, "realized_pnl", "unrealized_pnl", "pnl"))
