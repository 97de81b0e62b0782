"""The same queries as SQL over the given tables."""

from __future__ import annotations

import re

LEVELS = (1, 2, 3)
PRICE_COLUMNS = (
    ["day", "timestamp", "product"]
    + [f"{s}_{k}_{i}" for s in ("bid", "ask") for i in LEVELS for k in ("price", "volume")]
    + ["mid_price", "profit_and_loss"]
)
NUMBERS = PRICE_COLUMNS[3:]
TIES = "quantity, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice"

QUOTES = """quotes AS (
  SELECT 'P' || (l_suppkey % 5) AS product,
         date_diff('day', DATE '1995-01-01', CAST(l_shipdate AS DATE)) AS t,
         CASE WHEN l_linestatus = 'F' THEN 'BID' ELSE 'ASK' END AS side,
         floor(l_extendedprice / l_quantity) AS price, l_quantity AS quantity,
         l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice
  FROM lineitem)"""

RANKED = f"""ranked AS (
  SELECT *, row_number() OVER (PARTITION BY product, t, side
    ORDER BY CASE WHEN side = 'BID' THEN -price ELSE price END, {TIES}) AS level
  FROM quotes)"""

_LEVELS = ", ".join(
    f"max({src}) FILTER (WHERE side = '{s.upper()}' AND level = {i}) AS {s}_{k}_{i}"
    for s in ("bid", "ask")
    for i in LEVELS
    for k, src in (("price", "price"), ("volume", "quantity"))
)
BOOK = f"""pivoted AS (SELECT product, t, {_LEVELS} FROM ranked GROUP BY product, t),
book AS (SELECT *, coalesce((bid_price_1 + ask_price_1) / 2, bid_price_1, ask_price_1) AS mid_price FROM pivoted)"""

PRICES = f"""prices AS (
  SELECT CAST(floor(t / 365.0) AS BIGINT) AS day, CAST((t - 365 * floor(t / 365.0)) * 100 AS BIGINT) AS timestamp,
         {", ".join(PRICE_COLUMNS[2:-1])}, CAST(0 AS DOUBLE) AS profit_and_loss FROM book),
filled AS (SELECT product, day, timestamp, timestamp + 1000000 * day AS round_timestamp,
  {", ".join(f"coalesce({c}, 0) AS {c}" for c in NUMBERS)} FROM prices)"""

TICKS = """ticks AS (
  SELECT event_type AS product, ts AS time, event_id, value AS price, value AS mid_price,
         user_id % 20 + 1 AS size, user_id % 5 AS action FROM events)"""

SPLIT = """reals AS (SELECT * FROM ticks WHERE event_id % 2 = 0),
synths AS (SELECT * FROM ticks WHERE event_id % 2 = 1)"""

ORDERS = """orders_sim AS (
  SELECT o_orderkey, 'P' || (o_custkey % 5) AS product,
         date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) AS t,
         floor(o_totalprice / 100) AS price,
         CASE WHEN o_orderkey % 2 = 1 THEN -(o_custkey % 20 + 1) ELSE o_custkey % 20 + 1 END AS quantity
  FROM orders)"""

PARAMS = """params(product, momentum_weight, min_position, volatility_threshold, zscore_threshold, position_limit) AS (
  VALUES ('P0', 0.4::DOUBLE, 15, 1.2::DOUBLE, 0.5::DOUBLE, 50), ('P1', 0.8, 20, 0.8, 0.4, 50), ('P2', 0.6, 18, 1.5, 0.7, 50))"""

BOOKS = f"{QUOTES}, {RANKED}, {BOOK}"
PRICED = f"{BOOKS}, {PRICES}"


def r(places: int, *names: str) -> str:
    return ", ".join(f"round({n}, {places}) + 0.0 AS {n}" for n in names)


def last(n: int, key: str = "product", order: str = "round_timestamp") -> str:
    return f"(PARTITION BY {key} ORDER BY {order} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def win(order: str = "round_timestamp") -> str:
    return f"(PARTITION BY product ORDER BY {order})"


TICK_ORDER = "time, event_id"
SQL: dict[str, str] = {}

# ---------------------------------------------------------------- features of price rows

STAGE1 = f"""s1 AS (SELECT *, lag(mid_price) OVER {win()} AS lag_mid_price,
  avg(mid_price) OVER {last(10)} AS rolling_mean, stddev_samp(mid_price) OVER {last(10)} AS rolling_stddev,
  stddev_samp(bid_volume_1 + ask_volume_1) OVER {last(10)} AS depth_volatility,
  avg(mid_price) OVER {last(12)} AS fast_ma, avg(mid_price) OVER {last(26)} AS slow_ma,
  avg(mid_price) OVER {last(20)} AS sma,
  least(bid_volume_1, ask_volume_1) AS trade_volume_best,
  bid_volume_1 + bid_volume_2 + bid_volume_3 AS total_bid_volume,
  ask_volume_1 + ask_volume_2 + ask_volume_3 AS total_ask_volume,
  ask_price_1 - bid_price_1 AS bid_ask_spread,
  (bid_volume_1 - ask_volume_1) / nullif(bid_volume_1 + ask_volume_1, 0) AS order_book_imbalance
  FROM filled),
s2 AS (SELECT *, ln(nullif(mid_price / nullif(lag_mid_price, 0), 0)) AS log_return,
  (mid_price - rolling_mean) / nullif(rolling_stddev, 0) AS rolling_zscore,
  fast_ma - slow_ma AS macd_line, mid_price - lag_mid_price AS diff,
  CASE WHEN mid_price > lag_mid_price THEN mid_price - lag_mid_price ELSE 0 END AS gain,
  CASE WHEN mid_price < lag_mid_price THEN lag_mid_price - mid_price ELSE 0 END AS loss,
  least(total_bid_volume, total_ask_volume) AS trade_volume_total FROM s1),
s3 AS (SELECT *, sum(log_return * trade_volume_best) OVER {last(10)} / nullif(sum(trade_volume_best) OVER {last(10)}, 0)
    AS volume_weighted_return,
  avg(macd_line) OVER {last(9)} AS macd_signal,
  avg(gain) OVER {last(14)} AS avg_gain, avg(loss) OVER {last(14)} AS avg_loss,
  avg(abs(mid_price - sma)) OVER {last(20)} AS mad,
  stddev_samp(log_return) OVER {last(10)} AS rolling_volatility FROM s2),
s4 AS (SELECT *, avg_gain / nullif(avg_loss, 0) AS rs, 100 - 100 / (1 + avg_gain / nullif(avg_loss, 0)) AS rsi,
  (mid_price - sma) / nullif(0.015 * mad, 0) AS cci FROM s3)"""


def price_sql(columns: str) -> str:
    return f"WITH {PRICED}, {STAGE1} SELECT product, round_timestamp, {columns} FROM s4"


SQL["log_return"] = price_sql("lag_mid_price, " + r(6, "log_return"))
SQL["rolling_zscore"] = price_sql(r(4, "rolling_mean", "rolling_stddev") + ", " + r(6, "rolling_zscore"))
SQL["volume_weighted_return"] = price_sql(r(6, "volume_weighted_return"))
SQL["depth_volatility"] = price_sql(r(6, "depth_volatility"))
SQL["macd"] = price_sql(r(4, "fast_ma", "slow_ma", "macd_line", "macd_signal"))
SQL["rsi"] = price_sql("diff, gain, loss, " + r(6, "avg_gain", "avg_loss", "rs", "rsi"))
SQL["cci"] = price_sql(r(6, "sma", "mad") + ", " + r(4, "cci"))
SQL["rolling_volatility"] = price_sql(r(6, "rolling_volatility"))
SQL["feature_table"] = price_sql(
    "product AS base_product, trade_volume_best, trade_volume_total, bid_ask_spread, "
    + r(6, "order_book_imbalance", "log_return", "rolling_zscore", "volume_weighted_return", "depth_volatility",
        "rsi", "rolling_volatility")
    + ", " + r(4, "macd_line", "macd_signal", "cci")
)
_FOLDED = STAGE1.replace("PARTITION BY product", "PARTITION BY base_product").replace("ORDER BY round_timestamp", "ORDER BY round_timestamp, product")
SQL["feature_table_folded"] = f"""WITH {PRICED.replace("filled AS (SELECT product,", "filled_ AS (SELECT product,")},
filled AS (SELECT * REPLACE (CASE WHEN product IN ('P0', 'P1') THEN 'LEFT_' ELSE 'RIGHT_' END || product AS product),
  CASE WHEN product IN ('P0', 'P1') THEN 'LEFT' ELSE 'RIGHT' END AS base_product FROM filled_), {_FOLDED}
SELECT product, round_timestamp, base_product, trade_volume_best, trade_volume_total, bid_ask_spread,
  {r(6, "order_book_imbalance", "log_return", "rolling_zscore", "volume_weighted_return", "depth_volatility", "rsi", "rolling_volatility")},
  {r(4, "macd_line", "macd_signal", "cci")} FROM s4"""
SQL["book_features"] = f"""WITH {PRICED}, {STAGE1}
SELECT product, day * 365 + timestamp // 100 AS t, mid_price, bid_ask_spread,
  {r(6, "order_book_imbalance", "log_return", "rolling_mean", "rolling_zscore")}, {r(4, "rolling_stddev")} FROM s4"""

# ---------------------------------------------------------------- features of pivoted quotes

QUOTE_STAGES = f"""q1 AS (SELECT product, t,
  (coalesce(bid_price_1, 0) + coalesce(ask_price_1, 0)) / 2 AS mid_price,
  coalesce(ask_price_1, 0) - coalesce(bid_price_1, 0) AS spread,
  coalesce(bid_volume_1, 0) + coalesce(ask_volume_1, 0) AS total,
  coalesce((coalesce(bid_volume_1, 0) - coalesce(ask_volume_1, 0))
    / nullif(coalesce(bid_volume_1, 0) + coalesce(ask_volume_1, 0), 0), 0) AS imbalance FROM book),
q2 AS (SELECT *, mid_price - lag(mid_price) OVER {win("t")} AS change FROM q1),
q3 AS (SELECT product, t, mid_price, spread, imbalance, coalesce(change, 0) AS price_change,
  CASE WHEN count(mid_price) OVER {last(10, order="t")} >= 10 THEN stddev_samp(mid_price) OVER {last(10, order="t")} ELSE 0 END AS volatility,
  CASE WHEN count(change) OVER {last(10, order="t")} >= 10 THEN avg(change) OVER {last(10, order="t")} ELSE 0 END AS momentum,
  CASE WHEN count(total) OVER {last(10, order="t")} >= 10 THEN avg(total) OVER {last(10, order="t")} ELSE 0 END AS volume_trend
  FROM q2)"""


def quote_sql(columns: str) -> str:
    return f"WITH {BOOKS}, {QUOTE_STAGES} SELECT product, t, {columns} FROM q3"


SQL["price_change"] = quote_sql("price_change")
SQL["volatility_full"] = quote_sql(r(4, "volatility"))
SQL["momentum"] = quote_sql(r(6, "momentum"))
SQL["volume_trend"] = quote_sql(r(6, "volume_trend"))
SQL["quote_feature_table"] = quote_sql(
    "mid_price, spread, price_change, " + r(6, "imbalance", "momentum", "volume_trend") + ", " + r(4, "volatility")
)

# ---------------------------------------------------------------- book projections

SQL["l2_top"] = f"WITH {BOOKS} SELECT * FROM book"
_LISTED = ", ".join(
    f"coalesce(string_agg(CAST(CAST({f} AS BIGINT) AS VARCHAR), ',' ORDER BY level) FILTER (WHERE side = '{s[:3].upper()}'), '') AS {s}_{f}"
    for s in ("bids", "asks")
    for f in ("price", "quantity")
)
SQL["l2_pivot"] = f"""WITH {QUOTES}, {RANKED} SELECT product, t, count(*) FILTER (WHERE side = 'BID') AS n_bids,
  count(*) FILTER (WHERE side = 'ASK') AS n_asks, {_LISTED} FROM ranked GROUP BY product, t"""
SQL["book_pages"] = f"""WITH {QUOTES}, {RANKED} SELECT product, t, side, (level - 1) // 2 AS page, min(level) AS first_level,
  string_agg(CAST(price AS BIGINT) || ':' || CAST(quantity AS BIGINT), ',' ORDER BY level) AS levels FROM ranked GROUP BY product, t, side, page"""
SQL["name_columns"] = f"WITH {PRICED} SELECT * FROM prices"
SQL["cast_fill"] = f"WITH {PRICED} SELECT {', '.join(PRICE_COLUMNS)} FROM filled"
SQL["round_timestamp"] = f"WITH {PRICED} SELECT product, day, timestamp, round_timestamp FROM filled"
SQL["to_numeric"] = f"""WITH {QUOTES} SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, t,
  CASE WHEN l_linenumber IN (1, 2) THEN NULL ELSE price END AS price FROM quotes"""
SQL["base_product"] = """SELECT p_partkey, p_brand, CASE WHEN starts_with(p_brand, 'Brand#2') THEN 'Brand#2'
  WHEN starts_with(p_brand, 'Brand#1') THEN 'Brand#1' ELSE p_brand END AS base_product FROM part"""
SQL["trade_volume_best"] = f"WITH {BOOKS} SELECT product, t, least(bid_volume_1, ask_volume_1) AS trade_volume_best FROM book"
SQL["total_volumes"] = f"""WITH {PRICED}, {STAGE1}
SELECT product, day, timestamp, total_bid_volume, total_ask_volume, trade_volume_total FROM s2"""
SQL["bid_ask_spread"] = f"""WITH {BOOKS} SELECT product, t, ask_price_1 - bid_price_1 AS bid_ask_spread,
  coalesce(ask_price_1, 0) - coalesce(bid_price_1, 0) AS spread_filled FROM book"""
SQL["order_book_imbalance"] = f"""WITH {BOOKS}, x AS (SELECT product, t,
  (bid_volume_1 - ask_volume_1) / nullif(bid_volume_1 + ask_volume_1, 0) AS order_book_imbalance,
  coalesce((coalesce(bid_volume_1, 0) - coalesce(ask_volume_1, 0))
    / nullif(coalesce(bid_volume_1, 0) + coalesce(ask_volume_1, 0), 0), 0) AS imbalance_filled FROM book)
SELECT product, t, {r(6, "order_book_imbalance", "imbalance_filled")} FROM x"""
SQL["mid_price"] = f"""WITH {BOOKS} SELECT product, t,
  (coalesce(bid_price_1, 0) + coalesce(ask_price_1, 0)) / 2 AS mid_filled,
  (bid_price_1 + ask_price_1) / 2 AS mid_two_sided FROM book"""
SQL["numeric_only"] = f"""WITH {QUOTES} SELECT product, t, price, quantity, l_orderkey, l_linenumber, l_partkey,
  l_suppkey, l_extendedprice FROM quotes"""
SQL["feature_columns"] = f"WITH {BOOKS} SELECT * EXCLUDE (t) FROM book"
SQL["order_depth"] = f"""WITH {BOOKS}, sides AS (
  SELECT product, t, side, price, quantity, level FROM ranked WHERE level <= 3),
merged AS (SELECT product, t, side, price, arg_max(quantity, level) AS quantity FROM sides GROUP BY ALL)
SELECT product, t, count(*) FILTER (WHERE side = 'BID') AS n_buy, count(*) FILTER (WHERE side = 'ASK') AS n_sell,
  coalesce(sum(quantity) FILTER (WHERE side = 'BID'), 0) AS buy_volume,
  coalesce(sum(quantity) FILTER (WHERE side = 'ASK'), 0) AS sell_volume,
  coalesce(string_agg(CAST(price AS BIGINT) || ':' || CAST(quantity AS BIGINT), ',' ORDER BY price) FILTER (WHERE side = 'BID'), '') AS buy_levels,
  coalesce(string_agg(CAST(price AS BIGINT) || ':' || CAST(quantity AS BIGINT), ',' ORDER BY price) FILTER (WHERE side = 'ASK'), '') AS sell_levels
FROM merged GROUP BY product, t"""
SQL["best_level"] = f"""WITH {QUOTES} SELECT product, t, max(price) FILTER (WHERE side = 'BID') AS best_bid,
  min(price) FILTER (WHERE side = 'ASK') AS best_ask FROM quotes GROUP BY product, t"""
SQL["level_rank"] = f"WITH {QUOTES}, {RANKED} SELECT product, t, side, price, quantity, level FROM ranked"
SQL["sort_levels"] = f"WITH {QUOTES}, {RANKED} SELECT product, t, side, level, price FROM ranked"
SQL["two_sided"] = f"""WITH {BOOKS} SELECT product, t, bid_price_1, ask_price_1 FROM book
WHERE bid_price_1 IS NOT NULL AND ask_price_1 IS NOT NULL"""
SQL["side_split"] = f"""WITH {QUOTES} SELECT product, t, count(*) FILTER (WHERE side = 'BID') AS n_bid,
  count(*) FILTER (WHERE side = 'ASK') AS n_ask, sum(quantity) FILTER (WHERE side = 'BID') AS bid_quantity,
  sum(quantity) FILTER (WHERE side = 'ASK') AS ask_quantity FROM quotes GROUP BY product, t"""
SQL["time_window"] = f"WITH {BOOKS} SELECT product, t, mid_price FROM book WHERE t BETWEEN 100 AND 400"
SQL["drop_header_rows"] = f"WITH {PRICED} SELECT day, product, mid_price FROM prices"
SQL["row_counts"] = f"WITH {QUOTES} SELECT product, count(DISTINCT t) AS n_rows FROM quotes GROUP BY product"
SQL["distinct_products"] = f"WITH {QUOTES} SELECT DISTINCT product FROM quotes"
SQL["distinct_times"] = f"WITH {QUOTES} SELECT DISTINCT t FROM quotes"
SQL["state_json"] = f"""WITH {BOOKS} SELECT product, t, bid_price_1, ask_price_1, product AS state_product, t AS state_t FROM book"""
SQL["trading_states"] = f"""WITH {BOOKS}, {ORDERS}, sides AS (SELECT product, t, side, price, quantity, level FROM ranked WHERE level <= 3),
merged AS (SELECT product, t, side, price, arg_max(quantity, level) AS quantity FROM sides GROUP BY ALL),
present AS (SELECT product, t FROM merged UNION SELECT product, t FROM orders_sim),
traded AS (SELECT product, t, sum(quantity) AS traded FROM orders_sim GROUP BY product, t)
SELECT t, product, CASE side WHEN 'BID' THEN 'BUY' ELSE 'SELL' END AS part, price, CAST(quantity AS DOUBLE) AS quantity FROM merged
UNION ALL SELECT t, product, 'TRADE', price, CAST(quantity AS DOUBLE) FROM orders_sim
UNION ALL SELECT t, product, 'TRADED', NULL, CAST(coalesce(traded, 0) AS DOUBLE) FROM present LEFT JOIN traded USING (product, t)"""

# ---------------------------------------------------------------- ticks: projections, filters, unions

SQL["default_timestamp"] = f"""WITH {TICKS}, n AS (SELECT event_id, product,
  row_number() OVER (PARTITION BY product ORDER BY event_id) - 1 AS i FROM ticks)
SELECT event_id, product, strftime(TIMESTAMP '2024-01-01' + i * INTERVAL 1 MINUTE, '%Y-%m-%d %H:%M:%S') AS timestamp FROM n"""
SQL["train_table"] = f"""WITH {TICKS} SELECT event_id, product, price,
  CASE WHEN event_id % 2 = 0 THEN size END AS size FROM ticks"""
SQL["concat_by_name"] = f"""WITH {QUOTES}, {ORDERS} SELECT product, t, price, quantity, NULL::VARCHAR AS side FROM orders_sim
UNION ALL SELECT product, t, price, NULL, side FROM quotes"""
SQL["union_all_positional"] = f"""WITH {QUOTES}, {ORDERS} SELECT product, t, price FROM orders_sim
UNION ALL SELECT product, t, price FROM quotes"""
SQL["alias_symbol"] = SQL["union_all_positional"]
SQL["product_set"] = f"""WITH {QUOTES}, {ORDERS}, {TICKS} SELECT product FROM quotes UNION SELECT product FROM orders_sim
UNION SELECT product FROM ticks"""
SQL["synthetic_time"] = f"""WITH {TICKS}, {SPLIT}, m AS (SELECT product, max(time) AS last FROM reals GROUP BY product),
n AS (SELECT event_id, product, row_number() OVER (PARTITION BY product ORDER BY event_id) - 1 AS i FROM synths)
SELECT event_id, product, strftime(last + i * INTERVAL 1 MINUTE, '%Y-%m-%d %H:%M:%S') AS time,
  strftime(last + (i + 1) * INTERVAL 1 MINUTE, '%Y-%m-%d %H:%M:%S') AS later FROM n LEFT JOIN m USING (product)"""
SQL["carry_constants"] = f"""WITH {PRICED}, {ORDERS},
f AS (SELECT product, arg_min(mid_price, (day, timestamp)) AS mid_price, arg_min(profit_and_loss, (day, timestamp)) AS profit_and_loss,
  max(day) + 1 AS day FROM prices GROUP BY product)
SELECT o_orderkey, price, product, mid_price, profit_and_loss, day FROM orders_sim LEFT JOIN f USING (product)"""
LOTS = "CASE action WHEN 0 THEN -10 WHEN 1 THEN -5 WHEN 3 THEN 5 WHEN 4 THEN 10 ELSE 0 END"
SQL["action_delta"] = f"""WITH {TICKS} SELECT event_id, action, CAST({LOTS} AS BIGINT) AS agent_delta,
  (action - 2) * 25 AS env_delta FROM ticks"""
SQL["non_hold"] = f"WITH {TICKS} SELECT event_id, CAST(abs({LOTS}) AS BIGINT) AS quantity FROM ticks WHERE action <> 2"
SQL["by_product"] = f"WITH {TICKS} SELECT event_id, product, price FROM ticks WHERE product = 'click'"
SQL["trade_string"] = f"""WITH {ORDERS} SELECT o_orderkey,
  '(' || product || ', ' || CAST(price AS BIGINT) || ', ' || quantity || ')' AS order_text,
  '(' || product || ', me << , ' || CAST(price AS BIGINT) || ', ' || quantity || ', ' || t || ')' AS trade_text FROM orders_sim"""
SQL["limit_reject"] = f"""WITH {ORDERS}, {PARAMS} SELECT o_orderkey, o.product, quantity FROM orders_sim o
LEFT JOIN params p ON o.product = p.product WHERE abs(quantity) <= coalesce(position_limit, 10)"""
SQL["product_params"] = f"""WITH {ORDERS}, {PARAMS} SELECT o_orderkey, o.product,
  coalesce(momentum_weight, 0.6) AS momentum_weight, CAST(coalesce(min_position, 15) AS BIGINT) AS min_position,
  coalesce(volatility_threshold, 1.2) AS volatility_threshold, coalesce(zscore_threshold, 0.5) AS zscore_threshold,
  CAST(coalesce(position_limit, 50) AS BIGINT) AS position_limit
FROM orders_sim o LEFT JOIN params p ON o.product = p.product"""
SQL["order_fill"] = f"""WITH {BOOKS}, {ORDERS} SELECT o_orderkey, o.product, o.t, quantity, price,
  CASE WHEN quantity > 0 AND price >= ask_price_1 THEN ask_price_1
       WHEN quantity < 0 AND price <= bid_price_1 THEN bid_price_1 END AS fill_price
FROM orders_sim o JOIN book b ON o.product = b.product AND o.t = b.t"""
SQL["min_rows_guard"] = f"""WITH {TICKS}, c AS (SELECT product, count(*) AS n_rows FROM ticks GROUP BY product),
d AS (SELECT product, n_rows, CAST(5 AS BIGINT) AS n_features,
  CASE WHEN n_rows >= 50 THEN n_rows - 49 WHEN n_rows >= 10 THEN n_rows - greatest(5, n_rows // 2) + 1 ELSE 0 END AS n_sequences FROM c)
SELECT *, n_sequences >= 10 AS is_enough FROM d"""
SQL["empty_products"] = f"""WITH {ORDERS}, {TICKS} SELECT DISTINCT product FROM orders_sim
WHERE product NOT IN (SELECT product FROM ticks)"""
SQL["max_time"] = f"""WITH {TICKS} SELECT strftime(max(time), '%Y-%m-%d %H:%M:%S') AS last_time,
  max(event_id) AS last_event FROM ticks"""
SQL["sort_time"] = f"WITH {TICKS} SELECT event_id, product, price FROM ticks"
SQL["head_n"] = f"WITH {TICKS} SELECT event_id, product, price FROM ticks ORDER BY {TICK_ORDER} LIMIT 10"
SQL["latest_n"] = f"""WITH {TICKS} SELECT event_id, product, price FROM ticks
QUALIFY row_number() OVER (PARTITION BY product ORDER BY time DESC, event_id DESC) <= 5"""
SQL["last_row"] = SQL["latest_n"].replace("<= 5", "= 1")
SQL["row_index"] = f"""WITH {TICKS} SELECT event_id,
  row_number() OVER {win(TICK_ORDER)} - 1 AS row_index FROM ticks"""
SQL["running_totals"] = f"""WITH {TICKS} SELECT event_id, CAST(sum(size) OVER {win(TICK_ORDER)} AS BIGINT) AS size_so_far FROM ticks"""

# ---------------------------------------------------------------- ticks: returns and labels

RETURNS = f"""returns AS (SELECT *, ln(nullif(price / nullif(lag(price) OVER {win(TICK_ORDER)}, 0), 0)) AS r FROM ticks)"""
SQL["drop_null_returns"] = f"WITH {TICKS}, {RETURNS} SELECT event_id, round(r, 6) + 0.0 AS log_return FROM returns WHERE r IS NOT NULL"
SQL["drop_first_return"] = f"WITH {TICKS}, {RETURNS} SELECT event_id, {r(6, 'r')} FROM returns WHERE r IS NOT NULL"
SQL["direction_label"] = f"""WITH {TICKS}, {RETURNS} SELECT event_id, CAST(r > 0 AS BIGINT) AS direction
FROM returns WHERE r IS NOT NULL"""
SQL["direction_reward"] = f"""WITH {TICKS}, {RETURNS} SELECT event_id,
  round(CASE WHEN action % 2 = CAST(r > 0 AS BIGINT) THEN abs(r) ELSE -abs(r) END, 6) + 0.0 AS reward
FROM returns WHERE r IS NOT NULL"""
SQL["standard_scale"] = f"""WITH {TICKS}, {RETURNS}, m AS (SELECT product, avg(r) AS mean, stddev_pop(r) AS std FROM returns GROUP BY product)
SELECT event_id, round((r - mean) / CASE WHEN std = 0 THEN 1 ELSE std END, 6) + 0.0 AS scaled
FROM returns JOIN m USING (product) WHERE r IS NOT NULL"""
SQL["feature_momentum"] = f"""WITH {TICKS}, x AS (SELECT event_id,
  coalesce(price - lag(price) OVER {win(TICK_ORDER)}, 0) AS price_momentum,
  CAST(coalesce(size - lag(size) OVER {win(TICK_ORDER)}, 0) AS DOUBLE) AS size_momentum FROM ticks)
SELECT event_id, {r(6, "price_momentum", "size_momentum")} FROM x"""

# ---------------------------------------------------------------- statistics

LONG = """long AS (SELECT product, 'price' AS feature, price AS v FROM ticks
  UNION ALL SELECT product, 'size', CAST(size AS DOUBLE) FROM ticks)"""
SQL["feature_stats"] = f"""WITH {TICKS}, {LONG}, g AS (SELECT product, feature, avg(v) AS mean, stddev_samp(v) AS std,
  min(v) AS min, max(v) AS max FROM long GROUP BY ALL) SELECT product, feature, {r(6, "mean", "std", "min", "max")} FROM g"""
SQL["norm_stats"] = f"""WITH {TICKS}, {LONG}, g AS (SELECT product, feature, avg(v) AS mean, stddev_pop(v) AS std,
  max(abs(v)) AS max_abs FROM long GROUP BY ALL) SELECT product, feature, {r(6, "mean", "std", "max_abs")} FROM g"""
SQL["minmax_stats"] = f"""WITH {TICKS}, {LONG}, l2 AS (FROM long UNION ALL SELECT product, 'flat', 1.0 FROM ticks)
SELECT product, feature, min(v) AS min, max(v) AS max, max(v) - min(v) < 1e-8 AS is_constant FROM l2 GROUP BY ALL"""


def _normalised(rows: str, source: str) -> str:
    parts = ", ".join(
        f"round((t.{f} - {f}_mean) / ({f}_std + 1e-8), 6) + 0.0 AS {f}_zscore, "
        f"round(t.{f} / ({f}_max + 1e-8), 6) + 0.0 AS {f}_norm"
        for f in ("price", "size")
    )
    stats = ", ".join(
        f"avg({f}) AS {f}_mean, stddev_pop({f}) AS {f}_std, max(abs({f})) AS {f}_max" for f in ("price", "size")
    )
    return f"""g AS (SELECT product, {stats} FROM {source} GROUP BY product)
SELECT event_id, {parts} FROM {rows} t JOIN g USING (product)"""


SQL["stats_back_join"] = f"WITH {TICKS}, {_normalised('ticks', 'ticks')}"
NUMBERED = f"""numbered AS (SELECT *, row_number() OVER {win(TICK_ORDER)} - 1 AS row_index,
  count(*) OVER (PARTITION BY product) AS n FROM ticks),
split AS (SELECT *, row_index < floor(n * 0.8::DOUBLE) AS is_train FROM numbered)"""
SQL["train_test_split"] = f"WITH {TICKS}, {NUMBERED} SELECT event_id, row_index, is_train FROM split"
SQL["train_test_stats"] = f"""WITH {TICKS}, {NUMBERED}, train AS (FROM split WHERE is_train), test AS (FROM split WHERE NOT is_train),
{_normalised("test", "train")}"""
BOTH = """la AS (SELECT product, 'price' AS feature, price AS v FROM reals UNION ALL SELECT product, 'size', CAST(size AS DOUBLE) FROM reals),
lb AS (SELECT product, 'price' AS feature, price AS v FROM synths UNION ALL SELECT product, 'size', CAST(size AS DOUBLE) FROM synths)"""
_MOMENTS = "avg(v) AS {0}_mean, stddev_pop(v) AS {0}_std, min(v) AS {0}_min, max(v) AS {0}_max"
COMPARED = f"""{BOTH}, ga AS (SELECT product, feature, {_MOMENTS.format("real")} FROM la GROUP BY ALL),
gb AS (SELECT product, feature, {_MOMENTS.format("synth")} FROM lb GROUP BY ALL), j AS (FROM ga JOIN gb USING (product, feature))"""
SQL["real_vs_synth"] = f"WITH {TICKS}, {SPLIT}, {COMPARED} SELECT product, feature, {r(6, 'real_mean', 'synth_mean')} FROM j"
SQL["distribution_compare"] = f"""WITH {TICKS}, {SPLIT}, {COMPARED} SELECT product, feature,
  {r(6, *[f"{s}_{m}" for s in ("real", "synth") for m in ("mean", "std", "min", "max")])} FROM j"""
KS = f"""pool AS (SELECT product, feature, v, 1 AS a, 0 AS b FROM la UNION ALL SELECT product, feature, v, 0, 1 FROM lb),
m AS (SELECT product, feature, v, sum(a) AS a, sum(b) AS b FROM pool GROUP BY ALL),
n AS (SELECT product, feature, sum(a) AS n_real, sum(b) AS n_synth FROM pool GROUP BY ALL),
c AS (SELECT product, feature, sum(a) OVER w AS ca, sum(b) OVER w AS cb FROM m WINDOW w AS (PARTITION BY product, feature ORDER BY v)),
d AS (SELECT product, feature, n_real, n_synth, max(abs(ca / n_real - cb / n_synth)) AS ks_statistic
  FROM c JOIN n USING (product, feature) GROUP BY ALL),
x AS (SELECT *, sqrt(n_real * n_synth / (n_real + n_synth)) * ks_statistic AS l FROM d),
p AS (SELECT *, CASE WHEN l < 0.2 THEN 1.0 ELSE least(1.0, greatest(0.0, 2 * list_sum(list_transform(range(1, 101),
  lambda k: CASE WHEN k % 2 = 1 THEN 1 ELSE -1 END * exp(-2.0 * k * k * l * l))))) END AS p_value FROM x)"""
SQL["ks_2sample"] = f"""WITH {TICKS}, {SPLIT}, {BOTH}, {KS}
SELECT product, feature, CAST(n_real AS BIGINT) AS n_real, CAST(n_synth AS BIGINT) AS n_synth, {r(6, "ks_statistic", "p_value")} FROM p"""

# The synthetic rows: the same digests, the same draws.
def _uniform(salt: int) -> str:
    return f"((CAST('0x' || substr(md5(concat_ws('|', '0', feature, product, i, '{salt}')), 1, 12) AS BIGINT) + 0.5) / 281474976710656.0)"


DRAWN = f"""made AS (SELECT product, feature, i, greatest(min, least(max, mean + coalesce(std, 0) *
  sqrt(-2 * ln({_uniform(1)})) * cos(2 * pi() * {_uniform(2)}))) AS v
  FROM (SELECT product, feature, avg(v) AS mean, stddev_samp(v) AS std, min(v) AS min, max(v) AS max FROM long GROUP BY ALL), range(1000) n(i))"""
SQL["gaussian_synth_all"] = f"""WITH {TICKS}, {LONG}, {DRAWN} SELECT product, i * 100 AS timestamp,
  round(max(v) FILTER (WHERE feature = 'price'), 6) + 0.0 AS price, round(max(v) FILTER (WHERE feature = 'size'), 6) + 0.0 AS size
  FROM made GROUP BY product, i"""
SQL["gaussian_synth"] = f"SELECT * FROM ({SQL['gaussian_synth_all']}) WHERE product = 'click'"
SQL["synth_validate"] = f"""WITH {TICKS}, {LONG}, {DRAWN},
la AS (SELECT product, feature, v FROM long), lb AS (SELECT product, feature, v FROM made), {KS},
j AS (SELECT a.product, a.feature, avg(a.v) AS real_mean, stddev_pop(a.v) AS real_std, min(a.v) AS real_min, max(a.v) AS real_max FROM la a GROUP BY ALL),
k AS (SELECT b.product, b.feature, avg(b.v) AS synth_mean, stddev_pop(b.v) AS synth_std, min(b.v) AS synth_min, max(b.v) AS synth_max FROM lb b GROUP BY ALL)
SELECT product, feature, {r(5, *[f"{s}_{m}" for s in ("real", "synth") for m in ("mean", "std", "min", "max")])},
  {r(5, "ks_statistic", "p_value")}, round(CAST(n_real AS DOUBLE), 5) AS n_real, round(CAST(n_synth AS DOUBLE), 5) AS n_synth
FROM j JOIN k USING (product, feature) JOIN p USING (product, feature)"""
_RANGES = "SELECT product, min(price) AS p0, max(price) AS p1, min(size) AS s0, max(size) AS s1 FROM ticks GROUP BY product"
SQL["minmax_scale"] = f"""WITH {TICKS}, g AS ({_RANGES}), x AS (SELECT event_id,
  greatest(-1.0, least(1.0, 2 * (price - p0) / (p1 - p0 + 1e-8) - 1)) AS price,
  greatest(-1.0, least(1.0, 2 * (size - s0) / (s1 - s0 + 1e-8) - 1)) AS size FROM ticks JOIN g USING (product))
SELECT event_id, {r(6, "price", "size")} FROM x"""
SQL["minmax_inverse"] = f"WITH {TICKS} SELECT event_id, round(price, 4) + 0.0 AS price, CAST(size AS DOUBLE) AS size FROM ticks"
_SEQUENCES = f"""WITH {TICKS}, c AS (SELECT product, count(*) AS n FROM ticks GROUP BY product),
l AS (SELECT product, CASE WHEN n >= 50 THEN 50 ELSE greatest(5, n // 2) END AS len FROM c WHERE n >= 10),
o AS (SELECT *, row_number() OVER {win(TICK_ORDER)} AS i FROM ticks JOIN l USING (product)),
s AS (SELECT event_id, product, len, i, list(CAST(round(price * 100) AS BIGINT)) OVER w AS prices, list(CAST(size AS BIGINT)) OVER w AS sizes FROM o
  WINDOW w AS (PARTITION BY product ORDER BY i ROWS BETWEEN CURRENT ROW AND 49 FOLLOWING))
SELECT event_id, CAST(len AS BIGINT) AS length, array_to_string(prices[1:len], ',') AS prices, array_to_string(sizes[1:len], ',') AS sizes
FROM s WHERE len(prices) >= len"""
SQL["sequences"] = _SEQUENCES
SQL["sequences_strided"] = f"{_SEQUENCES} AND (i - 1) % 25 = 0"

# ---------------------------------------------------------------- signals

HISTORY = f"""mids AS (SELECT *, (bid_price_1 + ask_price_1) / 2 AS mid FROM book WHERE bid_price_1 IS NOT NULL AND ask_price_1 IS NOT NULL),
h0 AS (SELECT *, count(*) OVER {last(30, order="t")} AS history_rows, avg(mid) OVER {last(30, order="t")} AS history_mean,
  stddev_pop(mid) OVER {last(30, order="t")} AS sp, avg(mid) OVER {last(5, order="t")} AS a5, avg(mid) OVER {last(15, order="t")} AS a15,
  stddev_pop(mid) OVER {last(5, order="t")} AS s5 FROM mids),
h AS (SELECT *, CASE WHEN history_rows > 1 AND sp > 0 THEN sp ELSE 1.0 END AS history_std,
  CASE WHEN history_rows >= 15 THEN a5 END AS short_ma, CASE WHEN history_rows >= 15 THEN a15 END AS long_ma,
  CASE WHEN history_rows >= 5 THEN s5 END AS short_volatility FROM h0)"""
SQL["history_stats"] = f"WITH {BOOKS}, {HISTORY} SELECT product, t, history_rows, {r(4, 'history_mean', 'history_std')} FROM h"
SQL["moving_averages"] = f"WITH {BOOKS}, {HISTORY} SELECT product, t, {r(4, 'short_ma', 'long_ma')} FROM h"
SQL["short_volatility"] = f"WITH {BOOKS}, {HISTORY} SELECT product, t, {r(4, 'short_volatility')} FROM h"
SQL["zscore_norm"] = f"""WITH {BOOKS}, {HISTORY} SELECT product, t, round((mid - history_mean) / history_std, 6) + 0.0 AS normalised,
  round(mid, 4) + 0.0 AS restored FROM h"""
SQL["trend_strength"] = f"""WITH {BOOKS}, {HISTORY} SELECT product, t,
  round(CASE WHEN short_volatility = 0 THEN 0 ELSE (short_ma - long_ma) / short_volatility END, 6) + 0.0 AS over_volatility,
  round(coalesce((short_ma - long_ma) / nullif(long_ma, 0), 0), 6) + 0.0 AS over_mean FROM h"""
FAIR = f"""{HISTORY}, {PARAMS},
hp AS (SELECT h.*, coalesce(momentum_weight, 0.6) AS mw, coalesce(min_position, 15) AS mp, coalesce(volatility_threshold, 1.2) AS vt,
  coalesce(position_limit, 50) AS pl, coalesce((short_ma - long_ma) / nullif(long_ma, 0), 0) AS trend
  FROM h LEFT JOIN params p ON h.product = p.product),
f0 AS (SELECT *, CASE WHEN long_ma IS NULL THEN 0.0 ELSE mw * trend + (1 - mw) * -((mid - history_mean) / history_std) END AS signal FROM hp),
f1 AS (SELECT *, mid + signal * history_std AS acceptable_price,
  (1 + abs(signal) * 2.0) * CASE WHEN abs(trend) > 0.2 THEN 1 + abs(trend) * 0.5 ELSE 1.0 END
    * (1 / sqrt(CASE WHEN short_volatility > 0 THEN short_volatility / vt ELSE 1.0 END)) AS factor FROM f0),
fair AS (SELECT *, CAST(CASE WHEN history_rows < 5 THEN mp
  ELSE least(trunc(greatest(mp, 15) * greatest(0.7, least(3.0, factor))), pl) END AS BIGINT) AS target_size FROM f1)"""
SQL["fair_price"] = f"""WITH {BOOKS}, {FAIR} SELECT product, t, mid AS mid_price, {r(6, "signal")}, {r(4, "acceptable_price")} FROM fair"""
SQL["target_size"] = f"WITH {BOOKS}, {FAIR} SELECT product, t, target_size FROM fair"
SQL["quote_orders"] = f"""WITH {BOOKS}, {FAIR}
SELECT product, t, 'BUY' AS order_side, ask_price_1 AS order_price, CAST(least(ask_volume_1, least(pl, target_size)) AS BIGINT) AS quantity
FROM fair WHERE least(pl, target_size) > 0 AND trunc(ask_price_1) < acceptable_price
UNION ALL
SELECT product, t, 'SELL', bid_price_1, CAST(-least(bid_volume_1, least(pl, target_size)) AS BIGINT)
FROM fair WHERE least(pl, target_size) > 0 AND trunc(bid_price_1) > acceptable_price"""

_HELD = "(((t % 7) + 7) % 7 * 10 - 30)"
SQL["quote_orders_held"] = f"""WITH {BOOKS}, {FAIR}, room AS (SELECT *, least(pl - {_HELD}, target_size) AS to_buy, least(pl + {_HELD}, target_size) AS to_sell FROM fair)
SELECT product, t, 'BUY' AS order_side, ask_price_1 AS order_price, CAST(least(ask_volume_1, to_buy) AS BIGINT) AS quantity
FROM room WHERE to_buy > 0 AND trunc(ask_price_1) < acceptable_price
UNION ALL
SELECT product, t, 'SELL', bid_price_1, CAST(-least(bid_volume_1, to_sell) AS BIGINT)
FROM room WHERE to_sell > 0 AND trunc(bid_price_1) > acceptable_price"""


def walked(rows: str, inputs: str, order: str, step: str) -> str:
    """Positions of each product, row by row: ``step`` gives the next one from ``at`` and the row's ``x``."""
    step = re.sub(r"\bat\b", "acc[-1]", step)
    return f"""folded AS (SELECT product, list(row ORDER BY {order}) AS rows,
  list_reduce(list_prepend([0::BIGINT], list([{inputs}] ORDER BY {order})), lambda acc, x: list_append(acc, {step})) AS pos
  FROM (SELECT *, row_number() OVER (ORDER BY product, {order}) AS row FROM {rows}) GROUP BY product),
opened AS (SELECT unnest(rows) AS row, unnest(pos[2:]) AS position, unnest(pos[:-2]) AS position_before FROM folded),
walked AS (SELECT s.*, position_before, position FROM
  (SELECT *, row_number() OVER (ORDER BY product, {order}) AS row FROM {rows}) s JOIN opened USING (row))"""


_WANTED = """wanted AS (SELECT *,
  CASE WHEN trunc(ask_price_1) < acceptable_price THEN CAST(least(ask_volume_1, target_size) AS BIGINT) ELSE 0 END AS most_bought,
  CASE WHEN trunc(bid_price_1) > acceptable_price THEN CAST(least(bid_volume_1, target_size) AS BIGINT) ELSE 0 END AS most_sold FROM fair)"""
_FILLS = walked(
    "wanted",
    "most_bought, most_sold, CAST(pl AS BIGINT)",
    "t",
    "at + greatest(0, least(x[3] - at, x[1])) - greatest(0, least(x[3] + at, x[2]))",
)
SQL["quote_orders_filled"] = f"""WITH {BOOKS}, {FAIR}, {_WANTED}, {_FILLS}
SELECT product, t, 'BUY' AS order_side, ask_price_1 AS order_price, least(pl - position_before, most_bought) AS quantity, position_before, position
FROM walked WHERE least(pl - position_before, target_size) > 0 AND trunc(ask_price_1) < acceptable_price
UNION ALL
SELECT product, t, 'SELL', bid_price_1, -least(pl + position_before, most_sold), position_before, position
FROM walked WHERE least(pl + position_before, target_size) > 0 AND trunc(bid_price_1) > acceptable_price"""
_REFUSED = walked("limited", "CAST(quantity AS BIGINT), CAST(pl AS BIGINT)", "t, o_orderkey", "CASE WHEN abs(at + x[1]) <= x[2] THEN at + x[1] ELSE at END")
SQL["limit_reject_held"] = f"""WITH {ORDERS}, {PARAMS},
limited AS (SELECT o.*, coalesce(position_limit, 10) AS pl FROM orders_sim o LEFT JOIN params p ON o.product = p.product), {_REFUSED}
SELECT o_orderkey, product, quantity, position_before, position, abs(position_before + quantity) <= pl AS accepted FROM walked"""

# ---------------------------------------------------------------- positions


def clamped(rows: str, delta: str, limit: int | str) -> str:
    """Fold the steps of each product in order and unfold the positions again."""
    return f"""folded AS (SELECT product, list(event_id ORDER BY {TICK_ORDER}) AS ids,
  list_reduce(list_prepend([0::BIGINT], list([CAST({delta} AS BIGINT), CAST({limit} AS BIGINT)] ORDER BY {TICK_ORDER})),
    lambda acc, x: list_append(acc, greatest(-x[2], least(x[2], acc[-1] + x[1])))) AS pos FROM {rows} GROUP BY product),
opened AS (SELECT unnest(ids) AS event_id, unnest(pos[2:]) AS position, unnest(pos[:-2]) AS position_before FROM folded),
held AS (SELECT s.*, position_before, position, position - position_before AS change FROM {rows} s JOIN opened USING (event_id))"""


AGENT = f"{TICKS}, {clamped('ticks', LOTS, 50)}"
SIDE = "CASE WHEN change > 0 THEN 'BUY' WHEN change < 0 THEN 'SELL' ELSE 'HOLD' END"
SQL["clamped_position"] = f"WITH {AGENT} SELECT event_id, position_before, position, change FROM held"
SQL["varying_limit_position"] = f"""WITH {TICKS}, {clamped('ticks', LOTS, '20 + 10 * ((event_id // 100) % 3)')}
SELECT event_id, position_before, position, change FROM held"""
SQL["action_side"] = f"WITH {AGENT} SELECT event_id, action, {SIDE} AS trade_side, abs(change) AS quantity FROM held"
SQL["position_features"] = f"""WITH {AGENT} SELECT event_id, round(position / 50.0, 6) + 0.0 AS position_share,
  CAST(position > 0 AS DOUBLE) AS is_long, CAST(position < 0 AS DOUBLE) AS is_short FROM held"""
TRADES = f"""trades AS (SELECT event_id, product, time, {SIDE} AS trade_side, abs(change) AS trade_quantity, price AS trade_price
  FROM held WHERE change <> 0)"""
SQL["executed_trades"] = f"WITH {AGENT}, {TRADES} SELECT event_id, product, trade_side, trade_quantity, trade_price FROM trades"
SQL["signals_per_product"] = f"""WITH {AGENT}, {TRADES} SELECT event_id, product,
  row_number() OVER {win(TICK_ORDER)} - 1 AS signal_number, trade_side, trade_quantity FROM trades"""
PAIRED = f"""paired AS (SELECT *, lag(trade_side) OVER w AS ps, lag(trade_price) OVER w AS pp, lag(trade_quantity) OVER w AS pq
  FROM trades WINDOW w AS {win(TICK_ORDER)}),
gains AS (SELECT *, CASE WHEN ps = 'BUY' AND trade_side = 'SELL' THEN (trade_price - pp) * least(trade_quantity, pq)
  WHEN ps = 'SELL' AND trade_side = 'BUY' THEN (pp - trade_price) * least(trade_quantity, pq) ELSE 0 END AS gain FROM paired)"""
SQL["realized_pnl"] = f"""WITH {AGENT}, {TRADES}, {PAIRED} SELECT product, count(*) AS n_trades,
  round(sum(gain), 4) + 0.0 AS realized_pnl FROM gains GROUP BY product"""
SQL["mark_to_market"] = f"""WITH {AGENT}, {TRADES}, {PAIRED},
x AS (SELECT h.event_id, h.position, h.price,
  coalesce(sum(gain) OVER {win("h.time, h.event_id").replace("BY product", "BY h.product")}, 0) AS realized_pnl,
  last_value(g.trade_side IGNORE NULLS) OVER w AS ls, last_value(g.trade_price IGNORE NULLS) OVER w AS lp
  FROM held h LEFT JOIN gains g ON h.event_id = g.event_id
  WINDOW w AS (PARTITION BY h.product ORDER BY h.time, h.event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
y AS (SELECT *, CASE WHEN position = 0 OR ls IS NULL THEN 0 WHEN ls = 'BUY' THEN (price - lp) * position
  ELSE (lp - price) * abs(position) END AS unrealized_pnl FROM x)
SELECT event_id, position, {r(4, "realized_pnl", "unrealized_pnl")}, round(realized_pnl + unrealized_pnl, 4) + 0.0 AS pnl FROM y"""

STEPS = f"""looked AS (SELECT *, row_number() OVER w - 1 AS i, lead(mid_price) OVER w AS next_price, lead(time) OVER w AS next_time
  FROM ticks WINDOW w AS {win(TICK_ORDER)}),
steps AS (SELECT * FROM looked WHERE i >= 10 AND next_price IS NOT NULL)"""
ENV = f"""{TICKS}, {STEPS}, {clamped('steps', '(action - 2) * 25', 50)},
stepped AS (SELECT *, position * (next_price - mid_price) - abs(change) * mid_price * 0.001::DOUBLE AS reward FROM held),
summed AS (SELECT *, sum(reward) OVER {win(TICK_ORDER)} AS pnl, lag(position) OVER {win(TICK_ORDER)} AS before FROM stepped)"""
SQL["step_reward"] = f"WITH {ENV} SELECT event_id, position, change, {r(6, 'reward')} FROM stepped"
SQL["cumulative_pnl"] = f"WITH {ENV} SELECT event_id, {r(6, 'pnl')} FROM summed"
SQL["trade_log"] = f"""WITH {ENV} SELECT event_id, action, change, strftime(next_time, '%Y-%m-%d %H:%M:%S') AS trade_time,
  next_price AS trade_price, {r(6, "pnl")} FROM summed WHERE change <> 0"""
SQL["observation"] = f"""WITH {ENV} SELECT event_id, CAST(4 AS BIGINT) AS n, round(price, 2) + 0.0 AS price, CAST(size AS DOUBLE) AS size,
  round(position_before / 50.0, 2) + 0.0 AS share, round(CAST(CAST(pnl - reward AS FLOAT) AS DOUBLE), 2) + 0.0 AS pnl FROM summed"""
SQL["last_observation"] = f"""WITH {ENV}, ended AS (SELECT product, arg_max(position, ({TICK_ORDER})) AS position, arg_max(pnl, ({TICK_ORDER})) AS pnl
FROM summed GROUP BY product), seen AS (SELECT *, row_number() OVER (PARTITION BY product ORDER BY time DESC, event_id DESC) AS back FROM ticks)
SELECT product, event_id, round(price, 2) + 0.0 AS price, CAST(size AS DOUBLE) AS size, round(position / 50.0, 2) + 0.0 AS share,
  round(CAST(CAST(pnl AS FLOAT) AS DOUBLE), 2) + 0.0 AS pnl FROM seen JOIN ended USING (product) WHERE back = 1"""
SQL["position_changes"] = f"""WITH {ENV} SELECT product, CAST(count(*) FILTER (WHERE position <> before) AS BIGINT) AS n_changes
FROM summed GROUP BY product"""
SQL["backtest_summary"] = f"""WITH {ENV}, g AS (SELECT product, max(abs(position)) AS max_position,
  count(*) FILTER (WHERE position <> before) AS n_changes, count(*) AS n_steps, sum(reward) AS total_reward,
  avg(reward) / (stddev_pop(reward) + 1e-6) * sqrt(252) AS sharpe_ratio FROM summed GROUP BY product)
SELECT product, max_position, n_changes, n_steps, {r(6, "total_reward", "sharpe_ratio")} FROM g"""
SQL["total_pnl"] = f"""WITH {ENV} SELECT product, round(sum(reward), 6) + 0.0 AS total_pnl,
  count(*) FILTER (WHERE change <> 0) AS n_trades FROM stepped GROUP BY product"""
SQL["backtest"] = f"WITH {ENV} SELECT event_id, product, action, position, change, {r(6, 'reward', 'pnl')} FROM summed"

# ---------------------------------------------------------------- policy

WEIGHTS = [[((a * 7 + i * 3) % 11 - 5) / 10.0 for i in range(64)] for a in range(5)]
_SCORES = ", ".join(
    f"list_dot_product(CAST(embedding AS DOUBLE[]), [{', '.join(f'{w!r}::DOUBLE' for w in row)}]) AS q{a}"
    for a, row in enumerate(WEIGHTS)
)
SCORES = f"scored AS (SELECT vec_id, {_SCORES} FROM embeddings)"
SQL["q_scores"] = f"""WITH {SCORES} SELECT vec_id, {r(6, *[f"q{a}" for a in range(5)])},
  list_position([q0, q1, q2, q3, q4], greatest(q0, q1, q2, q3, q4)) - 1 AS action FROM scored"""
SQL["q_mask"] = f"""WITH {SCORES}, p AS (SELECT *, (vec_id % 5 - 2) * 25 AS position FROM scored),
m AS (SELECT vec_id, position, CASE WHEN position <= -50 THEN '-inf'::DOUBLE ELSE q0 END AS m0,
  CASE WHEN position <= -50 THEN '-inf'::DOUBLE ELSE q1 END AS m1, q2 AS m2,
  CASE WHEN position >= 50 THEN '-inf'::DOUBLE ELSE q3 END AS m3, CASE WHEN position >= 50 THEN '-inf'::DOUBLE ELSE q4 END AS m4 FROM p)
SELECT vec_id, position, list_position([m0, m1, m2, m3, m4], greatest(m0, m1, m2, m3, m4)) - 1 AS action FROM m"""


def _vector() -> str:
    cells = ["price", "size"]
    for f in ("price", "size"):
        cells += [f, f"({f} - {f}_mean) / ({f}_std + 1e-8)", f"{f} / ({f}_max + 1e-8)",
                  f"coalesce({f} - lag({f}) OVER {win(TICK_ORDER)}, 0)"]
    cells += ["position / 50.0", "position > 0", "position < 0"]
    return ", ".join(f"round(CAST({c} AS DOUBLE), 6) + 0.0 AS v{i}" for i, c in enumerate(cells))


SQL["feature_vector"] = f"""WITH {AGENT}, g AS (SELECT product, avg(price) AS price_mean, stddev_pop(price) AS price_std,
  max(abs(price)) AS price_max, avg(size) AS size_mean, stddev_pop(size) AS size_std, max(abs(size)) AS size_max
  FROM ticks GROUP BY product)
SELECT event_id, CAST(13 AS BIGINT) AS n, {_vector()} FROM held JOIN g USING (product)"""

# ---------------------------------------------------------------- streams: the same results as their batch form

SQL["stream_signals"] = SQL["quote_orders"]
SQL["stream_signals_held"] = SQL["quote_orders_filled"]
SQL["stream_signals_stored"] = SQL["quote_orders_filled"]
SQL["stream_positions"] = SQL["mark_to_market"]

# ---------------------------------------------------------------- files: what was written is read back

SQL["scan_prices_csv"] = SQL["scan_folder"] = SQL["scan_prices_header"] = SQL["name_columns"]
SQL["scan_quotes"] = SQL["split_raw"] = f"WITH {QUOTES} SELECT product, t, side, price, quantity FROM quotes"
SQL["scan_features"] = f"WITH {TICKS} SELECT event_id, price, product FROM ticks"
SQL["write_split"] = f"""WITH {PRICED}, {STAGE1} SELECT product AS base_product, round_timestamp, mid_price, bid_ask_spread,
  {r(6, "log_return")} FROM s4"""
SQL["write_tables"] = SQL["l2_top"]
