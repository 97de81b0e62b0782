import random

import pytest
from pyspark.sql import functions as F

from tickloom.operators import positions
from tickloom.plans import Series, arrange

SERIES = Series.of("product", "t")
SCHEMA = "product string, t long, delta long, price double"


def _walk(deltas, limit, at=0):
    held = []
    for d in deltas:
        at = min(limit, max(-limit, at + d))
        held.append(at)
    return held


def _random_rows(n=400, seed=5):
    rng = random.Random(seed)
    return [("hot" if i % 3 else "cold", i, rng.choice([-10, -5, 0, 5, 10, 40, -40]), 100 + rng.random()) for i in range(n)]


def test_clamp_both_ways(spark):
    deltas = [30, 30, 5, -120, 10, 200, -1]
    df = spark.createDataFrame([("a", i, d, 1.0) for i, d in enumerate(deltas)], SCHEMA)
    out = positions.clamped_position(df, SERIES, F.col("delta"), F.lit(50)).orderBy("t").collect()
    assert [r.position for r in out] == [30, 50, 50, -50, -40, 50, 49]
    assert [r.change for r in out] == [30, 20, 0, -100, 10, 90, -1]
    assert [r.position_before for r in out] == [0, 30, 50, 50, -50, -40, 50]


@pytest.mark.parametrize("block", [7, 40, 100])
def test_blocks_equal_the_walk(spark, small_blocks, block):
    small_blocks(rowsPerBlock=block)
    rows = _random_rows()
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    start = spark.createDataFrame([("hot", 20)], "product string, position long")
    out = positions.clamped_position(df, SERIES, F.col("delta"), F.lit(50), start).collect()
    for product, at in (("hot", 20), ("cold", 0)):
        mine = sorted((r for r in out if r.product == product), key=lambda r: r.t)
        expected = _walk([r[2] for r in rows if r[0] == product], 50, at)
        assert [r.position for r in mine] == expected
        assert all(-50 <= r.position <= 50 for r in mine)


def _ledger(rows, limit):
    """Profit after each row, kept the slow way."""
    at, realized, last, out = 0, 0.0, None, []
    for delta, price in rows:
        after = min(limit, max(-limit, at + delta))
        if after != at:
            trade = ("BUY" if after > at else "SELL", price, abs(after - at))
            if last and last[0] != trade[0]:
                sign = 1 if last[0] == "BUY" else -1
                realized += sign * (price - last[1]) * min(last[2], trade[2])
            last = trade
        at = after
        sign = 1 if last and last[0] == "BUY" else -1
        open_profit = sign * (price - last[1]) * (at if last[0] == "BUY" else abs(at)) if last and at else 0.0
        out.append((realized, open_profit))
    return out


@pytest.mark.parametrize("block", [15, 100000])
def test_mark_to_market(spark, small_blocks, block):
    small_blocks(rowsPerBlock=block)
    rows = _random_rows(seed=8)
    df = spark.createDataFrame(rows, SCHEMA)
    held = positions.hold(arrange(df, SERIES), F.col("delta"), F.lit(50))
    out = positions.mark_to_market(held).rows().collect()
    for product in ("hot", "cold"):
        mine = sorted((r for r in out if r.product == product), key=lambda r: r.t)
        expected = _ledger([(r[2], r[3]) for r in rows if r[0] == product], 50)
        for row, (realized, opened) in zip(mine, expected):
            assert row.realized_pnl == pytest.approx(realized, abs=1e-6)
            assert row.unrealized_pnl == pytest.approx(opened, abs=1e-6)
    totals = {r.product: r.realized_pnl for r in positions.realized_pnl(held).collect()}
    assert totals["hot"] == pytest.approx(_ledger([(r[2], r[3]) for r in rows if r[0] == "hot"], 50)[-1][0], abs=1e-6)


def test_adjacent_pairs_only(spark):
    trades = [(5, 100.0), (5, 110.0), (-5, 120.0), (-5, 90.0), (5, 80.0)]  # buy buy sell sell buy
    df = spark.createDataFrame([("a", i, d, p) for i, (d, p) in enumerate(trades)], SCHEMA)
    held = positions.hold(arrange(df, SERIES), F.col("delta"), F.lit(50))
    row = positions.realized_pnl(held).first()
    assert row.realized_pnl == (120 - 110) * 5 + (90 - 80) * 5
    assert row.n_trades == 5
    signals = positions.signals_per_product(held).orderBy("signal_number").collect()
    assert [(r.signal_number, r.trade_side, r.trade_quantity) for r in signals] == [
        (0, "BUY", 5), (1, "BUY", 5), (2, "SELL", 5), (3, "SELL", 5), (4, "BUY", 5)
    ]


@pytest.mark.parametrize("block", [6, 100000])
def test_backtest_by_hand(spark, small_blocks, block):
    small_blocks(rowsPerBlock=block)
    mids = [10.0, 11.0, 12.0, 11.0, 13.0, 15.0, 14.0, 12.0]
    actions = [4, 0, 3, 3, 4, 2, 0, 4]
    df = spark.createDataFrame([("a", i, a, m) for i, (a, m) in enumerate(zip(actions, mids))], "product string, t long, action long, mid_price double")
    stepped = positions.step_rewards(df, SERIES, limit=10, cost=0.01, history_window=2)
    rows = positions.cumulative_pnl(stepped).rows().orderBy("t").collect()
    at, pnl, expected = 0, 0.0, []
    for i in range(2, 7):
        after = min(10, max(-10, at + (actions[i] - 2) * 5))
        reward = after * (mids[i + 1] - mids[i]) - abs(after - at) * mids[i] * 0.01
        pnl, at = pnl + reward, after
        expected.append((i, after, reward, pnl))
    assert [(r.t, r.position) for r in rows] == [(e[0], e[1]) for e in expected]
    assert [r.pnl for r in rows] == pytest.approx([e[3] for e in expected])
    summary = positions.backtest_summary(stepped).first()
    held = [e[1] for e in expected]
    assert summary.n_changes == sum(a != b for a, b in zip(held, held[1:]))
    assert summary.max_position == max(map(abs, held))
    assert summary.total_reward == pytest.approx(pnl)
    assert positions.position_changes(stepped).first().n_changes == summary.n_changes
    log = positions.trade_log(stepped).orderBy("t").collect()
    assert all(r.trade_time == r.t + 1 and r.trade_price == mids[r.t + 1] for r in log)


def test_action_maps(spark):
    df = spark.range(5).select(
        positions.action_lots(F.col("id")).alias("lots"), positions.action_limit_steps(F.col("id"), F.lit(15)).alias("steps")
    )
    assert [tuple(r) for r in df.collect()] == [(-10, -14), (-5, -7), (0, 0), (5, 7), (10, 14)]


def test_limits_that_change_do_not_depend_on_blocks(spark, small_blocks):
    steps = [(i * 7 % 11) - 5 for i in range(300)]
    limits = [5 if i < 50 else 20 if i % 90 < 60 else 3 for i in range(300)]
    at, want = 0, []
    for step, limit in zip(steps, limits):
        at = min(limit, max(-limit, at + step))
        want.append(at)
    df = spark.createDataFrame([("a", i, s, n) for i, (s, n) in enumerate(zip(steps, limits))], "product string, t long, step long, most long")
    for rows in (7, 40, 10_000):
        small_blocks(rowsPerBlock=rows)
        out = positions.clamped_position(df, Series.of("product", "t"), F.col("step"), F.col("most"))
        assert [r.position for r in out.orderBy("t").collect()] == want


def test_limit_of_zero_has_no_share(spark):
    shown = spark.range(1).select(*[c.alias(n) for n, c in positions.position_features(F.lit(0), F.lit(0)).items()])
    assert shown.first().position_share is None
