"""Scans give what a walk over the rows gives, whatever the blocks, batches, limits and starts."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickloom.operators import fills, positions, signals
from tickloom.operators.fills import _fill_steps, _reject_steps
from tickloom.plans import Series, arrange
from tickloom.plans.scan import HIGH, LOW, Clamps, Pieces, compose

SERIES = Series.of("product", "t")
SCHEMA = "product string, t long, buy long, sell long, quantity long, most long"
FILLS = Pieces(_fill_steps, {"buy": 0, "sell": 0, "limit": 1 << 60})
REJECTS = Pieces(_reject_steps, {"quantity": 0, "limit": 1 << 60})


def fill(at, buy, sell, limit):
    return at + max(0, min(limit - at, buy)) - max(0, min(limit + at, sell))


def reject(at, quantity, limit):
    return at + quantity if abs(at + quantity) <= limit else at


def random_rows(n=400, seed=1, biggest=40):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        buy, sell = (rng.choice([0, 0, 3, 15, rng.randrange(biggest)]) for _ in "ab")
        limit = rng.choice([20, 20, 20, 50, 5])
        rows.append(("hot" if i % 3 else "cold", i, buy, sell, rng.randrange(-biggest // 2, biggest // 2), limit))
    return rows


def walk(rows, step, at=0):
    out = []
    for row in rows:
        at = step(at, row)
        out.append(at)
    return out


FILL_STEP = lambda at, r: fill(at, r[2], r[3], r[5])
REJECT_STEP = lambda at, r: reject(at, r[4], r[5])


@pytest.mark.parametrize("block", [7, 40, 100_000])
@pytest.mark.parametrize("batch", [5, 10_000])
def test_blocks_and_batches_do_not_matter(spark, small_blocks, block, batch):
    small_blocks(rowsPerBlock=block)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        rows = random_rows()
        df = spark.createDataFrame(rows, SCHEMA).repartition(4)
        start = spark.createDataFrame([("hot", 17), ("gone", 3)], "product string, position long")
        laid = arrange(df, SERIES)
        assert laid.split == (block < 100_000)
        filled = fills.filled_positions(laid, F.col("buy"), F.col("sell"), F.col("most"), start).rows().collect()
        accepted = fills.accepted_orders(laid, F.col("quantity"), F.col("most"), start).rows().collect()
        clamped = positions.hold(laid, F.col("quantity"), F.col("most"), start).rows().collect()
        clamp = lambda at, r: min(r[5], max(-r[5], at + r[4]))
        for out, step in ((filled, FILL_STEP), (accepted, REJECT_STEP), (clamped, clamp)):
            assert len(out) == len(rows)
            for product, at in (("hot", 17), ("cold", 0)):
                mine = sorted((r for r in out if r.product == product), key=lambda r: r.t)
                want = walk([r for r in rows if r[0] == product], step, at)
                assert [r.position for r in mine] == want
                assert [r.position_before for r in mine] == [at, *want[:-1]]
                assert all(r.change == r.position - r.position_before for r in mine)
        assert all(r.accepted == (abs(r.position_before + r.quantity) <= r.most) for r in accepted)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_missing_values_keys_and_empty_tables(spark, small_blocks):
    small_blocks(rowsPerBlock=6)
    rows = [(None if i % 2 else "a", i, None if i % 5 == 0 else 30, 10, None if i % 7 == 0 else 9, None if i % 4 == 0 else 25) for i in range(60)]
    df = spark.createDataFrame(rows, SCHEMA)
    plain = [(*r[:2], r[2] or 0, r[3], r[4] or 0, r[5] if r[5] is not None else 1 << 60) for r in rows]
    laid = arrange(df, SERIES)
    for out, step in (
        (fills.filled_positions(laid, F.col("buy"), F.col("sell"), F.col("most")), FILL_STEP),
        (fills.accepted_orders(laid, F.col("quantity"), F.col("most")), REJECT_STEP),
    ):
        got = {r.t: r.position for r in out.rows().collect()}
        for product in (None, "a"):
            mine = [r for r in plain if r[0] == product]
            assert [got[r[1]] for r in mine] == walk(mine, step)
    none = arrange(spark.createDataFrame([], SCHEMA), SERIES)
    assert fills.accepted_orders(none, F.col("quantity"), F.col("most")).rows().count() == 0


@pytest.mark.parametrize("family, step", [(FILLS, FILL_STEP), (REJECTS, REJECT_STEP)])
def test_functions_of_many_rows_hold_for_every_start(family, step):
    for seed in range(20):
        rows = random_rows(seed * 7 + 1, seed, biggest=[5, 40, 1000][seed % 3])
        arrays = {n: np.array([r[i] for r in rows]) for i, n in enumerate(SCHEMA_NAMES) if n in ("buy", "sell", "quantity", "limit")}
        cut = len(rows) // 3
        whole = family.fold(arrays)
        joined = whole if not cut else family.join(*[family.fold({n: a[s] for n, a in arrays.items()}) for s in (slice(0, cut), slice(cut, None))])
        for start in [*range(-70, 71, 3), -5000, 5000, 1 << 40, -(1 << 40)]:
            want = walk(rows, step, start)
            assert family.value(whole, start) == family.value(joined, start) == want[-1]
            assert family.replay(arrays, start).tolist() == want


SCHEMA_NAMES = ["product", "t", "buy", "sell", "quantity", "limit"]


def test_large_limits_need_few_pieces():
    """A limit of millions costs what its cuts cost, not a table of all positions."""
    rng = np.random.default_rng(0)
    n = 20_000
    rows = {"quantity": rng.integers(-1000, 1000, n), "limit": np.full(n, 5_000_000)}
    function = REJECTS.fold(rows).reshape(3, -1)
    assert function.shape[1] < 10_000
    at = 4_999_000
    for q in rows["quantity"].tolist():
        at = reject(at, q, 5_000_000)
    assert REJECTS.value(function.reshape(-1), 4_999_000) == at


def test_compose_merges_equal_neighbours():
    identity = np.array([[LOW], [1], [0]])
    flat = (np.array([[0, 10]]), np.array([[0, 0, 0]]), np.array([[7, 7, 7]]))
    counts, pieces = compose(np.array([1]), identity, *flat)
    assert counts.tolist() == [1] and pieces.tolist() == [[LOW], [0], [7]]
    turn = (np.array([[5, HIGH]]), np.array([[1, -1, 1]]), np.array([[0, 10, 0]]))
    counts, pieces = compose(np.array([1]), identity, *turn)
    counts, pieces = compose(counts, pieces, *turn)
    value = lambda x: Pieces(None, {}).value(pieces.reshape(-1), x)
    once = lambda x: x if x < 5 else 10 - x
    assert [value(x) for x in range(-20, 20)] == [once(once(x)) for x in range(-20, 20)]


def test_clamps_join():
    c = Clamps()
    a = {"delta": np.array([30, -80, 5]), "limit": np.array([50, 40, 40])}
    b = {"delta": np.array([100, -3]), "limit": np.array([20, 90])}
    joined = c.join(c.fold(a), c.fold(b))
    for x in range(-60, 61):
        at = x
        for d, m in zip([*a["delta"], *b["delta"]], [*a["limit"], *b["limit"]]):
            at = min(m, max(-m, at + d))
        assert c.value(joined, x) == at


def test_filled_orders_by_hand(spark):
    """Buys stop at the limit, a sell and a buy of one book see the same position, and sells make room again."""
    rows = [
        # t, bid, bid volume, ask, ask volume, acceptable, target
        (1, 90.0, 5.0, 99.0, 30.0, 100.0, 40),
        (2, 90.0, 5.0, 99.0, 30.0, 100.0, 40),
        (3, 101.0, 70.0, 102.0, 9.0, 100.0, 60),
        (4, 101.0, 70.0, 99.0, 9.0, 100.0, 60),
        (5, 98.0, 70.0, 102.0, 9.0, 100.0, 60),
    ]
    df = spark.createDataFrame(
        [("a", *r, 50) for r in rows],
        "product string, t long, bid_price_1 double, bid_volume_1 double, ask_price_1 double, ask_volume_1 double, "
        "acceptable_price double, target_size long, position_limit int",
    )
    out = signals.filled_orders(df, SERIES).orderBy("t", "order_side").collect()
    assert [(r.t, r.order_side, r.quantity, r.position_before, r.position) for r in out] == [
        (1, "BUY", 30, 0, 30),
        (2, "BUY", 20, 30, 50),
        (3, "SELL", -60, 50, -10),
        (4, "BUY", 9, -10, -41),
        (4, "SELL", -40, -10, -41),
    ]
