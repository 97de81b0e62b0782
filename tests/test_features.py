import math
import statistics as st

import pytest
from pyspark.sql import functions as F

from tickloom.operators import features
from tickloom.operators import policy, sequences, signals
from tickloom.plans import Series

SERIES = Series.of("product", "t")


def _prices(spark, mids, **extra):
    rows = [("a", i, None if m is None else float(m)) for i, m in enumerate(mids)]
    return spark.createDataFrame(rows, "product string, t long, mid_price double")


def _column(df, name):
    return [r[name] for r in df.orderBy("t").collect()]


MIDS = [100, 101, 99, 102, 105, 104, 103, 108, 107, 110, 111, 109, 115, 114, 118, 117, 120, 119, 125, 121,
        122, 128, 127, 126, 130, 131, 129, 135, 134, 133, 140, 138]


def _tail(values, i, n):
    return values[max(0, i - n + 1): i + 1]


def test_rolling_features_by_hand(spark):
    wanted = [features.log_return(), features.rolling_zscore(), features.macd(), features.rsi(), features.cci(),
              features.rolling_volatility(), features.price_change(), features.volatility_full(), features.momentum()]
    rows = features.add_features(_prices(spark, MIDS), SERIES, wanted).orderBy("t").collect()
    returns = [None] + [math.log(b / a) for a, b in zip(MIDS, MIDS[1:])]
    moves = [None] + [b - a for a, b in zip(MIDS, MIDS[1:])]
    line = [st.mean(_tail(MIDS, i, 12)) - st.mean(_tail(MIDS, i, 26)) for i in range(len(MIDS))]
    sma = [st.mean(_tail(MIDS, i, 20)) for i in range(len(MIDS))]
    for i, row in enumerate(rows):
        window = _tail(MIDS, i, 10)
        assert row.log_return == (pytest.approx(returns[i]) if i else None)
        assert row.rolling_mean == pytest.approx(st.mean(window))
        assert row.rolling_stddev == (pytest.approx(st.stdev(window)) if i else None)
        assert row.macd_line == pytest.approx(line[i])
        assert row.macd_signal == pytest.approx(st.mean(_tail(line, i, 9)))
        gains = [max(m or 0, 0) for m in _tail(moves, i, 14)]
        losses = [max(-(m or 0), 0) for m in _tail(moves, i, 14)]
        expected = 100 - 100 / (1 + sum(gains) / sum(losses)) if sum(losses) else None
        assert row.rsi == (pytest.approx(expected) if expected is not None else None)
        mad = st.mean(abs(MIDS[j] - sma[j]) for j in range(max(0, i - 19), i + 1))
        assert row.cci == (pytest.approx((MIDS[i] - sma[i]) / (0.015 * mad)) if mad else None)
        if i < 9:
            assert row.volatility is None
        else:
            assert row.volatility == pytest.approx(st.stdev(window))
        if i < 10:
            assert row.momentum is None
        else:
            assert row.momentum == pytest.approx(st.mean(_tail(moves, i, 10)))


def test_constant_price(spark):
    rows = features.add_features(
        _prices(spark, [7] * 30), SERIES, [features.rolling_zscore(), features.rsi(), features.cci()]
    ).collect()
    assert all(r.rolling_zscore is None and r.rsi is None and r.cci is None for r in rows)
    history = signals.price_history(_prices(spark, [7] * 30), SERIES).collect()
    assert all(r.history_std == 1.0 for r in history)


def test_zero_price(spark):
    out = features.add_features(_prices(spark, [5, 0, 4]), SERIES, [features.log_return()])
    assert _column(out, "log_return") == [None, None, None]


@pytest.mark.parametrize("n", [9, 10, 11])
def test_full_window_edge(spark, n):
    df = _prices(spark, range(1, n + 1)).select(
        "product", "t", (F.col("mid_price") - 1).alias("bid_price_1"), (F.col("mid_price") + 1).alias("ask_price_1"),
        F.lit("3").alias("bid_size_1"), F.when(F.col("t") == 0, "bad").otherwise("1").alias("ask_size_1"),
    )
    out = features.quote_book_features(df, "product", "t").orderBy("t").collect()
    assert [r.momentum != 0 for r in out] == [i >= 10 for i in range(n)]
    assert [r.volume_trend != 0 for r in out] == [i >= 9 for i in range(n)]
    assert out[0].price_change == 0 and out[0].imbalance == 1.0 and out[0].ask_size_1 == 0.0


def test_volume_weights_count_the_first_row(spark):
    df = _prices(spark, [100, 110]).withColumn("trade_volume_best", F.lit(2.0))
    out = features.add_features(df, SERIES, [features.volume_weighted_return()])
    assert _column(out, "volume_weighted_return")[1] == pytest.approx(math.log(1.1) * 2 / 4)


def test_one_shuffle_for_all_features(spark):
    prices = _prices(spark, MIDS)
    out = features.add_features(
        prices.withColumn("trade_volume_best", F.lit(1.0)), SERIES,
        [features.log_return(), features.rolling_zscore(), features.volume_weighted_return(), features.macd(), features.rsi()],
    )
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    assert plan.count("Sort [") == 1


@pytest.mark.parametrize("block", [12, 100000])
@pytest.mark.parametrize("n,expected", [(9, 0), (10, 6), (19, 11), (20, 1), (25, 6)])
def test_sequence_counts(spark, small_blocks, n, expected, block):
    small_blocks(rowsPerBlock=block)
    out = sequences.sequences(_prices(spark, range(n)), SERIES, ["mid_price"], 20)
    rows = out.orderBy("t").collect()
    assert len(rows) == expected
    for r in rows:
        assert [v[0] for v in r.sequence] == [float(i) for i in range(r.t, r.t + r.sequence_length)]


def test_split_latest_and_last(spark, small_blocks):
    df = _prices(spark, range(101))
    split = sequences.split_rows(df, SERIES).orderBy("t").collect()
    assert [r.is_train for r in split] == [i < 80 for i in range(101)]
    assert sorted(_column(sequences.latest_rows(df, SERIES, 3), "t")) == [98, 99, 100]
    assert sequences.last_row(df, SERIES).first().t == 100
    assert _column(sequences.time_window(df, "t", 3, 5), "t") == [3, 4, 5]


def test_default_minutes(spark, small_blocks):
    out = sequences.default_timestamp(_prices(spark, range(100)), SERIES).orderBy("t").collect()
    assert (out[0].timestamp.isoformat(), out[99].timestamp.isoformat()) == ("2024-01-01T00:00:00", "2024-01-01T01:39:00")


def test_labels_and_rewards(spark):
    df = _prices(spark, [10, 11, 11, 9]).withColumnRenamed("mid_price", "price")
    out = policy.direction_labels(df, SERIES)
    out = out.withColumn("reward", policy.direction_reward(F.lit(1), F.col("direction"), F.col("r")))
    assert _column(out, "t") == [1, 2, 3] and _column(out, "direction") == [1, 0, 0]
    assert _column(out, "reward") == pytest.approx([math.log(1.1), 0, math.log(9 / 11)])


def test_scores_ties_and_masks(spark):
    df = spark.createDataFrame([(50,), (-50,), (0,)], "position int")
    scores = policy.q_scores(F.array(F.lit(1.0), F.lit(2.0)), [[1, 0], [0, 1], [2, 0], [1, 1], [3, 0]])
    out = df.select("position", scores.alias("s"), policy.mask_scores(scores, F.col("position"), F.lit(50)).alias("m"))
    rows = out.select("position", policy.best_action(F.col("s")).alias("a"), policy.best_action(F.col("m")).alias("b")).collect()
    assert [tuple(r) for r in rows] == [(50, 3, 1), (-50, 3, 3), (0, 3, 3)]


@pytest.mark.parametrize("block", [30, 100_000])
@pytest.mark.parametrize("length, stride", [(7, 1), (20, 3), (20, 1)])
def test_sequences_do_not_depend_on_blocks_or_batches(spark, small_blocks, block, length, stride):
    small_blocks(rowsPerBlock=block)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 9)
    try:
        rows = [(p, i, None if i % 11 == 0 else float(i), float(-i)) for p, n in (("a", 100), (None, 60), ("short", 12), ("gone", 9)) for i in range(n)]
        df = spark.createDataFrame(rows, "product string, t long, x double, y double").repartition(5)
        out = sequences.sequences(df, SERIES, ["x", "y"], length, stride).collect()
        want = []
        for p in ("a", None, "short", "gone"):
            mine = [r for r in rows if r[0] == p]
            if len(mine) < min(length, 10):
                continue
            n = length if len(mine) >= length else max(5, len(mine) // 2)
            want += [(p, i, n, [list(r[2:]) for r in mine[i : i + n]]) for i in range(0, len(mine) - n + 1, stride)]
        assert sorted(((r.product, r.t, r.sequence_length, r.sequence) for r in out), key=repr) == sorted(want, key=repr)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
