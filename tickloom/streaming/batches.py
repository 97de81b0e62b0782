"""Orders and positions over a stream, with state carried from batch to batch.

Each micro-batch goes through the same operators as a table does, so a product
with a large share of a batch is split like any long series. What a product's
next rows need to know (its last books, or its position and last trade) is a
small table per batch in the query's folder. A batch that is run again reads
the state of the batch before it and overwrites its own output, so every row
counts once. Rows no later than what their product has already seen are kept
apart under ``late``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tickloom.operators.book import two_sided
from tickloom.operators.positions import hold, mark_to_market
from tickloom.operators.sequences import last_row, latest_rows
from tickloom.operators.signals import HISTORY, fair_prices, hold_filled, quote_orders
from tickloom.plans import Series, arrange, attach

Batch = Callable[[DataFrame, int], None]


def stream_signals(
    books: DataFrame,
    series: Series,
    path: str,
    params: DataFrame | None = None,
    trigger: dict | None = None,
    fills: bool = False,
    opening: DataFrame | None = None,
) -> StreamingQuery:
    """Orders for every book of a stream, from its product's last 30 two-sided books.

    Orders go to ``{path}/orders``, late books to ``{path}/late``. Without ``fills`` every book is quoted as if nothing
    were held. With it, orders fill at their quotes, and each order fits the position that all fills before it have left,
    those of earlier batches too; ``opening`` may hold a position per key (columns: key, ``position``) to start from. Books
    with their positions then go to ``{path}/books``.
    """

    def hold(priced: DataFrame, batch: int) -> DataFrame:
        """Orders of this batch's books, from the positions that the batch before has left."""
        spark = priced.sparkSession
        state = _read_state(spark, path, batch, "held")
        start = opening if state is None else state.select(*series.key, "position")
        held = hold_filled(arrange(priced, series), start).rows()
        _write(held, path, "books", batch)
        done = spark.read.schema(held.schema).parquet(_batch_path(path, "books", batch))
        newest = done.select(*series.key, *series.order_names, "position")
        if state is None and opening is not None:
            # Products that open with a position and have no book yet.
            unseen = [F.lit(None).cast(priced.schema[c].dataType).alias(c) for c in series.order_names]
            state = opening.select(*series.key, *unseen, F.col("position").cast("long").alias("position"))
        if state is not None:
            newest = newest.unionByName(state)
        _write_state(last_row(newest, series), path, batch, "held")
        return quote_orders(done, F.col("position_before"))

    def run(df: DataFrame, batch: int) -> None:
        spark = df.sparkSession
        tail = _read_state(spark, path, batch)
        fresh = df.filter(two_sided())
        if tail is not None:
            fresh = _set_late_apart(fresh, tail, series, path, batch)
        rows = fresh.withColumn("_new", F.lit(True))
        if tail is not None:
            rows = rows.unionByName(tail.withColumn("_new", F.lit(False)))
        priced = fair_prices(rows, series, params).filter("_new").drop("_new")
        _write(hold(priced, batch) if fills else quote_orders(priced), path, "orders", batch)
        _write_state(latest_rows(rows.drop("_new"), series, HISTORY - 1), path, batch)

    return _start(books, run, path, trigger)


def stream_positions(
    ticks: DataFrame,
    series: Series,
    path: str,
    delta: Column,
    limit: Column,
    price: str = "price",
    trigger: dict | None = None,
) -> StreamingQuery:
    """Position, trade and profit after every tick of a stream, to ``{path}/positions``."""

    def run(df: DataFrame, batch: int) -> None:
        spark = df.sparkSession
        state = _read_state(spark, path, batch)
        start = opening = None
        fresh = df
        if state is not None:
            fresh = _set_late_apart(df, state, series, path, batch)
            start = state.select(*series.key, "position")
            opening = state.select(*series.key, "last_trade", "realized")
        held = hold(arrange(fresh, series), delta, limit, start)
        marked = mark_to_market(held, price, opening).rows()
        _write(marked, path, "positions", batch)
        done = spark.read.schema(marked.schema).parquet(_batch_path(path, "positions", batch))
        kept = [*series.key, *series.order_names, "position", "last_trade"]
        newest = done.select(*dict.fromkeys(kept), F.col("realized_pnl").alias("realized"))
        if state is not None:
            newest = newest.unionByName(state)
        _write_state(last_row(newest, series), path, batch)

    return _start(ticks, run, path, trigger)


def _start(source: DataFrame, run: Batch, path: str, trigger: dict | None) -> StreamingQuery:
    def batch(df: DataFrame, number: int) -> None:
        df.persist()
        try:
            run(df, number)
        finally:
            df.unpersist()

    writer = source.writeStream.foreachBatch(batch).option("checkpointLocation", f"{path}/checkpoint")
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def _batch_path(path: str, name: str, batch: int) -> str:
    return f"{path}/{name}/batch={batch}"


def _write(df: DataFrame, path: str, name: str, batch: int) -> None:
    df.write.mode("overwrite").parquet(_batch_path(path, name, batch))


def _write_state(state: DataFrame, path: str, batch: int, name: str = "state") -> None:
    _write(state, path, name, batch)
    # A rerun of this batch needs the state before it; nothing needs older ones.
    if batch >= 2:
        spark = state.sparkSession
        old = spark._jvm.org.apache.hadoop.fs.Path(_batch_path(path, name, batch - 2))
        old.getFileSystem(spark._jsc.hadoopConfiguration()).delete(old, True)


def _read_state(spark: SparkSession, path: str, batch: int, name: str = "state") -> DataFrame | None:
    return spark.read.parquet(_batch_path(path, name, batch - 1)) if batch > 0 else None


def _set_late_apart(df: DataFrame, state: DataFrame, series: Series, path: str, batch: int) -> DataFrame:
    """Rows after the last one each product has seen; the others are written to ``late``."""
    order = F.struct(*series.order_names)
    seen = state.groupBy(*series.key).agg(F.max(order).alias("_seen"))
    marked = attach(df, seen, series.key, null_safe=True)
    is_late = F.coalesce(order <= F.col("_seen"), F.lit(False))
    _write(marked.filter(is_late).drop("_seen"), path, "late", batch)
    return marked.filter(~is_late).drop("_seen")
