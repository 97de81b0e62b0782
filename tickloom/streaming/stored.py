"""Orders over a stream with typed state per product in Spark's state store.

Beside the batch-wise form of ``batches``: here Spark keeps the last 30 mids, the books that wait and the position of each
product, snapshots them with the query's checkpoint, and drops or wakes them by event time. Books may arrive out of order
within the watermark's patience. A product's rows of one batch go through one task, so products that hold a large
share of all rows belong to the batch-wise form.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from tickloom.operators.book import two_sided
from tickloom.operators.signals import HISTORY, book_mid, fill_room, priced_by_history, quote_orders
from tickloom.plans import Series
from tickloom.plans.settings import session_settings

# Task functions travel by value, so executors need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _in_order(rows: Sequence[Row], order: Sequence[str]) -> list[Row]:
    """Rows by their order columns, nulls first."""
    return sorted(rows, key=lambda r: [(r[c] is not None, r[c]) for c in order])


class Histories(StatefulProcessor):
    """Books in time order with ``history``, the mids of the product's last books, the book's own last.

    A book waits until the watermark has reached its event time (``_ms``). One timer per product and batch wakes it;
    with ``forget_ms`` another one drops the history of a product that has been silent for so long.
    """

    def __init__(self, schema: T.StructType, order: Sequence[str], keep: int, forget_ms: int | None):
        self.schema, self.order, self.keep, self.forget_ms = schema, ["_ms", *order], keep, forget_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.mids = handle.getListState("mids", T.StructType([T.StructField("mid", T.DoubleType())]))
        self.waiting = handle.getListState("waiting", self.schema)
        self.last = handle.getValueState("last", T.StructType([T.StructField("ms", T.LongType())]))

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        fresh = list(rows)
        self.waiting.appendList([tuple(r) for r in fresh])
        self.handle.registerTimer(min(r["_ms"] for r in fresh))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        reached = timerValues.getCurrentWatermarkInMs()
        named = Row(*self.schema.names)
        books = [named(*r) for r in self.waiting.get()] if self.waiting.exists() else []
        ready = _in_order([r for r in books if r["_ms"] <= reached], self.order)
        if ready:
            self._keep_waiting([r for r in books if r["_ms"] > reached])
            yield from self._released(ready)
        elif not books and self.forget_ms is not None and self.last.exists() and self.last.get()[0] + self.forget_ms <= reached:
            self.mids.clear()
            self.last.clear()

    def _keep_waiting(self, books: list[Row]) -> None:
        if books:
            self.waiting.put([tuple(r) for r in books])
            self.handle.registerTimer(min(r["_ms"] for r in books))
        else:
            self.waiting.clear()

    def _released(self, ready: list[Row]) -> Iterator[Row]:
        mids = [m[0] for m in self.mids.get()] if self.mids.exists() else []
        last = self.last.get()[0] if self.last.exists() else None
        for row in ready:
            if self.forget_ms is not None and last is not None and row["_ms"] - last >= self.forget_ms:
                mids = []
            last = row["_ms"]
            mids = [*mids, row["mid_price"]][-self.keep:]
            yield Row(**row.asDict(), history=mids)
        self.mids.put([(m,) for m in mids])
        self.last.update((last,))
        if self.forget_ms is not None:
            self.handle.registerTimer(last + self.forget_ms)

    def close(self) -> None:
        pass


class Holdings(StatefulProcessor):
    """Rows with ``position_before`` and ``position``, where each fills ``_buy`` and ``_sell`` as far as ``_limit`` allows."""

    def __init__(self, order: Sequence[str]):
        self.order = ["_ms", *order]

    def init(self, handle) -> None:
        self.position = handle.getValueState("position", T.StructType([T.StructField("position", T.LongType())]))

    def handleInitialState(self, key, initialState: Row, timerValues) -> None:
        self.position.update((int(initialState["position"] or 0),))

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        before = self.position.get()[0] if self.position.exists() else 0
        for row in _in_order(list(rows), self.order):
            bought = max(0, min(row["_limit"] - before, row["_buy"]))
            sold = max(0, min(row["_limit"] + before, row["_sell"]))
            after = before + bought - sold
            yield Row(**row.asDict(), position_before=before, position=after)
            before = after
        self.position.update((before,))

    def close(self) -> None:
        pass


def _with(schema: T.StructType, **more: T.DataType) -> T.StructType:
    return T.StructType([*schema.fields, *(T.StructField(n, t) for n, t in more.items())])


def stored_signals(
    books: DataFrame,
    series: Series,
    path: str,
    event_time: Column,
    params: DataFrame | None = None,
    patience: str = "0 seconds",
    forget_ms: int | None = None,
    fills: bool = False,
    opening: DataFrame | None = None,
    trigger: dict | None = None,
) -> StreamingQuery:
    """Orders of ``batches.stream_signals`` for every book of a stream, to ``{path}/orders``, with the state in Spark's store.

    ``event_time`` is a timestamp after 1970 that never falls along a product's order; books without one take no part. A book
    is answered once the watermark, the latest event time of any product less ``patience``, has reached it, in the order of the
    series whatever order books arrive in. Books behind the watermark are dropped and counted by Spark
    (``numRowsDroppedByWatermark`` of the query's progress). A product without books for ``forget_ms`` starts a new history; its position stays.
    With ``fills`` orders fill and move the position; ``opening`` may hold one per key (columns: key, ``position``).
    """
    order = list(series.order_names)
    timed = books.filter(two_sided()).withColumns({"mid_price": book_mid(), "_at": event_time}).filter("_at IS NOT NULL")
    rows = timed.withWatermark("_at", patience).withColumn("_ms", F.unix_millis("_at"))
    told = _with(rows.schema, history=T.ArrayType(T.DoubleType()))
    seen = rows.groupBy(*series.key).transformWithState(
        Histories(rows.schema, order, HISTORY, forget_ms), told, "Append", "EventTime"
    )
    priced = priced_by_history(seen, F.col("history"), params)
    if fills:
        buy, sell, limit = fill_room()
        none = F.lit(0).cast("long")
        room = priced.withColumns({"_buy": F.coalesce(buy, none), "_sell": F.coalesce(sell, none), "_limit": limit.cast("long")})
        held = _with(room.schema, position_before=T.LongType(), position=T.LongType())
        start = None if opening is None else opening.select(*series.key, F.col("position").cast("long").alias("position")).groupBy(*series.key)
        moved = room.groupBy(*series.key).transformWithState(Holdings(order), held, "Append", "None", start)
        orders = quote_orders(moved, F.col("position_before")).drop("_buy", "_sell", "_limit")
    else:
        orders = quote_orders(priced)
    return _start(books.sparkSession, orders.drop("_at", "_ms", "history"), path, trigger)


def _start(spark: SparkSession, rows: DataFrame, path: str, trigger: dict | None) -> StreamingQuery:
    """A query takes the session's settings when it starts; typed state needs the RocksDB store."""
    with session_settings(spark, {PROVIDER: ROCKS}):
        writer = rows.writeStream.format("parquet").option("path", f"{path}/orders").option("checkpointLocation", f"{path}/checkpoint")
        return writer.trigger(**(trigger or {"availableNow": True})).start()
