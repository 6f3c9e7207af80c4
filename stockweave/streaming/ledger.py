"""Structured Streaming: the stock ledger of arriving movements, and contributions counted once while a preview lives."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from stockweave.functions.scalars import INT_MAX
from stockweave.operators.consolidate import PREVIEW_MINUTES

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
LEDGER = "event_id long, product_id long, accepted boolean, stock long, reason string"
CONTRIBUTION = "event_id long, ts timestamp, source_identity string, product_key string, quantity long"


def _whole(x) -> int | None:
    return None if pd.isna(x) else int(x)


class _Ledger(StatefulProcessor):
    """State: the stock of one product, and the ids of its events. Rows of a batch are applied by event_id, those without one last."""

    def __init__(self, catalogue: bool, start_stock: int, repeat_hours: int | None):
        self.catalogue, self.start_stock, self.repeat_hours = catalogue, start_stock, repeat_hours

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.stock = handle.getValueState("stock", "stock long")
        self.seen = handle.getMapState("seen", "event_id long", "once boolean", self.repeat_hours and self.repeat_hours * 3_600_000)

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:  # noqa: N802, N803
        stock = _whole(initialState["quantity"].iloc[0])
        if stock is not None:
            self.stock.update((stock,))

    def _decided(self, product: int | None, kind, quantity: int | None, stock: int | None) -> tuple[int | None, str | None]:
        """The stock after a movement, and why it is refused."""
        if product is None:
            return stock, "product is missing"
        if kind not in ("IN", "OUT"):
            return stock, "type is missing"
        if quantity is None:
            return stock, "quantity is missing"
        if quantity < 1:
            return stock, "quantity under 1"
        if stock is None:
            return stock, "unknown product"
        after = stock - quantity if kind == "OUT" else stock + quantity
        if after < 0:
            return stock, "insufficient stock"
        return (stock, "stock beyond int") if after > INT_MAX else (after, None)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        batch = pd.concat(list(rows)).sort_values(["event_id", "movement_type", "quantity"], kind="stable")
        product = _whole(key[0])
        stock = self.stock.get()[0] if self.stock.exists() else None if self.catalogue else self.start_stock
        was, out, here = stock, [], set()
        for event, kind, quantity in zip(map(_whole, batch["event_id"]), batch["movement_type"], map(_whole, batch["quantity"]), strict=True):
            if event is not None and (event in here or self.seen.containsKey((event,))):
                out.append((event, product, False, stock, "repeated"))
                continue
            if event is not None:
                here.add(event)
                self.seen.updateValue((event,), (True,))
            stock, reason = self._decided(product, kind, quantity, stock)
            out.append((event, product, reason is None, stock, reason))
        if stock != was or not self.catalogue and stock is not None:
            self.stock.update((stock,))
        made = pd.DataFrame(out, columns=["event_id", "product_id", "accepted", "stock", "reason"])
        yield made.astype({"event_id": "Int64", "product_id": "Int64", "stock": "Int64"})

    def close(self) -> None:
        pass


def stream_stock_ledger(events: DataFrame, stocks: DataFrame | None = None, start_stock: int = 0, repeat_hours: int | None = None) -> DataFrame:
    """Streaming events (event_id, product_id, movement_type, quantity) -> each event's outcome: accepted, the stock after it, and the reason against.

    stocks (id, quantity), a table, is what products start with; movements of others are refused. Without it every product starts with start_stock.
    Within a micro-batch events go by event_id, across batches by arrival. An event without product, type or quantity, or of a quantity under 1, is refused and changes nothing; an event_id that its
    product had before is a repeat. repeat_hours bounds for how long ids are kept, by the cluster's clock; such a stream never ends by itself, as time goes on without events. Stocks and ids outlive a restart from the checkpoint, which does not read stocks again. Needs the RocksDB state store.
    """
    grouped = events.select("event_id", F.col("product_id").cast("long").alias("product_id"), "movement_type", "quantity").groupBy("product_id")
    start = None if stocks is None else stocks.where("id IS NOT NULL").groupBy(F.col("id").cast("long").alias("product_id")).agg(F.min("quantity").cast("long").alias("quantity")).groupBy("product_id")
    return grouped.transformWithStateInPandas(_Ledger(stocks is not None, start_stock, repeat_hours), LEDGER, "update", "processingTime" if repeat_hours else "none", start)


class _Counted(StatefulProcessor):
    """State: until when one source row is counted, and a timer that forgets it then."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.until = handle.getValueState("until", "until long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        batch = pd.concat(list(rows)).sort_values(["event_id", "ts"], kind="stable")
        until = self.until.get()[0] if self.until.exists() else None
        was, keep = until, []
        for ts in batch["ts"]:
            now = int(pd.Timestamp(ts).value // 1000)
            counts = until is None or now >= until
            keep.append(counts)
            if counts:
                until = now + PREVIEW_MINUTES * 60_000_000
        if until != was:
            if was is not None:
                self.handle.deleteTimer(was // 1000 + 1)
            self.until.update((until,))
            self.handle.registerTimer(until // 1000 + 1)
        yield batch.loc[keep, ["event_id", "ts", "source_identity", "product_key", "quantity"]]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.until.clear()
        yield from ()

    def close(self) -> None:
        pass


def stream_contribution_dedupe(rows: DataFrame) -> DataFrame:
    """Streaming rows (event_id, ts, source_identity, product_key, quantity) -> those that count: of a source row the first, and no other for the 30 minutes that a preview lives.

    Of a batch the least event_id goes first, so the outcome doesn't depend on arrival within it; time is that of the rows. Rows more than 30 minutes behind the latest of
    the batches before are too late and left out; when the watermark, as far behind, has passed a source row's 30 minutes, its state goes. Rows without time, source row or product are left out. Quantities of a product are summed by whoever reads. Needs the RocksDB state store.
    """
    timed = rows.where("ts IS NOT NULL AND source_identity IS NOT NULL AND product_key IS NOT NULL").select(F.col("event_id").cast("long").alias("event_id"), F.col("ts").cast("timestamp").alias("ts"), "source_identity", "product_key", F.coalesce(F.col("quantity").cast("long"), F.lit(0)).alias("quantity"))
    return timed.withWatermark("ts", f"{PREVIEW_MINUTES} minutes").groupBy("source_identity").transformWithStateInPandas(_Counted(), CONTRIBUTION, "append", "eventTime")
