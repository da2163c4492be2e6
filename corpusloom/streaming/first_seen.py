"""Keep-first inside a stream: of the items of a key the first to arrive passes, ever.

The keys that passed are the state of the stream, kept in the state store, partitioned by key and restored from the
checkpoint after a failure.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from corpusloom.operators.store import KEY
from corpusloom.session import state_store
from corpusloom.sources.index_store import load_index
from corpusloom.streaming.sync import start_loads

EVENT_TIME = "_event_time"


def _first_of_batches(batches: Iterator[pa.RecordBatch], key: Sequence[str], order_by: str) -> Iterator[pa.RecordBatch]:
    """Of each Arrow batch the rows of the first stamp of every key, so that a key of a third of all rows moves as a few rows a batch."""
    names = [str(i) for i in range(len(key))]
    for batch in batches:
        columns = [*(batch.column(c) for c in key), batch.column(order_by), pa.array(range(batch.num_rows), pa.int64())]
        grouped = pa.table(columns, names=[*names, "stamp", "at"]).group_by(names).aggregate([("at", "list"), ("stamp", "list")])
        kept: list[int] = []
        for at, stamps in zip(grouped["at_list"].to_pylist(), grouped["stamp_list"].to_pylist()):
            first = None if None in stamps else min(stamps)
            kept += [i for i, stamp in zip(at, stamps) if stamp == first]
        yield batch.take(pa.array(sorted(kept), pa.int64()))


def _order(value: Any) -> tuple:
    """As Spark orders values: null first, texts by their bytes, lists and rows by their members."""
    if value is None:
        return (0,)
    if isinstance(value, str):
        return 1, value.encode()
    return (1, [_order(v) for v in value]) if isinstance(value, (list, tuple)) else (1, value)


class _FirstOfKey(StatefulProcessor):
    """Passes the first row of a key that has no state; the state goes when its timer fires."""

    def __init__(self, order_by: str, horizon_ms: int | None) -> None:
        self.order_by, self.horizon_ms = order_by, horizon_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", "stamp long")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        first = min(rows, key=lambda row: (_order(row[self.order_by]), _order(row)))
        if self.seen.exists():
            return
        self.seen.update((first[self.order_by],))
        if self.horizon_ms is not None:
            self.handle.registerTimer(int((first[self.order_by] or 0) * 1000 + self.horizon_ms))
        yield first

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        self.seen.clear()
        return iter(())

    def close(self) -> None:
        pass


def first_seen(items: DataFrame, key: Sequence[str] = KEY, order_by: str = "last_update", horizon: int | None = None) -> DataFrame:
    """The first item of every key of a stream: of those of one micro-batch the first by ``order_by`` (epoch seconds),
    then by content; a missing stamp comes before all others. So a stream of one micro-batch passes what ``keep_first`` keeps.

    Without ``horizon`` a key is never forgotten, and the state grows with the keys. With it (seconds) a key is forgotten
    once the stream's time, the greatest stamp less the horizon, has passed its first stamp by the horizon: an item of
    that key is a first one again. Items older than the stream's time was at the start of the micro-batch before are late and
    dropped, and so are, with a horizon, those without a stamp. A null in a key is a value like any other. Columns keep their names and types.
    """
    schema = items.schema
    early = items.mapInArrow(lambda batches: _first_of_batches(batches, key, order_by), schema)
    if horizon is None:
        grouped, mode = early.groupBy(*key), "None"
    else:
        timed = early.where(F.col(order_by).isNotNull()).withColumn(EVENT_TIME, F.timestamp_seconds(order_by))
        grouped, mode = timed.withWatermark(EVENT_TIME, f"{int(horizon)} seconds").groupBy(*key), "EventTime"
    processor = _FirstOfKey(order_by, None if horizon is None else int(horizon) * 1000)
    kept = grouped.transformWithState(processor, schema if horizon is None else timed.schema, "Append", mode)
    return kept.select(*schema.names)


def load_first_seen(items: DataFrame, index_path: str, checkpoint: str, horizon: int | None = None) -> StreamingQuery:
    """The first item of every key of a stream of raw items as loads of the index (see ``sync_index_stream``)."""
    with state_store(items.sparkSession):
        return start_loads(first_seen(items, horizon=horizon), index_path, checkpoint, once=True)
