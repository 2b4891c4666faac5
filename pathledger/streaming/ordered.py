"""Folds over streams in event order: a reorder buffer per key, released by event-time timers.

A stream brings the rows of a key in any order, over Arrow batches, files and micro-batches. Each row waits in keyed state under
its millisecond until the watermark has passed that, when no earlier row can come any more; then the rows of that millisecond
are folded in their order. So a stream gives what a batch over all its rows gives, for all that isn't later than the watermark.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import IntegerType, LongType, StructType

#: (state or None, rows of one key and millisecond in order) -> (state or None, rows to emit)
Fold = Callable[[tuple | None, list[dict]], tuple[tuple | None, list[dict]]]
AT = "event_at"


def in_order(order: list[str]) -> Callable[[dict], tuple]:
    return lambda r: tuple((r[c] is not None, r[c]) for c in order)


class OrderedFold(StatefulProcessor):
    """Rows of a millisecond are kept in parts, one for each batch that brought some, so that none is written twice."""

    def __init__(self, ts: str, fold: Fold, state: str, schema: StructType, order: list[str]):
        self.ts, self.fold, self.kind, self.schema, self.order = ts, fold, state, schema, order

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getMapState("held", "ms long, part int", "rows binary")
        self.parts = handle.getMapState("parts", "ms long", "n int")
        self.state = handle.getValueState("state", self.kind)

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802
        new: dict[int, list[dict]] = {}
        for pdf in rows:
            pdf = pdf.drop(columns=AT).astype(object)
            for r in pdf.where(pdf.notna(), None).to_dict("records"):
                new.setdefault(int(r[self.ts]), []).append(r)
        for ms, found in new.items():
            n = self.parts.getValue((ms,))[0] if self.parts.containsKey((ms,)) else 0
            if not n:
                self.handle.registerTimer(ms)
            self.held.updateValue((ms, n), (pickle.dumps(found),))
            self.parts.updateValue((ms,), (n + 1,))
        yield self.frame([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):  # noqa: N802
        ms, rows = expiredTimerInfo.getExpiryTimeInMs(), []
        for part in range(self.parts.getValue((ms,))[0]):
            rows += pickle.loads(self.held.getValue((ms, part))[0])
            self.held.removeKey((ms, part))
        self.parts.removeKey((ms,))
        state, out = self.fold(tuple(self.state.get()) if self.state.exists() else None, sorted(rows, key=in_order(self.order)))
        if state is None:
            self.state.clear()
        else:
            self.state.update(state)
        yield self.frame(out)

    def frame(self, rows: list[dict]) -> pd.DataFrame:
        whole = {f.name for f in self.schema if isinstance(f.dataType, (LongType, IntegerType))}
        return pd.DataFrame({f.name: pd.Series([r[f.name] for r in rows], dtype="Int64" if f.name in whole else object) for f in self.schema})

    def close(self) -> None:
        pass


def ordered(events: DataFrame, keys: list[str], ts: str, late: str, fold: Fold, state: str, schema: StructType, order: list[str]) -> DataFrame:
    """The fold of each key's rows by (ts, order); ts in ms. Rows that come more than `late` after a later one are dropped.

    The watermark starts at 1970, so times are later than that. Rows are emitted once the watermark (the greatest ts so far less `late`) reaches them, so the last ones wait for later
    events. Needs the RocksDB state store provider.
    """
    timed = events.withColumn(AT, F.timestamp_millis(F.col(ts))).withWatermark(AT, late)
    return timed.groupBy(*keys).transformWithStateInPandas(OrderedFold(ts, fold, state, schema, order), schema, "append", "eventTime")
