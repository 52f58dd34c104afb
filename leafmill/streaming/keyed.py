"""Listening progress as keyed state of a streaming query.

Each user's document has its last write in Spark's state store. An event that
is not newer than what is stored changes nothing, so order, repeats and late
arrival don't matter; a timer in event time fires once a listener has been away
for a while. What comes out are the writes that became the latest, and a row
marked idle when a timer fires.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from leafmill.streaming.progress import KEY, transition

#: The state store that keyed state needs.
PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")

_STATE = T.StructType(
    [
        T.StructField("ts", T.TimestampType()), T.StructField("event_id", T.LongType()), T.StructField("current_segment_number", T.IntegerType()),
        T.StructField("position_seconds", T.DoubleType()), T.StructField("playback_speed", T.DoubleType()), T.StructField("completed", T.BooleanType()),
    ]
)
_FIELDS = _STATE.fieldNames()


class LastWrite(StatefulProcessor):
    """Keeps the greatest (ts, event_id) of each key."""

    def __init__(self, idle_ms: int):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", _STATE)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        stored = self.last.get() if self.last.exists() else None
        best = None
        for frame in rows:
            top = frame.sort_values(["ts", "event_id"], kind="stable").iloc[-1]
            if best is None or (top["ts"], top["event_id"]) > (best["ts"], best["event_id"]):
                best = top
        if best is None or (stored is not None and (pd.Timestamp(stored[0]), stored[1]) >= (best["ts"], best["event_id"])):
            return
        self.last.update((best["ts"].to_pydatetime(), int(best["event_id"]), int(best["current_segment_number"]), float(best["position_seconds"]), float(best["playback_speed"]), bool(best["completed"])))
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        # An event that is late by more than the wait has its time behind the watermark.
        due = int(best["ts"].timestamp() * 1000) + self.idle_ms
        self.handle.registerTimer(max(due, timerValues.getCurrentWatermarkInMs() + 1))
        yield self._row(key, [best[f] for f in _FIELDS], False)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.last.exists():
            yield self._row(key, list(self.last.get()), True)

    def close(self) -> None:
        pass

    def _row(self, key: tuple, values: list, idle: bool) -> pd.DataFrame:
        return pd.DataFrame({**{k: [v] for k, v in zip(KEY, key, strict=True)}, **{f: [v] for f, v in zip(_FIELDS, values, strict=True)}, "idle": [idle]})


def keyed_progress(events: DataFrame, late: str = "3650 days", idle: str = "30 minutes") -> DataFrame:
    """A stream of the writes that became their key's latest, and of idle marks.

    ``events`` as in ``progress``; those later than ``late`` behind the newest
    may be dropped by the watermark. The last row of a key that isn't idle, by
    ts and event_id, is what ``progress.latest`` gives for all its events.
    Needs the state store in ``PROVIDER``.
    """
    saved = transition(events.withWatermark("ts", late))
    seconds = pd.Timedelta(idle).total_seconds()
    fields = {f.name: f.dataType.simpleString() for f in saved.schema.fields}
    kinds = ", ".join(f"{k} {fields[k]}" for k in KEY)
    out = f"{kinds}, ts timestamp, event_id long, current_segment_number int, position_seconds double, playback_speed double, completed boolean, idle boolean"
    typed = saved.withColumns({f.name: F.col(f.name).cast(f.dataType) for f in _STATE.fields})
    return typed.groupBy(*KEY).transformWithStateInPandas(LastWrite(int(seconds * 1000)), out, "Append", "EventTime")
