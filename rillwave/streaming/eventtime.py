"""Sessions by event time, with timers that end them and state that goes with them.

A session of a key is a run of rows no more than ``gap`` apart. Rows may come in any order while the watermark allows:
each extends, joins or opens sessions of its key. A session's timer stands at its end plus the gap; when the watermark
has passed that, no row on time can belong to it any more: the session is emitted and its state removed. A row behind the
watermark changes no session and becomes a row of kind ``LATE`` of its own, so nothing is dropped. (Spark drops late
rows by the column that carries the watermark; the operator sees a copy of the time without that mark.)

State of a key: its open sessions, four numbers each. Nothing is kept for a key without one.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..session import shared_folder

SESSION, LATE = "SESSION", "LATE"
OUTPUT = "session_id string, kind string, start_ms long, end_ms long, n long, total double"


_SPANS = ["start_ms", "end_ms", "n", "total"]
Spans = list[np.ndarray]                       # one array per column of _SPANS: a key has few rows, frames would cost more than the work


def merged(spans: Spans, gap: int) -> Spans:
    """Spans with those at most ``gap`` apart made one, in order."""
    if not len(spans[0]):
        return spans
    order = np.lexsort((spans[1], spans[0]))
    start, end, n, total = (c[order] for c in spans)
    first = np.flatnonzero(np.concatenate([[True], start[1:] - np.maximum.accumulate(end)[:-1] > gap]))
    return [start[first], np.maximum.reduceat(end, first), np.add.reduceat(n, first), np.add.reduceat(total, first)]


def joined(spans: pd.DataFrame, gap: int) -> pd.DataFrame:
    """`merged` for a frame."""
    return pd.DataFrame(dict(zip(_SPANS, merged([spans[c].to_numpy() for c in _SPANS], gap))))


class GapSessions(StatefulProcessor):
    """Open sessions of a key as one value; its timer stands at the earliest end plus the gap."""

    def __init__(self, gap_ms: int):
        self.gap = gap_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "start_ms array<long>, end_ms array<long>, n array<long>, total array<double>")

    def _held(self) -> Spans:
        columns = self.open.get() or [[]] * len(_SPANS)
        return [np.array(c, float if name == "total" else np.int64) for name, c in zip(_SPANS, columns)]

    def _hold(self, spans: Spans) -> None:
        self.open.update(tuple(c.tolist() for c in spans))
        self._wait(spans)

    def _wait(self, spans: Spans) -> None:
        self.handle.registerTimer(int(spans[1].min()) + self.gap)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        watermark, held = timerValues.getCurrentWatermarkInMs(), None
        for batch in rows:
            at, value = batch["at_ms"].to_numpy(), batch["value"].to_numpy()
            points = [at, at, np.ones(len(at), np.int64), value]
            late = at < watermark
            if late.any():
                yield _output(key[0], LATE, [c[late] for c in points])
            if not late.all():
                held = self._held() if held is None else held
                held = merged([np.concatenate([h, c[~late]]) for h, c in zip(held, points)], self.gap)
        if held is not None:
            self._hold(held)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """Ends all sessions the watermark has passed; a timer of a session that has grown since finds none."""
        held = self._held()
        done = held[1] + self.gap < timerValues.getCurrentWatermarkInMs()
        if done.all():
            self.open.clear()
        elif done.any():
            self._hold([c[~done] for c in held])
        else:
            self._wait(held)
        if done.any():
            yield _output(key[0], SESSION, [c[done] for c in held])

    def close(self) -> None:
        pass


def _output(session: str, kind: str, spans: Spans) -> pd.DataFrame:
    return pd.DataFrame({"session_id": session, "kind": kind, **dict(zip(_SPANS, spans))})


def sessions(rows: DataFrame, gap_s: float, delay_s: float) -> DataFrame:
    """Streaming rows (session_id, at timestamp, value) -> sessions that have ended, and late rows, as ``OUTPUT``.

    Times are whole milliseconds. A row without key or time belongs to no session and is left out; a missing value
    counts as 0 in ``total``. ``delay_s`` is how long the watermark waits for rows out of order.
    """
    timed_state(rows.sparkSession)
    marked = rows.where("session_id is not null and at is not null").withWatermark("at", f"{round(delay_s * 1000)} milliseconds")
    seen = marked.select("session_id", F.unix_millis(F.col("at")).alias("at_ms"), F.coalesce(F.col("value").cast("double"), F.lit(0.0)).alias("value"))
    return seen.groupBy("session_id").transformWithStateInPandas(
        statefulProcessor=GapSessions(round(gap_s * 1000)), outputStructType=OUTPUT, outputMode="Append", timeMode="EventTime")


def timed_state(spark: SparkSession) -> None:
    """Timers and times to live need the state store that Spark keeps on disk and backs up in the checkpoint."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def advance(stream: DataFrame, base: str) -> None:
    """Process all that is available now; progress and output stay in ``base``, so a rerun goes on where it ended."""
    (stream.writeStream.format("parquet").outputMode("append").option("path", f"{base}/out")
     .option("checkpointLocation", f"{base}/progress").trigger(availableNow=True).start().awaitTermination())


def replayed(waves: list[DataFrame], operator: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Output of a streaming operator over rows that arrive in the given waves, one after the other."""
    spark = waves[0].sparkSession
    base = f"{shared_folder(spark)}/waves-{uuid.uuid4().hex}"
    for wave in waves:
        wave.write.mode("append").parquet(f"{base}/in")
        stream = operator(spark.readStream.schema(wave.schema).parquet(f"{base}/in"))
        advance(stream, base)
    return spark.read.schema(stream.schema).parquet(f"{base}/out")
