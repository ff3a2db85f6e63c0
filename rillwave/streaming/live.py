"""Live windows from raw blocks, and the detector as a Structured Streaming operator."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..functions import kernels as K
from ..functions.batches import append_kernel
from ..model import LIVE_FEATURES, STEPS, GuardError, LiveConfig
from ..session import shared_folder
from . import machine as M
from .eventtime import timed_state
from .sessions import records, steps_frame

_SITE = ("alpha_rel", "beta_alpha_ratio", "muscle_tension")


def _joint_windows(blocks: DataFrame, cfg: LiveConfig) -> DataFrame:
    """Complete windows with one array column per configured channel; a single shuffle."""
    n, hop = cfg.window_n, cfg.hop_n
    start, size = F.col("start_ix"), F.size("uv")
    first = F.greatest(F.lit(0).cast("long"), F.ceil((start - n + 1) / hop).cast("long"))
    last = F.floor((start + size - 1) / hop).cast("long")
    cut = (blocks.where(F.col("channel").isin(*cfg.channels) & (size > 0))
           .withColumn("window_ix", F.explode(F.when(last >= first, F.sequence(first, last))))
           .withColumn("_at", F.greatest(start, F.col("window_ix") * hop))
           .withColumn("_to", F.least(start + size, F.col("window_ix") * hop + n)))
    part = F.slice("uv", (F.col("_at") - start + 1).cast("int"), (F.col("_to") - F.col("_at")).cast("int"))
    piece = F.struct(F.col("_at").alias("at"), part.alias("uv"))

    def channel(c: str) -> Column:
        return F.flatten(F.sort_array(F.collect_list(F.when(F.col("channel") == c, piece)))["uv"])

    wide = cut.groupBy("recording_id", "window_ix").agg(*[channel(c).alias(f"_c{i}") for i, c in enumerate(cfg.channels)])
    complete = F.lit(True)
    for i in range(len(cfg.channels)):
        complete = complete & (F.size(f"_c{i}") == n)
    return wide.where(complete)


def _window_kernel(w: np.ndarray, cfg: LiveConfig) -> dict:
    """Windows (batch, channel, sample) -> ok flag, features, per-channel features (NaN when rejected)."""
    ok = K.live_quality(w, cfg)
    out = {"ok": ok, **{f: np.full(len(w), np.nan) for f in LIVE_FEATURES},
           **{f"site_{k}": np.full(w.shape[:2], np.nan) for k in _SITE}}
    if ok.any():
        feats, per = K.live_features(w[ok], cfg)
        for f in LIVE_FEATURES:
            out[f][ok] = feats[f]
        for k in _SITE:
            out[f"site_{k}"][ok] = per[k]
    return out


def live_windows(blocks: DataFrame, cfg: LiveConfig) -> DataFrame:
    """WINDOWS rows (plus window_ix) of each recording: 2 s windows every second, t at the window end."""
    d, arr = T.DoubleType(), T.ArrayType(T.DoubleType())
    cols = [f"_c{i}" for i in range(len(cfg.channels))]
    rows = append_kernel(_joint_windows(blocks, cfg), cols, lambda *m: _window_kernel(np.stack(m, axis=1), cfg),
                         [("ok", T.BooleanType())] + [(f, d) for f in LIVE_FEATURES] + [(f"site_{k}", arr) for k in _SITE])
    per = F.create_map(*[x for i, c in enumerate(cfg.channels) for x in (
        F.lit(c), F.struct(*[F.col(f"site_{k}")[i].alias(k) for k in _SITE]))])
    t = (F.col("window_ix") * cfg.hop_n + cfg.window_n) / F.lit(float(cfg.fs))
    return rows.select(F.col("recording_id").alias("session_id"), "window_ix", t.alias("t"), "ok", *LIVE_FEATURES,
                       F.when(F.col("ok"), per).alias("channels"))


#: A session that brings nothing for so long has ended: its state goes, and what comes later begins anew.
IDLE_S = 24 * 3600.0


class _Detector(StatefulProcessor):
    """Detector state of a session with a time to live."""

    state = "doc string"

    def __init__(self, cfg: LiveConfig, idle_s: float):
        self.cfg, self.idle_ms = cfg, round(idle_s * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("detector", self.state, ttlDurationMs=self.idle_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        doc = M.loads(self.held.get()[0]) if self.held.exists() else M.fresh(self.cfg)
        frame = pd.concat(list(rows), ignore_index=True).sort_values("t", kind="stable")
        steps = M.run_rows(doc, records(frame), self.cfg)
        self.held.update((M.dumps(doc),))
        if steps:
            yield steps_frame(key[0], steps)

    def close(self) -> None:
        pass


def _stateful(rows: DataFrame, processor: StatefulProcessor) -> DataFrame:
    timed_state(rows.sparkSession)
    return rows.groupBy("session_id").transformWithStateInPandas(
        statefulProcessor=processor, outputStructType=STEPS, outputMode="Append", timeMode="ProcessingTime")


def detect_windows_stream(windows: DataFrame, cfg: LiveConfig, idle_s: float = IDLE_S) -> DataFrame:
    """Streaming WINDOWS rows -> STEPS. State per session is one bounded JSON document that expires ``idle_s`` after its last row.

    Rows of a micro-batch are put in time order; a row at or before the last processed time
    arrived late, changes nothing and gives a LATE step. What one session can bring at once
    is bounded by the source's trigger limit (files, bytes or offsets per trigger): set one.
    """
    return _stateful(windows, _Detector(cfg, idle_s))


def drain(stream: DataFrame, name: str, base: str | None = None) -> DataFrame:
    """Run a streaming query over everything available now and return its output as a table.

    Output and progress live in the shared folder, so a lost executor only costs a retry. A state with a time to live
    asks for empty batches for ever, so here the query runs without them. ``base`` is the folder of an earlier call
    that this one continues.
    """
    spark = stream.sparkSession
    empty_batches, before = "spark.sql.streaming.noDataMicroBatches.enabled", spark.conf.get("spark.sql.streaming.noDataMicroBatches.enabled")
    spark.conf.set(empty_batches, "false")
    base = base or f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    query = (stream.writeStream.format("parquet").outputMode("append").option("path", f"{base}/out")
             .option("checkpointLocation", f"{base}/progress").trigger(availableNow=True).start())
    spark.conf.set(empty_batches, before)
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out")


class _ChunkDetector(_Detector):
    """Additionally the samples that the next window still needs, and where they begin."""

    state = "doc string, rest binary, at long"

    def _windows_done(self, doc: dict, parts: list[np.ndarray], at: int) -> tuple[list[dict], np.ndarray, int]:
        """Steps of the complete windows; what the next window still needs, and where that begins."""
        cfg = self.cfg
        win, hop, steps = cfg.window_n, cfg.hop_n, []
        buf = np.concatenate(parts, axis=1)
        first = -(-at // hop)
        count = max(0, (at + buf.shape[1] - first * hop - win) // hop + 1)
        if count:
            off = first * hop - at
            views = np.lib.stride_tricks.sliding_window_view(buf[:, off:], win, axis=1)[:, ::hop][:, :count]
            done = _window_kernel(np.ascontiguousarray(views.transpose(1, 0, 2)), cfg)
            for i in range(count):
                row = {"t": ((first + i) * hop + win) / cfg.fs, "ok": bool(done["ok"][i]), "bvc": None,
                       **{f: float(done[f][i]) for f in LIVE_FEATURES},
                       "channels": {c: {k: float(done[f"site_{k}"][i, j]) for k in _SITE} for j, c in enumerate(cfg.channels)}}
                steps.extend(M.run_rows(doc, [row], cfg))
            keep = min((first + count) * hop - at, buf.shape[1])
            buf, at = buf[:, keep:], at + keep
        return steps, buf, at

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        cfg, width = self.cfg, len(self.cfg.channels)
        if self.held.exists():
            text, rest, at = self.held.get()
            doc, rest = M.loads(text), np.frombuffer(bytes(rest), dtype="<f8").reshape(width, -1)
        else:
            doc, rest, at = M.fresh(cfg), np.zeros((width, 0)), 0
        frame = pd.concat(list(rows), ignore_index=True).sort_values("start_ix", kind="stable")
        parts, expect, steps = [rest], at + rest.shape[1], []
        for start, uv in zip(frame["start_ix"], frame["uv"]):
            block = np.array([np.asarray(c, dtype=float) for c in uv])
            if block.shape[0] != width:
                raise GuardError(f"chunk has {block.shape[0]} channels, expected {width}")
            if start + block.shape[1] <= expect:
                doc["late"] += 1
                steps.append(M.unused(start / cfg.fs, M.LATE))
                continue
            if start > expect:
                steps += self._windows_done(doc, parts, at)[0]
                steps.append(M.unused(start / cfg.fs, M.GAP))
                parts, at, expect = [], int(start), int(start)
            parts.append(block[:, expect - start:])
            expect = start + block.shape[1]
        new, buf, at = self._windows_done(doc, parts, at)
        steps += new
        self.held.update((M.dumps(doc), np.ascontiguousarray(buf, dtype="<f8").tobytes(), int(at)))
        if steps:
            yield steps_frame(key[0], steps)


def detect_chunks_stream(chunks: DataFrame, cfg: LiveConfig, idle_s: float = IDLE_S) -> DataFrame:
    """Streaming raw chunks (session_id, start_ix, uv: channel-major arrays) -> STEPS.

    The state additionally keeps the samples that the next window still needs, never more than
    one window. A chunk that does not continue its session gives a GAP step; windows start anew behind the gap. A chunk
    that brings nothing new gives a LATE step. State expires ``idle_s`` after the last chunk of its session.
    """
    return _stateful(chunks, _ChunkDetector(cfg, idle_s))
