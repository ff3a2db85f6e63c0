"""Quantities that relate frequencies or electrodes: bicoherence and phase locking."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

from ..functions import kernels as K
from ..functions.batches import append_kernel
from ..model import PLV_SITE_PAIRS


def history_bicoherence(blocks: DataFrame, fs: float, epoch_n: int, history_s: float = 60.0,
                        segment_epochs: int = 256) -> DataFrame:
    """Squared bicoherence of the ``history_s`` seconds that end with each complete epoch.

    Blocks travel once, into segments of ``segment_epochs`` epochs plus a halo of one history, so
    a group holds a few MB however long the recording is. Quality of the history is judged by
    ``assess_histories``; here only incomplete histories give NULL.
    """
    span = round(history_s * fs)
    size = segment_epochs * epoch_n
    start, count = F.col("start_ix"), F.size("uv")
    routed = (blocks.where(count > 0).withColumn("segment", F.explode(F.sequence(
        F.floor(start / size).cast("long"), F.floor((start + count - 1 + span) / size).cast("long")))))
    schema = "recording_id string, channel string, epoch_ix long, bicoherence double"

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        recording, channel, segment = key
        lo = max(0, int(segment) * size - span)
        hi = (int(segment) + 1) * size
        x = np.full(hi - lo, np.nan)
        seen = np.zeros(hi - lo, dtype=bool)
        for at, uv in zip(pdf["start_ix"], pdf["uv"]):
            v = np.asarray(uv, dtype=float)
            a, b = max(at, lo), min(at + len(v), hi)
            if a < b:
                x[a - lo:b - lo] = v[a - at:b - at]
                seen[a - lo:b - lo] = True
        first = int(segment) * segment_epochs
        whole = [e for e in range(first, first + segment_epochs)
                 if seen[e * epoch_n - lo:(e + 1) * epoch_n - lo].all()]
        ends = [(e + 1) * epoch_n - lo for e in whole]
        value = K.rolling_bicoherence(x, fs, ends, span)
        return pd.DataFrame({"recording_id": recording, "channel": channel,
                             "epoch_ix": np.array(whole, dtype="int64"), "bicoherence": value})

    out = routed.groupBy("recording_id", "channel", "segment").applyInPandas(run, schema)
    return out.withColumn("bicoherence", F.nanvl("bicoherence", F.lit(None).cast("double")))


def piece_length(epoch_n: int, fs: float, history_s: float = 60.0) -> int:
    """Longest piece that tiles both the epoch and the history."""
    return math.gcd(epoch_n, round(history_s * fs))


def pair_phase_locking(epochs: DataFrame, sites: DataFrame, fs: float, pairs=PLV_SITE_PAIRS,
                       band=(8.0, 13.0)) -> DataFrame:
    """Alpha phase locking of the fixed site pairs, per epoch.

    ``sites`` (recording_id, site, channel) comes from verified channel locations only; where a
    site is named twice the alphabetically last channel wins. Only channels that occur in a pair
    are shuffled, keyed by (recording, epoch, pair).
    """
    spark = epochs.sparkSession
    sides = [(f"pair_{a}_{b}__alpha_plv", s, k) for a, b in pairs for s, k in ((a, 0), (b, 1))]
    plan = F.broadcast(spark.createDataFrame(sides, "pair string, site string, side int"))   # fixed 8 rows
    chosen = sites.groupBy("recording_id", "site").agg(F.max("channel").alias("channel"))
    tagged = epochs.join(chosen.join(plan, "site"), ["recording_id", "channel"])
    both = (tagged.groupBy("recording_id", "epoch_ix", "pair")
            .agg(F.max(F.when(F.col("side") == 0, F.col("uv"))).alias("left_uv"),
                 F.max(F.when(F.col("side") == 1, F.col("uv"))).alias("right_uv"))
            .where("left_uv is not null and right_uv is not null"))

    def kernel(x: np.ndarray, y: np.ndarray) -> dict:
        ok = np.isfinite(x).all(axis=1) & np.isfinite(y).all(axis=1)
        out = np.full(len(x), np.nan)
        if ok.any():
            out[ok] = K.phase_locking(x[ok], y[ok], fs, band)
        return {"plv": out}

    return append_kernel(both, ["left_uv", "right_uv"], kernel, [("plv", T.DoubleType())])
