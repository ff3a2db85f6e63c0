"""Cutting sample blocks into fixed epochs by absolute sample index."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from ..model import GuardError


def epoch_samples(fs: float, epoch_s: float) -> int:
    """Samples per epoch, with the analysis guards (half-even rounding, exact grid)."""
    if not fs / 2 > 40:
        raise GuardError("the 0.5-40 Hz feature set needs a sampling rate above 80 Hz")
    if not math.isfinite(epoch_s) or epoch_s < 4:
        raise GuardError("epochs must last at least four seconds")
    n = round(epoch_s * fs)
    if not math.isclose(n / fs, epoch_s, rel_tol=1e-5, abs_tol=1e-8):
        raise GuardError("epoch duration must align to the sample grid")
    return n


def cut(blocks: DataFrame, n: int, name: str = "epoch_ix", hop: int | None = None) -> DataFrame:
    """Assemble complete windows of ``n`` samples from blocks of any length.

    With ``hop`` the windows overlap: window k covers samples [k*hop, k*hop + n). Incomplete
    windows (the tail, or windows with absent blocks) are dropped; missing samples inside a
    block stay NULL and are judged by quality control. One shuffle, keyed so finely that no
    recording is ever in one task.
    """
    hop = hop or n
    start, size = F.col("start_ix"), F.size("uv")
    first = F.greatest(F.lit(0).cast("long"), F.ceil((start - n + 1) / hop).cast("long"))
    last = F.floor((start + size - 1) / hop).cast("long")
    pieces = (blocks.where(size > 0)
              .withColumn(name, F.explode(F.when(last >= first, F.sequence(first, last))))
              .withColumn("_at", F.greatest(start, F.col(name) * hop))
              .withColumn("_to", F.least(start + size, F.col(name) * hop + n)))
    whole = (F.col("_at") == start) & (F.col("_to") == start + size)
    part = F.slice("uv", (F.col("_at") - start + 1).cast("int"), (F.col("_to") - F.col("_at")).cast("int"))
    piece = F.struct(F.col("_at").alias("at"), F.when(whole, F.col("uv")).otherwise(part).alias("uv"))
    return (pieces.groupBy("recording_id", "channel", name)
            .agg(F.sum(F.col("_to") - F.col("_at")).alias("_n"), F.sort_array(F.collect_list(piece)).alias("_p"))
            .where(F.col("_n") == n)
            .select("recording_id", "channel", name, F.flatten(F.col("_p.uv")).alias("uv")))


def from_samples(samples: DataFrame, block: int = 1024) -> DataFrame:
    """Tidy samples (recording_id, channel, sample_ix, uv) -> blocks of up to ``block`` samples."""
    bucket = F.floor(F.col("sample_ix") / block).cast("long")
    return (samples.groupBy("recording_id", "channel", bucket.alias("_b"))
            .agg(F.sort_array(F.collect_list(F.struct("sample_ix", "uv"))).alias("_s"))
            .select("recording_id", "channel", F.col("_s")[0]["sample_ix"].alias("start_ix"),
                    F.col("_s.uv").alias("uv")))


def to_samples(blocks: DataFrame) -> DataFrame:
    return (blocks.select("recording_id", "channel", "start_ix", F.posexplode("uv").alias("_i", "uv"))
            .select("recording_id", "channel", (F.col("start_ix") + F.col("_i")).alias("sample_ix"), "uv"))


def lengths(blocks: DataFrame) -> DataFrame:
    """Samples per recording."""
    return blocks.groupBy("recording_id").agg(F.max(F.col("start_ix") + F.size("uv")).alias("samples"))


def epoch_times(start_s: Column | float, fs: float, n: int, epoch_s: float, ix: str = "epoch_ix") -> list[Column]:
    t = (start_s if isinstance(start_s, Column) else F.lit(float(start_s))) + F.col(ix) * n / F.lit(float(fs))
    return [t.alias("time_s"), (t + F.lit(float(epoch_s))).alias("epoch_end_s")]
