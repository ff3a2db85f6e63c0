"""Epoch quality control, clock validation and the quality of trailing histories."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from ..functions.batches import append_kernel
from ..model import RESERVED_NUMERICS, GuardError, QualityPolicy
from .segments import own_rows, with_halo

D = T.DoubleType()
STATS = [("n_missing", T.LongType()), ("n_samples", T.LongType()), ("max_abs", D), ("mean_uv", D), ("m2_uv", D)]


def stats_kernel(x: np.ndarray) -> dict:
    """Per row: missing count, peak, mean and sum of squared deviations (NaN once a sample is missing)."""
    bad = ~np.isfinite(x)
    mean = np.where(bad.any(axis=1), np.nan, np.nan_to_num(x).mean(axis=1))
    return {"n_missing": bad.sum(axis=1), "n_samples": np.full(len(x), x.shape[1]),
            "max_abs": np.where(bad.any(axis=1), np.nan, np.abs(np.nan_to_num(x)).max(axis=1)),
            "mean_uv": mean, "m2_uv": ((x - mean[:, None]) ** 2).sum(axis=1)}


def signal_stats(epochs: DataFrame) -> DataFrame:
    return append_kernel(epochs, ["uv"], stats_kernel, STATS)


def finite(c: Column) -> Column:
    """NULL, NaN and infinities of monitor numerics all mean "missing"."""
    return F.when(~F.isnan(c) & (F.abs(c) < float("inf")), c)


def numeric_stats(aux: DataFrame, n: int, ix: str = "epoch_ix") -> DataFrame:
    """Per epoch and monitor numeric: rows, missing rows, extremes and the median of finite values."""
    v = finite(F.col("value"))
    return (aux.groupBy("recording_id", F.floor(F.col("sample_ix") / n).cast("long").alias(ix), "name")
            .agg(F.count("*").alias("n_rows"), (F.lit(n) - F.count(v)).alias("n_missing"),
                 F.min(v).alias("lo"), F.max(v).alias("hi"), F.median(v).alias("mid")))


def _pick(name: str, col: str, agg=F.max) -> Column:
    return agg(F.when(F.col("name") == name, F.col(col)))


def wide_numerics(stats: DataFrame, ix: str = "epoch_ix") -> DataFrame:
    """One row per epoch: recorded_* medians and what the SQI / EMG rules need."""
    medians = [_pick(name, "mid").alias(f"recorded_{name.lower()}") for name in RESERVED_NUMERICS]
    needs = [_pick(name, src).alias(f"{name.lower()}_{dst}")
             for name in ("SQI", "EMG") for src, dst in (("n_rows", "rows"), ("n_missing", "gaps"),
                                                         ("lo", "lo"), ("hi", "hi"))]
    return stats.groupBy("recording_id", ix).agg(*medians, *needs)


def verdict(df: DataFrame, policy: QualityPolicy, has_sqi: Column, has_emg: Column, require_sqi: Column) -> DataFrame:
    """Reasons, warnings and acceptance from the joint figures of all channels.

    Expects any_missing, max_abs, min_sd and the sqi_* / emg_* columns.
    """
    lit = F.lit
    clean = ~F.col("any_missing")
    sqi_gap = F.coalesce(F.col("sqi_gaps") > 0, lit(True))
    sqi_bad = (F.col("sqi_lo") < 0) | (F.col("sqi_hi") > 100)
    sqi_low = F.col("sqi_lo") < policy.min_sqi
    emg_gap = F.coalesce(F.col("emg_gaps") > 0, lit(True))
    emg_hot = F.col("emg_hi") >= policy.emg_warning_db
    reasons = F.array_compact(F.array(
        F.when(~clean, lit("missing_eeg_samples")),
        F.when(clean & (F.col("max_abs") > policy.max_abs_uv), lit("amplitude_outlier")),
        F.when(clean & (F.col("min_sd") < policy.flat_std_uv), lit("flat_signal")),
        F.when((has_sqi & sqi_gap) | (~has_sqi & require_sqi), lit("missing_sqi"))
        .when(has_sqi & sqi_bad, lit("invalid_sqi"))
        .when(has_sqi & sqi_low, lit("low_sqi"))))
    warnings = F.array_compact(F.array(
        F.when(~has_emg | emg_gap, lit("emg_quality_unknown"))
        .when(emg_hot, lit("possible_muscle_contamination"))))
    return (df.withColumn("reasons", reasons).withColumn("warnings", warnings)
            .withColumn("accepted", F.size("reasons") == 0)
            .withColumn("sqi_min", F.when(has_sqi & ~sqi_gap & ~sqi_bad, F.col("sqi_lo")))
            .withColumn("emg_max_db", F.when(has_emg & ~emg_gap, F.col("emg_hi"))))


_NUMERIC_NEEDS = [f"{a}_{b}" for a in ("sqi", "emg") for b in ("rows", "gaps", "lo", "hi")]


def _attach(joint: DataFrame, numerics: DataFrame | None, ix: str, flags: DataFrame | None,
            require_sqi: bool) -> tuple[DataFrame, Column, Column, Column]:
    if numerics is None:
        for c in _NUMERIC_NEEDS:
            joint = joint.withColumn(c, F.lit(None).cast("double"))
        has = F.lit(False), F.lit(False)
    else:
        joint = joint.join(numerics, ["recording_id", ix], "left")
        has = F.lit(True), F.lit(True)
    if flags is None:
        return joint, *has, F.lit(require_sqi)
    joint = joint.join(flags.select("recording_id", "has_sqi", "has_emg", "require_sqi"), "recording_id")
    return joint, F.col("has_sqi"), F.col("has_emg"), F.col("require_sqi")


def channel_counts(blocks: DataFrame) -> DataFrame:
    """(recording_id, n_channels): how many channels each recording has."""
    return blocks.groupBy("recording_id").agg(F.count_distinct("channel").alias("n_channels"))


def joint_channels(stats: DataFrame, ix: str = "epoch_ix", channels: int | DataFrame | None = None) -> DataFrame:
    """Quality is judged over all channels together.

    ``channels``: how many there must be, one number or ``channel_counts``; an epoch that lacks one has missing samples.
    """
    joint = (stats.groupBy("recording_id", ix)
             .agg(F.max(F.col("n_missing") > 0).alias("any_missing"), F.max("max_abs").alias("max_abs"),
                  F.min(F.sqrt(F.col("m2_uv") / F.col("n_samples"))).alias("min_sd"), F.count("*").alias("_present")))
    need = F.lit(channels) if channels is None or isinstance(channels, int) else F.col("n_channels")
    if isinstance(channels, DataFrame):
        joint = joint.join(channels, "recording_id", "left")
    return (joint.withColumn("any_missing", F.col("any_missing") | F.coalesce(F.col("_present") < need, F.lit(False)))
            .drop("_present", "n_channels"))


def assess_epochs(stats: DataFrame, numerics: DataFrame | None = None, policy: QualityPolicy = QualityPolicy(),
                  flags: DataFrame | None = None, require_sqi: bool = False, ix: str = "epoch_ix",
                  channels: int | DataFrame | None = None) -> DataFrame:
    """Epoch verdicts from per-channel signal stats and per-epoch monitor numerics.

    ``flags`` (recording_id, has_sqi, has_emg, require_sqi) mixes recordings with different
    monitors; without it the presence of ``numerics`` speaks for every recording.
    ``channels``: see ``joint_channels``.
    """
    joint, has_sqi, has_emg, need = _attach(joint_channels(stats, ix, channels), numerics, ix, flags, require_sqi)
    return verdict(joint, policy, has_sqi, has_emg, need)


def assess_histories(stats: DataFrame, pieces: int, numerics: DataFrame | None = None,
                     policy: QualityPolicy = QualityPolicy(), flags: DataFrame | None = None,
                     require_sqi: bool = False, ix: str = "epoch_ix", segment: int = 512,
                     channels: int | DataFrame | None = None) -> DataFrame:
    """The same verdict over the ``pieces`` consecutive pieces that end with each piece.

    The flat test needs the deviation of the *whole* history, so means and squared deviations of
    the pieces are merged, two passes over at most ``pieces`` small structs.
    """
    look = W.partitionBy("recording_id", "channel", "segment").orderBy(ix).rangeBetween(-(pieces - 1), 0)
    parts = F.collect_list(F.struct(F.col("n_samples").cast("double").alias("n"), F.col("mean_uv").alias("m"),
                                    F.col("m2_uv").alias("q"))).over(look)
    zero = F.lit(0.0)
    total = F.aggregate("_parts", zero, lambda s, p: s + p["n"])
    mean = F.aggregate("_parts", zero, lambda s, p: s + p["n"] * p["m"]) / total
    per_channel = own_rows(
        with_halo(stats, ix, segment, pieces - 1)
        .withColumn("_parts", parts)
        .withColumn("n_missing", F.sum("n_missing").over(look))
        .withColumn("max_abs", F.max("max_abs").over(look)))
    per_channel = (per_channel.where(F.size("_parts") == pieces)
                   .withColumn("n_samples", total).withColumn("_mean", mean)
                   .withColumn("m2_uv", F.aggregate("_parts", zero, lambda s, p: s + p["q"]
                                                    + p["n"] * (p["m"] - F.col("_mean")) * (p["m"] - F.col("_mean"))))
                   .drop("_parts", "_mean"))
    if numerics is not None:
        seen = W.partitionBy("recording_id", "segment").orderBy(ix).rangeBetween(-(pieces - 1), 0)
        fold = {"rows": F.sum, "gaps": F.sum, "lo": F.min, "hi": F.max}
        keep = numerics.select("recording_id", ix, *_NUMERIC_NEEDS)
        wide = with_halo(keep, ix, segment, pieces - 1)
        covered = F.count("*").over(seen)
        wide = wide.select("recording_id", ix, "is_own", "segment", covered.alias("_c"),
                           *[fold[c.split("_")[1]](c).over(seen).alias(c) for c in _NUMERIC_NEEDS])
        # an epoch without any numeric row is a gap of its own
        numerics = (own_rows(wide)
                    .select("recording_id", ix, *[
                        F.when(F.col("_c") == pieces, F.col(c)).alias(c) if c.endswith("gaps") else F.col(c)
                        for c in _NUMERIC_NEEDS]))
    joint, has_sqi, has_emg, need = _attach(joint_channels(per_channel, ix, channels), numerics, ix, flags, require_sqi)
    return verdict(joint, policy, has_sqi, has_emg, need)


# --- recording validation -------------------------------------------------------------------------

def clock_report(samples: DataFrame, fs: float, segment: int = 65536) -> DataFrame:
    """Per recording: rows, non-finite times and steps that leave the uniform grid."""
    t = F.col("time_s")
    bad = t.isNull() | F.isnan(t) | (F.abs(t) == float("inf"))
    w = W.partitionBy("recording_id", "segment").orderBy("sample_ix")
    step = 1.0 / fs
    return (with_halo(samples.select("recording_id", "sample_ix", "time_s"), "sample_ix", segment, 1)
            .withColumn("_dt", t - F.lag("time_s").over(w))
            .where("is_own")
            .groupBy("recording_id")
            .agg(F.count("*").alias("n_rows"), F.count_if(bad).alias("n_bad_time"),
                 F.count_if(F.abs(F.col("_dt") - F.lit(step)) > F.lit(1e-7 + 1e-4 * step)).alias("n_bad_step")))


def check_sidecar(fs: float, channels: list[str], columns: list[str]) -> None:
    """Guards that need no data."""
    if not np.isfinite(fs) or fs < 2:
        raise GuardError("sampling_rate_hz must be a finite number >= 2")
    if not channels or len(set(channels)) != len(channels) or any(not c for c in channels):
        raise GuardError("eeg_columns must name unique channels")
    if "time_s" not in columns:
        raise GuardError("a time_s column is required")
    gone = [c for c in channels if c not in columns]
    if gone:
        raise GuardError(f"channels absent from the data: {gone}")
    reserved = {*RESERVED_NUMERICS, "time_s"}
    reserved |= {f"BIS/{c}" for c in reserved}
    if set(channels) & reserved:
        raise GuardError("monitor numerics and timestamps are not raw channels")


def validate_wide(frame: DataFrame, fs: float, channels: list[str]) -> None:
    """Raise unless a wide recording (recording_id, sample_ix, time_s, channels...) obeys every rule."""
    check_sidecar(fs, channels, frame.columns)
    rows = clock_report(frame, fs).where("n_rows < 2 or n_bad_time > 0 or n_bad_step > 0").take(1)
    if rows:
        raise GuardError("timestamps must be finite, increasing and uniformly sampled; keep gaps as NULL"
                         if rows[0]["n_rows"] >= 2 else "a recording needs at least two samples")
    infinite = F.greatest(*[F.abs(F.coalesce(F.nanvl(F.col(f"`{c}`"), F.lit(0.0)), F.lit(0.0)))
                            for c in channels], F.lit(0.0)) == float("inf")
    if frame.where(infinite).take(1):
        raise GuardError("infinite amplitudes are invalid; use NULL for missing samples")
