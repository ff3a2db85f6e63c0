"""Per-epoch spectra as DataFrame operators."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F, types as T

from ..functions import kernels as K
from ..functions.batches import append_kernel
from .quality import STATS, stats_kernel

D = T.DoubleType()


def epoch_features(epochs: DataFrame, fs: float, line_hz: float | None = None) -> DataFrame:
    """Signal stats and the 14 spectral outputs of every epoch row, in one Arrow pass.

    Rows with a missing sample skip the transform and get NULLs. The joint verdict over all
    channels comes later; computing a spectrum that is then rejected is far cheaper than
    shuffling the raw signal a second time to find out first.
    """
    def kernel(x: np.ndarray) -> dict:
        K.check_spectral_input(x.shape[1], fs, line_hz)
        out = stats_kernel(x)
        ok = out["n_missing"] == 0
        feats = K.spectral_features(x[ok], fs, line_hz) if ok.any() else {}
        for c in K.SPECTRAL_COLUMNS:
            out[c] = np.full(len(x), np.nan)
            if ok.any():
                out[c][ok] = feats[c]
        return out

    return append_kernel(epochs, ["uv"], kernel, STATS + [(c, D) for c in K.SPECTRAL_COLUMNS])


def epoch_psd(epochs: DataFrame, fs: float) -> DataFrame:
    """Unnotched one-sided density of every epoch row as an array over frequency bins."""
    seg = round(2 * fs)
    bins = seg // 2 + 1

    def kernel(x: np.ndarray) -> dict:
        ok = np.isfinite(x).all(axis=1)
        p = np.full((len(x), bins), np.nan)
        if ok.any():
            p[ok] = K.offline_psd(x[ok], fs)[1]
        return {"psd": p}

    return append_kernel(epochs, ["uv"], kernel, [("psd", T.ArrayType(D))])


def by_bin(psd: DataFrame, fs: float, low: float | None = None, high: float | None = None) -> DataFrame:
    """Array of densities -> one row per frequency bin."""
    seg = round(2 * fs)
    out = (psd.select(*[c for c in psd.columns if c != "psd"], F.posexplode("psd").alias("bin", "psd"))
           .withColumn("freq_hz", F.col("bin") * F.lit(float(fs)) / F.lit(float(seg))))
    if low is not None:
        out = out.where((F.col("freq_hz") >= low) & (F.col("freq_hz") <= high))
    return out


def mean_psd(psd: DataFrame, accepted: DataFrame, fs: float) -> DataFrame:
    """Mean density per recording, channel and bin over accepted epochs only."""
    good = accepted.where("accepted").select("recording_id", "epoch_ix")
    return (by_bin(psd.join(good, ["recording_id", "epoch_ix"], "left_semi"), fs)
            .groupBy("recording_id", "channel", "bin", "freq_hz").agg(F.avg("psd").alias("mean_psd")))


def density_array(psd: DataFrame, accepted: DataFrame, fs: float) -> DataFrame:
    """Density spectral array in dB; rejected epochs keep their rows with NULL power."""
    verdicts = accepted.select("recording_id", "epoch_ix", "accepted")
    db = F.lit(10.0) * F.log10(F.greatest(F.col("psd"), F.lit(1e-12)))
    return (by_bin(psd.join(verdicts, ["recording_id", "epoch_ix"]), fs)
            .withColumn("power_db", F.when(F.col("accepted") & F.col("psd").isNotNull(), db)).drop("psd"))
