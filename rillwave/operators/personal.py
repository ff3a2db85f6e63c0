"""Personal baselines of live features and the weighted arousal index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..model import LIVE_FEATURES, LiveConfig
from ..session import cut_lineage


def calibration_end(windows: DataFrame, cfg: LiveConfig) -> DataFrame:
    """Time of the window that completes calibration, for sessions that get there.

    That is the first window at or after ``baseline_sec`` once enough clean windows exist. Only
    the earliest clean windows are ranked, a group limit Spark applies before the shuffle. The
    result is one row per session and is kept, because every later step needs it.
    """
    rank = F.row_number().over(W.partitionBy("session_id").orderBy("t"))
    need = cfg.baseline_min_windows
    enough = (windows.where("ok").select("session_id", "t").withColumn("_r", rank).where(F.col("_r") <= need)
              .groupBy("session_id").agg(F.count("*").alias("_n"), F.max("t").alias("_t")))
    ready = enough.where(F.col("_n") == need).select(
        "session_id", F.greatest(F.col("_t"), F.lit(float(cfg.baseline_sec))).alias("_from"))
    return cut_lineage(windows.select("session_id", "t").join(ready, "session_id").where("t >= _from")
                       .groupBy("session_id").agg(F.min("t").alias("calibrated_t")))


def _middle(values: Column) -> Column:
    """Median of a sorted array."""
    n = F.size(values)
    return (F.get(values, F.floor((n - 1) / 2).cast("int")) + F.get(values, F.floor(n / 2).cast("int"))) / 2.0


def robust_baseline(windows: DataFrame, cfg: LiveConfig, features=LIVE_FEATURES, ends: DataFrame | None = None) -> DataFrame:
    """Per session and feature: median, 1.4826 MAD and scale = max(mad, 1e-6, 0.05 |median|).

    Calibration spans minutes, so a group holds a few hundred values and both medians come from
    one sorted array: a single pass over the windows.
    """
    ends = calibration_end(windows, cfg) if ends is None else ends
    rows = (windows.where("ok").join(ends, "session_id").where("t <= calibrated_t")
            .select("session_id", F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).alias("x"))
                                                      for f in features])).alias("p"))
            .select("session_id", "p.*").where("x is not null"))
    return (rows.groupBy("session_id", "feature").agg(F.sort_array(F.collect_list("x")).alias("_x"))
            .withColumn("med", _middle(F.col("_x")))
            .withColumn("_d", F.array_sort(F.transform("_x", lambda v: F.abs(v - F.col("med")))))
            .select("session_id", "feature", "med", (_middle(F.col("_d")) * 1.4826).alias("mad"), F.size("_x").cast("long").alias("n"))
            .withColumn("scale", F.greatest("mad", F.lit(1e-6), F.abs(F.col("med")) * 0.05)))


def baseline_map(baseline: DataFrame) -> DataFrame:
    entry = F.struct("feature", F.struct("med", "scale"))
    return baseline.groupBy("session_id").agg(F.map_from_entries(F.collect_list(entry)).alias("baseline"))


def weighted_index(z: dict[str, Column], weights: dict[str, float]) -> Column:
    """Sum of w z over available features, divided by the root of the sum of |w|."""
    num, den = F.lit(0.0), F.lit(0.0)
    for f, w in weights.items():
        if f in z:
            num = num + F.coalesce(z[f] * w, F.lit(0.0))
            den = den + F.when(z[f].isNotNull(), abs(w)).otherwise(0.0)
    return num / F.sqrt(F.when(den == 0.0, 1.0).otherwise(den))


def arousal_index(windows: DataFrame, cfg: LiveConfig) -> DataFrame:
    """Raw index of every clean window after calibration, against the fixed calibration baseline."""
    ends = calibration_end(windows, cfg)
    base = baseline_map(robust_baseline(windows, cfg, ends=ends)).join(ends, "session_id")
    rows = windows.where("ok").join(base, "session_id").where("t > calibrated_t")
    z = {f: (F.col(f) - F.col("baseline")[f]["med"]) / F.col("baseline")[f]["scale"] for f in LIVE_FEATURES}
    return rows.withColumn("raw_index", weighted_index(z, cfg.weights)).drop("baseline")
