"""As-of join backward with expiry, split by time so that a hot key is never one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..model import GuardError
from .segments import segment_of, with_halo


def asof_backward(left: DataFrame, right: DataFrame, keys: list[str], left_t: str, right_t: str,
                  max_age: float, tie: str | None = None, width: float | None = None) -> DataFrame:
    """Left rows plus ``ref``: the latest right row at or before them, NULL once older than ``max_age``.

    The latest *row* wins even when its values are NULL, and an expired latest row does not fall
    back to an older one. Because a match may reach back at most ``max_age``, right rows only
    travel into the time buckets that can still see them; each (key, bucket) is sorted on its own.
    """
    if not max_age >= 0:
        raise GuardError("max_age must be nonnegative")
    width = width or max(60.0, float(max_age))
    payload = [c for c in right.columns if c not in keys]
    ref = F.struct(*payload)
    left_cols = left.columns
    probe = (left.withColumn("segment", segment_of(F.col(left_t), width))
             .select(*keys, "segment", F.col(left_t).cast("double").alias("_t"), F.lit(1).alias("_side"),
                     F.lit(None).cast("long").alias("_tie"), F.struct(*left_cols).alias("_row"),
                     F.lit(None).cast(right.select(ref.alias("r")).schema["r"].dataType).alias("_ref")))
    # a sliver of slack keeps boundary rows; the exact age test follows below
    held = with_halo(right, right_t, width, max_age * (1 + 1e-9) + 1e-3)
    held = held.select(*keys, "segment", F.col(right_t).cast("double").alias("_t"), F.lit(0).alias("_side"),
                       (F.col(tie) if tie else F.lit(None)).cast("long").alias("_tie"),
                       F.lit(None).cast(probe.schema["_row"].dataType).alias("_row"), ref.alias("_ref"))
    w = (W.partitionBy(*keys, "segment").orderBy("_t", "_side", "_tie")
         .rowsBetween(W.unboundedPreceding, W.currentRow))
    joined = (probe.unionByName(held)
              .withColumn("_hit", F.last("_ref", ignorenulls=True).over(w))
              .where("_side = 1"))
    fresh = F.col("_t") - F.col(f"_hit.{right_t}") <= F.lit(float(max_age))
    return joined.select("_row.*", F.when(fresh, F.col("_hit")).alias("ref"))


def check_track(tracks: DataFrame, reach_rows: int = 65536) -> DataFrame:
    """Per track: rows with a non-finite time, and rows whose time does not exceed the previous row's.

    The row before a track's first one in a segment of row numbers is the last one of the segment before that holds
    any: tracks may share one numbering, so it can lie any distance back.
    """
    t = F.col("t")
    bad = t.isNull() | F.isnan(t) | (F.abs(t) == float("inf"))
    keys, at = ["case_id", "tname"], F.struct("row_ix", "t")
    inside = W.partitionBy(*keys, "segment").orderBy("row_ix")
    counts = (tracks.withColumn("segment", segment_of(F.col("row_ix"), reach_rows))
              .withColumn("_prev", F.lag("t").over(inside))
              .groupBy(*keys, "segment")
              .agg(F.count("*").alias("_n"), F.count_if(bad).alias("_bad"), F.count_if(F.col("_prev") >= t).alias("_back"),
                   F.min(at).alias("_first"), F.max(at).alias("_last")))
    edge = F.lag("_last.t").over(W.partitionBy(*keys).orderBy("segment")) >= F.col("_first.t")
    return (counts.withColumn("_edge", F.coalesce(edge, F.lit(False)).cast("long"))
            .groupBy(*keys)
            .agg(F.sum("_n").alias("n_rows"), F.sum("_bad").alias("n_bad_time"), F.sum(F.col("_back") + F.col("_edge")).alias("n_not_increasing")))


def hold_numeric(clock: DataFrame, tracks: DataFrame, keys: list[str], clock_t: str = "t",
                 max_age_s: float = 5.0, out: Column | None = None, checked: bool = True) -> DataFrame:
    """Causal last observation of a monitor track on another clock; no backfill, expiry inclusive."""
    if checked and "row_ix" in tracks.columns:
        report = check_track(tracks).where("n_bad_time > 0 or n_not_increasing > 0").take(1)
        if report:
            raise GuardError(f"track {report[0]['tname']} times must be finite and strictly increasing")
    right = tracks.select(*keys, F.col("t").alias("track_t"), "value")
    hit = asof_backward(clock, right, keys, clock_t, "track_t", max_age_s)
    return hit.withColumn("held", F.col("ref.value")).drop("ref")


def compact_clock(tracks: DataFrame) -> DataFrame:
    """Waveform tracks store (start, interval) in their first two time rows: t_i = start + i * interval."""
    head = (tracks.where("row_ix < 2").groupBy("case_id", "tname")
            .agg(F.max(F.when(F.col("row_ix") == 0, F.col("t"))).alias("start"),
                 F.max(F.when(F.col("row_ix") == 1, F.col("t"))).alias("interval")))
    ok = (F.abs(F.col("start")) < float("inf")) & (F.col("interval") > 0) & (F.col("interval") < float("inf"))
    return (tracks.drop("t").join(head, ["case_id", "tname"])
            .withColumn("t", F.when(F.coalesce(ok, F.lit(False)), F.col("start") + F.col("row_ix") * F.col("interval"))
                        .otherwise(F.raise_error(F.lit("invalid waveform start or sample interval")).cast("double")))
            .drop("start", "interval"))
