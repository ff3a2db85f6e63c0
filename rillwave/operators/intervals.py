"""Join of intervals with points in time, inside a key.

Intervals are sorted into classes by the power of two above their length; in its class an interval touches at most two
buckets, and a point meets one bucket of each class that occurs (there are few: lengths span few powers of two). Widths
thus come from the data, and neither long nor short intervals are copied more than twice. Buckets with more points than
``CROWD`` are split: points are dealt over parts and the bucket's intervals go to each part, so that a hot key or a
burst of points spreads over tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

#: Points of a bucket that one part holds.
CROWD = 4096


def interval_join(intervals: DataFrame, points: DataFrame, key: str, begin: str, end: str, at: str, crowd: int = CROWD) -> DataFrame:
    """All pairs of an interval and a point of the same key with begin <= at <= end.

    The other columns of the two sides must differ in name. Rows without key, bounds or time, and intervals that end
    before they begin, match nothing.
    """
    length = F.col(end) - F.col(begin)
    # the least class holds lengths up to a thousandth; 2 ** class is at least the length
    level = F.ceil(F.log2(F.greatest(length, F.lit(0.001)))).cast("int")
    left = intervals.where(f"`{key}` is not null and `{begin}` <= `{end}`").withColumn("_level", level)
    width = F.pow(F.lit(2.0), F.col("_level"))
    bucket = lambda c: F.floor(F.col(c) / width).cast("long")
    left = left.withColumn("_bucket", F.explode(F.sequence(bucket(begin), bucket(end))))
    levels = [r[0] for r in left.select("_level").distinct().collect()]       # at most a few dozen small numbers
    if not levels:
        levels = [0]
    right = (points.where(f"`{key}` is not null and `{at}` is not null").withColumn("_level", F.explode(F.array(*map(F.lit, levels))))
             .withColumn("_bucket", bucket(at)))
    place = [key, "_level", "_bucket"]
    parts = right.groupBy(place).agg(F.ceil(F.count("*") / F.lit(crowd)).cast("int").alias("_parts"))
    left = left.join(parts, place).withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))).drop("_parts")
    crowded = parts.where("_parts > 1")
    right = (right.join(crowded, place, "left").withColumn("_part", F.when(F.col("_parts").isNull(), 0).otherwise(
        F.pmod(F.xxhash64(*[c for c in right.columns if c not in ("_level", "_bucket")]), F.col("_parts"))).cast("int")).drop("_parts"))
    met = left.join(right, [*place, "_part"]).where(F.col(at).between(F.col(begin), F.col(end)))
    return met.drop("_level", "_bucket", "_part")
