"""Bounded look-back without whole-recording windows.

One recording or session may hold a third of all rows, so nothing here partitions a window by
recording alone. A row joins the fixed-size segment it lies in and, as *halo*, the following
segments whose rows may look back at it. A bounded look-back over (key, segment) then gives
exactly the result of the unsegmented window, at ``halo / size`` extra rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

SEGMENT = "segment"
OWN = "is_own"


def segment_of(position: Column, size: float) -> Column:
    return F.floor(position / F.lit(size)).cast("long")


def with_halo(df: DataFrame, position: str, size: float, reach: float) -> DataFrame:
    """Copy each row into every segment that may look back at it by up to ``reach``."""
    p = F.col(position)
    return (df.withColumn(SEGMENT, F.explode(F.sequence(segment_of(p, size), segment_of(p + F.lit(reach), size))))
            .withColumn(OWN, F.col(SEGMENT) == segment_of(p, size)))


def own_rows(df: DataFrame) -> DataFrame:
    return df.where(OWN).drop(OWN, SEGMENT)
