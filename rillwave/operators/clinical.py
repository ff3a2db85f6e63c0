"""Checklist observations that raise detector sensitivity for a limited time."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.scalars import bvc_band, bvc_modifier
from ..model import BVC_VALID_S
from .asof import asof_backward


def with_clinical(windows: DataFrame, observations: DataFrame, valid_s: float = BVC_VALID_S) -> DataFrame:
    """Windows plus ``bvc`` struct(mult, offset, band, score, obs): the latest observation, if not expired.

    ``observations``: session_id, t, score and optionally obs (input order; the later one of equal
    times wins).
    """
    obs = observations if "obs" in observations.columns else observations.withColumn("obs", F.lit(0).cast("long"))
    obs = obs.select("session_id", F.col("t").alias("obs_t"), F.col("score").cast("int").alias("score"),
                     F.col("obs").cast("long").alias("obs"))
    hit = asof_backward(windows, obs, ["session_id"], "t", "obs_t", valid_s, tie="obs", width=max(3600.0, valid_s))
    band = F.coalesce(bvc_band(F.col("ref.score")), F.lit("none"))
    return (hit.withColumn("_band", band)
            .withColumn("bvc", F.struct(bvc_modifier(F.col("_band"), 0).alias("mult"),
                                        bvc_modifier(F.col("_band"), 1).alias("offset"),
                                        F.col("_band").alias("band"),
                                        F.coalesce(F.col("ref.score"), F.lit(0)).alias("score"),
                                        F.when(F.col("ref").isNotNull(),
                                               F.concat_ws("#", F.col("ref.obs_t").cast("string"),
                                                           F.col("ref.obs").cast("string"))).alias("obs")))
            .drop("ref", "_band"))
