"""Re-derived bipolar montage by scalp site, as joins on the site name."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.scalars import site_of
from ..model import MONTAGE_SITES, GuardError


def site_table(blocks: DataFrame) -> DataFrame:
    """Channels of each recording with their scalp site."""
    return (blocks.select("recording_id", "channel").distinct()
            .withColumn("site", site_of(F.col("channel"))))


def montage_plan(blocks: DataFrame, side: str, reference: str | None = None) -> DataFrame:
    """Per recording: the reference that will be used, or why none can be (``problem``)."""
    if side not in MONTAGE_SITES:
        raise GuardError(f"montage side must be one of {sorted(MONTAGE_SITES)}")
    need = [s.lower() for s in MONTAGE_SITES[side]]
    sites = site_table(blocks).groupBy("recording_id").agg(F.collect_set("site").alias("sites"))
    has = lambda s: F.array_contains("sites", s)
    missing = F.array_except(F.array(*map(F.lit, need)), F.col("sites"))
    problem = F.when(F.size(missing) > 0, F.concat(F.lit("scan lacks electrodes: "), F.array_join(missing, ",")))
    if reference:
        desc = F.lit(f"{reference}_scan_channel")
        problem = problem.when(~has(reference.lower()), F.lit(f"reference channel {reference} not in scan"))
    else:
        desc = F.when(has("fpz"), "Fpz").otherwise("approximate_Fpz_as_mean_Fp1_Fp2")
        problem = problem.when(~has("fpz") & ~(has("fp1") & has("fp2")),
                               F.lit("no Fpz and no Fp1+Fp2 to approximate it"))
    return sites.select("recording_id", desc.alias("reference"), problem.alias("problem"))


def rederive(blocks: DataFrame, side: str = "left", reference: str | None = None, strict: bool = True) -> DataFrame:
    """Blocks of ``site - reference`` for the two sites of ``side``.

    Channels of one recording are cut into blocks at the same positions, so the subtraction is an
    array expression after grouping by (recording, start_ix): no sample is exploded. An optional column ``position``
    tells a channel's place in its recording; without it the alphabetical order decides between channels of one site.
    """
    plan = montage_plan(blocks, side, reference)
    if strict:
        bad = plan.where("problem is not null").take(1)
        if bad:
            raise GuardError(f"{bad[0]['recording_id']}: {bad[0]['problem']}")
    wanted = {s.lower() for s in MONTAGE_SITES[side]} | {reference.lower() if reference else "fpz", "fp1", "fp2"}
    at = lambda s: F.max(F.when(F.col("site") == s.lower(), F.col("uv"))).alias(f"_{s.lower()}")
    # two channels of one site: the last one in the recording's order wins
    order = F.struct(F.max("position"), F.col("channel")) if "position" in blocks.columns else F.struct("channel")
    last = (blocks.groupBy("recording_id", "channel").agg(order.alias("_order")).withColumn("site", site_of(F.col("channel")))
            .groupBy("recording_id", "site").agg(F.max("_order")["channel"].alias("channel")))
    wide = (blocks.join(last.where(F.col("site").isin(*wanted)), ["recording_id", "channel"])
            .groupBy("recording_id", "start_ix").agg(*[at(s) for s in sorted(wanted)])
            .join(plan.where("problem is null"), "recording_id"))
    if reference:
        ref = F.col(f"_{reference.lower()}")
    else:
        mean = F.zip_with("_fp1", "_fp2", lambda a, b: (a + b) / 2.0)
        ref = F.when(F.col("reference") == "Fpz", F.col("_fpz")).otherwise(mean)
    wide = wide.withColumn("_ref", ref)
    parts = [F.struct(F.lit(f"BISlike_{s}_minus_ref").alias("channel"),
                      F.zip_with(F.col(f"_{s.lower()}"), F.col("_ref"), lambda a, b: a - b).alias("uv"))
             for s in MONTAGE_SITES[side]]
    return (wide.select("recording_id", "start_ix", "reference", F.explode(F.array(*parts)).alias("p"))
            .select("recording_id", "p.channel", "start_ix", "p.uv", "reference"))
