"""Personal calibration of the ten named components and the two clipped composites."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from ..model import (BASELINE_CONTEXTS, FULL_CALIBRATION_S, RDI_COMPONENTS, SCORING_CONTEXTS, SOI_COMPONENTS,
                     GuardError)
from .quality import finite
from .recurrence import union_duration

COMPONENTS = {"SOI": tuple(SOI_COMPONENTS), "RDI": RDI_COMPONENTS}


def fit_calibrations(epochs: DataFrame, context: str = "awake_personal_baseline", instants: bool = False) -> DataFrame:
    """One calibration per subject from its epochs labelled ``baseline``.

    Result: subject_id, medication_profile_id, session_id, context, duration_s, SOI, RDI and
    ``problems``, the guards the subject violates. A subject with problems has no usable
    calibration; ``require_calibration`` turns that into an error. With ``instants`` an epoch may
    end where it begins, as events without a length do: it adds its values and no duration.
    """
    need = {"time_s", "epoch_end_s", "subject_id", "research_label", "recording_context"}
    if not need <= set(epochs.columns):
        raise GuardError(f"calibration table needs {sorted(need)}")
    rows = epochs.where(F.col("research_label") == "baseline").withColumn("subject_id", F.col("subject_id").cast("string"))
    present = {i: [c for c in names if c in epochs.columns] for i, names in COMPONENTS.items()}
    every = [c for names in present.values() for c in names]
    times = F.coalesce((finite(F.col("time_s").cast("double")).isNotNull()
                        & finite(F.col("epoch_end_s").cast("double")).isNotNull()
                        & (F.col("epoch_end_s") >= F.col("time_s") if instants else F.col("epoch_end_s") > F.col("time_s"))),
                       F.lit(False))
    known = F.coalesce(F.col("recording_context").isin(*BASELINE_CONTEXTS), F.lit(False))
    aggs = [F.count("*").alias("n"), F.count_if(~known).alias("_ctx"), F.count_if(~times).alias("_times")]
    ids = [c for c in ("session_id", "medication_profile_id") if c in epochs.columns]
    for c in ids:
        aggs += [F.min(c).alias(f"_{c}_lo"), F.max(c).alias(f"_{c}_hi"), F.count_if(F.col(c).isNull()).alias(f"_{c}_gap")]
    for c in every:
        v = finite(F.col(c).cast("double"))
        aggs += [F.avg(v).alias(f"_{c}_mean"), F.stddev_samp(v).alias(f"_{c}_sd"), F.count(v).alias(f"_{c}_n")]
    stats = rows.groupBy("subject_id").agg(*aggs)
    length = union_duration(rows.where(times), "subject_id", "time_s", "epoch_end_s")
    general = [F.when(F.col("n") < 3, "fewer than three baseline epochs"),
               F.when(F.col("_ctx") > 0, "baseline context is not a documented awake one"),
               F.when(F.col("_times") > 0, "epoch times must be finite with positive duration")]
    general += [F.when((F.col(f"_{c}_gap") > 0) | (F.col(f"_{c}_lo") != F.col(f"_{c}_hi")), f"{c} must be consistent")
                for c in ids]
    # Turn the wide figures into one row per component and gather them again per subject. The
    # rows are already partitioned by subject, so this adds no shuffle.
    parts = F.array(*[F.struct(F.lit(i).alias("index"), F.lit(c).alias("name"), F.col(f"_{c}_mean").alias("mean"),
                               F.col(f"_{c}_sd").alias("sd"), F.col(f"_{c}_n").alias("n"))
                      for i, names in present.items() for c in names]
                    or [F.expr("named_struct('index', '', 'name', '', 'mean', 0D, 'sd', 1D, 'n', 0L)")])
    tidy = stats.select("subject_id", "n", F.array_compact(F.array(*general)).alias("_general"),
                        *[F.col(f"_{c}_lo").cast("string").alias(c) for c in ids], F.explode(parts).alias("p"))
    fault = (F.when(F.col("p.index") == "", None)
             .when(F.col("p.n") < F.col("n"), F.concat("p.name", F.lit(" contains missing values")))
             .when(~F.coalesce(F.col("p.sd") > 0, F.lit(False)), F.concat("p.name", F.lit(" has zero variance"))))

    def settings(index: str) -> Column:
        entry = F.struct("p.name", F.struct("p.mean", "p.sd", "p.n"))
        return F.struct(F.map_from_entries(F.collect_list(F.when(F.col("p.index") == index, entry))).alias("components"),
                        F.lit(None).cast("map<string,double>").alias("weights")).alias(index)

    gathered = tidy.groupBy("subject_id").agg(
        *[F.first(c).alias(c) for c in ids], settings("SOI"), settings("RDI"),
        F.concat(F.first("_general"), F.sort_array(F.collect_list(fault))).alias("problems"))
    for c, default in (("medication_profile_id", "not_recorded"), ("session_id", None)):
        if c not in ids:
            gathered = gathered.withColumn(c, F.lit(default).cast("string"))
    return (gathered.join(length, "subject_id", "left")
            .select("subject_id", "medication_profile_id", "session_id", F.lit(context).alias("context"), "duration_s",
                    "SOI", "RDI", "problems"))


def require_calibration(epochs: DataFrame, subject_id: str, context: str = "awake_personal_baseline") -> DataFrame:
    """Calibration of one subject, or an error naming the violated guard."""
    mine = epochs.where(F.col("subject_id").cast("string") == F.lit(str(subject_id)))
    fitted = fit_calibrations(mine, context)
    rows = fitted.select("problems").take(1)
    if not rows:
        raise GuardError("fewer than three baseline epochs for this subject")
    if rows[0]["problems"]:
        raise GuardError("; ".join(rows[0]["problems"]))
    return fitted.drop("problems")


def _isfinite(c: Column) -> Column:
    return F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False))


def _with_parts(df: DataFrame, index: str) -> DataFrame:
    """Adds one small array of structs per composite: name, weight, sub-score and validity of each part.

    Higher-order functions keep the expression five times smaller than one branch per component.
    """
    names = COMPONENTS[index]
    plan = F.array(*[F.struct(F.lit(c).alias("name"), F.lit(float(SOI_COMPONENTS.get(c, 0))).alias("dir")) for c in names])
    even = F.create_map(*[x for c in names for x in (F.lit(c), F.lit(0.2))])
    df = df.withColumn("_w", F.coalesce(F.col(index)["weights"], even))

    def read(p):
        b = F.try_element_at(F.col(index)["components"], p["name"])
        return F.struct(p["name"].alias("name"), p["dir"].alias("dir"), F.try_element_at(F.col("_w"), p["name"]).alias("w"),
                        finite(F.try_element_at(F.col("values"), p["name"])).alias("x"),
                        b["mean"].alias("mean"), b["sd"].alias("sd"), b.isNotNull().alias("has"))

    def grade(p):
        shift = (p["x"] - p["mean"]) / (p["sd"] * 3.0)
        raw = shift * p["dir"] * 100.0 if index == "SOI" else (F.lit(1.0) - F.abs(shift)) * 100.0
        there = p["x"].isNotNull() & p["has"]
        valid = _isfinite(p["mean"]) & _isfinite(p["sd"]) & (p["sd"] > 0)
        return F.struct(p["name"].alias("name"), p["w"].alias("w"),
                        F.when(there & valid, F.least(F.greatest(raw, F.lit(0.0)), F.lit(100.0))).alias("s"),
                        (~there).alias("missing"), (there & ~valid).alias("invalid"))

    keys = F.array_sort(F.map_keys("_w")) == F.array(*[F.lit(c) for c in sorted(names)])
    total = F.aggregate(F.map_values("_w"), F.lit(0.0), lambda t, w: t + w)
    good = keys & F.forall(F.map_values("_w"), lambda w: _isfinite(w) & (w >= 0))
    wrong = (F.when(~F.coalesce(good, F.lit(False)), f"{index} needs five nonnegative finite weights")
             .when(F.abs(total - 1.0) > 1e-9, f"{index} weights must sum to 1"))
    return (df.withColumn(f"_{index}_raw", F.transform(plan, read)).withColumn(f"_{index}", F.transform(f"_{index}_raw", grade))
            .withColumn(f"_{index}_bad", F.concat(
                F.array_compact(F.array(wrong)),
                F.transform(F.filter(f"_{index}", lambda p: p["invalid"]),
                            lambda p: F.concat(p["name"], F.lit(": calibration SD must be positive and finite")))))
            .drop("_w", f"_{index}_raw"))


def _result(index: str) -> Column:
    n, part = len(COMPONENTS[index]), f"_{index}"
    gone = F.transform(F.filter(part, lambda p: p["missing"]), lambda p: p["name"])
    total = F.aggregate(part, F.lit(0.0), lambda t, p: t + p["w"] * p["s"])       # NULL if any part is
    return F.struct(
        F.when(F.size("_issues") == 0, total).alias("score"),
        F.map_from_arrays(F.transform(part, lambda p: p["name"]), F.transform(part, lambda p: p["s"])).alias("components"),
        gone.alias("missing"), ((F.lit(n) - F.size(gone)) / F.lit(float(n))).alias("component_coverage"),
        F.col("_issues").alias("calibration_issues"))


NO_CALIBRATION = "no calibration of this subject and medication profile"


def score(pairs: DataFrame, strict: bool = True) -> DataFrame:
    """Both composites for rows with ``values`` and the calibration columns.

    Adds SOI_result, RDI_result and ``problems``. No imputation and no reweighting: a composite
    needs all five components and an adequate calibration. With ``strict`` an invalid setting is
    an error; otherwise it is listed and both results are NULL.
    """
    length, context = F.coalesce(F.col("duration_s"), F.lit(0.0)), F.coalesce(F.col("context"), F.lit("unspecified"))
    issues = F.array_compact(F.array(
        F.when(length < FULL_CALIBRATION_S, "calibration_shorter_than_article_24h"),
        F.when(~context.isin(*SCORING_CONTEXTS), "calibration_not_documented_awake_baseline")))
    bad = F.array_compact(F.array(F.when(F.col("SOI").isNull() & F.col("RDI").isNull(), NO_CALIBRATION),
                                  F.when(~(_isfinite(length) & (length >= 0)),
                                         "calibration duration must be finite and nonnegative")))
    out = pairs.withColumn("_issues", issues)
    for index in COMPONENTS:
        out = _with_parts(out, index)
    out = out.withColumn("problems", F.concat(bad, "_SOI_bad", "_RDI_bad"))
    fine = F.size("problems") == 0
    if strict:
        fine = fine | F.raise_error(F.array_join("problems", "; ")).cast("boolean")
    for index in COMPONENTS:
        out = out.withColumn(f"{index}_result", F.when(fine, _result(index)))
    return out.drop("_issues", "_SOI", "_RDI", "_SOI_bad", "_RDI_bad")


def match_calibration(features: DataFrame, calibrations: DataFrame) -> DataFrame:
    """Features with the calibration of the same subject under the same medication profile.

    Features without one keep their row; `score` names the reason.
    """
    return features.join(calibrations, ["subject_id", "medication_profile_id"], "left")


def check_identity(features: dict, calibration: dict) -> None:
    """Guards of scoring one feature document against one calibration document."""
    for key in ("subject_id", "medication_profile_id"):
        if not features.get(key) or not calibration.get(key):
            raise GuardError(f"{key} must be declared on both sides (use not_recorded if unknown)")
        if features[key] != calibration[key]:
            raise GuardError(f"{key} differs between features and calibration")


def score_documents(spark, features: dict, calibration: dict) -> dict:
    """Score one feature document; the same operator over a one-row DataFrame."""
    from ..model import CALIBRATION

    row = {k: calibration.get(k) for k in ("subject_id", "medication_profile_id", "session_id", "context")}
    row["duration_s"] = float(calibration.get("duration_s", 0))
    if not math.isfinite(row["duration_s"]) or row["duration_s"] < 0:
        raise GuardError("calibration duration must be finite and nonnegative")
    for index in COMPONENTS:
        s = calibration.get(index, {})
        row[index] = {"components": {k: {"mean": float(v["mean"]), "sd": float(v["sd"]), "n": v.get("n")}
                                     for k, v in s.get("components", {}).items()},
                      "weights": {k: float(v) for k, v in s["weights"].items()} if "weights" in s else None}
    values = {k: float(v) for k, v in features.get("values", {}).items() if v is not None}
    df = (spark.createDataFrame([row], CALIBRATION)
          .crossJoin(spark.createDataFrame([(values,)], "values map<string,double>")))   # one row each
    r = score(df, strict=False).first()
    if r["problems"]:
        raise GuardError("; ".join(r["problems"]))
    return {"use": "research_only", "classification": "indeterminate",
            "calibration_context": row["context"] or "unspecified",
            "indices": {i: {k: (dict(v) if isinstance(v, dict) else v) for k, v in r[f"{i}_result"].asDict().items()}
                        for i in COMPONENTS}}
