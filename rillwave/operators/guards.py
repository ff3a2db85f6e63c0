"""Input rules of cohorts and labelled tables as violation counts.

Each check returns (rule, n): how many rows or groups violate the rule. ``enforce`` turns a
report into an error. All counts are distributed aggregates; only the short report is collected.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..model import GROUP_NAMES, LABEL_SOURCES, STATE_LABELS, GuardError
from .quality import finite


def enforce(report: DataFrame) -> None:
    bad = report.where("n > 0").orderBy("rule").collect()      # one row per rule
    if bad:
        raise GuardError("; ".join(f"{r['rule']} ({r['n']})" for r in bad))


def _report(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _counts(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Row rules, all in one pass."""
    row = df.agg(*[F.count_if(F.coalesce(c, F.lit(True))).alias(r) for r, c in rules.items()])
    pairs = F.array(*[F.struct(F.lit(r).alias("rule"), F.col(r).alias("n")) for r in rules])
    return row.select(F.explode(pairs).alias("p")).select("p.*")


def _groups(df: DataFrame, rule: str, keys: list[str], bad: Column, *aggs: Column) -> DataFrame:
    """Number of key groups that satisfy ``bad``."""
    return (df.groupBy(*keys).agg(*(aggs or (F.count("*").alias("c"),))).where(bad)
            .agg(F.count("*").alias("n")).select(F.lit(rule).alias("rule"), "n"))


def _few(df: DataFrame, rule: str, column: str, least: int) -> DataFrame:
    return df.agg(F.when(F.count_distinct(column) < least, 1).otherwise(0).cast("long").alias("n")).select(
        F.lit(rule).alias("rule"), "n")


def manifest_report(manifest: DataFrame) -> DataFrame:
    missing = [c for c in ("file", "subject_id", "group") if c not in manifest.columns]
    if missing:
        raise GuardError(f"manifest needs columns: {missing}")
    rows = _counts(manifest, {"unknown_group": ~F.col("group").isin(*GROUP_NAMES),
                              "path_like_subject_id": F.col("subject_id").rlike(r"[\\/]|^\.")})
    return _report([rows, _groups(manifest, "duplicate_subject_id", ["subject_id"], F.col("c") > 1)])


def _surgical(c: str) -> Column:
    return F.lower(F.col(c).cast("string")).rlike("anesthesia|perioperative")


def _features_ok(df: DataFrame, features: list[str], reserved: set[str]) -> None:
    gone = [f for f in features if f not in df.columns]
    if not features or gone or set(features) & reserved:
        raise GuardError("select explicit numeric features; identifiers and labels cannot be features"
                         + (f" (absent: {gone})" if gone else ""))


def _missing_features(features: list[str]) -> Column:
    return reduce(Column.__or__, [finite(F.col(f).cast("double")).isNull() for f in features])


STATE_COLUMNS = ("subject_id", "session_id", "epoch_id", "research_label", "label_source", "recording_context")


def state_table_report(table: DataFrame, features: list[str]) -> DataFrame:
    """Rules of the labelled-state table, including that every held-out fold keeps all classes."""
    gone = [c for c in STATE_COLUMNS if c not in table.columns]
    if gone:
        raise GuardError(f"label table needs columns: {gone}")
    _features_ok(table, features, set(STATE_COLUMNS))
    rows = _counts(table, {
        "missing_identifier": reduce(Column.__or__, [F.col(c).isNull() for c in STATE_COLUMNS]),
        "unknown_label": ~F.col("research_label").isin(*STATE_LABELS),
        "unknown_label_source": ~F.col("label_source").isin(*LABEL_SOURCES),
        "surgical_context": _surgical("recording_context"),
        "missing_feature": _missing_features(features)})
    # a class seen in one subject only is absent from the fold that holds this subject out
    return _report([rows, _few(table, "fewer_than_two_labels", "research_label", 2),
                    _few(table, "fewer_than_three_subjects", "subject_id", 3),
                    _groups(table, "duplicate_epoch", ["subject_id", "session_id", "epoch_id"], F.col("c") > 1),
                    _groups(table, "label_in_one_subject_only", ["research_label"], F.col("s") < 2,
                            F.count_distinct("subject_id").alias("s"))])


GROUP_ID_COLUMNS = ("subject_id", "group", "site", "accepted")


def accepted_rows(table: DataFrame) -> DataFrame:
    if "accepted" not in table.columns:
        return table
    return table.where(F.lower(F.col("accepted").cast("string")) == "true")


def group_table_report(table: DataFrame, features: list[str]) -> DataFrame:
    """Rules of the diagnostic-group table (accepted rows only)."""
    gone = [c for c in ("subject_id", "group") if c not in table.columns]
    if gone:
        raise GuardError(f"group table needs columns: {gone}")
    _features_ok(table, features, set(GROUP_ID_COLUMNS))
    table = accepted_rows(table)
    rules = {"missing_identifier": F.col("subject_id").isNull() | F.col("group").isNull(),
             "unknown_group": ~F.col("group").isin(*GROUP_NAMES.values()),
             "missing_feature": _missing_features(features)}
    if "recording_context" in table.columns:
        rules["surgical_context"] = _surgical("recording_context")
    parts = [_counts(table, rules), _few(table, "fewer_than_two_groups", "group", 2),
             _groups(table, "subject_in_several_groups", ["subject_id"], F.col("g") > 1,
                     F.count_distinct("group").alias("g")),
             _groups(table, "group_with_one_subject", ["group"], F.col("s") < 2,
                     F.count_distinct("subject_id").alias("s"))]
    if "site" in table.columns:
        sites = table.groupBy("site").agg(F.count_distinct("group").alias("g"))
        parts.append(sites.agg(F.when(F.min(F.col("g") == 1) & (F.count("*") > 0), F.count("*")).otherwise(0)
                               .alias("n")).select(F.lit("every_site_single_group").alias("rule"), "n"))
    return _report(parts)
