"""Manifests, checklist files, labelled tables and calibration documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.scalars import bvc_flag, bvc_score
from ..model import (BVC_ITEMS, CALIBRATION, FEATURE_VALUES, GROUP_NAMES, MANIFEST_COLUMNS, RECORDING_SUFFIXES, SENSOR_SHEETS,
                     GuardError)
from ..operators.quality import finite


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """All-string manifest, NULL as empty text; absent optional columns become empty."""
    m = spark.read.option("header", True).csv(path)
    for c in MANIFEST_COLUMNS[3:]:
        if c not in m.columns:
            m = m.withColumn(c, F.lit(""))
    return m.na.fill("")


def build_manifest(spark: SparkSession, root: str) -> DataFrame:
    """Scan ROOT/{ASD,PSY,HC}/** for recordings; only paths are read, never contents."""
    base = root.rstrip("/")
    suffix = "|".join(s[1:] for s in RECORDING_SUFFIXES)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(base).select("path")
    rel = F.substring_index("path", base.split("://")[-1] + "/", -1)
    rows = (files.select(rel.alias("file")).where(F.lower("file").rlike(rf"\.({suffix})$"))
            .withColumn("group", F.split("file", "/")[0]).where(F.col("group").isin(*GROUP_NAMES)))
    stem = F.regexp_replace("file", r"\.[^./]+$", "")
    tail = F.array_join(F.slice(F.split(stem, "/"), F.lit(2), F.size(F.split(stem, "/"))), "_")
    return rows.select("file", F.concat_ws("_", "group", tail).alias("subject_id"), "group").orderBy("group", "file")


def read_checklist(spark: SparkSession, path: str, session_id: str) -> DataFrame:
    """Checklist observations: time_min and six flags -> (session_id, t, score, obs)."""
    raw = spark.read.option("header", True).csv(path)
    flags = {c: bvc_flag(F.col(c)) for c in BVC_ITEMS if c in raw.columns}
    return raw.select(F.lit(session_id).alias("session_id"), (F.col("time_min").cast("double") * 60.0).alias("t"),
                      bvc_score(flags).alias("score"), F.monotonically_increasing_id().alias("obs"))


def read_labelled(spark: SparkSession, path: str) -> DataFrame:
    """Labelled feature table; identifiers stay text, numeric columns are doubles."""
    if path.endswith(".parquet"):
        table = spark.read.parquet(path)
    else:
        # everything is read as text: an inferred type would turn the id 007 into 7
        table = spark.read.option("header", True).csv(path)
        ids = {"subject_id", "session_id", "epoch_id"}
        plain = [c for c in table.columns if c not in ids]
        bad = table.agg(*[F.max(F.col(f"`{c}`").isNotNull() & F.expr(f"try_cast(trim(`{c}`) as double)").isNull()).alias(c) for c in plain]).first()
        table = table.select(*[F.col(f"`{c}`") if c in ids or bad[c] else F.trim(F.col(f"`{c}`")).cast("double").alias(c) for c in table.columns])
    for c in ("subject_id", "session_id", "epoch_id"):
        if c in table.columns:
            table = table.withColumn(c, F.col(c).cast("string"))
    for c, t in table.dtypes:
        if t == "double":
            table = table.withColumn(c, finite(F.col(f"`{c}`")))
    return table


def read_calibrations(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CALIBRATION).option("multiLine", True).json(path)


def read_feature_values(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(FEATURE_VALUES).option("multiLine", True).json(path)


def sensor_sheet(spark: SparkSession, name: str) -> DataFrame:
    """Documented sensor layouts as small dimension tables; never applied to a recording by themselves."""
    if name not in SENSOR_SHEETS:
        raise GuardError(f"unknown sensor sheet {name!r}; choose from {sorted(SENSOR_SHEETS)}")
    sheet = SENSOR_SHEETS[name]
    if "pair_contacts" in sheet:
        rows = [(name, i, str(a), str(b)) for i, (a, b) in enumerate(sheet["pair_contacts"])]
        return spark.createDataFrame(rows, "sheet string, derivation int, signal_contact string, reference_contact string")
    return spark.createDataFrame([(name, i, s) for i, s in enumerate(sheet["scalp_sites"])], "sheet string, position int, site string")
