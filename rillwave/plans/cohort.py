"""Cohort conversion: manifest in, pooled group-labelled features out; resumable and failure-isolating."""

from __future__ import annotations

import hashlib
import json
import threading
import uuid
from contextlib import contextmanager
from functools import reduce

from pyspark.accumulators import AccumulatorParam
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.scalars import literal_map
from ..model import GROUP_NAMES, GuardError
from ..operators import guards, montage
from ..session import cut_lineage
from ..sources.cohort import read_manifest
from ..sources.recordings import decode, decode_plan
from . import commit
from .analyze import analyze

#: Tables of a cohort folder; blocks stay only where they are asked for.
TABLES = ("blocks", "features", "failures")


class _Failed(AccumulatorParam):
    """Failed recordings with their errors; never more than the limit needs."""

    def __init__(self, most: int):
        self.most = most

    def zero(self, value: dict) -> dict:
        return {}

    def addInPlace(self, a: dict, b: dict) -> dict:
        for k, v in b.items():
            if len(a) > self.most:
                break
            a.setdefault(k, v)
        return a


@contextmanager
def failure_budget(spark: SparkSession, most: int | None, poll_s: float = 0.1):
    """Yields ``note(recording, error)`` for tasks; as soon as more than ``most`` recordings failed, the jobs inside stop.

    Counts arrive as tasks end, and a recording counts once however often its task is tried.
    """
    if most is None:
        yield None
        return
    sc = spark.sparkContext
    seen, group, over, ended = sc.accumulator({}, _Failed(most)), f"failure-budget-{uuid.uuid4().hex}", threading.Event(), threading.Event()

    def watch() -> None:
        while not ended.wait(poll_s):
            if len(seen.value) > most:
                over.set()
                sc.cancelJobGroup(group)

    sc.setJobGroup(group, "stops at too many failures", interruptOnCancel=True)
    watcher = threading.Thread(target=watch, daemon=True)
    watcher.start()
    try:
        yield lambda recording, error: seen.add({recording: error})
    except Exception:
        if not over.is_set():
            raise
        raise _aborted(len(seen.value), next(iter(seen.value.values()))) from None
    finally:
        ended.set()
        watcher.join()
        sc._jsc.clearJobGroup()
    if len(seen.value) > most:
        raise _aborted(len(seen.value), next(iter(seen.value.values())))


def _aborted(n: int, error: str) -> GuardError:
    return GuardError(f"aborted after {n} failures; one of them: {error}")


def run_key(epoch_s: float) -> str:
    """Settings that change results; finished work is only reused under the same key."""
    return hashlib.sha256(json.dumps({"epoch_s": epoch_s}).encode()).hexdigest()[:12]


def finished(spark: SparkSession, out_dir: str, key: str) -> DataFrame:
    """Subjects whose features are committed under this key."""
    rows = commit.read(spark, out_dir, "features")
    if rows is None:
        return spark.createDataFrame([], "subject_id string")
    return rows.where(F.col("run_key") == key).select("subject_id").distinct()


def _rederived(blocks: DataFrame, jobs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Blocks with montages applied where the manifest asks for one, and the subjects that cannot be."""
    combos = jobs.where("bis_montage <> ''").select("bis_montage", "bis_reference").distinct().collect()   # sides x references
    plain = blocks.join(jobs.where("bis_montage = ''").select("recording_id"), "recording_id", "left_semi")
    parts, problems = [plain.select("recording_id", "channel", "start_ix", "uv")], []
    for side, ref in combos:
        mine = blocks.join(jobs.where((F.col("bis_montage") == side) & (F.col("bis_reference") == ref)).select("recording_id"),
                           "recording_id", "left_semi")
        parts.append(montage.rederive(mine, side, ref or None, strict=False).select("recording_id", "channel", "start_ix", "uv"))
        problems.append(montage.montage_plan(mine, side, ref or None).where("problem is not null")
                        .select("recording_id", F.col("problem").alias("error")))
    empty = blocks.sparkSession.createDataFrame([], "recording_id string, error string")
    return reduce(DataFrame.unionByName, parts), reduce(DataFrame.unionByName, problems, empty)


def convert_cohort(spark: SparkSession, manifest: str | DataFrame, out_dir: str, root: str = "", epoch_s: float = 4.0,
                   keep_raw: bool = False, max_failures: int | None = None) -> dict:
    """Convert and analyse every manifest row that is not finished yet.

    All recordings go through the same DataFrame stages at once; a file that cannot be read or
    analysed becomes a row of ``failures``. A run is committed by one log entry (`commit`); what a broken run
    left is removed by the next. With ``max_failures`` reading stops, without a commit, as soon as more files than
    that cannot be read; failures that only the analysis meets are counted at the end, after the commit.
    """
    table = read_manifest(spark, manifest) if isinstance(manifest, str) else manifest
    guards.enforce(guards.manifest_report(table))
    key, attempt = run_key(epoch_s), commit.begin(out_dir, TABLES)
    at = lambda name: f"{out_dir}/{name}/attempt={attempt}"
    base = root or (manifest.rsplit("/", 1)[0] if isinstance(manifest, str) else "")
    jobs = (table.join(finished(spark, out_dir, key), "subject_id", "left_anti")
            .withColumn("recording_id", F.col("subject_id"))
            .withColumn("path", F.when(F.col("file").rlike("^(/|[a-z0-9]+:)"), F.col("file")).otherwise(F.concat(F.lit(base + "/"), "file"))))
    jobs = cut_lineage(jobs)
    plan = cut_lineage(decode_plan(jobs))
    if max_failures is not None:
        bad = plan.where("error is not null").select("recording_id", "error").limit(max_failures + 1).collect()
        if len(bad) > max_failures:                       # headers are enough to stop: no signal is read
            raise _aborted(len(bad), bad[0]["error"])
    rates = [r["fs"] for r in plan.where("error is null and samples >= 0").select("fs").distinct().collect()]   # device types
    # blocks are kept as a table: analysis reads them several times and executors may be lost
    with failure_budget(spark, max_failures) as note:
        raw = decode(plan, note)
        raw.write.mode("overwrite").parquet(at("blocks"))
    stored = spark.read.schema(raw.schema).parquet(at("blocks"))
    failures = stored.where("error is not null").groupBy("recording_id").agg(F.min("error").alias("error"))
    usable = stored.where("error is null").join(failures.select("recording_id"), "recording_id", "left_anti")
    rates += [r["fs"] for r in usable.where("fs is not null").select("fs").distinct().collect() if r["fs"] not in rates]
    blocks, unmountable = _rederived(usable.select("recording_id", "channel", "start_ix", "uv", "position"), jobs)
    failures = failures.unionByName(unmountable)
    results = []
    for fs in sorted(rates):
        same = usable.where(F.col("fs") == fs).select("recording_id").distinct()
        mine = blocks.join(same, "recording_id", "left_semi")
        try:
            a = analyze(mine, fs, epoch_s)
        except GuardError as exc:
            failures = failures.unionByName(same.withColumn("error", F.lit(f"GuardError: {exc}")))
            continue
        results.append(a.epochs.join(a.features, ["recording_id", "epoch_ix"], "left"))
    labels = jobs.select("recording_id", "subject_id", F.element_at(literal_map(GROUP_NAMES), F.col("group")).alias("group"),
                         "site", F.when(F.col("context") == "", "awake_observational_research").otherwise(F.col("context")).alias("recording_context"),
                         F.when(F.col("license") == "", "unspecified").otherwise(F.col("license")).alias("license"),
                         F.when(F.col("source") == "", F.col("path")).otherwise(F.col("source")).alias("source"))
    done = finished(spark, out_dir, key)
    if results:
        pooled = reduce(DataFrame.unionByName, results)
        (labels.join(pooled, "recording_id").drop("recording_id").withColumn("run_key", F.lit(key))
         .write.mode("overwrite").parquet(at("features")))
        done = done.union(spark.read.parquet(at("features")).select("subject_id").distinct())
    silent = (jobs.select("recording_id").join(failures, "recording_id", "left_anti")
              .join(done.withColumnRenamed("subject_id", "recording_id"), "recording_id", "left_anti")
              .withColumn("error", F.lit("GuardError: recording is shorter than one complete epoch")))
    failed = failures.unionByName(silent).withColumnRenamed("recording_id", "subject_id")
    failed.write.mode("overwrite").parquet(at("failures"))
    commit.commit(out_dir, attempt, ["features"] * bool(results) + ["failures"] + ["blocks"] * keep_raw)
    commit.recover(out_dir, TABLES)                       # blocks nobody asked for, failures of earlier runs
    failed = spark.read.parquet(at("failures"))
    n_failed = failed.count()
    if max_failures is not None and n_failed > max_failures:
        raise _aborted(n_failed, failed.first()["error"])
    total = table.count()
    converted = table.join(done, "subject_id", "left_semi")
    groups = {GROUP_NAMES[r["group"]]: r["n"] for r in converted.groupBy("group").agg(F.count("*").alias("n")).collect()}
    if not groups:
        raise GuardError("no recording converted successfully; see failures")
    return {"subjects_per_group": groups, "converted": sum(groups.values()), "failed": n_failed, "total": total}


def pooled_wide(features: DataFrame, channels: list[str], values: list[str]) -> DataFrame:
    """Pooled table with one row per epoch and ``<channel>__<feature>`` columns (NULL where a subject lacks the channel)."""
    keys = ["subject_id", "group", "site", "epoch_ix", "accepted", "recording_context"]
    packed = features.groupBy(*keys).pivot("channel", channels).agg(F.first(F.struct(*values)))
    return packed.select(*keys, *[F.col(f"`{c}`.{v}").alias(f"{c}__{v}") for c in channels for v in values])
