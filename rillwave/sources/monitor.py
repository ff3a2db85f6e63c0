"""Public monitor tracks: cached download, listing checks and excerpts on the waveform clock."""

from __future__ import annotations

import gzip
import hashlib
import math
import re
from pathlib import Path
from urllib.request import Request, urlopen

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..model import GuardError
from ..operators.asof import compact_clock, hold_numeric
from .recordings import in_file_order

# The public open-data API and its track names.
BASE_URL = "https://api.vitaldb.net/"
WAVES = ("BIS/EEG1_WAV", "BIS/EEG2_WAV")
NUMERICS = ("BIS/BIS", "BIS/SQI", "BIS/EMG", "BIS/SEF", "BIS/SR", "BIS/TOTPOW")
MAX_CASE = 6388


def cached(url: str, target: Path) -> Path:
    """Download once; a file already in the cache wins."""
    if not target.exists():
        with urlopen(Request(url, headers={"User-Agent": "rillwave research"}), timeout=60) as response:
            body = response.read()
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_bytes(body)
    return target


def content_hash(path: Path) -> str:
    raw = path.read_bytes()
    return hashlib.sha256(gzip.decompress(raw) if raw[:2] == b"\x1f\x8b" else raw).hexdigest()


def track_ids(listing: DataFrame, caseid: int) -> dict[str, str]:
    """Track name -> identifier of one case; every name at most once, identifiers well formed."""
    if not 1 <= caseid <= MAX_CASE:
        raise GuardError(f"caseid must lie in 1..{MAX_CASE}")
    rows = (listing.where((F.col("caseid") == caseid) & F.col("tname").isin(*WAVES, *NUMERICS))
            .groupBy("tname").agg(F.count("*").alias("n"), F.min("tid").alias("tid")).collect())    # at most 8 rows
    for r in rows:
        if r["n"] != 1:
            raise GuardError(f"ambiguous track listing for {r['tname']}")
        if not re.fullmatch(r"[0-9a-f]{40}", r["tid"]):
            raise GuardError("unexpected track identifier")
    return {r["tname"]: r["tid"] for r in rows}


def read_track(spark: SparkSession, path: str, case_id: str, tname: str) -> DataFrame:
    """Two-column track file (Time, value) -> TRACKS rows in file order."""
    raw = spark.read.option("header", True).option("inferSchema", False).csv(path)
    if len(raw.columns) != 2 or raw.columns[0] != "Time":
        raise GuardError("a track needs Time and exactly one value column")
    return in_file_order(raw).select(F.lit(case_id).alias("case_id"), F.lit(tname).alias("tname"), F.col("sample_ix").alias("row_ix"),
                                     F.col("Time").cast("double").alias("t"), F.col(f"`{raw.columns[1]}`").cast("double").alias("value"))


def excerpt(tracks: DataFrame, start_s: float, duration_s: float, fs: float = 128.0, max_age_s: float = 5.0) -> DataFrame:
    """Wide excerpt of one case: two waveforms on their grid plus held numerics, never backfilled."""
    if not (math.isfinite(start_s) and math.isfinite(duration_s)) or start_s < 0 or duration_s <= 0:
        raise GuardError("excerpt start must be nonnegative and duration positive")
    first, count = round(start_s * fs), round(duration_s * fs)
    if not math.isclose(first / fs, start_s, rel_tol=1e-5, abs_tol=1e-8) or not math.isclose(count / fs, duration_s, rel_tol=1e-5, abs_tol=1e-8):
        raise GuardError("excerpt bounds must align to the sample grid")
    names = {r["tname"] for r in tracks.select("tname").distinct().collect()}        # a handful of track names
    lacking = [w for w in WAVES if w not in names]
    if lacking:
        raise GuardError(f"raw waveform required: {lacking}")
    waves = compact_clock(tracks.where(F.col("tname").isin(*WAVES)))
    one, two = (waves.where(F.col("tname") == w).select("case_id", "row_ix", F.col("t").alias(f"t{i}"), F.col("value").alias(f"v{i}"))
                for i, w in enumerate(WAVES, 1))
    both = one.join(two, ["case_id", "row_ix"], "full")
    tally = both.agg(F.count("*").alias("n"), F.count("t1").alias("a"), F.count("t2").alias("b"),
                     F.count_if(F.abs(F.col("t1") - F.col("t2")) > 1e-8 + 1e-5 * F.abs(F.col("t2"))).alias("off"),
                     F.max(F.when(F.col("row_ix") == 1, F.col("t1"))).alias("t_1"),
                     F.max(F.when(F.col("row_ix") == 0, F.col("t1"))).alias("t_0")).first()
    if tally["a"] != tally["n"] or tally["b"] != tally["n"] or tally["off"]:
        raise GuardError("waveform tracks must have identical sampling clocks")
    if not math.isclose(1.0 / (tally["t_1"] - tally["t_0"]), fs, rel_tol=1e-5):
        raise GuardError("unexpected waveform sampling rate; inspect the track metadata")
    if first + count > tally["n"] or count < 2:
        raise GuardError("requested excerpt lies outside the recorded track")
    wave = (both.where((F.col("row_ix") >= first) & (F.col("row_ix") < first + count))
            .select("case_id", (F.col("row_ix") - first).alias("sample_ix"), F.col("t1").alias("time_s"),
                    F.col("v1").alias("BIS_EEG1"), F.col("v2").alias("BIS_EEG2")))
    for n in NUMERICS:
        if n in names:
            track = tracks.where(F.col("tname") == n)
            wave = hold_numeric(wave, track, ["case_id"], "time_s", max_age_s).withColumnRenamed("held", n.split("/")[-1])
    return wave


def fetch(spark: SparkSession, caseid: int, cache: str, start_s: float = 332.0, duration_s: float = 120.0) -> tuple[DataFrame, dict]:
    """Excerpt of one public case with provenance; every file is cached and hashed."""
    if not 1 <= caseid <= MAX_CASE:
        raise GuardError(f"caseid must lie in 1..{MAX_CASE}")
    folder = Path(cache)
    listing = spark.read.option("header", True).csv(str(cached(BASE_URL + "trks", folder / "trks.csv.gz")))
    tracks, sources = None, []
    for name, tid in track_ids(listing, caseid).items():
        path = cached(BASE_URL + tid, folder / f"{tid}.csv.gz")
        part = read_track(spark, str(path), str(caseid), name)
        tracks = part if tracks is None else tracks.unionByName(part)
        sources.append({"tname": name, "tid": tid, "url": BASE_URL + tid, "decompressed_csv_sha256": content_hash(path)})
    if tracks is None:
        raise GuardError("the listing names no track of this case")
    meta = {"sampling_rate_hz": 128.0, "eeg_unit": "uV", "eeg_columns": ["BIS_EEG1", "BIS_EEG2"], "channel_locations": {},
            "reference": "not_reported", "reference_verified": False, "sensor": {"family": "BIS", "model": "not_reported"},
            "recording_context": "perioperative_anesthesia", "subject_id": f"vitaldb-case-{caseid}", "psychiatric_labels": None,
            "caseid": caseid, "excerpt": {"start_s": start_s, "duration_s": duration_s, "samples": round(duration_s * 128)},
            "numeric_alignment": {"method": "causal_last_observation", "max_age_s": 5, "backfill": False},
            "source_tracks": sources}
    return excerpt(tracks, start_s, duration_s), meta
