"""Recordings on disk: CSV with a JSON sidecar, and EDF/BDF decoded in parallel record ranges."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from pathlib import PurePosixPath

import numpy as np
import pandas as pd
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F, types as T

from ..model import RESERVED_NUMERICS, SIDECAR, UNIT_TO_UV, GuardError
from ..operators.quality import check_sidecar, validate_wide


@dataclass
class Recording:
    """A wide recording: one row per sample (recording_id, sample_ix, time_s, channels, numerics)."""

    frame: DataFrame
    fs: float
    channels: list[str]
    metadata: dict = field(default_factory=dict)

    def blocks(self, size: int = 1024) -> DataFrame:
        """Channel blocks for the epoch operators; one shuffle for all channels."""
        cols = [F.col(f"`{c}`").cast("double").alias(f"c{i}") for i, c in enumerate(self.channels)]
        packed = (self.frame.groupBy("recording_id", F.floor(F.col("sample_ix") / size).cast("long").alias("_b"))
                  .agg(F.sort_array(F.collect_list(F.struct("sample_ix", *cols))).alias("_s")))
        parts = [F.struct(F.lit(c).alias("channel"), F.col(f"_s.c{i}").alias("uv")) for i, c in enumerate(self.channels)]
        return (packed.select("recording_id", F.col("_s")[0]["sample_ix"].alias("start_ix"), F.explode(F.array(*parts)).alias("p"))
                .select("recording_id", "p.channel", "start_ix", "p.uv"))

    def numerics(self) -> DataFrame | None:
        """Monitor numerics as (recording_id, sample_ix, name, value), or None if there are none."""
        names = [c for c in RESERVED_NUMERICS if c in self.frame.columns]
        if not names:
            return None
        pairs = F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("value")) for c in names])
        return self.frame.select("recording_id", "sample_ix", F.explode(pairs).alias("p")).select("recording_id", "sample_ix", "p.*")

    def sites(self) -> DataFrame | None:
        return verified_sites(self.frame.sparkSession, self.metadata, self.channels)

    def flags(self) -> dict:
        return {"sqi": "SQI" in self.frame.columns, "emg": "EMG" in self.frame.columns,
                "require_sqi": (self.metadata.get("sensor") or {}).get("family") == "BIS"}


def verified_sites(spark: SparkSession, metadata: dict, channels: list[str]) -> DataFrame | None:
    """Verified channel locations only; NULL locations never name an electrode."""
    where = metadata.get("channel_locations") or {}
    by_site = {site: c for c, site in where.items() if c in channels}      # a repeated site: the last entry wins
    rows = [(metadata["recording_id"], site, c) for site, c in by_site.items()]
    if metadata.get("reference_verified") is not True or not rows:
        return None
    return spark.createDataFrame(rows, "recording_id string, site string, channel string")


def read_sidecars(spark: SparkSession, path: str) -> DataFrame:
    """Sidecar documents as a table."""
    return spark.read.schema(SIDECAR).option("multiLine", True).json(path)


def read_document(path: str) -> dict:
    """One small JSON document, read on the driver."""
    fs, p = filesystem(path)
    with fs.open_input_stream(p) as f:
        return json.loads(f.read().decode("utf-8"))


def filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    """Local paths and URIs alike (any store pyarrow can reach)."""
    if "://" in path:
        return pafs.FileSystem.from_uri(path)
    bare = path.removeprefix("file:")
    return pafs.LocalFileSystem(), bare


def in_file_order(df: DataFrame) -> DataFrame:
    """Append ``sample_ix``, the row position in the (single) source file.

    Rows keep their order inside a file split; splits are ordered by their byte offset. Only one
    row per split passes the window.
    """
    tagged = df.select("*", F.col("_metadata.file_block_start").alias("_at"), F.monotonically_increasing_id().alias("_row"))
    splits = tagged.groupBy("_at").agg(F.min("_row").alias("_first"), F.count("*").alias("_n"))
    before = F.sum("_n").over(W.orderBy("_at").rowsBetween(W.unboundedPreceding, -1))
    splits = splits.select("_at", "_first", F.coalesce(before, F.lit(0)).alias("_before"))
    return (tagged.join(splits, "_at").withColumn("sample_ix", F.col("_before") + F.col("_row") - F.col("_first"))
            .drop("_at", "_row", "_first", "_before"))


def read_csv(spark: SparkSession, path: str, metadata_path: str, recording_id: str | None = None) -> Recording:
    """CSV with mandatory unit and channels from its sidecar; converted to microvolts once."""
    meta = read_document(metadata_path)
    unit, channels = meta.get("eeg_unit"), list(meta.get("eeg_columns") or [])
    if unit not in UNIT_TO_UV:
        raise GuardError("eeg_unit must be uV, mV or V")
    header = spark.read.option("header", True).csv(path).columns
    fs = float(meta["sampling_rate_hz"])
    check_sidecar(fs, channels, header)
    numeric = {*channels, "time_s", *RESERVED_NUMERICS}
    schema = T.StructType([T.StructField(c, T.DoubleType() if c in numeric else T.StringType()) for c in header])
    raw = spark.read.schema(schema).option("header", True).option("mode", "FAILFAST").option("nanValue", "NaN").csv(path)
    rid = recording_id or meta.get("subject_id") or PurePosixPath(path).stem
    missing = lambda c: F.nanvl(F.col(f"`{c}`"), F.lit(None).cast("double"))
    cols: list[Column] = [F.lit(rid).alias("recording_id"), F.col("sample_ix")]
    for c in header:
        cols.append((missing(c) * UNIT_TO_UV[unit]).alias(c) if c in channels else
                    missing(c).alias(c) if c in RESERVED_NUMERICS else F.col(f"`{c}`"))
    frame = in_file_order(raw).select(*cols)
    validate_wide(frame, fs, channels)
    meta.update(original_eeg_unit=unit, eeg_unit="uV", recording_id=rid)
    return Recording(frame, fs, channels, meta)


# --- EDF / BDF ------------------------------------------------------------------------------------

# name -> bytes of the per-signal header fields of the public EDF specification
_FIELDS = (("label", 16), ("transducer", 80), ("unit", 8), ("phys_min", 8), ("phys_max", 8), ("dig_min", 8),
           ("dig_max", 8), ("prefilter", 80), ("samples", 8), ("reserved", 32))
_TO_UV = {"uv": 1.0, "µv": 1.0, "mv": 1e3, "v": 1e6}
_NOT_EEG = {"edf annotations", "bdf annotations", "status", "trigger"}


def parse_edf_header(raw: bytes) -> dict:
    """Header bytes -> file layout; raises on anything that is not EDF or BDF."""
    if len(raw) < 256:
        raise GuardError("truncated EDF header")
    wide = raw[:1] == b"\xff"
    if not wide and raw[:8].strip() != b"0":
        raise GuardError("not an EDF or BDF file")
    text = raw.decode("latin-1")
    head, records, seconds, ns = int(text[184:192]), int(text[236:244]), float(text[244:252]), int(text[252:256])
    out, at = {"header_bytes": head, "records": records, "record_s": seconds, "width": 3 if wide else 2, "signals": []}, 256
    cols = {}
    for name, size in _FIELDS:
        cols[name] = [text[at + i * size:at + (i + 1) * size].strip() for i in range(ns)]
        at += size * ns
    offset = 0
    for i in range(ns):
        n = int(cols["samples"][i])
        span = float(cols["dig_max"][i]) - float(cols["dig_min"][i])
        gain = (float(cols["phys_max"][i]) - float(cols["phys_min"][i])) / span if span else 0.0
        label = cols["label"][i]
        out["signals"].append({"label": label, "samples": n, "offset": offset, "gain": gain,
                               "shift": float(cols["phys_min"][i]) - gain * float(cols["dig_min"][i]),
                               "unit": cols["unit"][i].lower(), "eeg": label.lower() not in _NOT_EEG})
        offset += n
    out["record_samples"] = offset
    return out


def _read_range(path: str, start: int, length: int) -> bytes:
    fs, p = filesystem(path)
    with fs.open_input_file(p) as f:
        f.seek(start)
        return f.read(length)


def edf_layout(path: str) -> dict:
    ns = int(_read_range(path, 252, 4) or b"0")
    layout = parse_edf_header(_read_range(path, 0, 256 * (ns + 1)))
    if layout["records"] < 0:          # still being written: derive from the size
        fs, p = filesystem(path)
        size = fs.get_file_info(p).size - layout["header_bytes"]
        layout["records"] = size // (layout["record_samples"] * layout["width"])
    return layout


def choose_signals(layout: dict, wanted: list[str] | None) -> tuple[list[dict], float]:
    """Signals by label (default: all EEG ones) and their common sampling rate."""
    by_label = {s["label"]: s for s in layout["signals"]}
    names = wanted or [s["label"] for s in layout["signals"] if s["eeg"]]
    gone = [c for c in names if c not in by_label]
    if gone or not names:
        raise GuardError(f"channels not found in file: {gone or 'none typed eeg'}")
    picked = [by_label[c] for c in names]
    if not all(s["eeg"] for s in picked):
        raise GuardError("selected channels must be EEG, not annotations or triggers")
    if len({s["samples"] for s in picked}) != 1:
        raise GuardError("selected channels differ in sampling rate")
    if not all(s["unit"] in _TO_UV for s in picked):
        raise GuardError("selected channels must declare a voltage unit")
    return picked, picked[0]["samples"] / layout["record_s"]


def decode_records(raw: bytes, layout: dict, picked: list[dict]) -> np.ndarray:
    """Record bytes -> microvolts (signal, sample)."""
    w = layout["width"]
    if w == 2:
        flat = np.frombuffer(raw, dtype="<i2").astype(float)
    else:
        b = np.frombuffer(raw, dtype=np.uint8).reshape(-1, 3).astype(np.int32)
        flat = ((b[:, 0] | (b[:, 1] << 8) | (b[:, 2] << 16)) << 8 >> 8).astype(float)
    grid = flat.reshape(-1, layout["record_samples"])
    return np.stack([(grid[:, s["offset"]:s["offset"] + s["samples"]].ravel() * s["gain"] + s["shift"]) * _TO_UV[s["unit"]]
                     for s in picked])


_DECODERS: dict[str, Callable] = {}


def register_decoder(suffix: str, fn: Callable) -> None:
    """Add a whole-file decoder ``fn(path, channels) -> (names, fs, array in microvolts)``."""
    _DECODERS[suffix.lower()] = fn


_PLAN = ("recording_id string, path string, channels string, first long, count long, fs double, samples long, layout string, error string")


def chosen_labels(channels: str) -> list[str] | None:
    """Labels end with a line feed each (they may hold blanks), or are separated by blanks; none: all channels."""
    return [c for c in (channels.split("\n") if "\n" in channels else channels.split()) if c] or None


def decode_plan(files: DataFrame, chunk_bytes: int = 8 << 20) -> DataFrame:
    """files (recording_id, path, channels: space separated or '') -> record ranges of about ``chunk_bytes``.

    Only headers are read here. A file that cannot be read yields one row with its ``error``.
    """
    decoders = dict(_DECODERS)

    def plan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = []
            for rid, path, channels in zip(pdf["recording_id"], pdf["path"], pdf["channels"]):
                base = {"recording_id": rid, "path": path, "channels": channels, "error": None}
                try:
                    suffix = PurePosixPath(path).suffix.lower()
                    if suffix in decoders:
                        rows.append({**base, "first": 0, "count": -1, "fs": np.nan, "samples": -1, "layout": suffix})
                        continue
                    if suffix not in (".edf", ".bdf"):
                        raise GuardError(f"unsupported format {suffix}; register a decoder")
                    layout = edf_layout(path)
                    picked, fs = choose_signals(layout, chosen_labels(channels))
                    step = max(1, chunk_bytes // (layout["record_samples"] * layout["width"]))
                    for first in range(0, layout["records"], step):
                        rows.append({**base, "first": first, "count": min(step, layout["records"] - first), "fs": fs,
                                     "samples": layout["records"] * picked[0]["samples"], "layout": json.dumps(layout)})
                    if layout["records"] == 0:
                        raise GuardError("recording has no data records")
                except Exception as exc:       # one bad file must not abort the cohort
                    rows.append({**base, "first": 0, "count": 0, "fs": np.nan, "samples": 0, "layout": None,
                                 "error": f"{type(exc).__name__}: {exc}"})
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in _PLAN.split(", ")])

    parts = max(1, files.sparkSession.sparkContext.defaultParallelism)
    return files.select("recording_id", "path", F.coalesce("channels", F.lit("")).alias("channels")).repartition(parts).mapInPandas(plan, _PLAN)


_DECODED = "recording_id string, channel string, start_ix long, uv array<double>, fs double, position int, error string"


def decode(plan: DataFrame, note: Callable[[str, str], None] | None = None) -> DataFrame:
    """Record ranges -> blocks (recording_id, channel, start_ix, uv, fs, position, error); ranges spread over tasks.

    ``note(recording, error)`` is called in the task for every range that cannot be decoded.
    """
    decoders = dict(_DECODERS)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for row in pdf.itertuples(index=False):
                bad = {"recording_id": [row.recording_id], "channel": [None], "start_ix": [None], "uv": [None], "fs": [None],
                       "position": [None]}
                if row.error is not None:
                    yield pd.DataFrame({**bad, "error": [row.error]})
                    continue
                try:
                    wanted = chosen_labels(row.channels)
                    if row.count < 0:
                        names, fs, x = decoders[row.layout](row.path, wanted)
                        start = 0
                    else:
                        layout = json.loads(row.layout)
                        picked, fs = choose_signals(layout, wanted)
                        size = layout["record_samples"] * layout["width"]
                        raw = _read_range(row.path, layout["header_bytes"] + row.first * size, row.count * size)
                        if len(raw) != row.count * size:
                            raise GuardError("file ends before its last data record")
                        x, names, start = decode_records(raw, layout, picked), [s["label"] for s in picked], row.first * picked[0]["samples"]
                    yield pd.DataFrame({"recording_id": row.recording_id, "channel": names, "start_ix": start,
                                        "uv": list(x), "fs": fs, "position": range(len(names)), "error": None})
                except Exception as exc:
                    error = f"{type(exc).__name__}: {exc}"
                    if note:
                        note(row.recording_id, error)
                    yield pd.DataFrame({**bad, "error": [error]})

    parts = max(1, plan.sparkSession.sparkContext.defaultParallelism) * 4
    return plan.repartition(parts, "recording_id", "first").mapInPandas(run, _DECODED)


def decode_one(spark: SparkSession, recording_id: str, path: str, labels: list[str]) -> DataFrame:
    """Blocks of the named channels of one file; any range that cannot be decoded ends the job with its error."""
    files = spark.createDataFrame([(recording_id, path, "".join(f"{c}\n" for c in labels))],
                                  "recording_id string, path string, channels string")
    broken = F.raise_error(F.concat_ws(": ", "recording_id", "error")).cast("boolean")
    return decode(decode_plan(files)).where(F.when(F.col("error").isNotNull(), broken).otherwise(True)).drop("error")


def read_edf(spark: SparkSession, path: str, metadata_path: str) -> tuple[DataFrame, dict]:
    """One EDF/BDF with its sidecar -> (blocks, metadata); the file's rate overrides the sidecar's."""
    meta = read_document(metadata_path)
    if not meta.get("eeg_columns"):
        raise GuardError("sidecar eeg_columns must select channels of the file")
    layout = edf_layout(path)
    _, fs = choose_signals(layout, list(meta["eeg_columns"]))
    rid = meta.get("subject_id") or PurePosixPath(path).stem
    blocks = decode_one(spark, rid, path, list(meta["eeg_columns"]))
    meta.update(sampling_rate_hz=fs, eeg_unit="uV", original_eeg_unit="physical units of the file", recording_id=rid)
    return blocks.select("recording_id", "channel", "start_ix", "uv"), meta
