"""Report data products and a self-contained HTML page."""

from __future__ import annotations

import json
from html import escape

from pyspark.sql import DataFrame, functions as F

from ..operators import epochs as E, spectral
from ..sources.recordings import filesystem
from .analyze import Analysis


def write_json(data: dict, path: str) -> None:
    """Strict JSON (NaN is an error); parent folders are created."""
    body = json.dumps(data, indent=2, allow_nan=False) + "\n"
    write_text(body, path)


def write_text(body: str, path: str) -> None:
    fs, p = filesystem(path)
    fs.create_dir(p.rsplit("/", 1)[0] or "/", recursive=True)
    with fs.open_output_stream(p) as f:
        f.write(body.encode("utf-8"))


def spectra(a: Analysis, channel: str) -> tuple[DataFrame, DataFrame]:
    """Mean spectrum and density spectral array of one channel from one shared density table (unnotched)."""
    psd = spectral.epoch_psd(E.cut(a.blocks.where(F.col("channel") == channel), a.epoch_n), a.fs)
    verdict = a.epochs.select("recording_id", "epoch_ix", "accepted")
    return spectral.mean_psd(psd, verdict, a.fs), spectral.density_array(psd, verdict, a.fs)


def preview(a: Analysis, seconds: float = 12.0) -> DataFrame:
    """The first seconds of every channel."""
    n = int(seconds * a.fs)
    return E.to_samples(a.blocks.where(F.col("start_ix") < n)).where(F.col("sample_ix") < n)


def session_series(steps: DataFrame, cfg) -> DataFrame:
    """Plot-ready series of a monitored session: index, thresholds, build-up and alert marks."""
    return steps.select("session_id", (F.col("t") / 60.0).alias("minutes"), "index",
                        F.when(F.col("state") != "CALIBRATING", F.col("cusum")).alias("cusum"),
                        F.lit(float(cfg.alert_level)).alias("imminent_level"), F.lit(float(cfg.cusum_h)).alias("cusum_threshold"),
                        F.col("alert.level").alias("alert_level"), F.col("alert.index").alias("alert_index"))


def _curve(points: list[tuple[float, float]], title: str) -> str:
    if len(points) < 2:
        return ""
    xs, ys = zip(*points)
    dx, dy = (max(xs) - min(xs)) or 1.0, (max(ys) - min(ys)) or 1.0
    path = " ".join(f"{700 * (x - min(xs)) / dx:.1f},{180 - 170 * (y - min(ys)) / dy:.1f}" for x, y in points)
    return f'<figure><figcaption>{escape(title)}</figcaption><svg viewBox="0 0 700 190"><polyline fill="none" stroke="#2563eb" points="{path}"/></svg></figure>'


def write_report(a: Analysis, metadata: dict, channels: list[str], out_dir: str) -> dict:
    """features, mean spectrum and density array as tables; summary.json and report.html as documents."""
    summary = a.summary(metadata, channels)
    a.wide(channels).write.mode("overwrite").parquet(f"{out_dir}/features")
    mean, dsa = spectra(a, channels[0])
    mean.write.mode("overwrite").parquet(f"{out_dir}/mean_psd")
    dsa.write.mode("overwrite").parquet(f"{out_dir}/density_array")
    write_json(summary, f"{out_dir}/summary.json")
    spark = a.epochs.sparkSession
    rows = (spark.read.parquet(f"{out_dir}/mean_psd").where("freq_hz between 0.5 and 40 and mean_psd > 0")
            .groupBy("freq_hz").agg(F.avg("mean_psd").alias("p")).orderBy("freq_hz").selectExpr("freq_hz", "log10(p) as y").collect())   # 80 bins
    page = (f'<!doctype html><meta charset="utf-8"><title>Recording report</title><body style="font:16px sans-serif;max-width:60em;margin:auto">'
            f'<h1>Recording report</h1><p>Source: {escape(str(metadata.get("source", "user-supplied recording")))}. '
            f'Context: {escape(str(summary["recording_context"]))}. {a.fs:g} Hz, {len(channels)} channels.</p>'
            f'<p><b>{summary["accepted_epochs"]}/{summary["complete_epochs"]}</b> accepted epochs; composites unavailable; state indeterminate.</p>'
            f'<p>{escape(summary["index_reason"])}. Research use only, no diagnosis.</p>'
            + _curve([(r["freq_hz"], r["y"]) for r in rows], f"{channels[0]}: log10 mean density of accepted epochs")
            + f'<details><summary>Settings and provenance</summary><pre>{escape(json.dumps(summary, indent=2, allow_nan=False))}</pre></details></body>')
    write_text(page, f"{out_dir}/report.html")
    return summary
