"""Command line over the same API: python -m rillwave <command>."""

from __future__ import annotations

import argparse
import json
import sys
from dataclasses import replace

from . import __version__
from .model import GuardError, LiveConfig, QualityPolicy


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="rillwave", description="Spark-native biosignal analytics; research use only")
    p.add_argument("--version", action="version", version=__version__)
    sub = p.add_subparsers(dest="command", required=True)

    def command(name, *args, **options):
        c = sub.add_parser(name)
        for a in args:
            c.add_argument(a)
        for k, v in options.items():
            c.add_argument("--" + k.replace("_", "-"), **v)
        return c

    need = {"required": True}
    command("analyze", "input", metadata=need, out=need, epoch_s={"type": float, "default": 4.0},
            line_hz={"type": float, "choices": (50.0, 60.0)}, min_sqi={"type": float, "default": 80.0})
    command("convert", "input", out=need, subject_id=need, channels={"nargs": "+"}, context={"default": "awake_observational_research"},
            license={"default": "unspecified"}, bis_montage={"choices": ("left", "right")}, bis_reference={}, proxy={"action": "store_true"})
    command("convert-cohort", "manifest", out=need, epoch_s={"type": float, "default": 4.0}, keep_raw={"action": "store_true"},
            max_failures={"type": int})
    command("make-manifest", "root", out=need)
    command("fetch", caseid={"type": int, "default": 1}, start_s={"type": float, "default": 332.0},
            duration_s={"type": float, "default": 120.0}, out=need, cache={})
    command("score", features=need, calibration=need, out=need)
    command("calibrate", "input", subject_id=need, out=need)
    command("train", "input", features={"nargs": "+", "required": True}, out=need)
    command("train-groups", "input", features={"nargs": "+", "required": True}, out=need)
    live = command("monitor", file={}, source={"choices": ("synthetic", "csv"), "default": "synthetic"}, fs={"type": float, "default": 256.0},
                   baseline_sec={"type": float, "default": 180.0}, profile={"default": "meltdown"}, bvc_file={}, horizon_min={"type": float},
                   cusum_k={"type": float}, cusum_h={"type": float}, minutes={"type": float, "default": 50.0}, seed={"type": int, "default": 7},
                   model={"choices": ("index", "kalman"), "default": "index"}, webhook_url={}, report={})
    live.add_argument("--channels", nargs="+", default=["TP9", "AF7", "AF8", "TP10"])
    live.add_argument("--frontal", nargs=2, default=["AF7", "AF8"])
    live.add_argument("--events", type=float, nargs="*", default=[22.0, 42.0])
    live.add_argument("--notify", nargs="+", default=["console"])
    live.add_argument("--outbox", help="folder that remembers what was delivered, so that a second run sends only what is new")
    return p


def _analyze(spark, a) -> dict:
    from .plans.analyze import analyze, analyze_recording
    from .plans.report import write_report
    from .sources.recordings import read_csv, read_edf, verified_sites

    policy = QualityPolicy(min_sqi=a.min_sqi)
    if a.input.lower().endswith((".edf", ".bdf")):
        blocks, meta = read_edf(spark, a.input, a.metadata)
        family = (meta.get("sensor") or {}).get("family")
        channels = meta["eeg_columns"]
        result = analyze(blocks, meta["sampling_rate_hz"], a.epoch_s, a.line_hz, policy, require_sqi=family == "BIS",
                         sites=verified_sites(spark, meta, channels), channels=len(channels))
    else:
        rec = read_csv(spark, a.input, a.metadata)
        result, meta, channels = analyze_recording(rec, a.epoch_s, a.line_hz, policy), rec.metadata, rec.channels
    s = write_report(result, meta, channels, a.out)
    return {k: s[k] for k in ("complete_epochs", "accepted_epochs", "rejected_epochs", "SOI", "RDI", "classification")}


def _convert(spark, a) -> dict:
    from pyspark.sql import functions as F

    from .operators import montage
    from .plans.analyze import analyze
    from .plans.report import write_json, write_report
    from .sources.recordings import choose_signals, decode_one, edf_layout

    signals, fs = choose_signals(edf_layout(a.input), a.channels)
    names, reference, locations = [s["label"] for s in signals], "documented_common_reference", {}
    blocks = decode_one(spark, a.subject_id, a.input, names)
    if a.bis_montage:
        from .model import MONTAGE_SITES
        reference = montage.montage_plan(blocks, a.bis_montage, a.bis_reference).first()["reference"]
        blocks = montage.rederive(blocks, a.bis_montage, a.bis_reference).drop("reference")
        locations = {f"BISlike_{s}_minus_ref": s for s in MONTAGE_SITES[a.bis_montage]}
        names = list(locations)
    blocks.select("recording_id", "channel", "start_ix", "uv").write.mode("overwrite").parquet(f"{a.out}/blocks")
    meta = {"sampling_rate_hz": fs, "eeg_unit": "uV", "eeg_columns": names, "channel_locations": locations, "reference": reference,
            "reference_verified": False, "sensor": {"family": "research_eeg", "model": "not_reported"}, "recording_context": a.context,
            "subject_id": a.subject_id, "psychiatric_labels": None, "source": a.input, "license": a.license,
            "changes": "converted to microvolts; no filtering, resampling or interpolation"}
    write_json(meta, f"{a.out}/metadata.json")
    out = {"channels": names, "sampling_rate_hz": fs}
    if a.proxy:
        stored = spark.read.parquet(f"{a.out}/blocks")
        out["accepted_epochs"] = write_report(analyze(stored, fs), meta, names, f"{a.out}/analysis")["accepted_epochs"]
    return out


def _monitor(spark, a) -> dict:
    from pyspark.sql import functions as F

    from .operators.clinical import with_clinical
    from .operators.evaluate import evaluation, lead_times
    from .plans.report import write_json
    from .sources.cohort import read_checklist
    from .sources.simulate import Script, simulated_blocks
    from .sources.wearable import read_wearable_csv
    from .streaming.live import live_windows
    from .streaming.notify import build, deliver, outbox
    from .streaming.sessions import run_sessions

    cfg = LiveConfig(fs=a.fs, channels=tuple(a.channels), frontal_pair=tuple(a.frontal), baseline_sec=a.baseline_sec).with_profile(a.profile)
    if a.model == "kalman":
        cfg = cfg.with_kalman()
    given = {k: v for k, v in (("cusum_k", a.cusum_k), ("cusum_h", a.cusum_h), ("horizon_min", a.horizon_min)) if v is not None}
    cfg = replace(cfg, **given)
    if a.source == "synthetic":
        seeds = spark.createDataFrame([("session", a.seed)], "recording_id string, seed long")
        blocks = simulated_blocks(spark, seeds, cfg, Script(minutes=a.minutes, events_min=tuple(a.events)))
    elif a.file:
        blocks = read_wearable_csv(spark, a.file, cfg, "session")
    else:
        raise GuardError("--file is required for the csv source")
    windows = live_windows(blocks, cfg)
    if a.bvc_file:
        windows = with_clinical(windows, read_checklist(spark, a.bvc_file, "session"), cfg.bvc_valid_sec)
    steps = run_sessions(windows, cfg).cache()
    notifiers = build(a.notify, a.webhook_url)
    (outbox(notifiers, a.outbox) if a.outbox else deliver(notifiers))(steps, 0)
    alerts = steps.where("alert is not null").select("session_id", "alert.t", "alert.level")
    if not a.events:
        return {"alerts": alerts.count()}
    truth = spark.createDataFrame([("session", e * 60.0) for e in a.events], "session_id string, t double")
    result = evaluation(truth, alerts, cfg.horizon_min).drop("session_id").first().asDict()
    result["events"] = [r.asDict() for r in lead_times(truth, alerts).drop("session_id", "event_t").orderBy(F.col("event_min")).collect()]
    if a.report:
        write_json(result, a.report)
    return result


def run(spark, a) -> dict:
    from .plans import report
    from .sources import cohort as C

    if a.command == "analyze":
        return _analyze(spark, a)
    if a.command == "convert":
        return _convert(spark, a)
    if a.command == "monitor":
        return _monitor(spark, a)
    if a.command == "convert-cohort":
        from .plans.cohort import convert_cohort
        return convert_cohort(spark, a.manifest, a.out, epoch_s=a.epoch_s, keep_raw=a.keep_raw, max_failures=a.max_failures)
    if a.command == "make-manifest":
        m = C.build_manifest(spark, a.root)
        m.write.mode("overwrite").option("header", True).csv(a.out)
        n = spark.read.option("header", True).csv(a.out).count()
        if not n:
            raise GuardError(f"no recordings found under {a.root}")
        return {"files": n}
    if a.command == "fetch":
        from .sources.monitor import fetch
        frame, meta = fetch(spark, a.caseid, a.cache or f"{a.out}/source_cache", a.start_s, a.duration_s)
        frame.write.mode("overwrite").parquet(f"{a.out}/recording")
        report.write_json(meta, f"{a.out}/metadata.json")
        return {"caseid": a.caseid, "excerpt": meta["excerpt"]}
    if a.command == "score":
        from .operators.composite import check_identity, score_documents
        from .sources.recordings import read_document
        features, calibration = read_document(a.features), read_document(a.calibration)
        check_identity(features, calibration)
        result = score_documents(spark, features, calibration)
        report.write_json(result, a.out)
        return {k: v["score"] for k, v in result["indices"].items()}
    if a.command == "calibrate":
        from .operators.composite import require_calibration
        row = require_calibration(C.read_labelled(spark, a.input), a.subject_id).first().asDict(recursive=True)
        for k in ("SOI", "RDI"):
            row[k].pop("weights")
        report.write_json({k: v for k, v in row.items() if v is not None}, a.out)
        return {"duration_s": row["duration_s"]}
    from .operators.learn import final_model, train_groups, train_states
    table = C.read_labelled(spark, a.input)
    trainer, label = (train_states, "research_label") if a.command == "train" else (train_groups, "group")
    result, rows = trainer(table, a.features)
    report.write_json(result, f"{a.out}/evaluation.json")
    rows.write.mode("overwrite").parquet(f"{a.out}/held_out_predictions")
    report.write_json(final_model(table, label, a.features), f"{a.out}/model.json")
    keys = ("subjects", "rows", "balanced_accuracy", "macro_f1", "subjects_per_group", "epochs", "subject_balanced_accuracy", "epoch_balanced_accuracy")
    return {k: result[k] for k in keys if k in result}


def main(argv: list[str] | None = None) -> int:
    a = _parser().parse_args(argv)
    from .session import local_session
    try:
        print(json.dumps(run(local_session(), a)))
    except (ValueError, OSError, KeyError) as exc:
        print(f"Error: {exc}", file=sys.stderr)
        return 2
    return 0
