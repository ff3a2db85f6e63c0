import json
import warnings
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from rillwave import cli
from rillwave.functions import kernels as K
from rillwave.functions.statespace import information_weights
from rillwave.model import GuardError, LiveConfig, PROFILES, QualityPolicy
from rillwave.operators import evaluate, learn
from rillwave.operators.clinical import with_clinical
from rillwave.plans.analyze import analyze, analyze_recording
from rillwave.plans import commit
from rillwave.plans.cohort import convert_cohort, pooled_wide
from rillwave.plans.report import write_report
from rillwave.sources import cohort as C, monitor, recordings as R, simulate, wearable
from rillwave.streaming import live, machine as M, notify, sessions


def write_csv(path, cols):
    names = list(cols)
    path.write_text(",".join(names) + "\n" + "\n".join(",".join("" if v != v else repr(float(v)) for v in r) for r in zip(*cols.values())) + "\n")


def recording(tmp_path, unit="uV", n=512, **extra):
    t = extra.pop("time", np.arange(n) / 128)
    write_csv(tmp_path / "raw.csv", {"time_s": t, "EEG": np.sin(np.arange(n)), **extra})
    (tmp_path / "meta.json").write_text(json.dumps({"sampling_rate_hz": 128, "eeg_unit": unit, "eeg_columns": ["EEG"], "subject_id": "r"}))
    return str(tmp_path / "raw.csv"), str(tmp_path / "meta.json")


def test_csv_units_and_guards(spark, tmp_path):
    rec = R.read_csv(spark, *recording(tmp_path, "V"))
    assert rec.frame.where("sample_ix = 1").first()["EEG"] == pytest.approx(np.sin(1) * 1e6)
    assert rec.metadata["eeg_unit"] == "uV" and rec.metadata["original_eeg_unit"] == "V"
    with pytest.raises(GuardError):
        R.read_csv(spark, *recording(tmp_path, "unknown"))
    t = np.arange(512) / 128
    t[30] += 0.002
    with pytest.raises(GuardError):
        R.read_csv(spark, *recording(tmp_path, time=t))
    with pytest.raises(GuardError):
        R.read_csv(spark, *recording(tmp_path, time=(np.arange(512) / 128)[::-1]))


def test_file_order_survives_splits(spark, tmp_path):
    n = 60000
    write_csv(tmp_path / "big.csv", {"v": np.arange(n)})
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "50k")
    try:
        df = R.in_file_order(spark.read.schema("v double").option("header", True).csv(str(tmp_path / "big.csv")))
        assert df.rdd.getNumPartitions() > 1
        assert df.where("sample_ix <> v").count() == 0 and df.count() == n
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_analysis_of_a_monitor_recording(spark, tmp_path):
    n = 128 * 72
    rng = np.random.default_rng(5)
    x = rng.normal(0, 10, n)
    x[17 * 512 + 3] = np.nan
    path, meta = recording(tmp_path, n=n, SQI=np.full(n, 99.0), EMG=np.full(n, 20.0), X=x)
    m = json.loads(open(meta).read())
    m.update(eeg_columns=["EEG", "X"], sensor={"family": "BIS"})
    open(meta, "w").write(json.dumps(m))
    rec = R.read_csv(spark, path, meta)
    a = analyze_recording(rec)
    w = a.wide(["EEG", "X"]).orderBy("epoch_ix").toPandas()
    assert len(w) == 18 and list(w.accepted) == [True] * 17 + [False] and w.quality_reasons[17] == "missing_eeg_samples"
    assert not [c for c in w.columns if c.startswith("pair_")]
    assert (w.recorded_sqi == 99).all() and list(w.time_s[:2]) == [0.0, 4.0]
    ref = K.spectral_features(x[None, 512:1024], 128.0)
    for k, v in ref.items():
        assert w[f"X__{k}"][1] == pytest.approx(v[0], rel=1e-9)
    bic = w["X__auto_bicoherence_squared_60s"]
    assert bic[:14].isna().all() and bic[14:17].notna().all() and np.isnan(bic[17])
    assert bic[15] == pytest.approx(K.rolling_bicoherence(x[512:8192], 128.0, [7680], 7680)[0])
    s = write_report(a, rec.metadata, ["EEG", "X"], str(tmp_path / "out"))
    assert (s["complete_epochs"], s["accepted_epochs"], s["unused_tail_samples"]) == (18, 17, 0) and s["SOI"] is None
    assert "report" in (tmp_path / "out/report.html").read_text()
    dsa = spark.read.parquet(str(tmp_path / "out/density_array"))
    assert dsa.where("epoch_ix = 17 and power_db is not null").count() == 0


def test_longer_epochs_use_piecewise_histories(spark):
    x = np.random.default_rng(6).normal(0, 10, 128 * 72)
    rows = [("r", "a", i, [float(v) for v in x[i:i + 300]]) for i in range(0, len(x), 300)]
    b = spark.createDataFrame(rows, "recording_id string, channel string, start_ix long, uv array<double>")
    aux = spark.createDataFrame([("r", i, "EMG", 20.0) for i in range(len(x))], "recording_id string, sample_ix long, name string, value double")
    flags = spark.createDataFrame([("r", False, True, False)], "recording_id string, has_sqi boolean, has_emg boolean, require_sqi boolean")
    f = analyze(b, 128.0, 8.0, numerics=aux, flags=flags).features.orderBy("epoch_ix").toPandas()
    got = f["auto_bicoherence_squared_60s"]
    assert list(got.notna()) == [False] * 7 + [True] * 2
    assert got[7] == pytest.approx(K.rolling_bicoherence(x[512:8192], 128.0, [7680], 7680)[0])
    with pytest.raises(GuardError):
        analyze(b, 128.0, 3.0)
    with pytest.raises(GuardError):
        analyze(b, 64.0)


def write_edf(path, channels, fs=128, seconds=4, wide=False):
    """Tiny EDF/BDF writer for fixtures: label -> samples in microvolts."""
    ns, lim = len(channels), (8388607 if wide else 32767)
    head = [("\xffBIOSEMI" if wide else "0").ljust(8)[:8], "".ljust(80), "".ljust(80), "01.01.20", "00.00.00",
            str(256 * (ns + 1)).ljust(8), "".ljust(44), str(seconds).ljust(8), "1".ljust(8), str(ns).ljust(4)]
    cols = [[c.ljust(16) for c in channels], ["".ljust(80)] * ns, ["uV".ljust(8)] * ns, ["-1000".ljust(8)] * ns, ["1000".ljust(8)] * ns,
            [str(-lim).ljust(8)] * ns, [str(lim).ljust(8)] * ns, ["".ljust(80)] * ns, [str(fs).ljust(8)] * ns, ["".ljust(32)] * ns]
    raw = ("".join(head) + "".join("".join(c) for c in cols)).encode("latin-1")
    for s in range(seconds):
        for x in channels.values():
            d = np.round(np.asarray(x)[s * fs:(s + 1) * fs] / 1000 * lim).astype("<i4")
            raw += d.astype("<i2").tobytes() if not wide else d.view(np.uint8).reshape(-1, 4)[:, :3].tobytes()
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(raw)


@pytest.mark.parametrize("wide", [False, True])
def test_edf_ranges(spark, tmp_path, wide):
    x = {"EEG Fp1": 100 * np.sin(np.arange(640)), "Cz": -50 * np.cos(np.arange(640)), "Status": np.zeros(640)}
    write_edf(tmp_path / "a.edf", x, seconds=5, wide=wide)
    files = spark.createDataFrame([("a", str(tmp_path / "a.edf"), "")], "recording_id string, path string, channels string")
    plan = R.decode_plan(files, chunk_bytes=2000)
    assert plan.count() > 1
    got = R.decode(plan).orderBy("channel", "start_ix").collect()
    assert {r["channel"] for r in got} == {"EEG Fp1", "Cz"} and {r["fs"] for r in got} == {128.0}
    y = np.concatenate([r["uv"] for r in got if r["channel"] == "EEG Fp1"])
    np.testing.assert_allclose(y, x["EEG Fp1"], atol=0.02)
    (tmp_path / "m.json").write_text(json.dumps({"eeg_columns": ["EEG Fp1"], "sampling_rate_hz": 1, "subject_id": "a"}))
    blocks, meta = R.read_edf(spark, str(tmp_path / "a.edf"), str(tmp_path / "m.json"))
    assert meta["sampling_rate_hz"] == 128.0 and blocks.select("channel").distinct().count() == 1


def test_cohort_isolates_failures_and_resumes(spark, tmp_path):
    rng = np.random.default_rng(0)
    for g, name, chans in (("ASD", "a", ("Fp1", "Fp2", "F7")), ("HC", "h", ("Fp1", "Cz"))):
        write_edf(tmp_path / g / "sub" / f"{name}.edf", {c: rng.normal(0, 20, 128 * 9) for c in chans}, seconds=9)
    (tmp_path / "PSY").mkdir()
    (tmp_path / "PSY" / "bad.edf").write_bytes(b"x")
    m = C.build_manifest(spark, str(tmp_path))
    assert [r["subject_id"] for r in m.collect()] == ["ASD_sub_a", "HC_sub_h", "PSY_bad"]
    m = m.withColumn("bis_montage", F.when(F.col("group") == "ASD", "left").otherwise(""))
    m.coalesce(1).write.option("header", True).csv(str(tmp_path / "manifest"))
    table = C.read_manifest(spark, str(tmp_path / "manifest"))
    out = str(tmp_path / "out")
    r = convert_cohort(spark, table, out, root=str(tmp_path))
    assert (r["converted"], r["failed"], r["total"]) == (2, 1, 3)
    assert r["subjects_per_group"] == {"autism_spectrum": 1, "healthy_control": 1}
    pooled = spark.read.parquet(out + "/features")
    assert {(x["subject_id"], x["channel"]) for x in pooled.select("subject_id", "channel").distinct().collect()} == {
        ("ASD_sub_a", "BISlike_Fp1_minus_ref"), ("ASD_sub_a", "BISlike_F7_minus_ref"), ("HC_sub_h", "Fp1"), ("HC_sub_h", "Cz")}
    wide = pooled_wide(pooled, ["Fp1", "BISlike_F7_minus_ref"], ["sef95_hz"]).toPandas()
    assert len(wide) == 4 and wide["Fp1__sef95_hz"].notna().sum() == 2
    assert "PSY_bad" == spark.read.parquet(out + "/failures").first()["subject_id"]
    before = pooled.count()
    assert convert_cohort(spark, table, out, root=str(tmp_path))["converted"] == 2
    assert spark.read.parquet(out + "/features").count() == before
    with pytest.raises(GuardError):
        convert_cohort(spark, table, out, root=str(tmp_path), max_failures=0)


def cohort(spark, root, good=3):
    rng = np.random.default_rng(5)
    for i in range(good):
        write_edf(root / "HC" / f"h{i}.edf", {"Cz": rng.normal(0, 20, 128 * 9)}, seconds=9)
    C.build_manifest(spark, str(root)).coalesce(1).write.option("header", True).csv(str(root / "manifest"))
    return C.read_manifest(spark, str(root / "manifest"))


@pytest.mark.parametrize("dies", ["commit", "recover"])
def test_cohort_run_that_dies_half_way_leaves_nothing_double(spark, tmp_path, monkeypatch, dies):
    table, out = cohort(spark, tmp_path), str(tmp_path / "out")
    first = table.where("subject_id = 'HC_h0'")
    assert convert_cohort(spark, first, out, root=str(tmp_path))["converted"] == 1
    calls, real = [], getattr(commit, dies)

    def broken(*args):
        calls.append(args)
        if len(calls) == (1 if dies == "commit" else 2):            # `recover` runs at the start as well
            raise OSError("killed")
        return real(*args)

    monkeypatch.setattr(commit, dies, broken)
    with pytest.raises(OSError):
        convert_cohort(spark, table, out, root=str(tmp_path))
    seen = {r["subject_id"] for r in commit.read(spark, out, "features").collect()}
    assert seen == ({"HC_h0"} if dies == "commit" else {"HC_h0", "HC_h1", "HC_h2"})
    monkeypatch.setattr(commit, dies, real)
    r = convert_cohort(spark, table, out, root=str(tmp_path))
    assert (r["converted"], r["failed"], r["total"]) == (3, 0, 3)
    rows = spark.read.parquet(out + "/features")
    assert rows.count() == rows.select("subject_id", "epoch_ix", "channel").distinct().count() == commit.read(spark, out, "features").count() == 6
    assert rows.select("subject_id").distinct().count() == 3
    assert commit.folders(out, "blocks") == [] and not list((tmp_path / "out" / "blocks").glob("attempt=*"))


def test_cohort_stops_reading_at_too_many_failures(spark, tmp_path):
    table, out = cohort(spark, tmp_path, good=1), str(tmp_path / "out")
    (tmp_path / "opened").mkdir()
    opened = str(tmp_path / "opened")

    def slow(path, channels):
        import time
        from pathlib import Path

        (Path(opened) / Path(path).stem).touch()
        time.sleep(0.3)
        raise ValueError("unreadable")

    bad = table.crossJoin(spark.range(200)).withColumn("subject_id", F.concat(F.lit("b"), "id")).withColumn(
        "file", F.concat("subject_id", F.lit(".slow"))).drop("id").select(table.columns)
    R.register_decoder(".slow", slow)
    try:
        with pytest.raises(GuardError, match="aborted after 4 failures; one of them: .*unreadable"):
            convert_cohort(spark, table.unionByName(bad), out, root=str(tmp_path), max_failures=3)
    finally:
        R._DECODERS.pop(".slow")
    assert 4 <= len(list((tmp_path / "opened").iterdir())) < 150
    assert commit.entries(out) == {}
    assert convert_cohort(spark, table, out, root=str(tmp_path), max_failures=0)["converted"] == 1
    with pytest.raises(GuardError, match="unsupported format"):          # headers alone are enough
        convert_cohort(spark, table.unionByName(bad), str(tmp_path / "other"), root=str(tmp_path), max_failures=3)


def states(spark):
    rows = [(f"s{s}", "x", str(i), "baseline" if i % 2 == 0 else "sensory_loading", "participant", "unit_test", i % 2 + s * 0.01)
            for s in range(3) for i in range(8)]
    return spark.createDataFrame(rows, "subject_id string, session_id string, epoch_id string, research_label string, label_source string, recording_context string, alpha_power double")


def test_states_are_predicted_for_every_row(spark):
    result, pred = learn.train_states(states(spark), ["alpha_power"])
    assert result["subjects"] == 3 and len(result["folds"]) == 3 and result["balanced_accuracy"] == 1.0
    assert pred.count() == 24 and pred.where("held_out_prediction is null").count() == 0


@pytest.mark.parametrize("change", [
    lambda d: d.withColumn("recording_context", F.lit("perioperative_anesthesia")), lambda d: d.union(d.limit(1)),
    lambda d: d.withColumn("label_source", F.lit("guess")), lambda d: d.where("subject_id <> 's0'"),
    lambda d: d.withColumn("alpha_power", F.when(F.col("epoch_id") != "0", F.col("alpha_power")))])
def test_state_guards(spark, change):
    with pytest.raises(GuardError):
        learn.train_states(change(states(spark)), ["alpha_power"])


def test_hyperplane_is_optimal(spark):
    """No small change of any coefficient lowers the exact weighted hinge objective noticeably."""
    rng = np.random.default_rng(4)
    y = rng.integers(0, 2, 90)
    x = rng.normal(0, 1, (90, 2)) + y[:, None] * [1.5, 0.5]
    df = spark.createDataFrame([(f"s{i % 3}", "ab"[k], float(v[0]), float(v[1])) for i, (k, v) in enumerate(zip(y, x))],
                               "subject_id string, label string, f1 double, f2 double")
    m = learn.final_model(df, "label", ["f1", "f2"])
    z = (x - x.mean(axis=0)) / x.std(axis=0)
    np.testing.assert_allclose([m["mean"], m["sd"]], [x.mean(axis=0), x.std(axis=0)])
    c = np.where(y == 1, 90 / (2 * (y == 1).sum()), 90 / (2 * (y == 0).sum()))
    cost = lambda w: 0.5 * (w[:2] ** 2).sum() + (c * np.maximum(0, 1 - (2 * y - 1) * (z @ w[:2] + w[2]))).sum()
    w = np.array([*m["pairs"][0]["coef"], m["pairs"][0]["intercept"]])
    around = [cost(w + rng.normal(0, s, 3)) for s in (0.3, 0.1, 0.03, 0.01) for _ in range(200)]
    assert cost(w) <= min(around) * (1 + 5e-4)


def test_groups_by_subject_votes(spark):
    rng = np.random.default_rng(0)
    rows = [(f"{g}-{s}", g, f"site{s % 2}", True, float(i + rng.normal(0, 0.2)), float(rng.normal()))
            for i, g in enumerate(("autism_spectrum", "psychosis_spectrum", "healthy_control")) for s in range(2) for _ in range(6)]
    t = spark.createDataFrame(rows, "subject_id string, `group` string, site string, accepted boolean, f1 double, f2 double")
    r, votes = learn.train_groups(t, ["f1", "f2"])
    assert r["subject_balanced_accuracy"] == 1.0 and votes.count() == 6
    for bad in (t.withColumn("site", F.col("group")), t.where("subject_id <> 'healthy_control-1'"), t.withColumn("recording_context", F.lit("perioperative"))):
        with pytest.raises(GuardError):
            learn.train_groups(bad, ["f1", "f2"])
    with pytest.raises(GuardError):
        learn.train_groups(t, ["group"])


def test_unconverged_models_are_reported(spark):
    rng = np.random.default_rng(5)
    rows = [(f"s{i % 3}", "a" if i % 2 else "b", float(rng.normal() + (i % 2)), float(rng.normal())) for i in range(240)]
    df = spark.createDataFrame(rows, "subject_id string, label string, f1 double, f2 double").cache()
    classes, folds = learn.folds_of(df, "label", ["f1", "f2"], "subject_id")
    with pytest.warns(learn.UnconvergedWarning, match="of 3 models stopped unconverged: a / b without s"):
        learn.fit(df, "label", ["f1", "f2"], "subject_id", classes, folds, rounds=0)
    with warnings.catch_warnings():
        warnings.simplefilter("error", learn.UnconvergedWarning)
        learn.fit(df, "label", ["f1", "f2"], "subject_id", classes, folds, rounds=40)


# --- live ----------------------------------------------------------------------------------------

def simulated(spark, cfg, seed=7, rid="s", **script):
    seeds = spark.createDataFrame([(rid, seed)], "recording_id string, seed long")
    return simulate.simulated_blocks(spark, seeds, cfg, simulate.Script(**script))


@pytest.fixture(scope="module")
def demo(spark):
    """Windows of the 50-minute demo session, shared by several tests."""
    w = live.live_windows(simulated(spark, LiveConfig()), LiveConfig()).cache()
    w.count()
    return w


def outcome(spark, windows, cfg, events=(22, 42)):
    steps = sessions.run_sessions(windows, cfg).cache()
    alerts = steps.where("alert is not null").select("session_id", "alert.t", "alert.level")
    truth = spark.createDataFrame([("s", e * 60.0) for e in events], "session_id string, t double")
    return steps, evaluate.evaluation(truth, alerts, cfg.horizon_min).first(), evaluate.lead_times(truth, alerts).orderBy("event_t").collect()


def test_two_levels_on_the_demo_session(spark, demo):
    steps, e, leads = outcome(spark, demo, LiveConfig())
    assert (e["detected_early"], e["detected_imminent"], e["false_alarms"]) == (2, 2, 0)
    assert all(11 >= r["early_warning_lead_min"] > r["imminent_lead_min"] > 0 for r in leads)
    # published demo figures of the seeded session
    assert [(r["early_warning_lead_min"], r["imminent_lead_min"]) for r in leads] == [(9.28, 3.52), (8.45, 2.83)]
    assert e["n_alerts"] == 5


def test_state_space_model_warns_too(spark, demo):
    _, e, _ = outcome(spark, demo, LiveConfig().with_kalman())
    assert e["detected_early"] == 2 and e["false_alarms"] == 0


def test_checklist_makes_the_warning_earlier(spark, demo):
    cfg = LiveConfig().with_profile("psychosis")
    assert cfg.horizon_min == 20.0 and cfg.weights["muscle_tension"] == 1.0 and "de-escalation" in cfg.early_msg

    def early(score):
        w = demo
        if score is not None:
            w = with_clinical(demo, spark.createDataFrame([("s", 240.0, score)], "session_id string, t double, score int"))
        s = sessions.run_sessions(w, cfg).where("alert is not null").select("alert.*")
        return s.cache()

    plain, zero, high = early(None), early(0), early(3)
    first = lambda d: d.where("level = 'EARLY_WARNING'").orderBy("t").first()
    assert first(high)["t"] < first(plain)["t"] == first(zero)["t"]
    assert "BVC 3" in first(high)["message"] and high.where("level = 'CLINICAL_RISK'").count() == 1


def test_onset_map_names_the_leading_site(spark):
    cfg = LiveConfig()
    w = live.live_windows(simulated(spark, cfg, seed=11, lead_channel="TP9", lead_min=4.0), cfg)
    a = sessions.run_sessions(w, cfg).where("alert.onset is not null").select("alert.*").orderBy("t").first()
    assert a["onset"]["first_channel"] == "TP9" and a["onset"]["first_region"] == "left temporoparietal"
    assert "not a brain focus" in a["message"] and "no channel-level onset" in M.onset_text(None)


def test_calm_session_stays_silent(spark):
    cfg = LiveConfig()
    w = live.live_windows(simulated(spark, cfg, seed=3, minutes=30.0, events_min=(), distractors_min=(12.0, 22.0)), cfg)
    assert sessions.run_sessions(w, cfg).where("alert is not null").count() == 0


def test_segments_do_not_change_the_detector(spark, demo):
    cfg = LiveConfig()
    as_json = lambda s: {r["j"] for r in s.select(F.to_json(F.struct("*")).alias("j")).collect()}
    part = demo.where("t < 1500")
    assert as_json(sessions.run_sessions(part, cfg, 400)) == as_json(sessions.run_sessions(part, cfg))


def test_equal_times_give_a_late_step(spark, demo):
    part = demo.where("t <= 10").drop("window_ix")
    steps = sessions.run_sessions(part.union(part.where("t = 5")), LiveConfig())
    assert [(r["t"], r["state"]) for r in steps.where("state <> 'CALIBRATING'").collect()] == [(5.0, "LATE")] and steps.count() == part.count() + 1


def test_stream_equals_batch(spark, demo, tmp_path):
    cfg = replace(LiveConfig(), baseline_sec=60.0)
    blocks = simulated(spark, cfg, minutes=4.0, events_min=(3.0,), distractors_min=()).cache()
    rows = wearable.chunks(blocks, cfg)
    n = 10 * 256
    for i in range(4):        # four files, so at least four micro-batches
        rows.where(f"start_ix >= {i * 6 * n} and start_ix < {(i + 1) * 6 * n}").coalesce(1).write.mode("append").parquet(str(tmp_path / "chunks"))
    stream = live.detect_chunks_stream(wearable.chunk_stream(spark, str(tmp_path / "chunks")), cfg)
    got = {r["t"]: r for r in live.drain(stream, "chunks").collect()}
    want = {r["t"]: r for r in sessions.run_sessions(live.live_windows(blocks, cfg), cfg).collect()}
    assert sorted(got) == sorted(want) and len(got) == 239
    for t, r in want.items():
        assert got[t]["state"] == r["state"] and (r["index"] is None or got[t]["index"] == pytest.approx(r["index"], abs=1e-9))


def test_gap_of_a_session_is_a_step_and_others_go_on(spark, tmp_path):
    cfg = replace(LiveConfig(), channels=("a", "b"), frontal_pair=("a", "b"))
    x = np.random.default_rng(4).normal(0, 10, (2, 4 * 256)).tolist()
    rows = [("whole", 0, x), ("whole", 1024, x), ("torn", 0, x), ("torn", 5 * 1024, x), ("torn", 0, x)]
    spark.createDataFrame(rows, "session_id string, start_ix long, uv array<array<double>>").coalesce(1).write.parquet(str(tmp_path / "c"))
    out = live.drain(live.detect_chunks_stream(wearable.chunk_stream(spark, str(tmp_path / "c")), cfg), "gap")
    got = {s: sorted((r["t"], r["state"]) for r in out.where(F.col("session_id") == s).collect()) for s in ("whole", "torn")}
    calm = lambda *t: [(float(v), "CALIBRATING") for v in t]
    assert got["whole"] == calm(2, 3, 4, 5, 6, 7, 8)
    assert got["torn"] == [(0.0, "LATE"), *calm(2, 3, 4), (20.0, "GAP"), *calm(22, 23, 24)]


def test_windows_stream_names_late_rows(spark, demo, tmp_path):
    cfg = replace(LiveConfig(), baseline_sec=30.0)
    part = demo.where("t <= 120").drop("window_ix")
    part.where("t <= 60").coalesce(1).write.parquet(str(tmp_path / "w"))
    part.where("t > 50").coalesce(1).write.mode("append").parquet(str(tmp_path / "w"))
    src = spark.readStream.schema(part.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "w"))
    sent = []

    class Sink:
        def send(self, alert):
            sent.append(alert)

    out = live.drain(live.detect_windows_stream(src, cfg), "late")
    late = "state = 'LATE'"
    assert out.where(f"not ({late})").count() == out.select("t").distinct().count() == 119
    assert sorted(r["t"] for r in out.where(late).collect()) == [float(t) for t in range(51, 61)]
    notify.deliver([Sink()])(sessions.run_sessions(demo, LiveConfig()), 0)
    assert len(sent) == 5 and sent[0]["level"] == "EARLY_WARNING"


def test_outbox_delivers_once_and_tries_again(spark, demo, tmp_path):
    steps = sessions.run_sessions(demo, LiveConfig()).cache()
    want = sorted(r[0] for r in steps.where("alert is not null").select("alert.t").collect())
    box, down = str(tmp_path / "box"), tmp_path / "down"
    down.touch()

    class Sink:
        def __init__(self, name, flag=None):
            self.address, self.folder, self.flag = name, str(tmp_path / name), str(flag) if flag else None

        def send(self, alert):
            import os
            import uuid

            os.makedirs(self.folder, exist_ok=True)
            if self.flag and os.path.exists(self.flag):
                raise OSError("receiver is down")
            open(f"{self.folder}/{alert['t']}_{uuid.uuid4().hex}", "w").close()

    def got(name):
        return sorted(float(f.name.split("_")[0]) for f in (tmp_path / name).iterdir())

    batch = notify.outbox([Sink("up"), Sink("late", down), notify.Console()], box, tries=2, pause_s=0.01)
    for part, number in (("t < 800", 0), ("t < 800", 0), ("true", 1)):    # the first batch is replayed
        batch(steps.where(part), number)
    assert got("up") == want and got("late") == [] and len(want) == 5
    down.unlink()
    batch(steps.where("false"), 2)                                       # an empty batch: what is due goes out
    batch(steps, 3)
    assert got("up") == got("late") == want
    sent = notify.receipts(spark, box).where("sent").groupBy("session_id", "t", "level", "target").count().collect()
    assert len(sent) == 15 and {r["count"] for r in sent} == {1}
    assert notify.receipts(spark, box).where("not sent and tries = 2").count() > 0
    # a task that dies after sending leaves its mark: without any receipt nothing is sent again
    spark.createDataFrame([], notify._RECEIPT).write.mode("overwrite").parquet(box + "/receipts")
    batch(steps, 4)
    assert got("up") == got("late") == want


def test_spooled_alerts_share_files_and_arrive_once(spark, tmp_path):
    box, down = str(tmp_path / "box"), tmp_path / "down"

    class Broken(notify.Spool):
        def __init__(self, folder, flag):
            super().__init__(folder)
            self.flag = str(flag)

        def send_all(self, alerts, key):
            import os
            if os.path.exists(self.flag):
                raise OSError("folder is full")
            return super().send_all(alerts, key)

    alert = F.struct((F.col("id") / 4).alias("t"), F.when(F.col("id") % 3 == 0, "IMMINENT").otherwise("EARLY_WARNING").alias("level"),
                     F.lit(1.5).alias("index"), F.when(F.col("id") != 100, 0.25).alias("slope_per_min"), F.lit(2.0).alias("eta_min"), F.lit("m").alias("message"))
    steps = spark.range(900).select(F.concat(F.lit("s"), F.col("id") % 7).alias("session_id"), "id", alert.alias("alert"))
    batch = notify.outbox([notify.Spool(f"{box}/up"), Broken(f"{box}/late", down)], box, tries=2, pause_s=0.01)
    down.touch()
    batch(steps.where("id < 300"), 0)
    batch(steps.where("id < 300"), 0)
    down.unlink()
    batch(steps, 1)
    spark.createDataFrame([], notify._RECEIPT).write.mode("overwrite").parquet(box + "/receipts")
    batch(steps.union(steps.withColumn("session_id", F.lit("new"))), 2)          # other batches: their marks list the alerts
    for folder in ("up", "late"):
        got = spark.read.schema("session_id string, t double, level string").json(f"{box}/{folder}").groupBy("session_id", "t", "level").count()
        assert got.agg(F.count("*"), F.max("count")).first() == (1798, 1)       # one alert has no trend to tell, twice
        assert len(list((tmp_path / "box" / folder).glob("*.json"))) < 60
    sent = notify.receipts(spark, box).where("sent").groupBy("session_id", "t", "level", "target").count()
    assert sent.agg(F.count("*"), F.max("count")).first() == (3596, 1)
    assert notify.receipts(spark, box).where("not sent").select("t").distinct().collect() == [(25.0,)]
    assert not list((tmp_path / "box" / "marks").iterdir())


def test_state_of_idle_sessions_expires(spark, demo, tmp_path):
    import time

    cfg = replace(LiveConfig(), baseline_sec=30.0)
    part = demo.where("t <= 20").drop("window_ix")
    for idle, state in ((3600.0, "LATE"), (0.5, "CALIBRATING")):
        folder = str(tmp_path / f"w{idle}")
        for _ in range(2):                      # the same windows again: known ones while the state lives, new ones later
            part.coalesce(1).write.mode("append").parquet(folder)
            out = live.drain(live.detect_windows_stream(spark.readStream.schema(part.schema).parquet(folder), cfg, idle), "idle", f"{folder}-run")
            time.sleep(1.5)
        assert sorted(r["state"] for r in out.collect()) == sorted(["CALIBRATING"] * 19 + [state] * 19)


def test_alert_lines_and_notifiers():
    a = {"t": 763.0, "level": "EARLY_WARNING", "index": 1.125, "slope_per_min": 0.2, "eta_min": 6.5, "message": "m"}
    assert notify.text(a) == "[12:43] EARLY WARNING | index +1.12 z | trend +0.20 z/min | ETA ~6 min\n  m"
    assert "ETA <1 min" in notify.text({**a, "eta_min": 0.4}) and "ETA" not in notify.text({**a, "level": "IMMINENT"})
    with pytest.raises(GuardError):
        notify.build(["pigeon"])
    with pytest.raises(GuardError):
        notify.build(["webhook"])


def test_simulator_truth_and_weights(spark):
    s = simulate.Script()
    t = np.arange(0, 3000, 7.0)
    df = spark.createDataFrame([(float(v),) for v in t], "t double").select(simulate.arousal_column(F.col("t"), s).alias("a"))
    np.testing.assert_allclose([r["a"] for r in df.collect()], simulate.arousal(t, s), atol=1e-12)
    assert information_weights({"a": -2.0, "b": 1.0}, {"a": 1.0, "b": 2.0}) == {"a": 0.8, "b": 0.2}
    with pytest.raises(GuardError):
        LiveConfig().with_profile("nope")


def test_wearable_csv(spark, tmp_path):
    cfg = LiveConfig()
    x = {c: np.random.default_rng(i).normal(0, 5, 700) for i, c in enumerate(("AF7", "TP9", "TP10", "AF8"))}
    write_csv(tmp_path / "w.csv", {"timestamp": np.arange(700), **x})
    b = wearable.read_wearable_csv(spark, str(tmp_path / "w.csv"), cfg, "s", block=256)
    assert live.live_windows(b, cfg).count() == 1
    assert b.where("channel = 'TP9' and start_ix = 256").first()["uv"] == pytest.approx(list(x["TP9"][256:512]))
    with pytest.raises(GuardError):
        wearable.pick_channels(["time", "TP9"], cfg)


def test_checklist_file(spark, tmp_path):
    (tmp_path / "b.csv").write_text("time_min,confused,irritable,boisterous,verbal_threats,physical_threats,attacking_objects\n4,0,1,true,yes,0,2\n")
    r = C.read_checklist(spark, str(tmp_path / "b.csv"), "s").first()
    assert (r["t"], r["score"]) == (240.0, 3)


def test_monitor_excerpt(spark):
    rows = [("1", w, i, [0.0, 1 / 128][i] if i < 2 else None, float(i)) for w in monitor.WAVES for i in range(1280)]
    rows += [("1", "BIS/SQI", i, 2.0 + i, 90.0 + i) for i in range(2)]
    tr = spark.createDataFrame(rows, "case_id string, tname string, row_ix long, t double, value double")
    e = monitor.excerpt(tr, 1.0, 8.0).orderBy("sample_ix").collect()
    assert len(e) == 1024 and e[0]["time_s"] == 1.0 and e[0]["BIS_EEG1"] == 128.0
    assert e[0]["SQI"] is None and e[128]["SQI"] == 90.0 and e[1023]["SQI"] is None
    for bad in ((-1.0, 1.0), (0.0, 0.0), (0.001, 1.0), (5.0, 60.0)):
        with pytest.raises(GuardError):
            monitor.excerpt(tr, *bad)
    listing = spark.createDataFrame([("1", monitor.WAVES[0], "a" * 40), ("2", monitor.WAVES[0], "b" * 40)], "caseid string, tname string, tid string")
    assert monitor.track_ids(listing, 1) == {monitor.WAVES[0]: "a" * 40}
    with pytest.raises(GuardError):
        monitor.track_ids(listing, 6389)


def test_sensor_sheets(spark):
    assert C.sensor_sheet(spark, "quatro_sensor").count() == 2 and C.sensor_sheet(spark, "eight_site_extended").count() == 8


def test_command_line(spark, tmp_path, capsys):
    path, meta = recording(tmp_path, n=1024)
    assert cli.main(["analyze", path, "--metadata", meta, "--out", str(tmp_path / "o")]) == 0
    assert json.loads(capsys.readouterr().out)["complete_epochs"] == 2
    f = {"subject_id": "s", "medication_profile_id": "m", "values": {"alpha_variance": 1.0}}
    c = {"subject_id": "t", "medication_profile_id": "m", "duration_s": 1, "context": "x"}
    for n, d in (("f", f), ("c", c)):
        (tmp_path / f"{n}.json").write_text(json.dumps(d))
    args = ["score", "--features", str(tmp_path / "f.json"), "--calibration", str(tmp_path / "c.json"), "--out", str(tmp_path / "r.json")]
    assert cli.main(args) == 2 and "subject_id" in capsys.readouterr().err
    (tmp_path / "c.json").write_text(json.dumps({**c, "subject_id": "s"}))
    assert cli.main(args) == 0 and json.loads((tmp_path / "r.json").read_text())["indices"]["SOI"]["score"] is None
    assert set(PROFILES) == {"meltdown", "psychosis"} and QualityPolicy().min_sqi == 80


def test_verified_pairs_are_reported(spark, tmp_path):
    t = np.arange(1024) / 128
    write_csv(tmp_path / "raw.csv", {"time_s": t, "c1": 10 * np.sin(2 * np.pi * 10 * t), "c2": 9 * np.sin(2 * np.pi * 10 * t + 0.7), "c3": t * 0 + np.cos(50 * t)})
    meta = {"sampling_rate_hz": 128, "eeg_unit": "uV", "eeg_columns": ["c1", "c2", "c3"], "subject_id": "r", "reference_verified": True,
            "channel_locations": {"c3": "P3", "c1": "Fp1", "c2": "P3"}}
    (tmp_path / "m.json").write_text(json.dumps(meta))
    rec = R.read_csv(spark, str(tmp_path / "raw.csv"), str(tmp_path / "m.json"))
    w = analyze_recording(rec).wide(rec.channels).toPandas()
    assert (w["pair_Fp1_P3__alpha_plv"] > 0.995).all() and w["pair_Fp2_P4__alpha_plv"].isna().all()
    rec.metadata["reference_verified"] = False
    assert analyze_recording(rec).pairs is None
