import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from rillwave.functions import scalars as S, sqlfuncs
from rillwave.model import GuardError, QualityPolicy, RDI_COMPONENTS, SOI_COMPONENTS
from rillwave.operators import asof, composite, epochs as E, evaluate, guards, labelled, montage, quality, recurrence, segments
from rillwave.plans import queries


def track(spark, rows, tname="BIS/SQI"):
    return spark.createDataFrame([("c", tname, i, t, v) for i, (t, v) in enumerate(rows)],
                                 "case_id string, tname string, row_ix long, t double, value double")


def test_asof_is_causal_with_inclusive_expiry(spark):
    clock = spark.createDataFrame([("c", float(t)) for t in (0, 1, 2, 3, 8, 9)], "case_id string, t double")
    for rows, want in (([(1.0, 80.0), (3.0, 90.0)], [None, 80, 80, 90, 90, None]),
                       ([(1.0, 80.0), (3.0, None)], [None, 80, 80, None, None, None])):
        got = asof.hold_numeric(clock, track(spark, rows).drop("tname"), ["case_id"], checked=False).orderBy("t").collect()
        assert [r["held"] for r in got] == want


def test_asof_over_bucket_edges_equals_search(spark):
    rng = np.random.default_rng(0)
    tt, q = np.sort(rng.uniform(0, 1000, 150)), np.sort(rng.uniform(0, 1000, 400))
    clock = spark.createDataFrame([("c", float(t)) for t in q], "case_id string, t double")
    tr = track(spark, [(float(t), float(i)) for i, t in enumerate(tt)]).drop("tname", "row_ix")
    got = [r["held"] for r in asof.hold_numeric(clock, tr, ["case_id"], max_age_s=5.0).orderBy("t").collect()]
    at = np.searchsorted(tt, q, side="right") - 1
    want = [float(i) if i >= 0 and t - tt[i] <= 5 else None for i, t in zip(at, q)]
    assert got == want


def test_backward_track_is_rejected(spark):
    clock = spark.createDataFrame([("c", 1.0)], "case_id string, t double")
    with pytest.raises(GuardError):
        asof.hold_numeric(clock, track(spark, [(2.0, 50.0), (1.0, 60.0)]), ["case_id"])


def test_track_steps_backwards_across_segments_and_gaps(spark):
    rows = [("c", n, i, t, 0.0) for n, i, t in (("a", 1, 5.0), ("b", 3, 1.0), ("a", 7, 4.0), ("b", 39, 2.0), ("b", 40, 2.0), ("a", 41, 6.0), ("a", 90, None), ("a", 97, 1.0))]
    df = spark.createDataFrame(rows, "case_id string, tname string, row_ix long, t double, value double")
    for reach in (1, 8, 65536):
        got = {r["tname"]: tuple(r)[2:] for r in asof.check_track(df, reach).collect()}
        assert got == {"a": (5, 1, 1), "b": (3, 0, 1)}


def test_compact_clock(spark):
    got = asof.compact_clock(track(spark, [(0.0, 1.0), (1 / 128, 2.0), (None, 3.0), (None, 4.0)])).orderBy("row_ix").collect()
    assert [r["t"] for r in got] == [i / 128 for i in range(4)]
    with pytest.raises(Exception, match="invalid waveform"):
        asof.compact_clock(track(spark, [(0.0, 1.0), (0.0, 2.0)])).collect()


def blocks(spark, x, rid="r", size=100):
    """x: channel -> samples; blocks deliberately not aligned to epochs."""
    rows = [(rid, c, i, [None if v is None or math.isnan(v) else float(v) for v in s[i:i + size]])
            for c, s in x.items() for i in range(0, len(s), size)]
    return spark.createDataFrame(rows, "recording_id string, channel string, start_ix long, uv array<double>")


def test_cut_reassembles_overlapping_windows(spark):
    x = np.arange(1000.0)
    got = {r["w"]: r["uv"] for r in E.cut(blocks(spark, {"a": x}, size=37), 256, "w", 128).collect()}
    assert sorted(got) == list(range(6))
    assert all(got[k] == list(x[k * 128:k * 128 + 256]) for k in got)


def verdict(spark, x, sqi=95.0, emg=25.0, policy=QualityPolicy(), need=False):
    stats = quality.signal_stats(E.cut(blocks(spark, x), 512))
    rows = [("r", i, n, v[i] if isinstance(v, list) else v) for n, v in (("SQI", sqi), ("EMG", emg)) if v is not None for i in range(512)]
    aux = spark.createDataFrame(rows, "recording_id string, sample_ix long, name string, value double") if rows else None
    wide = None if aux is None else quality.wide_numerics(quality.numeric_stats(aux, 512))
    flags = spark.createDataFrame([("r", sqi is not None, emg is not None, need)],
                                  "recording_id string, has_sqi boolean, has_emg boolean, require_sqi boolean")
    return quality.assess_epochs(stats, wide, policy, flags).first()


def waves(**change):
    x = {"a": np.sin(np.arange(512.0)), "b": np.cos(np.arange(512.0))}
    for c, (i, v) in change.items():
        x[c][i] = v
    return x


@pytest.mark.parametrize("kw, reasons, warnings", [
    ({}, [], []),
    ({"x": waves(a=(5, np.nan))}, ["missing_eeg_samples"], []),
    ({"x": waves(b=(30, 900.0))}, ["amplitude_outlier"], []),
    ({"x": {"a": np.sin(np.arange(512.0)), "b": np.ones(512)}}, ["flat_signal"], []),
    ({"sqi": [95.0] * 3 + [0.0] + [95.0] * 508}, ["low_sqi"], []),
    ({"sqi": 101.0}, ["invalid_sqi"], []),
    ({"sqi": [float("inf")] + [95.0] * 511}, ["missing_sqi"], []),
    ({"sqi": None, "need": True}, ["missing_sqi"], []),
    ({"sqi": None}, [], []),
    ({"emg": 40.0}, [], ["possible_muscle_contamination"]),
    ({"emg": None}, [], ["emg_quality_unknown"])])
def test_epoch_verdicts(spark, kw, reasons, warnings):
    r = verdict(spark, kw.pop("x", waves()), **kw)
    assert (r["reasons"], r["warnings"], r["accepted"]) == (reasons, warnings, not reasons)


def test_epoch_without_a_channel_has_missing_samples(spark):
    x = np.sin(np.arange(1536.0))
    b = blocks(spark, {"a": x}, size=512).union(blocks(spark, {"b": x}, size=512).where("start_ix <> 512"))
    stats = quality.signal_stats(E.cut(b, 512))
    for channels in (2, quality.channel_counts(b)):
        got = {r["epoch_ix"]: r["reasons"] for r in quality.assess_epochs(stats, channels=channels).collect()}
        assert got == {0: [], 1: ["missing_eeg_samples"], 2: []}
        past = quality.assess_histories(stats, 3, channels=channels).collect()
        assert [r["reasons"] for r in past] == [["missing_eeg_samples"]]


def test_policy_guards():
    for bad in ({"min_sqi": -1}, {"max_abs_uv": 0}, {"flat_std_uv": float("nan")}):
        with pytest.raises(GuardError):
            QualityPolicy(**bad)


def test_clock_report_finds_shifted_sample(spark):
    t = np.arange(512) / 128
    t[30] += 0.002
    s = spark.createDataFrame([("r", i, float(v)) for i, v in enumerate(t)], "recording_id string, sample_ix long, time_s double")
    for seg in (16, 65536):
        assert quality.clock_report(s, 128.0, seg).first()["n_bad_step"] == 2


def test_reserved_names_are_not_channels():
    for name in ("BIS", "BIS/SQI", "time_s"):
        with pytest.raises(GuardError):
            quality.check_sidecar(128.0, [name], ["time_s", name])


def test_history_flatness_spans_the_whole_history(spark):
    x = np.tile(np.sin(np.arange(512.0)), 4)
    x[512:1024] = 5.0                       # one flat epoch, but the history around it is not flat
    stats = quality.signal_stats(E.cut(blocks(spark, {"a": x}), 512))
    for seg in (1, 2, 512):
        h = {r["epoch_ix"]: r for r in quality.assess_histories(stats, 3, segment=seg).collect()}
        assert sorted(h) == [2, 3] and all(r["accepted"] for r in h.values())
        assert h[2]["min_sd"] == pytest.approx(np.std(x[:1536]), rel=1e-12)


def test_montage(spark):
    names = ["EEG Fp1-LE", "EEG Fp2-LE", "EEG F7-LE", "EEG Fpz-LE"]
    b = blocks(spark, {c: np.full(8, i + 1.0) for i, c in enumerate(names)})
    got = {r["channel"]: (set(r["uv"]), r["reference"]) for r in montage.rederive(b, "left").collect()}
    assert got == {"BISlike_Fp1_minus_ref": ({-3.0}, "Fpz"), "BISlike_F7_minus_ref": ({-1.0}, "Fpz")}
    twice = b.union(blocks(spark, {"Fp1-Z": np.full(8, 9.0)})).withColumn("position", F.expr("decode(channel, 'EEG Fp1-LE', 7, 'Fp1-Z', 2, 'EEG Fpz-LE', 1, 0)"))
    for later, want in (("EEG Fp1-LE", -3.0), ("Fp1-Z", 5.0)):      # a repeated site: the last channel of the recording
        moved = twice.withColumn("position", F.when(F.col("channel") == later, 8).otherwise(F.col("position")))
        assert {r["uv"][0] for r in montage.rederive(moved, "left").where("channel like '%Fp1%'").collect()} == {want}
    b = blocks(spark, {c: np.ones(8) for c in ("Fp1", "Fp2", "F7")})
    assert "approximate" in montage.rederive(b, "left").first()["reference"]
    for cols in (("Fp1", "Fp2", "Cz"), ("F7", "Cz")):
        with pytest.raises(GuardError):
            montage.rederive(blocks(spark, {c: np.ones(8) for c in cols}), "left")


def test_recurrences_do_not_depend_on_segments(spark):
    rng = np.random.default_rng(2)
    rows = [(k, float(t), float(v)) for k in ("a", "b") for t, v in enumerate(rng.normal(0.2, 1, 300))]
    df = spark.createDataFrame(rows, "k string, t double, x double")

    def run(size):
        lv = recurrence.scan(df, "k", "t", recurrence.Smoothing(0.1), "level", size=size, x="x")
        lv = lv.withColumn("cap", F.when(F.col("level") < 0.1, 0.4))
        return recurrence.scan(lv, "k", "t", recurrence.Accumulation(0.1), "s", size=size, x="x", cap="cap").orderBy("k", "t").toPandas()

    small, big = run(7.0), run(1e6)
    level = s = None
    for i, v in enumerate(r[2] for r in rows[:300]):
        level = v if level is None else level + 0.1 * (v - level)
        s = max(0.0, (s or 0.0) + v - 0.1)
        if level < 0.1:
            s = min(s, 0.4)
        assert (big["level"][i], big["s"][i]) == pytest.approx((level, s))
    np.testing.assert_allclose(small[["level", "s"]], big[["level", "s"]], atol=1e-12)


def test_recurrences_survive_a_join_that_turns_into_a_broadcast(spark):
    df = spark.range(6000).select((F.col("id") % 20).alias("k"), F.floor(F.col("id") / 20).cast("double").alias("t"), F.lit(1.0).alias("x"))
    # planned as a sort-merge join; its small side is broadcast once its size is known, and reads stay spread as over large tables
    large = {"autoBroadcastJoinThreshold": "-1", "adaptive.autoBroadcastJoinThreshold": "50KB", "adaptive.coalescePartitions.enabled": "false"}
    kept = {k: spark.conf.get(f"spark.sql.{k}", None) for k in large}
    for k, v in large.items():
        spark.conf.set(f"spark.sql.{k}", v)
    try:
        s = recurrence.scan(df, "k", "t", recurrence.Accumulation(0.5), "s", size=1.0, x="x")
        assert s.where("abs(s - (t + 1) * 0.5) > 1e-9 or s is null").count() == 0 and s.count() == 6000
    finally:
        for k, v in kept.items():
            spark.conf.unset(f"spark.sql.{k}") if v is None else spark.conf.set(f"spark.sql.{k}", v)


def test_interval_union_counts_overlap_once(spark):
    df = spark.createDataFrame([("a", 0.0, 10.0), ("a", 1.0, 11.0), ("a", 2.0, 12.0), ("b", 0.0, 100.0), ("b", 50.0, 60.0), ("b", 150.0, 151.0)],
                               "k string, a double, b double")
    for width in (1.0, 7.0, 4096.0):
        got = {r["k"]: r["duration_s"] for r in recurrence.union_duration(df, "k", "a", "b", width).collect()}
        assert got == {"a": 12.0, "b": 101.0}


def test_trend_and_quality_over_halo(spark):
    df = spark.createDataFrame([("a", float(t), 2.0 * t / 60, t % 3 != 0) for t in range(400)], "k string, t double, y double, ok boolean")
    for seg in (50.0, 1e6):
        r = recurrence.trend(df, "k", "t", "y", 180.0, segment_s=seg).orderBy("t").collect()
        assert len(r) == 400 and r[59]["slope_per_min"] is None and r[60]["slope_per_min"] == pytest.approx(2.0)
    o = recurrence.ordinal(df, "k", "t", size=37.0)
    q = recurrence.quality_fraction(o, "k", "ordinal", F.col("ok"), 60, segment=16).orderBy("t").collect()
    assert [r["ordinal"] for r in q] == list(range(400)) and q[399]["quality"] == pytest.approx(40 / 60)


def fixture():
    cal = {"subject_id": "s", "medication_profile_id": "m", "context": "illustrative_paper_example", "duration_s": 86400,
           "SOI": {"components": {c: {"mean": 1, "sd": 0.1} for c in SOI_COMPONENTS}},
           "RDI": {"components": {c: {"mean": 1, "sd": 0.1} for c in RDI_COMPONENTS}}}
    return {"values": {c: 1.0 for c in (*SOI_COMPONENTS, *RDI_COMPONENTS)}}, cal


def test_composite_arithmetic(spark):
    f, c = fixture()
    r = composite.score_documents(spark, f, c)["indices"]
    assert r["SOI"]["score"] == pytest.approx(0) and r["RDI"]["score"] == pytest.approx(100)
    f["values"].update(gating_efficiency=0.7, frontoparietal_plv=0.7, **{k: 1.15 for k in RDI_COMPONENTS})
    r = composite.score_documents(spark, f, c)["indices"]
    assert r["SOI"]["score"] == pytest.approx(40) and r["RDI"]["score"] == pytest.approx(50)


def test_worked_example(spark):
    cal = {"subject_id": "p", "medication_profile_id": "m", "context": "illustrative_paper_example", "duration_s": 86400, "RDI": {"components": {}},
           "SOI": {"components": {"alpha_variance": {"mean": 0.12, "sd": 0.07}, "gating_efficiency": {"mean": 0.85, "sd": 0.10},
                                  "posterior_gamma": {"mean": 4.2, "sd": 1.5}, "frontoparietal_plv": {"mean": 0.61, "sd": 0.09},
                                  "autonomic_surge": {"mean": 0.02, "sd": 0.03}}}}
    vals = {"alpha_variance": 0.38, "gating_efficiency": 0.54, "posterior_gamma": 8.9, "frontoparietal_plv": 0.33, "autonomic_surge": 0.11}
    r = composite.score_documents(spark, {"values": vals}, cal)["indices"]
    assert r["SOI"]["score"] == pytest.approx(100) and r["RDI"]["score"] is None and len(r["RDI"]["missing"]) == 5


def test_missing_parts_are_never_reweighted(spark):
    f, c = fixture()
    f["values"]["alpha_variance"] = float("nan")
    del f["values"]["posterior_gamma"]
    r = composite.score_documents(spark, f, c)["indices"]["SOI"]
    assert r["score"] is None and r["component_coverage"] == 0.6 and r["missing"] == ["alpha_variance", "posterior_gamma"]
    f, c = fixture()
    assert composite.score_documents(spark, f, {**c, "duration_s": 3600})["indices"]["RDI"]["score"] is None
    assert composite.score_documents(spark, f, {**c, "context": "anesthesia"})["indices"]["SOI"]["score"] is None


def test_planted_nulls_leave_scores_out(spark, tmp_path):
    import duckdb

    from checks.oracles import ORACLES
    from rillwave.plans import queries

    rows = [(i, 1, "view", 800.0 + i, '{"k": %d}' % (i * i)) for i in range(1, 6)]
    rows += [(20, 1, "purchase", 100.0, '{"k": 9}'), (21, 1, "purchase", None, '{"k": 9}'), (22, 1, "purchase", 100.0, "{}"),
             (23, 1, "purchase", 200.0, '{"k": 9}'), (24, 2, "purchase", 100.0, '{"k": 9}')]
    events = spark.createDataFrame(rows, "event_id long, user_id long, event_type string, value double, props string")
    events.selectExpr("event_id", "timestamp_seconds(event_id) AS ts", "user_id", "event_type", "value", "props").coalesce(1).write.parquet(
        str(tmp_path / "events.parquet"))
    got = {r.event_id: r for r in queries.soi_rdi_score(spark, str(tmp_path)).collect()}
    assert got[20].soi is not None and got[20].rdi is not None and got[20].soi_missing == ""
    assert got[21].soi is None and got[21].rdi is None and got[21].soi_missing == "alpha_variance,posterior_gamma,autonomic_surge"
    assert got[22].soi is None and got[22].soi_missing == "gating_efficiency,posterior_gamma,frontoparietal_plv"
    assert got[23].soi is not None and (got[23].soi_missing, got[23].soi_coverage) == ("", 1.0) and got[23].rdi is not None
    assert got[24].soi is None and got[24].issues == composite.NO_CALIBRATION
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{tmp_path}/events.parquet/*.parquet')")
    want = con.execute(ORACLES["soi_rdi_score"]).fetchdf().set_index("event_id")
    for i, r in got.items():
        assert r.soi_missing == want.soi_missing[i] or i == 24
        assert (r.soi is None) == (want.soi[i] != want.soi[i]) and (r.soi is None or r.soi == pytest.approx(want.soi[i]))


@pytest.mark.parametrize("change", [
    lambda c: c.update(duration_s=float("nan")),
    lambda c: c["SOI"]["components"]["alpha_variance"].update(sd=0),
    lambda c: c["RDI"]["components"]["temporal_csd"].update(sd=float("inf")),
    lambda c: c["SOI"].update(weights={n: 1 for n in SOI_COMPONENTS}),
    lambda c: c["SOI"].update(weights={"alpha_variance": 1.0})])
def test_invalid_calibrations_are_errors(spark, change):
    f, c = fixture()
    change(c)
    with pytest.raises(GuardError):
        composite.score_documents(spark, f, c)


def test_identity_guards():
    for a, b in (({"subject_id": "x"}, {"subject_id": "x"}), ({"subject_id": "x", "medication_profile_id": "m"}, {"subject_id": "y", "medication_profile_id": "m"})):
        with pytest.raises(GuardError):
            composite.check_identity(a, b)


def calib(spark, **cols):
    base = {"time_s": [0.0, 1, 2, 3, 4], "epoch_end_s": [1.0, 2, 3, 4, 5], "subject_id": ["A", "A", "A", "B", "A"],
            "recording_context": ["awake_personal_baseline"] * 5, "research_label": ["baseline"] * 4 + ["pre_meltdown"],
            "posterior_gamma": [1.0, 2, 3, 1000, 1000]}
    base.update(cols)
    return spark.createDataFrame([{k: float(v) if isinstance(v, int) else v for k, v in zip(base, r)} for r in zip(*base.values())])


def test_epochs_without_a_length_add_values_and_no_duration(spark):
    for ends, instants, problems in (([0.0, 2, 3, 4, 5], True, 0), ([0.0, 2, 3, 4, 5], False, 1), ([-1.0, 2, 3, 4, 5], True, 1)):
        r = composite.fit_calibrations(calib(spark, epoch_end_s=ends), instants=instants).where("subject_id = 'A'").first()
        assert len(r["problems"]) == problems and r["duration_s"] == 2.0 and r["RDI"]["components"] == {}
        assert tuple(r["SOI"]["components"]["posterior_gamma"]) == (2.0, 1.0, 3)


def event(i, kind, value, k):
    return i, 7, kind, value, json.dumps({"k": k})


def test_events_of_value_zero_are_calibrated_and_scored(spark, tmp_path):
    rows = [event(0, "view", 3.0, 5), event(1, "click", 0.0, 9), event(2, "signup", 8.0, 40), event(3, "purchase", 2.0, 7)]
    spark.createDataFrame(rows, "event_id long, user_id long, event_type string, value double, props string").write.parquet(f"{tmp_path}/events.parquet")
    fit = queries.calibration_fit(spark, str(tmp_path)).collect()
    assert len(fit) == 10 and {(r["n_problems"], r["n"], r["duration_s"]) for r in fit} == {(0, 3, 1080.0)}
    (r,) = queries.soi_rdi_score(spark, str(tmp_path)).collect()
    assert (r["soi_coverage"], r["soi_missing"], r["issues"]) == (1.0, "", "calibration_shorter_than_article_24h")


def test_calibration_of_one_subject(spark):
    r = composite.require_calibration(calib(spark), "A").first()
    assert r["SOI"]["components"]["posterior_gamma"]["mean"] == 2 and r["SOI"]["components"]["posterior_gamma"]["sd"] == 1
    assert r["duration_s"] == 3 and r["medication_profile_id"] == "not_recorded"


@pytest.mark.parametrize("cols", [{"posterior_gamma": [1.0] * 5}, {"recording_context": ["perioperative_anesthesia"] * 5},
                                  {"medication_profile_id": ["A", "A", "B", "A", "A"]}, {"epoch_end_s": [0.0, 2, 3, 4, 5]},
                                  {"research_label": ["baseline", "baseline"] + ["pre_meltdown"] * 3}, {"posterior_gamma": [1.0, 2, float("nan"), 1, 1]}])
def test_calibration_guards(spark, cols):
    with pytest.raises(GuardError):
        composite.require_calibration(calib(spark, **cols), "A")


def test_scalar_rules(spark):
    df = spark.createDataFrame([("EEG Fp1-REF", 0), ("Fp1-LE", 1), (" FP1", 3)], "n string, s int")
    assert [r[0] for r in df.select(S.site_of(F.col("n"))).collect()] == ["fp1"] * 3
    assert [r[0] for r in df.select(S.bvc_band(F.col("s"))).collect()] == ["low", "moderate", "very_high"]
    assert [tuple(r[0]) for r in spark.createDataFrame([("AF8",), ("X1",)], "c string").select(S.region_of(F.col("c"))).collect()] == [
        ("right frontal", "R"), ("X1", "?")]
    p = spark.createDataFrame([(15.0, 0.5, 0.25), (60.0, 2.0, -1.0), (None, 0.5, 0.2)], "a double, b double, c double")
    assert [r[0] for r in p.select(S.depth_proxy(F.col("a"), F.col("b"), F.col("c"))).collect()] == pytest.approx([100 * 1.75 / 3, 100.0, None])
    u = spark.createDataFrame([(1.0, "V"), (1.0, "uV")], "v double, u string")
    assert [r[0] for r in u.select(S.to_microvolts(F.col("v"), F.col("u"))).collect()] == [1e6, 1.0]
    with pytest.raises(Exception, match="eeg_unit"):
        spark.createDataFrame([(1.0, "x")], "v double, u string").select(S.to_microvolts(F.col("v"), F.col("u"))).collect()


def test_sql_functions(spark):
    sqlfuncs.register(spark, 128.0)
    x = [float(v) for v in 10 * np.sin(2 * np.pi * 10 * np.arange(512) / 128)]
    spark.createDataFrame([(x,)], "uv array<double>").createOrReplaceTempView("one_epoch")
    r = spark.sql("select spectral_features(uv).alpha_power_uv2 a, plv(uv, uv) p, site_of('EEG Fp1-LE') s, bvc_band(3) b from one_epoch").first()
    assert r["a"] == pytest.approx(50) and r["p"] == pytest.approx(1) and (r["s"], r["b"]) == ("fp1", "very_high")


def test_votes_break_ties_alphabetically(spark):
    df = spark.createDataFrame([("s", "x", "b"), ("s", "x", "a"), ("t", "y", "y"), ("t", "y", "y"), ("t", "y", "a")], "subject_id string, truth string, pred string")
    assert {r["subject_id"]: (r["pred"], r["epochs"]) for r in labelled.majority_vote(df).collect()} == {"s": ("a", 2), "t": ("y", 3)}


def test_lead_times_and_false_alarms(spark):
    ev = spark.createDataFrame([("s", 1320.0)], "session_id string, t double")
    al = spark.createDataFrame([("s", 763.2, "EARLY_WARNING"), ("s", 900.0, "EARLY_WARNING"), ("s", 420.0, "EARLY_WARNING"), ("s", 419.0, "EARLY_WARNING"),
                                ("s", 1108.8, "IMMINENT"), ("s", 1320.0, "IMMINENT"), ("s", 2000.0, "IMMINENT"), ("s", 600.0, "CLINICAL_RISK")],
                               "session_id string, t double, level string")
    r = evaluate.lead_times(ev, al).first()
    assert (r["early_warning_lead_min"], r["imminent_lead_min"], r["event_min"]) == (15.0, 3.52, 22.0)
    assert sorted(x["alert_t"] for x in evaluate.false_alarms(ev, al, 10.0).collect()) == [419.0, 420.0, 2000.0]
    e = evaluate.evaluation(ev, al, 10.0).first()
    assert (e["n_alerts"], e["false_alarms"], e["detected_early"], e["detected_imminent"]) == (7, 3, 1, 1)


def test_manifest_guards(spark):
    ok = spark.createDataFrame([("a.edf", "s1", "ASD"), ("b.edf", "s2", "HC")], "file string, subject_id string, `group` string")
    guards.enforce(guards.manifest_report(ok))
    for row in (("c.edf", "s3", "XYZ"), ("c.edf", "s1", "ASD"), ("c.edf", "a/b", "ASD"), ("c.edf", ".x", "ASD")):
        with pytest.raises(GuardError):
            guards.enforce(guards.manifest_report(ok.union(spark.createDataFrame([row], ok.schema))))
    with pytest.raises(GuardError):
        guards.manifest_report(ok.drop("group"))


def test_halo_copies_only_what_is_needed(spark):
    df = spark.range(100).select(F.col("id").alias("p"))
    h = segments.with_halo(df, "p", 10, 3)
    assert h.where("is_own").count() == 100 and h.where("not is_own").count() == 30


def test_features_without_calibration_keep_their_row(spark):
    from rillwave.model import CALIBRATION

    vals = "map('alpha_variance', 1.0D)"
    f = spark.sql(f"SELECT 'b' AS subject_id, 'none' AS medication_profile_id, {vals} AS values "
                  f"UNION ALL SELECT NULL, 'none', {vals}")
    rows = composite.score(composite.match_calibration(f, spark.createDataFrame([], CALIBRATION)), strict=False).collect()
    assert len(rows) == 2
    for r in rows:
        assert r["problems"] == [composite.NO_CALIBRATION] and r["SOI_result"] is None and r["RDI_result"] is None
