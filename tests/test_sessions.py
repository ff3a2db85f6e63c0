"""Event-time sessions, interval joins and vectorised recurrences at their edges."""

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from rillwave.operators import intervals, recurrence
from rillwave.streaming import eventtime


def test_sessions_close_by_the_watermark_and_leave_no_state(spark):
    def wave(*rows):
        return spark.createDataFrame([(k, s, float(s)) for k, s in rows], "session_id string, s int, value double").select(
            "session_id", F.timestamp_seconds("s").alias("at"), "value")

    # gap 10 s, watermark 5 s behind: a's rows come out of order, b stays open until the third wave
    waves = [wave(("a", 108), ("a", 100), ("a", 118), ("a", 140), ("b", 150), (None, 150)),
             wave(("a", 120), ("a", 149), ("b", 147), ("b", 160)),
             wave(("c", 300))]
    bases = []

    def operator(rows):
        out = eventtime.sessions(rows, gap_s=10.0, delay_s=5.0)
        bases.append(rows)
        return out

    got = eventtime.replayed(waves, operator)
    rows = sorted((r.session_id, r.kind, r.start_ms // 1000, r.end_ms // 1000, r.n, r.total) for r in got.collect())
    assert rows == [("a", "LATE", 120, 120, 1, 120.0), ("a", "SESSION", 100, 118, 3, 326.0), ("a", "SESSION", 140, 149, 2, 289.0),
                    ("b", "SESSION", 147, 160, 3, 457.0)]
    base = got.inputFiles()[0].removeprefix("file:").split("/out/")[0]
    left = spark.read.format("statestore").option("stateVarName", "open").load(f"{base}/progress")
    assert [r.session_id for r in left.select("key.session_id").collect()] == ["c"]


def test_joined_spans():
    spans = pd.DataFrame({"start_ms": [50, 0, 12, 30], "end_ms": [55, 10, 20, 45], "n": [1, 2, 3, 4], "total": [1.0, 2.0, 3.0, 4.0]})
    assert eventtime.joined(spans, 5).values.tolist() == [[0, 20, 5, 5.0], [30, 55, 5, 5.0]]
    assert eventtime.joined(spans.iloc[:0], 5).empty


def test_merged_spans_equal_brute_force():
    rng = np.random.default_rng(4)
    for _ in range(200):
        n, gap = int(rng.integers(0, 12)), int(rng.integers(0, 6))
        start = rng.integers(0, 60, n)
        spans = [start, start + rng.integers(0, 9, n), rng.integers(1, 4, n), rng.integers(0, 9, n).astype(float)]
        want = []
        for row in sorted(zip(*(c.tolist() for c in spans))):
            if want and row[0] - want[-1][1] <= gap:
                want[-1] = [want[-1][0], max(want[-1][1], row[1]), want[-1][2] + row[2], want[-1][3] + row[3]]
            else:
                want.append(list(row))
        assert [list(r) for r in zip(*(c.tolist() for c in eventtime.merged(spans, gap)))] == want


def test_a_key_touches_its_state_only_when_it_changes():
    calls = []

    class State:
        kept = None

        def __getattr__(self, name):
            calls.append(name)
            return {"get": lambda: self.kept, "exists": lambda: self.kept is not None, "update": lambda v: setattr(self, "kept", v),
                    "clear": lambda: setattr(self, "kept", None)}[name]

    class Handle:
        def getValueState(self, *_):
            return State()

        def registerTimer(self, at):
            calls.append(at)

    class Clock:
        def __init__(self, ms):
            self.getCurrentWatermarkInMs = lambda: ms

    def turn(act):
        calls.clear()
        return [r for f in act for r in f.itertuples(index=False, name=None)], list(calls)

    rows = lambda *at: iter([pd.DataFrame({"at_ms": np.array(at, np.int64), "value": [1.0] * len(at)})])
    sessions = eventtime.GapSessions(10)
    sessions.init(Handle())
    assert turn(sessions.handleInputRows(("a",), rows(5, 12, 40), Clock(0))) == ([], ["get", "update", 22])
    assert turn(sessions.handleInputRows(("a",), rows(3), Clock(4))) == ([("a", "LATE", 3, 3, 1, 1.0)], [])
    assert turn(sessions.handleExpiredTimer(("a",), Clock(22), None)) == ([], ["get", 22])
    assert turn(sessions.handleExpiredTimer(("a",), Clock(23), None)) == ([("a", "SESSION", 5, 12, 2, 2.0)], ["get", "update", 50])
    assert turn(sessions.handleExpiredTimer(("a",), Clock(51), None)) == ([("a", "SESSION", 40, 40, 1, 1.0)], ["get", "clear"])
    assert turn(sessions.handleExpiredTimer(("a",), Clock(60), None)) == ([], ["get", "clear"])


@pytest.mark.parametrize("crowd", [1, 3, 4096])
def test_interval_join_equals_brute_force(spark, crowd):
    rng = np.random.default_rng(crowd)
    left = [(i, "hot" if i % 3 else "k" + str(i % 4), float(b), float(b + n)) for i, (b, n) in
            enumerate(zip(rng.integers(-50, 50, 120), rng.choice([0, 1, 2, 7, 40, -1], 120)))] + [(900, None, 0.0, 1.0), (901, "hot", None, 1.0)]
    right = [(i, "hot" if i % 3 else "k" + str(i % 5), float(a)) for i, a in enumerate(rng.integers(-60, 60, 200))] + [(900, None, 0.0), (901, "hot", None)]
    right += right[:3]
    met = intervals.interval_join(spark.createDataFrame(left, "i long, k string, b double, e double"),
                                  spark.createDataFrame(right, "j long, k string, at double"), "k", "b", "e", "at", crowd)
    want = sorted((i, j) for i, k, b, e in left for j, q, a in right if k is not None and k == q and None not in (b, e, a) and b <= a <= e)
    assert sorted((r.i, r.j) for r in met.collect()) == want
    empty = intervals.interval_join(spark.createDataFrame([], "k string, b double, e double"), spark.createDataFrame([], "k string, at double"), "k", "b", "e", "at")
    assert empty.collect() == []


@pytest.mark.parametrize("op,cols", [(recurrence.Smoothing(0.3), 1), (recurrence.Accumulation(0.2), 2)])
@pytest.mark.parametrize("cut", [1, 4, 50])
def test_running_composition_across_batches(op, cols, cut):
    rng = np.random.default_rng(cut)
    n, groups = 50, np.repeat([0, 1, 2], [1, 29, 20])
    x, cap = rng.normal(size=n), np.where(rng.random(n) < 0.3, 0.5, np.nan)
    table = pa.RecordBatch.from_arrays([pa.array(groups), pa.array(groups)], names=["k", "g"])
    data = [x, cap][:cols]
    place = iter(range(0, n, cut))

    def parts(batch):
        at = next(place)
        return op.lift(*[d[at:at + batch.num_rows] for d in data])

    found = [np.concatenate(c) for c in zip(*[p for _, _, p in recurrence._running(op, (table.slice(i, cut) for i in range(0, n, cut)), ("k", "g"), parts)])]
    got = op.value([np.full(n, np.nan)] * 3, found)
    state, want = None, []
    for i in range(n):
        fresh = i == 0 or groups[i] != groups[i - 1]
        if cols == 1:
            state = x[i] if fresh else state + 0.3 * (x[i] - state)
        else:
            state = max(0.0, (0.0 if fresh else state) + x[i] - 0.2)
            state = state if np.isnan(cap[i]) else min(state, cap[i])
        want.append(state)
    assert np.allclose(got, want, atol=1e-12)


def test_trend_over_windows_longer_than_the_session(spark):
    rng = np.random.default_rng(2)
    t = np.sort(rng.choice(np.arange(0.0, 500_000.0, 7.0), 300, replace=False))
    y = np.cumsum(rng.normal(size=300))
    df = spark.createDataFrame([("s", float(a), float(b)) for a, b in zip(t, y)], "k string, t double, y double")
    got = [r.slope_per_min for r in recurrence.trend(df, "k", "t", "y", 100_000.0).orderBy("t").collect()]
    for i, slope in enumerate(got):
        inside = (t <= t[i]) & (t >= t[i] - 100_000.0)
        if inside.sum() < 10:
            assert slope is None
        else:
            assert slope == pytest.approx(60 * np.polyfit(t[inside] - t[i], y[inside], 1)[0], rel=1e-6, abs=1e-9)
