"""Detector over stored sessions, exact and parallel inside a session.

The transition is nonlinear in its state, so it has no summary to compose. Instead a long session
is cut into segments of a fixed number of windows, every segment is run from a guessed start, and
starts are corrected to the end state of the segment before until nothing changes any more. The
fixed point is the sequential result, bit for bit; each round re-runs only segments whose start
changed. The detector forgets (its level decays in seconds, its centres in minutes of calm), so
with segments of hours a few rounds suffice. Sessions of one segment need no round at all.

A task walks rows sorted by session and segment and holds the state of the open segment only.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F, types as T

from ..model import STEPS, LiveConfig
from ..operators.recurrence import ordinal, sorted_runs
from ..session import cut_lineage
from . import machine as M

_STEP_COLUMNS = [f.name for f in STEPS.fields]


def plain(v):
    """Rows nested in pandas cells -> dicts."""
    return v.asDict(recursive=True) if hasattr(v, "asDict") else v


def records(pdf: pd.DataFrame) -> list[dict]:
    names = list(pdf.columns)
    out = []
    for values in zip(*[pdf[c].tolist() for c in names]):
        row = dict(zip(names, values))
        row["bvc"] = plain(row.get("bvc"))
        if row.get("channels") is not None:
            row["channels"] = {c: plain(v) for c, v in dict(row["channels"]).items()}
        out.append(row)
    return out


def steps_frame(sessions: str | list[str], steps: list[dict]) -> pd.DataFrame:
    frame = pd.DataFrame(steps, columns=_STEP_COLUMNS[1:])
    frame.insert(0, "session_id", sessions)
    for f in STEPS.fields:
        if isinstance(f.dataType, T.DoubleType):
            frame[f.name] = frame[f.name].astype(float)
        elif f.name == "alert":
            frame[f.name] = frame[f.name].astype(object).where(frame[f.name].notna(), None)
    return frame


_KEYS = ["session_id", "segment"]


def _walk(frames: Iterator[pd.DataFrame], cfg: LiveConfig):
    """Rows sorted by (session, segment, t) -> per frame (keys of the steps, steps, ends of closed segments).

    The first row of a segment carries its start state, or nothing when that is a fresh state.
    """
    open_key = state = None
    for pdf in frames:
        keys, steps, ends = [], [], []
        for row in records(pdf):
            key = (row["session_id"], row["segment"])
            if key != open_key:
                if open_key is not None:
                    ends.append((*open_key, state))
                open_key, state = key, M.loads(row["start"]) if row["start"] else M.fresh(cfg)
            new = M.run_rows(state, [row], cfg)
            steps += new
            keys += [key] * len(new)
        yield keys, steps, ends
    if open_key is not None:
        yield [], [], [(*open_key, state)]


def _sorted_rows(rows: DataFrame, starts: DataFrame | None, segment_windows: int) -> DataFrame:
    """Rows in walking order: first segments from a fresh state, or those of `starts`.

    Start states are attached to first rows only, so they travel once.
    """
    nothing = F.lit(None).cast("string").alias("start")
    if starts is None:
        staged = rows.where("segment = 0").select("*", nothing)
    else:
        first = F.col("ordinal") % segment_windows == 0
        staged = (rows.where(first).join(starts.select(*_KEYS, "start"), _KEYS)
                  .unionByName(rows.where(~first).join(starts.select(*_KEYS), _KEYS, "left_semi").select("*", nothing)))
    return sorted_runs(staged, *_KEYS, "ordinal")


_WALKED = T.StructType([*STEPS.fields, T.StructField("segment", T.LongType()), T.StructField("end", T.StringType())])


def run_sessions(windows: DataFrame, cfg: LiveConfig, segment_windows: int = 16384) -> DataFrame:
    """Steps of every session from WINDOWS rows (plus ``bvc`` from ``with_clinical``, if any).

    Each turn walks the segments whose start has changed and keeps their steps and end states; starts are then set to
    the end of the segment before. When none changes, the last steps of each segment are those of the whole session.
    """
    # windows stand for kilobytes of raw signal each: compute them once, then only walk them
    windows = cut_lineage(windows)
    rows = ordinal(windows, "session_id", "t").withColumn("segment", F.floor(F.col("ordinal") / segment_windows).cast("long"))
    fresh, text = M.dumps(M.fresh(cfg)), F.lit(None).cast("string")
    known = rows.select(*_KEYS).distinct().select(*_KEYS, F.when(F.col("segment") == 0, F.lit(fresh)).alias("start"),
                                                  text.alias("end"), F.lit(None).cast("int").alias("turn"))
    before = W.partitionBy("session_id").orderBy("segment")

    def walk(frames):
        for keys, steps, ends in _walk(frames, cfg):
            if steps:
                ids, segments = zip(*keys)
                yield steps_frame(list(ids), steps).assign(segment=segments, end=None)
            if ends:
                ids, segments, states = zip(*ends)
                yield steps_frame(list(ids), [dict.fromkeys(_STEP_COLUMNS)] * len(ends)).assign(segment=segments, end=[*map(M.dumps, states)])

    if not rows.where("segment > 0").limit(1).count():                       # the first segments are all there is: one walk is the result
        def steps_only(frames):
            for keys, steps, _ in _walk(frames, cfg):
                if steps:
                    yield steps_frame([k[0] for k in keys], steps)

        return _sorted_rows(rows, None, segment_windows).mapInPandas(steps_only, STEPS)
    todo, turns = None, []
    while True:
        ran = cut_lineage(_sorted_rows(rows, todo, segment_windows).mapInPandas(walk, _WALKED))
        turn = F.lit(len(turns))
        turns.append(ran.where("end is null").drop("end").withColumn("turn", turn))
        ends = (known.join(ran.where("end is not null").select(*_KEYS, F.col("end").alias("now")), _KEYS, "left")
                .withColumn("end", F.coalesce("now", "end")).withColumn("turn", F.when(F.col("now").isNotNull(), turn).otherwise(F.col("turn"))))
        # until the segment before has run, the newest known state of the session is the guess
        given = F.coalesce(F.lag("end").over(before), F.last("end", ignorenulls=True).over(before.rowsBetween(W.unboundedPreceding, -1)))
        fixed = ends.withColumn("_next", F.when(F.col("segment") == 0, F.col("start")).otherwise(given))
        known = cut_lineage(fixed.select(*_KEYS, F.col("_next").alias("start"), "end", "turn",
                                         (~F.col("_next").eqNullSafe(F.col("start"))).alias("changed")))
        todo = known.where("changed").select(*_KEYS, "start")
        if not todo.take(1):
            break
    steps = reduce(DataFrame.unionByName, turns)
    if len(turns) > 1:
        steps = steps.join(known.select(*_KEYS, "turn"), [*_KEYS, "turn"], "left_semi")
    return steps.select(*_STEP_COLUMNS)
