"""Sequential recurrences over sessions, computed in parallel segments.

Every recurrence here composes: the effect of a whole segment on the incoming state is again a
small function of the same kind (affine for smoothing, clamp for accumulation). Segments are
summarised independently, summaries are composed up a fixed three-level tree, and each segment
is then replayed from its exact start. A session may hold any share of the rows: its segments
spread over tasks, and a task passes over sorted Arrow batches, each as a whole by doubling steps,
holding only the summary of the open segment between them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..session import cut_lineage
from .segments import own_rows, segment_of, with_halo

_FAN = 4096


class Smoothing:
    """Level of x with weight a; the first value initialises it. Summary: (A, B, end when first)."""

    inputs = ("x",)

    def __init__(self, alpha: float):
        self.alpha = alpha

    def lift(self, x: np.ndarray) -> list[np.ndarray]:
        """The summary of each single row."""
        return [np.full(len(x), 1.0 - self.alpha), self.alpha * x, x]

    def compose(self, p, q):
        return [p[0] * q[0], q[0] * p[1] + q[1], q[0] * p[2] + q[1]]

    def value(self, before, own):
        """State behind ``own`` when ``before`` (NaN: nothing) came first in its key."""
        return np.where(np.isnan(before[2]), own[2], own[0] * before[2] + own[1])


class Accumulation:
    """One-sided sum max(0, S + x - k), capped where a cap is given. Summary: clamp (shift, low, high)."""

    inputs = ("x", "cap")

    def __init__(self, k: float):
        self.k = k

    def lift(self, x: np.ndarray, cap: np.ndarray) -> list[np.ndarray]:
        high = np.where(np.isnan(cap), np.inf, cap)
        return [x - self.k, np.minimum(0.0, high), high]

    def compose(self, p, q):
        clamp = lambda s: np.minimum(q[2], np.maximum(q[1], s + q[0]))
        return [p[0] + q[0], clamp(p[1]), clamp(p[2])]

    def value(self, before, own):
        clamp = lambda c, s: np.minimum(c[2], np.maximum(c[1], s + c[0]))
        return clamp(own, np.where(np.isnan(before[0]), 0.0, clamp(before, 0.0)))


def running(op, parts: list[np.ndarray], first: np.ndarray) -> list[np.ndarray]:
    """Running composition of row summaries inside each group (``first`` marks group starts), by doubling steps.

    After step d every row holds the composition of the up to 2 d rows that end with it.
    """
    at = np.arange(len(first))
    start = np.maximum.accumulate(np.where(first, at, 0))
    parts, d = [p.copy() for p in parts], 1
    while len(reach := np.flatnonzero(at - d >= start)):
        new = op.compose([p[reach - d] for p in parts], [p[reach] for p in parts])
        for p, v in zip(parts, new):
            p[reach] = v
        d *= 2
    return parts


def _doubles(column: pa.Array) -> np.ndarray:
    return column.cast(pa.float64()).to_numpy(zero_copy_only=False)


def _summaries(column: pa.Array) -> list[np.ndarray]:
    """A column of three-number summaries as three arrays; NaN where there is none."""
    out = np.full((len(column), 3), np.nan)
    out[column.is_valid().to_numpy(zero_copy_only=False)] = column.flatten().to_numpy(zero_copy_only=False).reshape(-1, 3)
    return list(out.T)


def _lists(parts: list[np.ndarray]) -> pa.Array:
    """Three arrays as a column of summaries; null where all are NaN."""
    known = ~np.isnan(parts[0])
    offsets = np.concatenate([[0], np.cumsum(3 * known)]).astype(np.int32)
    flat = np.stack(parts, axis=1)[known].ravel()
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat), mask=pa.array(~known))


def _running(op, batches, columns: tuple[str, str], parts_of):
    """Per batch of rows sorted by two columns: (batch, group starts, running composition), carried across batches."""
    group = carry = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = [batch.column(c) for c in columns]
        first = np.zeros(batch.num_rows, bool)
        for k in keys:
            first[1:] |= pc.not_equal(k.slice(1), k.slice(0, len(k) - 1)).fill_null(True).to_numpy(zero_copy_only=False)
        goes_on = group == tuple(k[0].as_py() for k in keys)
        first[0] = True
        parts = running(op, parts_of(batch), first)
        if goes_on:
            own = int(np.argmax(np.append(first[1:], True))) + 1          # rows of the group that was open
            for p, v in zip(parts, op.compose([np.full(own, c) for c in carry], [p[:own] for p in parts])):
                p[:own] = v
            first[0] = False
        yield batch, first, parts
        group, carry = tuple(k[-1].as_py() for k in keys), [p[-1] for p in parts]


def sorted_runs(df: DataFrame, *cols: str) -> DataFrame:
    """Rows hashed by the first two columns and sorted by all of them.

    The partition count is given, because byte-sized coalescing would put a Python-heavy walk over
    compact rows into a few tasks. Rows are placed by a digest of the columns: Spark drops a shuffle by the
    columns themselves when a join on them came before, and that join may turn into a broadcast with local
    reads while it runs, which leaves a run spread over tasks.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(parts, F.xxhash64(*cols[:2])).sortWithinPartitions(*cols)


def scan(df: DataFrame, key: str, position: str, op, out: str, size: float = 65536.0, **columns: str) -> DataFrame:
    """Append the running value ``out`` of ``op`` per key in order of ``position``.

    ``columns`` names the column behind each input of the operator (x=..., cap=...).
    """
    rows = df.withColumn("segment", segment_of(F.col(position), size)).withColumn("_pos", F.col(position).cast("double"))
    values = []
    for i in op.inputs:
        rows = rows.withColumn(f"_{i}", (F.col(columns[i]) if i in columns else F.lit(None)).cast("double"))
        values.append(f"_{i}")
    kind = df.schema[key].dataType.simpleString()

    def summaries(group_col: str, parts_of):
        """Mapper that composes each sorted run of rows into one summary row."""
        def run(batches):
            last = None
            for batch, first, parts in _running(op, batches, (key, group_col), parts_of):
                ends = np.flatnonzero(first[1:])                          # rows before the start of another group
                out = [(batch.column(key)[int(i)].as_py(), batch.column(group_col)[int(i)].as_py(), [p[i] for p in parts]) for i in ends]
                if last is not None and first[0]:
                    out.insert(0, last)
                last = (batch.column(key)[-1].as_py(), batch.column(group_col)[-1].as_py(), [p[-1] for p in parts])
                yield from emitted(out)
            if last is not None:
                yield from emitted([last])

        def emitted(rows):
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[0] for r in rows], type=key_type), pa.array([r[1] for r in rows], pa.int64()),
                     _lists([np.array([r[2][i] for r in rows]) for i in range(3)])], names=[key, group_col, "p"])
        return run

    key_type = to_arrow_type(df.schema[key].dataType)
    slim = rows.select(key, "segment", "_pos", *values)
    # one row per segment: kept, so that the input is read once for summaries and once for the replay
    level1 = cut_lineage(sorted_runs(slim, key, "segment", "_pos")
                         .mapInArrow(summaries("segment", lambda b: op.lift(*[_doubles(b.column(v)) for v in values])), f"{key} {kind}, segment long, p array<double>")
                         .withColumn("fan", F.floor(F.col("segment") / _FAN).cast("long")))
    level2 = (sorted_runs(level1, key, "fan", "segment")
              .mapInArrow(summaries("fan", lambda b: _summaries(b.column("p"))), f"{key} {kind}, fan long, p array<double>"))

    def prefixes(batches):
        """Exclusive running composition inside each sorted run, behind the run's own ``first``."""
        tail = None
        for batch, first, parts in _running(op, batches, (key, "run"), lambda b: _summaries(b.column("p"))):
            seed = _summaries(batch.column("first"))
            earlier = [np.concatenate([[t], p[:-1]]) for t, p in zip(tail or [np.nan] * 3, parts)]
            whole = op.compose(seed, earlier)
            before = [np.where(first, s, np.where(np.isnan(seed[0]), e, w)) for s, e, w in zip(seed, earlier, whole)]
            tail = [p[-1] for p in parts]
            yield pa.RecordBatch.from_arrays([batch.column(key), batch.column("item"), _lists(before)], names=[key, "item", "before"])

    shape = f"{key} {kind}, item long, before array<double>"
    none = F.lit(None).cast("array<double>")
    tops = (sorted_runs(level2.select(key, F.lit(0).cast("long").alias("run"), F.col("fan").alias("item"), "p",
                                     none.alias("first")), key, "run", "item")
            .mapInArrow(prefixes, shape).select(key, F.col("item").alias("fan"), F.col("before").alias("first")))
    starts = (sorted_runs(level1.join(tops, [key, "fan"])
                         .select(key, F.col("fan").alias("run"), F.col("segment").alias("item"), "p", "first"),
                         key, "run", "item")
              .mapInArrow(prefixes, shape).select(key, F.col("item").alias("segment"), F.col("before").alias("_before")))
    schema = T.StructType(df.schema.fields + [T.StructField(out, T.DoubleType())])
    names = df.columns

    def replay(batches):
        for batch, _, parts in _running(op, batches, (key, "segment"), lambda b: op.lift(*[_doubles(b.column(v)) for v in values])):
            result = op.value(_summaries(batch.column("_before")), parts)
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in names] + [pa.array(result, mask=np.isnan(result))], names=[*names, out])

    return sorted_runs(rows.join(starts, [key, "segment"]), key, "segment", "_pos").mapInArrow(replay, schema)


def ordinal(df: DataFrame, key: str, position: str, out: str = "ordinal", size: float = 65536.0) -> DataFrame:
    """0-based row number per key: local row number plus the counts of earlier segments."""
    rows = df.withColumn("segment", segment_of(F.col(position), size))
    counts = rows.groupBy(key, "segment").agg(F.count("*").alias("_c"))
    earlier = W.partitionBy(key).orderBy("segment").rowsBetween(W.unboundedPreceding, -1)
    counts = counts.select(key, "segment", F.coalesce(F.sum("_c").over(earlier), F.lit(0)).alias("_before"))
    local = F.row_number().over(W.partitionBy(key, "segment").orderBy(position))
    return (rows.join(counts, [key, "segment"]).withColumn(out, (F.col("_before") + local - 1).cast("long"))
            .drop("_before", "segment"))


def trend(df: DataFrame, key: str, t: str, y: str, window_s: float = 180.0, min_points: int = 10,
          out: str = "slope_per_min", segment_s: float | None = None) -> DataFrame:
    """Least-squares slope per minute over the trailing ``window_s`` seconds, both edges included.

    NULL below ``min_points`` points or a span shorter than min(60, window / 2). Sums of a window are differences of
    running sums: what lies up to the row, less what lies before the window. All frames but one grow from the start of
    the segment, so each row enters each sum once; the last one holds only rows at exactly the window's edge. The time
    per row therefore does not depend on the window.
    """
    size = segment_s or max(3600.0, 10 * window_s)
    rel = F.col(t) - F.col("segment") * F.lit(float(size))      # small numbers keep the fit well conditioned
    part = f"partition by `{key}`, segment order by _rel range between"
    back = lambda s: f"{float(s)!r}D preceding"
    upto = lambda x, edge: f"coalesce(sum({x}) over ({part} unbounded preceding and {edge}), 0D)"
    at = lambda x, s: f"coalesce(sum({x}) over ({part} {back(s)} and {back(s)}), 0D)"
    inside = lambda x, edge="current row": f"({upto(x, edge)} - {upto(x, back(window_s))} + {at(x, window_s)})"
    seen = f"if(`{y}` is null, 0D, %s)"
    moments = {"_one": "1D", "_t": "_rel", "_y": f"`{y}`", "_tt": "_rel * _rel", "_ty": f"_rel * `{y}`"}
    rows = with_halo(df, t, size, window_s * (1 + 1e-9) + 1e-6).withColumn("_rel", rel)
    rows = rows.withColumns({c: F.expr(seen % e) for c, e in moments.items()})
    fit = rows.withColumns({"_rows": F.expr(inside("1D")), "_far": F.expr(inside("1D", back(min(60.0, window_s / 2)))),
                            **{f"_s{c}": F.expr(inside(c)) for c in moments}})
    n, st, sy, stt, sty = (F.col(f"_s{c}") for c in moments)
    spread = n * stt - st * st
    slope = F.when((F.round(n) > 1) & (spread > 1e-9 * n * stt), (n * sty - st * sy) / spread)
    enough = (F.round("_rows") >= min_points) & (F.round("_far") >= 1)
    return own_rows(fit.withColumn(out, F.when(enough, slope * 60.0)).drop("_rel", "_rows", "_far", *moments, *[f"_s{c}" for c in moments]))


def quality_fraction(df: DataFrame, key: str, ordinal_col: str, ok: Column, windows: int = 60,
                     out: str = "quality", segment: int = 4096) -> DataFrame:
    """Share of clean windows among the last ``windows`` windows."""
    w = W.partitionBy(key, "segment").orderBy(ordinal_col).rangeBetween(-(windows - 1), 0)
    halo = with_halo(df, ordinal_col, segment, windows - 1)
    return own_rows(halo.withColumn(out, F.avg(F.when(ok, 1.0).otherwise(0.0)).over(w)))


def union_duration(df: DataFrame, key: str, start: str, end: str, width: float = 4096.0) -> DataFrame:
    """Length of the union of intervals per key: overlapping epochs count once.

    The running maximum of ends is taken inside start-time buckets and carried across buckets
    from their maxima, so the only per-key window runs over one row per bucket.
    """
    rows = df.withColumn("segment", segment_of(F.col(start), width))
    edges = rows.groupBy(key, "segment").agg(F.max(end).alias("_e"))
    earlier = W.partitionBy(key).orderBy("segment").rowsBetween(W.unboundedPreceding, -1)
    edges = edges.select(key, "segment", F.max("_e").over(earlier).alias("_carry"))
    inside = W.partitionBy(key, "segment").orderBy(start, end).rowsBetween(W.unboundedPreceding, -1)
    reached = F.greatest(F.max(end).over(inside), F.col("_carry"), F.col(start))
    return (rows.join(edges, [key, "segment"])
            .withColumn("_new", F.greatest(F.lit(0.0), F.col(end) - reached))
            .groupBy(key).agg(F.sum("_new").alias("duration_s")))
