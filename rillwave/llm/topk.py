"""Exact top-k by distributed histogram selection.

Components become floor(1024 * x); scores are integer inner products. A first pass over all scores finds each query's
range and number of candidates. Then every pass scores all blocks again (cheaper than storing all scores), counts the
scores that fall into `BINS` equal bins of the query's current interval, adds the counts over the blocks, and narrows
the interval to the bin of the k-th largest score, until it is one value. A block tells only its highest bins, as many
as can matter. The last pass emits the scores above that value and, among equals, the smallest ids.

Defined cases: vectors null, empty, or with null or non-finite components take no part; components beyond the long
range saturate, and so do scores; vectors of different lengths are no candidates of each other; a query without
candidates has no rows; ties go to the smaller vec_id; rows sharing a vec_id all are candidates of
the other ids, and those of a query share its k places; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rillwave.llm.common import stored, table
from rillwave.llm.vectors import in_blocks, split, usable

BINS = 256
SCALE = 1024
_LONG = np.iinfo(np.int64)


def scores(points: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """Integer inner products, queries x points; exact in doubles where these suffice, in Python integers elsewhere."""
    top = float(np.abs(points.astype(float)).max(initial=0)) * float(np.abs(queries.astype(float)).max(initial=0))
    if top * points.shape[1] < 2.0 ** 53:
        return (queries.astype(np.float64) @ points.astype(np.float64).T).astype(np.int64)
    exact = queries.astype(object) @ points.astype(object).T
    return np.clip(exact, int(_LONG.min), int(_LONG.max)).astype(np.int64)


def _rows(pid, points, qid, queries):
    """(number of query, ids, scores) of each query against a block, its own row left out."""
    for at in range(0, len(qid), 64):
        for i, s in enumerate(scores(points, queries[at:at + 64]), at):
            other = pid != qid[i]
            yield i, pid[other], s[other]


def _range(rows: pa.Table) -> pa.Table:
    pid, points, qid, queries = split(rows, [], np.int64)
    out = [(qid[i], s.min(), s.max(), len(s)) for i, _, s in _rows(pid, points, qid, queries) if len(s)]
    return _table(out, ("id", "lo", "hi", "need"))


def _histogram(rows: pa.Table) -> pa.Table:
    pid, points, qid, queries, lo, hi, need = split(rows, ["lo", "hi", "need"], np.int64)
    out = []
    for i, _, s in _rows(pid, points, qid, queries):
        low, width = int(lo[i]), _width(int(lo[i]), int(hi[i]))
        s = s[(s >= lo[i]) & (s <= hi[i])]
        place = ((s.astype(np.uint64) - np.uint64(low % (1 << 64))) // np.uint64(width)).astype(np.int64)
        counts = np.bincount(place, minlength=BINS)[::-1]
        last = int(np.searchsorted(np.cumsum(counts), need[i])) + 1
        out += [(qid[i], BINS - 1 - b, counts[b]) for b in np.flatnonzero(counts[:last])]
    return _table(out, ("id", "bin", "n"))


def _chosen(rows: pa.Table) -> pa.Table:
    pid, points, qid, queries, lo, need = split(rows, ["lo", "need"], np.int64)
    out = []
    for i, ids, s in _rows(pid, points, qid, queries):
        above, equal = np.flatnonzero(s > lo[i]), np.flatnonzero(s == lo[i])[:need[i]]     # ids ascend
        out += [(qid[i], ids[j], s[j]) for j in np.concatenate([above, equal])]
    return _table(out, ("query_id", "vec_id", "score"))


def _table(rows: list[tuple], names: tuple[str, ...]) -> pa.Table:
    columns = zip(*rows) if rows else [()] * len(names)
    return pa.table({n: pa.array(np.array(c, np.int64)) for n, c in zip(names, columns)})


def _width(lo: int, hi: int) -> int:
    return max(1, -(-(hi - lo + 1) // BINS))


def top_k(vectors: DataFrame, is_query, k: int = 10) -> DataFrame:
    """query_id, rank, vec_id, score: the k highest integer inner products of each query."""
    grid = F.transform("v", lambda x: F.floor(F.lit(SCALE) * x))
    points = stored(usable(vectors).select("id", grid.alias("v"), "row"))
    queries = points.where(is_query(F.col("id")))
    n, q = points.count(), queries.count()
    each = lambda rows, fn, schema: rows.groupBy("dim", "pb", "qb").applyInArrow(fn, schema)

    state = stored(each(in_blocks(points, queries, [], n, q), _range, "id long, lo long, hi long, need long").groupBy("id")
                   .agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.least(F.sum("need"), F.lit(k)).alias("need")))
    width = F.expr(f"greatest(1, ceil((cast(hi as decimal(38,0)) - lo + 1) / {BINS}))").cast("long")
    while state.where("hi > lo").limit(1).count():
        asked = queries.join(state, "id")
        counts = each(in_blocks(points, asked, ["lo", "hi", "need"], n, q), _histogram, "id long, bin long, n long").groupBy(
            "id", "bin").agg(F.sum("n").alias("n"))
        from_top = Window.partitionBy("id").orderBy(F.desc("bin"))
        met = (counts.join(state, "id").withColumn("above", F.sum("n").over(from_top) - F.col("n"))
               .where("above < need and above + n >= need").withColumn("w", width))
        low = F.col("lo").cast("decimal(38,0)") + F.col("bin") * F.col("w")
        state = stored(met.select("id", low.cast("long").alias("lo"), F.least(low + F.col("w") - 1, F.col("hi")).cast("long").alias("hi"),
                                  (F.col("need") - F.col("above")).alias("need")))
    last = in_blocks(points, queries.join(state.select("id", "lo", "need"), "id"), ["lo", "need"], n, q)
    found = each(last, _chosen, "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op6_exact_top_k(spark, sf_dir):
    """The 10 highest integer inner products of every hundredth vector against all."""
    return top_k(table(spark, sf_dir, "embeddings"), lambda i: i % 100 == 0)


OP6_SQL = """
WITH g AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
    WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])) AS BIGINT) AS score
    FROM g q JOIN g c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v)),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank, vec_id, score FROM s)
SELECT * FROM r WHERE rank <= 10
"""
