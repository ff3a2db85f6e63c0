"""Hard negatives by Fagin's threshold algorithm.

Components become floor(256 * x); scores are integer inner products with an anchor. Rows are dealt into blocks. A task
sorts each dimension of its block once and serves every anchor from these lists: sorted access goes down a list where
the anchor's component is positive and up where it is negative, every row met is scored at once (random access), and
the sum of the products at the current depth bounds the score of every row not met yet. The search of a window of
scores ends once this bound lies strictly below its k-th score, or, with fewer rows found, below its floor; ties at the
k-th score are therefore all seen. The depth doubles, so a search looks at most twice as deep as it must.

Positives come first: the best `POSITIVES` rows of the anchor's label over all blocks. Each gives a window of scores,
and a second search over all blocks fills all windows of an anchor in one descent.

Bounds: a task holds one block of at most about `POINTS` rows and `ANCHORS` anchors and emits `k` rows per window; the
merge keeps k rows per window before and after its shuffle.

Defined cases: rows with a null vec_id or label, a null or empty vector or null or non-finite components take no part;
components beyond the long range saturate, and so do scores; vectors of different lengths are no candidates of each
other; a candidate is a row of another vec_id; rows that share an anchor's vec_id are anchors each for itself; equal
rows all count; a negative positive score has an empty window; an anchor without positives, or a window without
negatives, gives no rows; an empty table gives none; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rillwave.llm.common import stored, table

SCALE = 256
POSITIVES, NEGATIVES = 5, 5
#: A negative scores at least this share, in per cent, of its positive, and at most as much as it.
FLOOR = 80
POINTS, ANCHORS = 8192, 1024
#: Rows of each list that the first step of a search reads.
FIRST = 8
_LONG = np.iinfo(np.int64)


class Lists:
    """A block of integer vectors with each dimension in ascending order."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray, reach: float):
        """`reach` is the largest absolute component among the anchors; beyond 2^53 scores are Python integers."""
        top = float(np.abs(vectors.astype(float)).max(initial=0)) * reach * vectors.shape[1]
        self.kind = np.float64 if top < 2.0 ** 53 else object
        self.ids, self.labels, self.vectors = ids, labels, vectors.astype(self.kind)
        self.order = np.argsort(vectors, axis=0, kind="stable")

    def search(self, anchor: np.ndarray, fits: np.ndarray, windows: list[tuple[int, int]], k: int):
        """For each window (floor, ceiling) the k best rows among those that fit, and how many rows were scored."""
        n, q = len(self.ids), anchor.astype(self.kind)
        dims = np.flatnonzero(anchor)
        down = anchor[dims] > 0
        seen, found, scores, depth = np.zeros(n, bool), [], [], 0
        at = np.zeros(0, np.int64)
        values = np.zeros(0, np.int64)
        while depth < n:
            last = min(n, max(FIRST, 2 * depth)) if len(dims) else n
            if len(dims):
                met = np.where(down, self.order[n - last:n - depth, dims][::-1], self.order[depth:last, dims])
                new = np.unique(met[~seen[met]])
            else:
                new = np.arange(n)
            seen[new] = True
            new = new[fits[new]]
            found.append(new)
            scores.append(clipped(self.vectors[new] @ q))
            depth = last
            at, values = np.concatenate(found), np.concatenate(scores)
            if depth < n:
                edge = np.where(down, self.order[n - depth, dims], self.order[depth - 1, dims])
                bound = int((self.vectors[edge, dims] * q[dims]).sum())
                if all(bound < self.kth(values, w, k) for w in windows):
                    break
        best = []
        for low, high in windows:
            inside = np.flatnonzero((values >= low) & (values <= high))
            inside = inside[np.lexsort((self.ids[at[inside]], -values[inside].astype(object)))[:k]] if len(inside) else inside
            best.append((self.ids[at[inside]], values[inside]))
        return best, int(seen.sum())

    @staticmethod
    def kth(values: np.ndarray, window: tuple[int, int], k: int) -> int:
        inside = values[(values >= window[0]) & (values <= window[1])]
        return int(np.partition(inside, len(inside) - k)[len(inside) - k]) if len(inside) >= k else window[0]


def clipped(scores: np.ndarray) -> np.ndarray:
    return np.clip(scores, int(_LONG.min), int(_LONG.max)).astype(np.int64) if scores.dtype == object else scores.astype(np.int64)


def _block(rows: pa.Table) -> tuple[Lists, pa.Table, np.ndarray]:
    """Lists of the block's points, the anchors and their vectors."""
    role = rows["role"].to_numpy()
    points, anchors = rows.filter(pa.array(role == 0)), rows.filter(pa.array(role == 1))
    matrix = lambda t: t["v"].combine_chunks().flatten().to_numpy().reshape(t.num_rows, -1)
    asked = matrix(anchors) if anchors.num_rows else np.zeros((0, 1), np.int64)
    reach = float(np.abs(asked.astype(float)).max(initial=0))
    mine = matrix(points) if points.num_rows else np.zeros((0, asked.shape[1]), np.int64)
    return Lists(points["id"].to_numpy(), points["label"].to_numpy(), mine, reach), anchors, asked


def _positives(rows: pa.Table) -> pa.Table:
    lists, anchors, asked = _block(rows)
    out = []
    for row, own, label, q in zip(anchors["row"].to_pylist(), anchors["id"].to_pylist(), anchors["label"].to_pylist(), asked):
        [(ids, scores)], _ = lists.search(q, (lists.labels == label) & (lists.ids != own), [(int(_LONG.min), int(_LONG.max))], POSITIVES)
        out += [(row, i, s) for i, s in zip(ids.tolist(), scores.tolist())]
    return _table(out, ("row", "positive_id", "positive_score"))


def _negatives(rows: pa.Table) -> pa.Table:
    lists, anchors, asked = _block(rows)
    out = []
    for row, own, label, q, scores in zip(anchors["row"].to_pylist(), anchors["id"].to_pylist(), anchors["label"].to_pylist(),
                                          asked, anchors["positives"].to_pylist()):
        tops = sorted({s for s in scores if s >= 0})
        if not tops:
            continue
        best, _ = lists.search(q, (lists.labels != label) & (lists.ids != own), [(-(-FLOOR * s // 100), s) for s in tops], NEGATIVES)
        found = dict(zip(tops, best))
        for place, s in enumerate(scores):
            ids, values = found.get(s, ((), ()))
            out += [(row, place, int(i), int(v)) for i, v in zip(ids, values)]
    return _table(out, ("row", "place", "negative_id", "negative_score"))


def _table(rows: list[tuple], names: tuple[str, ...]) -> pa.Table:
    columns = zip(*rows) if rows else [()] * len(names)
    return pa.table({n: pa.array(list(c), pa.int64()) for n, c in zip(names, columns)})


def _met(points: DataFrame, anchors: DataFrame, n: int, m: int):
    """Every block of points meets every block of anchors of the same length; `anchors` may carry their positives' scores."""
    many, few = max(1, -(-n // POINTS)), max(1, -(-m // ANCHORS))
    block = lambda k: F.pmod(F.xxhash64("row"), F.lit(k)).cast("int")
    every = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    none = F.lit(None).cast("array<bigint>").alias("positives")
    given = "positives" if "positives" in anchors.columns else none
    a = points.select(F.size("v").alias("dim"), block(many).alias("pb"), every(few).alias("qb"), F.lit(0).alias("role"), "row", "id", "label", "v", none)
    b = anchors.select(F.size("v").alias("dim"), every(many).alias("pb"), block(few).alias("qb"), F.lit(1).alias("role"), "row", "id", "label", "v", given)
    return a.union(b).groupBy("dim", "pb", "qb")


def labelled(vectors: DataFrame, label: Column) -> DataFrame:
    """(id, label, v long[], row): the rows that take part, components on the integer grid."""
    v = F.col("embedding")
    good = F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))
    grid = F.transform(v, lambda x: F.floor(F.lit(float(SCALE)) * x.cast("double")).cast("long"))
    return (vectors.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & good & (F.size(v) > 0))
            .select(F.col("vec_id").alias("id"), label.cast("long").alias("label"), grid.alias("v"))
            .withColumn("row", F.monotonically_increasing_id()))


def mined(vectors: DataFrame, is_anchor, label: Column | None = None) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    `label` replaces the column of that name; it is null only where the column is.
    """
    points = stored(labelled(vectors, F.col("label") if label is None else label))
    anchors = points.where(is_anchor(F.col("id")))
    n, m = points.count(), anchors.count()

    by_score = Window.partitionBy("row").orderBy(F.desc("positive_score"), "positive_id")
    positives = stored(_met(points, anchors, n, m).applyInArrow(_positives, "row long, positive_id long, positive_score long")
                       .withColumn("place", (F.row_number().over(by_score) - 1).cast("long")).where(f"place < {POSITIVES}"))
    given = positives.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("place", "positive_score"))).alias("p"))
    asked = anchors.join(given, "row").withColumn("positives", F.col("p.positive_score"))

    by_score = Window.partitionBy("row", "place").orderBy(F.desc("negative_score"), "negative_id")
    negatives = (_met(points, asked, n, m).applyInArrow(_negatives, "row long, place long, negative_id long, negative_score long")
                 .withColumn("rank", F.row_number().over(by_score)).where(F.col("rank") <= NEGATIVES))
    return (negatives.join(positives, ["row", "place"]).join(anchors.select("row", F.col("id").alias("anchor_id")), "row")
            .select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"))


def op12_hard_negatives(spark, sf_dir):
    """Five hard negatives for each of the five positives of every hundredth vector, against all rows."""
    turned = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mined(table(spark, sf_dir, "embeddings"), lambda i: i % 100 == 0, turned)


OP12_SQL = """
WITH g AS (SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.r, a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same,
    CAST(list_sum(list_transform(range(1, len(a.v) + 1), lambda i: a.v[i] * c.v[i])) AS BIGINT) AS score
    FROM g a JOIN g c ON a.vec_id % 100 = 0 AND a.vec_id <> c.vec_id AND len(a.v) = len(c.v)),
p AS (SELECT * FROM (SELECT r, vec_id AS positive_id, score AS positive_score, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS place
    FROM s WHERE same) WHERE place <= 5),
n AS (SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY p.r, place ORDER BY score DESC, vec_id) AS rank, vec_id AS negative_id,
    positive_score, score AS negative_score
    FROM p JOIN s ON p.r = s.r AND NOT s.same AND 80 * positive_score <= 100 * score AND score <= positive_score)
SELECT * FROM n WHERE rank <= 5
"""
