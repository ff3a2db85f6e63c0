"""Approximate nearest neighbours by few stable projections and a kd-tree.

Vectors are projected to `DIMENSIONS` coordinates by Gaussian (2-stable) directions: the squared projected distance of
two vectors over their squared distance follows a chi-square law. A global kd-tree, whose split values come from the
projections of at most `SAMPLE` rows, deals all rows into cells of about `POINTS`; crowded cells are cut by hash. A query
first meets its own cell and then, with the k-th distance found there, only the cells whose box may still hold a
neighbour by the chi-square test. In a cell a kd-tree gives points in the order of their own projected distance; they are
verified on the original vectors until a point nearer than the k-th best would, with probability `SURE`, have shown up at
a smaller projected distance. Every row is indexed.

Defined cases: vectors null, empty, zero, or with null or non-finite components take no part; vectors of different
lengths are no candidates of each other; a query without candidates has no rows; ties go to the smaller vec_id; equal
rows count once, different vectors of a vec_id all are candidates of the other ids, and those of a query share its k
places; extra columns are ignored.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rillwave.llm.common import stored, table
from rillwave.llm.vectors import POINTS, QUERIES, usable

DIMENSIONS = 16
SURE = 0.95
#: Points of a leaf: their projected distances are one array operation.
LEAF = 512
#: Points verified before the first look at the bound; twice as many before each further one, up to MOST.
CHUNK, MOST = 16, 512
#: Rows whose projections give the split values of the cells, and the fewest of them in a cell.
SAMPLE, FEWEST = 20_000, 8


def directions(dim: int) -> np.ndarray:
    return np.random.default_rng(dim).standard_normal((dim, DIMENSIONS))


def chi_square_limit(p: float, dimensions: int) -> float:
    """The value below which a chi-square variable of an even number of degrees of freedom lies with probability p."""
    below = lambda x: 1 - math.exp(-x / 2) * sum((x / 2) ** i / math.factorial(i) for i in range(dimensions // 2))
    lo, hi = 0.0, 1000.0
    for _ in range(100):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if below(mid) < p else (lo, mid)
    return hi


class Tree:
    """A kd-tree: median splits along the widest side; nodes keep their bounding boxes."""

    def __init__(self, points: np.ndarray):
        self.points, self.low, self.high, self.children, self.rows = points, [], [], [], []
        self._grow(np.arange(len(points)))

    def _grow(self, rows: np.ndarray) -> int:
        at, own = len(self.low), self.points[rows]
        self.low.append(own.min(0))
        self.high.append(own.max(0))
        self.children.append(())
        self.rows.append(rows)
        side = int(np.argmax(self.high[at] - self.low[at]))
        if len(rows) > LEAF and self.high[at][side] > self.low[at][side]:
            order = rows[np.argpartition(own[:, side], len(rows) // 2)]
            half = len(rows) // 2
            self.children[at] = (self._grow(order[:half]), self._grow(order[half:]))
        return at

    def _gap(self, node: int, q: np.ndarray) -> float:
        d = np.maximum(np.maximum(self.low[node] - q, q - self.high[node]), 0.0)
        return float(d @ d)

    def walk(self, q: np.ndarray):
        """Blocks of (squared projected distances, rows): all points in ascending order."""
        heap, near, rows = [(self._gap(0, q), 0)], np.zeros(0), np.zeros(0, np.int64)
        while heap:
            _, node = heapq.heappop(heap)
            for child in self.children[node]:
                heapq.heappush(heap, (self._gap(child, q), child))
            if not self.children[node]:
                d = self.points[self.rows[node]] - q
                near, rows = np.append(near, np.einsum("ij,ij->i", d, d)), np.append(rows, self.rows[node])
            done = near <= heap[0][0] if heap else np.ones(len(near), bool)     # no leaf to come is nearer
            if done.any():
                order = np.flatnonzero(done)[np.argsort(near[done], kind="stable")]
                yield near[order], rows[order]
                near, rows = near[~done], rows[~done]


class Cells:
    """Split values of a kd-tree over all rows' projections."""

    def __init__(self, sample: np.ndarray, wanted: int):
        self.nodes: list[tuple] = []                  # (side, value, low child, high child) or (cell,)
        self.cells = 0
        self._grow(sample, wanted)

    def _grow(self, sample: np.ndarray, wanted: int) -> int:
        at = len(self.nodes)
        self.nodes.append(())
        if wanted > 1 and len(sample) >= 2 * FEWEST:
            side = int(np.argmax(sample.max(0) - sample.min(0)))
            value = float(np.median(sample[:, side]))
            low = sample[:, side] <= value
            if not low.all():
                self.nodes[at] = (side, value, self._grow(sample[low], wanted // 2), self._grow(sample[~low], wanted - wanted // 2))
                return at
        self.nodes[at] = (self.cells,)
        self.cells += 1
        return at

    def of(self, points: np.ndarray) -> np.ndarray:
        out, todo = np.zeros(len(points), np.int64), [(0, np.arange(len(points)))]
        while todo:
            at, rows = todo.pop()
            if len(self.nodes[at]) == 1:
                out[rows] = self.nodes[at][0]
                continue
            side, value, low, high = self.nodes[at]
            below = points[rows, side] <= value
            todo += [(low, rows[below]), (high, rows[~below])]
        return out

    def near(self, q: np.ndarray, reach: float) -> list[int]:
        """Cells whose box lies within the squared projected distance `reach`."""
        out, todo = [], [(0, 0.0, np.zeros(DIMENSIONS))]
        while todo:
            at, gap, sides = todo.pop()
            if len(self.nodes[at]) == 1:
                out.append(self.nodes[at][0])
                continue
            side, value, *children = self.nodes[at]
            off = q[side] - value
            for child, beyond in zip(children, (max(off, 0.0), max(-off, 0.0))):
                further = gap - sides[side] + max(sides[side], beyond * beyond)
                if further <= reach:
                    new = sides.copy()
                    new[side] = max(sides[side], beyond * beyond)
                    todo.append((child, further, new))
        return out


def nearest(points, flat, ids, queries, query_flat, query_ids, bounds, k: int, sure: float = SURE):
    """For each query: ids and squared distances of the k nearest points found within its bound, and how many were verified."""
    tree, limit = Tree(flat), chi_square_limit(sure, DIMENSIONS)
    for q, qf, qid, bound in zip(queries, query_flat, query_ids, bounds):
        best_d, best_i, kth, seen, step = np.zeros(0), np.zeros(0, np.int64), bound, 0, CHUNK
        for near, rows in tree.walk(qf):
            at = 0
            while at < len(rows):
                here = rows[at:at + step]
                some = here[near[at:at + step] <= limit * kth]
                seen += len(some)
                own = some[ids[some] != qid]
                d = points[own] - q
                d = np.einsum("ij,ij->i", d, d)
                better = d <= kth
                if better.any():
                    d, i = np.append(best_d, d[better]), np.append(best_i, ids[own[better]])
                    order = np.lexsort((i, d))[:k]
                    best_d, best_i = d[order], i[order]
                    if len(best_d) == k:
                        kth = min(bound, best_d[-1])
                if len(some) < len(here):
                    break
                at, step = at + step, min(2 * step, MOST)
            if len(rows) and near[-1] > limit * kth:
                break
        yield best_i, best_d, seen


def _by_length(batch: pa.RecordBatch):
    """(length, places, matrix) of the batch's vectors of each length."""
    v = batch.column(batch.schema.get_field_index("v"))
    lengths = pc.list_value_length(v).to_numpy(zero_copy_only=False)
    for dim in np.unique(lengths):
        at = np.flatnonzero(lengths == dim)
        yield int(dim), at, v.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).reshape(len(at), -1)


def _with_flat(batches):
    for batch in batches:
        flat = np.zeros((batch.num_rows, DIMENSIONS))
        for dim, at, m in _by_length(batch):
            flat[at] = m @ directions(dim)
        ends = pa.array(np.arange(0, flat.size + 1, DIMENSIONS), pa.int32())
        yield batch.append_column("flat", pa.ListArray.from_arrays(ends, pa.array(flat.ravel())))


def _matrix(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def placed(points: DataFrame) -> tuple[DataFrame, dict[int, Cells]]:
    """Points with projections and cells, and the cells of each length of vectors (a length outside the sample is one cell)."""
    flat = stored(points.mapInArrow(_with_flat, "id long, v array<double>, row long, flat array<double>"))
    n = flat.count()
    sample = flat.orderBy(F.xxhash64("row")).limit(SAMPLE).select(F.size("v").alias("dim"), "flat").toPandas()
    cells = {}
    for dim, rows in sample.groupby("dim"):
        cells[int(dim)] = Cells(np.stack(rows["flat"].to_list()), -(-n * len(rows) // (len(sample) * POINTS)))

    def place(batches):
        for batch in batches:
            cell, flats = np.zeros(batch.num_rows, np.int64), _matrix(batch.column(batch.schema.get_field_index("flat")))
            for dim, at, _ in _by_length(batch):
                if dim in cells:
                    cell[at] = cells[dim].of(flats[at])
            yield batch.append_column("cell", pa.array(cell))

    with_cell = flat.mapInArrow(place, "id long, v array<double>, row long, flat array<double>, cell long")
    return stored(with_cell.withColumn("dim", F.size("v"))), cells


def met(points: DataFrame, targets: DataFrame, k: int, sure: float) -> DataFrame:
    """The k nearest found of each target (a query row, a cell it visits and its bound) in that cell, crowded ones in blocks."""
    blocks = lambda df, size, name: df.groupBy("dim", "cell").agg(F.ceil(F.count("*") / size).cast("int").alias(name))
    sides = stored(blocks(points, POINTS, "many").join(blocks(targets, QUERIES, "few"), ["dim", "cell"]))
    one = lambda n: F.pmod(F.xxhash64("row"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    a = points.join(sides, ["dim", "cell"]).select("dim", "cell", one("many").alias("pb"), every("few").alias("qb"), F.lit(0).alias("role"),
                                                   "id", "v", "flat", "row", F.lit(None).cast("double").alias("bound"))
    b = targets.join(sides, ["dim", "cell"]).select("dim", "cell", every("many").alias("pb"), one("few").alias("qb"), F.lit(1).alias("role"),
                                                    "id", "v", "flat", "row", "bound")

    def block(rows: pa.Table) -> pa.Table:
        role = rows["role"].to_numpy()
        out = {"query_row": [], "query_id": [], "vec_id": [], "square": [], "verified": []}
        if 0 < role.sum() < len(role):
            ids, v, flat, row = rows["id"].to_numpy(), _matrix(rows["v"]), _matrix(rows["flat"]), rows["row"].to_numpy()
            p, q = np.flatnonzero(role == 0), np.flatnonzero(role == 1)
            p = p[np.argsort(ids[p], kind="stable")]
            bounds = rows["bound"].fill_null(0.0).to_numpy()[q]
            for at, (i, d, seen) in zip(q, nearest(v[p], flat[p], ids[p], v[q], flat[q], ids[q], bounds, k, sure)):
                for name, values in zip(out, (np.full(len(i), row[at]), np.full(len(i), ids[at]), i, d, np.full(len(i), seen))):
                    out[name].append(values)
        joined = {c: np.concatenate(x) if x else np.zeros(0) for c, x in out.items()}
        return pa.table({c: pa.array(x, pa.float64() if c == "square" else pa.int64()) for c, x in joined.items()})

    return a.union(b).groupBy("dim", "cell", "pb", "qb").applyInArrow(
        block, "query_row long, query_id long, vec_id long, square double, verified long")


def search(vectors: DataFrame, is_query, k: int = 10, sure: float = SURE) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each query, by Euclidean distance."""
    points, cells = placed(stored(usable(vectors, zero=False, distinct=True)))
    queries = points.where(is_query(F.col("id")))
    first = stored(met(points, queries.withColumn("bound", F.lit(float("inf"))), k, sure))
    place = F.row_number().over(Window.partitionBy("query_row").orderBy("square", "vec_id"))
    bound = (first.withColumn("place", place).where(F.col("place") == k)
             .select(F.col("query_row").alias("row"), F.col("square").alias("bound")))
    bounded = queries.join(bound, "row", "left").withColumn("bound", F.coalesce("bound", F.lit(float("inf"))))
    limit = chi_square_limit(sure, DIMENSIONS)

    def visits(batches):
        for batch in batches:
            col = {c: batch.column(i) for i, c in enumerate(batch.schema.names)}
            dims, own, bounds = (col[c].to_numpy(zero_copy_only=False) for c in ("dim", "cell", "bound"))
            flats, at, to = _matrix(col["flat"]), [], []
            for i in range(batch.num_rows):
                other = [c for c in cells[dims[i]].near(flats[i], limit * bounds[i]) if c != own[i]] if int(dims[i]) in cells else []
                at += [i] * len(other)
                to += other
            out = batch.take(pa.array(at, pa.int64()))
            yield out.set_column(out.schema.get_field_index("cell"), "cell", pa.array(to, pa.int64()))

    names = ["id", "v", "row", "flat", "cell", "dim", "bound"]
    further = stored(bounded.select(*names).mapInArrow(visits, "id long, v array<double>, row long, flat array<double>, cell long, dim int, bound double"))
    found = first.union(met(points, further, k, sure))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return (found.select("query_id", "vec_id", F.sqrt("square").alias("score")).withColumn("rank", rank).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))


def op4_nearest_neighbours(spark, sf_dir):
    """The 10 nearest found of every hundredth vector among all."""
    return search(table(spark, sf_dir, "embeddings"), lambda i: i % 100 == 0)
