"""Vectors in blocks: a stated query set meets all rows without a task that holds either of them whole."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Vectors of a block of points and of a block of queries; bounds a task's memory.
POINTS, QUERIES = 4096, 4096


def usable(vectors: DataFrame, zero: bool = True, distinct: bool = False) -> DataFrame:
    """(id, v double[], row): rows with a vec_id and a vector of finite components only; without all-zero ones unless `zero`.

    Rows that share a vec_id all count; with `distinct` equal ones of them count once.
    """
    v = F.col("embedding")
    good = v.isNotNull() & F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))
    rows = vectors.where(F.col("vec_id").isNotNull() & good).where(F.size(v) > 0)
    if not zero:
        rows = rows.where(F.exists(v, lambda x: x != 0))
    rows = rows.select(F.col("vec_id").alias("id"), v.cast("array<double>").alias("v"))
    return (rows.distinct() if distinct else rows).withColumn("row", F.monotonically_increasing_id())


def in_blocks(points: DataFrame, queries: DataFrame, extra: list[str], n_points: int, n_queries: int) -> DataFrame:
    """One frame of both, keyed (dim, pb, qb): each block of points meets each block of queries of the same length.

    Blocks go by `row`, so that a frequent id crowds none; store `usable` rows before. `queries` may carry `extra` long columns, null on the side of the points.
    """
    many, few = max(1, -(-n_points // POINTS)), max(1, -(-n_queries // QUERIES))
    block = lambda n: F.pmod(F.xxhash64("row"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    a = points.select(F.size("v").alias("dim"), block(many).alias("pb"), every(few).alias("qb"), F.lit(0).alias("role"), "id", "v",
                      *[F.lit(None).cast("long").alias(c) for c in extra])
    b = queries.select(F.size("v").alias("dim"), every(many).alias("pb"), block(few).alias("qb"), F.lit(1).alias("role"), "id", "v", *extra)
    return a.union(b)


def split(rows: pa.Table, extra: list[str], kind) -> tuple:
    """ids and matrix of the points, ids and matrix of the queries, and the queries' extra columns; by id."""
    role, ids = rows["role"].to_numpy(), rows["id"].to_numpy()
    matrix = rows["v"].combine_chunks().flatten().to_numpy().reshape(len(ids), -1).astype(kind)
    out = []
    for r in (0, 1):
        at = np.flatnonzero(role == r)
        at = at[np.argsort(ids[at])]
        out += [ids[at], matrix[at]]
    # nulls are filled first: with them the numbers would pass through doubles
    return (*out, *[rows[c].fill_null(0).to_numpy()[at] for c in extra])
