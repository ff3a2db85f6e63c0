"""Bridge between array columns and batch kernels: Arrow in, Arrow out, no per-row Python objects."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, types as T

_ROWS = 256        # rows handed to a kernel at once; keeps the working set in cache


def as_matrix(column: pa.Array) -> np.ndarray:
    """Equal-length list column -> (rows, samples) doubles, missing samples as NaN."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten()
    values = flat.to_numpy(zero_copy_only=False).astype(float, copy=False)
    return values.reshape(len(column), -1)


def to_arrow(values, dtype: pa.DataType) -> pa.Array:
    """NaN -> NULL, matrices -> list columns."""
    values = np.asarray(values)
    if pa.types.is_list(dtype):
        rows, width = values.shape
        flat = np.ascontiguousarray(values, dtype=float).ravel()
        offsets = pa.array(np.arange(rows + 1, dtype=np.int32) * width)
        return pa.ListArray.from_arrays(offsets, pa.array(flat, mask=np.isnan(flat)))
    if pa.types.is_floating(dtype):
        return pa.array(values.astype(float), type=dtype, mask=np.isnan(values.astype(float)))
    return pa.array(values, type=dtype)


_ARROW = {T.DoubleType: pa.float64(), T.LongType: pa.int64(), T.BooleanType: pa.bool_()}


def _arrow_type(t: T.DataType) -> pa.DataType:
    return pa.list_(pa.float64()) if isinstance(t, T.ArrayType) else _ARROW[type(t)]


def append_kernel(df: DataFrame, inputs: list[str], fn: Callable[..., dict],
                  outputs: list[tuple[str, T.DataType]], drop: list[str] | None = None) -> DataFrame:
    """Run ``fn(*matrices) -> {name: values}`` over the array columns and append its outputs.

    The input arrays are dropped unless ``drop`` says otherwise: raw signal does not travel on.
    """
    drop = inputs if drop is None else drop
    keep = [f for f in df.schema.fields if f.name not in drop]
    schema = T.StructType(keep + [T.StructField(n, t) for n, t in outputs])
    names = [f.name for f in keep]
    kinds = [(n, _arrow_type(t)) for n, t in outputs]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, _ROWS):
                batch = whole.slice(at, _ROWS)
                result = fn(*[as_matrix(batch.column(c)) for c in inputs])
                arrays = [batch.column(c) for c in names]
                arrays += [to_arrow(result[n], t) for n, t in kinds]
                yield pa.RecordBatch.from_arrays(arrays, names=names + [n for n, _ in kinds])

    return df.mapInArrow(run, schema)
