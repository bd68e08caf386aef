"""Embeddings as whole numbers, for operators whose results must be exact."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Scaled components must stay below this, so that sums of products fit a long; real embeddings are some units wide.
LARGEST = 2**26


def whole_components(rows: DataFrame, factor: int, carry: tuple[str, ...] = (), components: int | None = None) -> DataFrame:
    """``vec_id``, the carried columns and ``v``: floor(factor * x) of each component x of ``embedding``, as int.

    Rows with a null vector or any null or non-finite component are left out, and with ``components`` all vectors of
    another length. A component that isn't below ``LARGEST`` once scaled raises ValueError.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column("embedding")
            length = pc.fill_null(pc.list_value_length(vectors), -1).to_numpy(zero_copy_only=False).astype(np.int64)
            x = vectors.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(len(length)), np.maximum(length, 0))
            good = (length >= 0) if components is None else (length == components)
            good[row[~np.isfinite(x)]] = False
            whole = np.floor(factor * x[good[row]])
            if len(whole) and np.abs(whole).max() >= LARGEST:
                raise ValueError(f"a component times {factor} is {LARGEST} or more")
            at = np.concatenate([[0], np.cumsum(length[good])]).astype(np.int32)
            v = pa.ListArray.from_arrays(pa.array(at), pa.array(whole.astype(np.int32)))
            mask = pa.array(good)
            yield pa.RecordBatch.from_arrays([*[c.filter(mask) for c in batch.columns[:-1]], v], [*batch.schema.names[:-1], "v"])

    slim = rows.select(F.col("vec_id").cast("long"), *carry, "embedding")
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in slim.drop("embedding").schema)
    return slim.mapInArrow(run, f"{kinds}, v array<int>")


def exact(x: np.ndarray) -> np.ndarray:
    """Whole numbers as floats where all sums of products stay exact in them, else as longs."""
    most = int(np.abs(x).max()) if x.size else 0
    return x.astype(np.float64) if 4 * x.shape[-1] * most * most < 2**53 else x.astype(np.int64)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All inner products of the rows of two tables of whole numbers, exact."""
    a, b = exact(a), exact(b)
    if a.dtype != b.dtype:
        a, b = a.astype(np.int64), b.astype(np.int64)
    return (a @ b.T).astype(np.int64)


def squares(a: np.ndarray) -> np.ndarray:
    return np.einsum("ij,ij->i", a.astype(np.int64), a.astype(np.int64))
