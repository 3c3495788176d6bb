"""Rows of an embedding table as matrices, for the vector operators."""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def usable(vector: Column) -> Column:
    """Whether a vector is present and all its components are finite numbers."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & ~F.coalesce(bad, F.lit(True))


def matrix(column: pa.ChunkedArray | pa.Array, kind=np.float64) -> np.ndarray:
    """Equally long lists as rows."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        column = column if isinstance(column, pa.Array) else column.chunk(0)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(kind)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def numbered(df: DataFrame, key: str = "vec_id") -> DataFrame:
    """The table with ``row``, a number that tells its rows apart, in the shared folder so that it stays the same."""
    from brierworks.session import cut_lineage

    return cut_lineage(df.withColumn("row", F.monotonically_increasing_id()))
