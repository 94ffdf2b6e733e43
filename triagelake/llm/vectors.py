"""Vectors of integers from vectors of real numbers, shared by the operators that compute on them exactly."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

SCALE = 1024
#: Integers of this size or more take no part: their squared distances leave 64 bits.
BOUND = 1 << 27


def usable(embedding: str = "embedding") -> Column:
    """Whether a vector is there and holds only finite components whose integers stay below BOUND."""
    good = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < BOUND / SCALE))
    return F.coalesce(good, F.lit(False))


def integers(embedding: str = "embedding") -> Column:
    """Each component x as floor(1024 * x), in double precision."""
    return F.transform(embedding, lambda x: F.floor(x.cast("double") * SCALE))


def matrix(lists: pa.Array, width: int) -> np.ndarray:
    """Lists of `width` longs as rows of a matrix."""
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    return np.asarray(lists.flatten(), np.int64).reshape(len(lists), width)


def list_rows(values: np.ndarray) -> pa.Array:
    """Rows of a matrix as lists of longs."""
    n, width = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * width), pa.array(np.ascontiguousarray(values, np.int64).ravel()))


def floor_mean(sums: np.ndarray, counts: np.ndarray, old: np.ndarray) -> np.ndarray:
    """floor(sum / count) of each row, the old row where nothing was counted."""
    return np.where(counts[:, None] > 0, sums // np.maximum(counts, 1)[:, None], old)
