"""Vectors that take part in search and comparison."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(vector: Column, size: int) -> Column:
    """Of the given size, without NULL or non-finite components, and not zero."""
    return F.coalesce((F.size(vector) == size) & ~F.exists(
        vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(
        vector, lambda x: x != 0), F.lit(False))


def common_size(rows: DataFrame, vector_col: str) -> int:
    """The most frequent size (the larger of equals); vectors of another size take no part. 0 without vectors."""
    found = rows.where(F.size(vector_col) > 0).groupBy(F.size(vector_col).alias("s")).count().orderBy(
        F.desc("count"), F.desc("s")).first()
    return found["s"] if found else 0


def matrix(column: pa.Array | pa.ChunkedArray, size: int) -> np.ndarray:
    """A list column as rows of doubles."""
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, size)


def sample(rows: DataFrame, id_col: str, vector_col: str, most: int) -> np.ndarray:
    """About ``most`` vectors at most, chosen by a hash of the id, in a fixed order."""
    n = rows.count()
    part = min(1.0, most / max(n, 1))
    chosen = rows.where(F.pmod(F.xxhash64(F.lit("sample"), id_col), F.lit(1 << 20)) < int(part * (1 << 20)))
    table = chosen.select(F.xxhash64(id_col).alias("h"), vector_col).orderBy("h").toArrow()
    return matrix(table[vector_col], len(table[vector_col][0]) if len(table) else 1)
