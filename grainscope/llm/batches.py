"""Helpers for Arrow batches inside tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def slices_by_bytes(column: pa.Array, limit: int = 4 << 20) -> Iterator[tuple[int, int]]:
    """Consecutive (start, end) ranges of a text column with about ``limit`` bytes each; a longer text is alone."""
    sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    start, total = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if total and total + n > limit:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)


def gather_runs(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Positions of consecutive runs: ``starts[i] .. starts[i] + lengths[i]`` one after the other."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(total)


def offsets_of(lengths: np.ndarray) -> np.ndarray:
    """Prefix sums with a leading zero."""
    return np.concatenate([np.zeros(1, np.int64), np.cumsum(lengths, dtype=np.int64)])
