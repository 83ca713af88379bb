"""Vectors of integers from columns of arrays of floats, in numpy inside Arrow tasks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Scaled components from here on are refused: with less, a squared distance or inner product of 64 fits into a long.
LIMIT = float(1 << 27)


def fixed_point(column: pa.Array, size: int, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """Which rows are vectors of exactly ``size`` components, none null, non-finite or of LIMIT or more after scaling, and
    floor(scale * x) of these, each a row of longs."""
    kept = pc.equal(pc.fill_null(pc.list_value_length(column), -1), size).to_numpy(zero_copy_only=False).copy()
    flat = column.filter(pa.array(kept)).flatten()
    x = flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, size)  # nulls become nan
    x = np.floor(x * scale)
    fine = (np.abs(x) < LIMIT).all(1)  # false for nan too
    kept[kept] = fine
    return kept, x[fine].astype(np.int64)
