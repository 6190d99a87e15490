"""Vectors as whole numbers: exact arithmetic in numpy for the operators on embeddings."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: A component x becomes floor(SCALE * x), x as double.
SCALE = 1024


def integer_vectors(column: pa.Array, scale: int = SCALE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows whose vector is neither null nor holds a null or a component that isn't finite, their lengths, and the integers
    of all of them end to end.

    A component beyond 2**62 after scaling is an OverflowError: its row could neither be dropped nor be scored.
    """
    held = np.flatnonzero(column.is_valid().to_numpy(zero_copy_only=False))
    lengths = pc.list_value_length(column).drop_null().to_numpy().astype(np.int64)
    values = pc.fill_null(pc.cast(column.flatten(), pa.float64()), np.nan).to_numpy(zero_copy_only=False)
    ends = np.cumsum(lengths)
    odd = np.concatenate([[0], np.cumsum(~np.isfinite(values))])
    kept = odd[ends] == odd[ends - lengths]
    with np.errstate(over="ignore"):
        scaled = np.floor(values[np.repeat(kept, lengths)] * scale)
    if scaled.size and np.abs(scaled).max() > 2.0**62:
        raise OverflowError("a component is beyond 2**62 after scaling")
    return held[kept], lengths[kept], scaled.astype(np.int64)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b of int64 matrices, exactly: in floating point while no sum can lose a bit, else in 64-bit integers."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    if most < 2.0**53:
        return (a.astype(np.float64) @ b.astype(np.float64)).astype(np.int64)
    if most >= 2.0**63:
        raise OverflowError("inner products are beyond 64 bits")
    return a @ b


def lists(values: np.ndarray, lengths: np.ndarray) -> pa.ListArray:
    """An Arrow list column from values end to end."""
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]), pa.int32()), pa.array(values))
