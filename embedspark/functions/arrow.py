"""Small helpers that turn Arrow list columns into numpy blocks and back."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def list_lengths(column: pa.Array) -> np.ndarray:
    """Length of every list; -1 marks a null list."""
    lengths = column.value_lengths().fill_null(-1)
    return lengths.to_numpy(zero_copy_only=False)


def blocks(column: pa.Array, dtype: str = "f8") -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Yield (row numbers, matrix) for every distinct list length of the column.

    Null lists are left out, so ragged and partly null columns need no special case in callers.
    """
    lengths = list_lengths(column)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(dtype, copy=False)
    starts = np.concatenate([[0], np.cumsum(np.maximum(lengths, 0))[:-1]])
    for width in np.unique(lengths):
        if width < 0:
            continue
        rows = np.flatnonzero(lengths == width)
        if width * len(rows) == len(flat):
            yield rows, flat.reshape(len(rows), width)
        else:
            yield rows, flat[starts[rows][:, None] + np.arange(width)[None, :]]


def float_lists(rows: list[np.ndarray | None] | np.ndarray) -> pa.Array:
    """Rows of numbers (or None) as an Arrow list<float> array."""
    if isinstance(rows, np.ndarray) and rows.ndim == 2:
        count, width = rows.shape
        offsets = np.arange(count + 1, dtype="i4") * width
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(rows.astype("f4").ravel()))
    lengths = [0 if row is None else len(row) for row in rows]
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype("i4")
    present = [np.asarray(row, dtype="f4") for row in rows if row is not None]
    values = np.concatenate(present) if present else np.zeros(0, "f4")
    mask = pa.array([row is None for row in rows])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values), mask=mask)


def once_per_row(function):
    """Keeps the optimizer from running a costly function twice for one row.

    Exploding or filtering its result would otherwise copy the call into an inferred filter, often
    below a repartition. The price is that filters do not move below it: filter first.
    """
    return function.asNondeterministic()
