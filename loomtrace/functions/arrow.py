"""Columns of Arrow batches as Python values."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def plain(column: pa.Array) -> list:
    """What ``to_pylist`` gives, by NumPy where nothing is null: for numbers and lists of numbers some ten times as fast."""
    kind = column.type
    if column.null_count == len(column):
        return [None] * len(column)
    if column.null_count or pa.types.is_nested(kind) and not pa.types.is_list(kind) or pa.types.is_temporal(kind):
        return column.to_pylist()
    if pa.types.is_list(kind):
        ends = column.offsets.to_numpy().tolist()
        flat, base = plain(column.flatten()), ends[0]
        return [flat[a - base : b - base] for a, b in zip(ends, ends[1:])]
    return column.to_numpy(zero_copy_only=False).tolist()


def flat(column: pa.ListArray) -> tuple[np.ndarray | pa.Array, np.ndarray]:
    """The items of all lists of a column without nulls, and the row of each; items that are structs stay an Arrow column."""
    items, sizes = column.flatten(), np.diff(column.offsets.to_numpy())
    return items if pa.types.is_struct(items.type) else items.to_numpy(zero_copy_only=False), np.repeat(np.arange(len(sizes)), sizes)
