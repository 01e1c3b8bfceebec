"""Distinct counts over huge identifier sets (problem 4): the k smallest hash values.

A sketch is the sorted array of the ``k`` smallest distinct hash values of a set. Below
``k`` values it is the whole set and counts are exact. Otherwise let theta be the k-th
value over 2^60; of the set's values, a share theta falls below it, so ``k - 1`` values
below it stand for ``(k - 1) / theta``. Sketches merge by retaining the smallest, in any
order and grouping, and give the same array as one pass over all rows would.

Bounds: given theta, the number of values below it is binomial, so an estimate
``c / theta`` has the standard error ``sqrt(c * (1 - theta)) / theta`` (relative:
``1 / sqrt(k)``, 3.1 % at k = 1024); bounds lie ``Z`` of these either side, never below
the ``c`` values that were seen, and where none was seen at ``3 / theta`` above.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

K = 1024
Z = 1.96
RANGE = float(1 << 60)
#: Hash values a task holds before it passes its partial sketches on and starts anew.
HELD = 2_000_000


def hash60(value: Column | str) -> Column:
    """BIGINT in [0, 2^60): the first 15 hex digits of the MD5 of the value as text. NULL for NULL."""
    c = F.col(value) if isinstance(value, str) else value
    return F.conv(F.substring(F.md5(c.cast("string")), 1, 15), 16, 10).cast("bigint")


class _Partial:
    """Sketches under construction by group, in bounded memory."""

    def __init__(self, k: int):
        self.k, self.parts, self.size = k, {}, 0

    def add(self, key: tuple, values: np.ndarray) -> None:
        """``values`` sorted and distinct."""
        got = self.parts.get(key)
        if got is None:
            got = self.parts[key] = [[], 0, None]
        if got[2] is not None:
            values = values[: np.searchsorted(values, got[2])]
        values = values[: self.k]
        if not len(values):
            return
        got[0].append(values)
        got[1] += len(values)
        self.size += len(values)
        if got[1] >= 4 * self.k:
            self.settle(got)

    def settle(self, got: list) -> np.ndarray:
        parts = got[0]
        all_ = np.unique(np.concatenate(parts))[: self.k] if len(parts) > 1 else parts[0] if parts else np.empty(0, np.int64)
        self.size += len(all_) - got[1]
        got[0], got[1], got[2] = [all_], len(all_), all_[-1] if len(all_) == self.k else None
        return all_

    def drain(self, keys: Sequence[str], kinds: Sequence[pa.DataType]) -> pa.RecordBatch:
        names, arrays = list(self.parts), [self.settle(g) for g in self.parts.values()]
        offsets = np.concatenate([[0], np.cumsum([len(a) for a in arrays])]).astype(np.int32)
        values = np.concatenate(arrays) if arrays else np.empty(0, np.int64)
        cols = list(zip(*names)) or [()] * len(keys)
        self.parts, self.size = {}, 0
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)] + [pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, pa.int64()))], names=[*keys, "hashes"])


def _ddl(df: DataFrame, keys: Sequence[str]) -> str:
    kinds = dict(df.dtypes)
    return ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), "hashes array<bigint>"])


def partial_sketches(df: DataFrame, keys: Sequence[str], value: str, k: int = K) -> DataFrame:
    """``keys, hashes``: sketches of what each task sees; a group may come several times. Null values count nothing."""
    keys = list(keys)
    src = df.where(F.col(value).isNotNull()).select(*keys, hash60(value).alias("_h"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = _Partial(k)
        for b in batches:
            kinds = [b.schema.field(x).type for x in keys]
            got = pa.Table.from_batches([b]).group_by(keys, use_threads=False).aggregate([("_h", "list")])
            lists = got.column("_h_list").combine_chunks()
            at, values = lists.offsets.to_numpy(), lists.values.to_numpy()
            for i, key in enumerate(zip(*(got.column(x).to_pylist() for x in keys))):
                state.add(key, np.unique(values[at[i] : at[i + 1]]))
            if state.size > HELD:
                yield state.drain(keys, kinds)
        if state.parts:
            yield state.drain(keys, kinds)

    return src.mapInArrow(run, _ddl(src, keys))


def _rows(b: pa.RecordBatch, keys: Sequence[str]) -> Iterator[tuple[tuple, np.ndarray]]:
    lists = b.column(b.schema.get_field_index("hashes"))
    at, values = lists.offsets.to_numpy(), lists.values.to_numpy()
    for i, key in enumerate(zip(*(b.column(b.schema.get_field_index(x)).to_pylist() for x in keys))):
        yield key, values[at[i] : at[i + 1]]


def merge_sketches(sketches: DataFrame, keys: Sequence[str], k: int = K) -> DataFrame:
    """``keys, hashes``: one sketch per group, by retaining the smallest values.

    Each task streams its groups one after the other and holds one of them.
    """
    keys = list(keys)
    rows = sketches.select(*keys, "hashes").repartition(*keys).sortWithinPartitions(*keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, current, done = _Partial(k), None, 0
        ready = _Partial(k)
        kinds: list = []
        for b in batches:
            kinds = [b.schema.field(x).type for x in keys]
            for key, values in _rows(b, keys):
                if key != current and current is not None:
                    ready.add(current, state.settle(state.parts[current]))
                    state.parts.clear()
                    done += 1
                current = key
                state.add(key, values)
            if ready.size > HELD // 4 or done > 20_000:
                yield ready.drain(keys, kinds)
                done = 0
        if current is not None:
            ready.add(current, state.settle(state.parts[current]))
            yield ready.drain(keys, kinds)

    return rows.mapInArrow(run, _ddl(sketches, keys))


def cube_sketches(cells: DataFrame, dims: Sequence[str], fixed: Sequence[str] = (), k: int = K) -> DataFrame:
    """``fixed, dims, level, hashes``: a sketch for each combination of ``dims``.

    ``level`` has one bit per dimension, the first dimension's highest; a set bit means
    that the dimension is summed over (and null). Partial merges happen before the one
    shuffle; the finest level is the input itself.
    """
    dims, fixed, n = list(dims), list(fixed), len(dims)
    keys = [*fixed, *dims, "level"]
    src = cells.select(*fixed, *dims, F.lit(0).alias("level"), "hashes")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = _Partial(k)
        kinds: list = []
        for b in batches:
            kinds = [b.schema.field(x).type for x in keys]
            for key, values in _rows(b, keys):
                head, tail = key[: len(fixed)], key[len(fixed) : -1]
                for level in range(1, 1 << n):
                    state.add((*head, *(None if level >> (n - 1 - i) & 1 else tail[i] for i in range(n)), level), values)
            if state.size > HELD:
                yield state.drain(keys, kinds)
        if state.parts:
            yield state.drain(keys, kinds)

    return src.unionByName(merge_sketches(src.mapInArrow(run, _ddl(src, keys)), keys, k))


def theta(hashes: Column, k: int = K) -> Column:
    """Share of the hash range that a sketch covers; 1 where it is the whole set."""
    return F.when(F.size(hashes) >= k, F.element_at(hashes, k).cast("double") / F.lit(RANGE)).otherwise(F.lit(1.0))


def _below(hashes: Column, th: Column) -> Column:
    return F.filter(hashes, lambda h: h.cast("double") / F.lit(RANGE) < th)


def bounds(count: Column, th: Column) -> tuple[Column, Column, Column]:
    """(estimate, lower, upper) as BIGINT of a set of which ``count`` hash values lie below theta."""
    c = count.cast("double")
    half = F.lit(Z) * F.sqrt(c * (F.lit(1.0) - th)) / th
    upper = F.when((count == 0) & (th < 1), F.lit(3.0) / th).otherwise(c / th + half)
    return (F.floor(c / th + F.lit(0.5)).cast("bigint"), F.greatest(c, F.floor(c / th - half).cast("double")).cast("bigint"), F.ceil(upper).cast("bigint"))


def with_estimate(sketches: DataFrame, k: int = K) -> DataFrame:
    """``estimate, lower, upper, exact`` in place of ``hashes``."""
    h = F.col("hashes")
    th = theta(h, k)
    count = F.when(F.size(h) >= k, F.lit(k - 1)).otherwise(F.size(h))
    e, lo, up = bounds(count, th)
    return sketches.withColumns({"estimate": e, "lower": lo, "upper": up, "exact": F.size(h) < k}).drop("hashes")


def with_set_operations(pairs: DataFrame, a: str, b: str, k: int = K) -> DataFrame:
    """Estimates and bounds of union, intersection and both differences of two sketches, in place of them.

    All are counted below the smaller theta, within the k smallest values of the union.
    A null sketch is an empty set.
    """
    empty = F.array().cast("array<bigint>")
    x, y = F.coalesce(a, empty), F.coalesce(b, empty)
    both = F.array_sort(F.array_union(x, y))
    out = pairs.withColumn("_t", F.least(theta(x, k), theta(y, k), theta(both, k)))
    x, y = _below(x, F.col("_t")), _below(y, F.col("_t"))
    for name, c in (("union", F.array_union(x, y)), ("both", F.array_intersect(x, y)), (f"{a}_only", F.array_except(x, y)), (f"{b}_only", F.array_except(y, x))):
        e, lo, up = bounds(F.size(c), F.col("_t"))
        out = out.withColumns({f"{name}_estimate": e, f"{name}_lower": lo, f"{name}_upper": up})
    return out.drop("_t", a, b)
