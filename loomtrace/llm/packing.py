"""Filling containers of fixed capacity (problem 7): minimum bin slack.

Items are spread over shards by a hash, so a task holds the lengths of one shard. A
container takes the longest remaining item first; a subset-sum over bitsets then finds
the multiset of remaining lengths that fills what is left most closely: bit ``i`` of an
integer says that some choice adds up to ``i``. Lengths enter from long to short, with
counts in binary parts, until the gap can be filled exactly or all are in; walking the
bitsets back gives the counts of the choice.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Items in a shard, on average.
SHARD_ITEMS = 4_000


def closest(lengths: Sequence[int], counts: dict[int, int], gap: int) -> dict[int, int]:
    """How many items of each length fill ``gap`` as far as possible without exceeding it.

    ``lengths``: ascending, each positive with a positive count. All that fit take part.
    """
    fit = lengths[: bisect_right(lengths, gap)]
    mask, bits = (1 << (gap + 1)) - 1, 1
    parts: list[tuple[int, int, int]] = []
    full = 1 << gap
    for length in reversed(fit):
        left, step = min(counts[length], gap // length), 1
        while left:
            take = min(step, left)
            parts.append((bits, length, take))
            bits |= bits << (length * take) & mask
            left -= take
            step *= 2
        if bits & full:
            break
    total, chosen = bits.bit_length() - 1, {}
    for before, length, take in reversed(parts):
        if not before >> total & 1:
            chosen[length] = chosen.get(length, 0) + take
            total -= length * take
    return chosen


def fill(sizes: Sequence[int], capacity: int) -> list[list[int]]:
    """Containers as lists of item numbers. Sizes lie between 0 and ``capacity``; items of size 0 join the first container."""
    by: dict[int, list[int]] = {}
    for i, s in enumerate(sizes):
        by.setdefault(s, []).append(i)
    empty = by.pop(0, [])
    lengths = sorted(by)
    counts = {s: len(v) for s, v in by.items()}
    out: list[list[int]] = []
    while lengths:
        seed = lengths[-1]
        chosen = {seed: 1}
        counts[seed] -= 1
        if not counts[seed]:
            lengths.pop()
        if capacity > seed and lengths:
            for s, c in closest(lengths, counts, capacity - seed).items():
                chosen[s] = chosen.get(s, 0) + c
                counts[s] -= c
                if not counts[s]:
                    del lengths[bisect_right(lengths, s) - 1]
        out.append([by[s].pop() for s, c in chosen.items() for _ in range(c)])
    if empty:
        out[:1] = [empty + (out[0] if out else [])]
    return out


def pack(items: DataFrame, item: str, size: str, capacities: Sequence[tuple[str, int]], shard_items: int = SHARD_ITEMS, total: int | None = None) -> DataFrame:
    """``pack, shard, container, item, part, start, tokens``: every item in a container of each kind.

    An item larger than the capacity is cut: as many whole containers as it fills, and
    its rest (``part`` numbers the pieces, ``start`` is the first unit of each) is packed
    like an item. Containers are numbered within kind and shard. A null size counts as
    0; items of size 0 take no space and lie in the shard's first container. ``item``
    BIGINT should be unique: rows with the same item are different items all the same.
    Kinds without name or capacity are left out; one listed twice has the lower capacity.
    ``total``: number of rows, counted if not given. Other columns are ignored.
    """
    spark = items.sparkSession
    n = items.count() if total is None else total
    shards = max(1, -(-n // shard_items))
    least: dict[str, int] = {}
    for p, c in capacities:
        if p is not None and c is not None:
            least[str(p)] = min(int(c), least.get(str(p), int(c)))
    kinds = sorted(least.items())
    if any(c < 1 for _, c in kinds):
        raise ValueError("capacities are at least 1")
    out = "pack string, shard int, container bigint, item bigint, part int, start bigint, tokens bigint"
    if not kinds:
        return spark.createDataFrame([], out)
    # as text on the way through pandas, where a null would turn large numbers into floats
    one = items.select(F.col(item).cast("bigint").cast("string").alias("item"), F.coalesce(F.col(size).cast("bigint"), F.lit(0)).alias("size"))
    one = one.withColumn("shard", F.pmod(F.xxhash64("item", F.lit(17)), F.lit(shards)).cast("int"))
    packs = F.array(*[F.struct(F.lit(p).alias("pack"), F.lit(c).alias("capacity")) for p, c in kinds])
    rows = one.select("item", "size", "shard", F.explode(packs).alias("p")).select("item", "size", "shard", "p.pack", "p.capacity")

    def shard(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["size", "item"])
        cap = int(pdf["capacity"].iloc[0])
        ids, sizes = [None if x is None else int(x) for x in pdf["item"]], pdf["size"].tolist()
        whole = [s // cap if s > cap else 0 for s in sizes]
        rests = [s - w * cap for s, w in zip(sizes, whole)]
        # pieces cut off larger items fill their containers alone; so does a rest of 0
        got: list[tuple] = []
        place = [i for i in range(len(ids)) if rests[i] or not whole[i]]
        c = 0
        for members in fill([rests[i] for i in place], cap):
            for m in members:
                i = place[m]
                got.append((c, ids[i], whole[i], whole[i] * cap, rests[i]))
            c += 1
        for i, w in enumerate(whole):
            for p in range(w):
                got.append((c, ids[i], p, p * cap, cap))
                c += 1
        df = pd.DataFrame(got, columns=["container", "item", "part", "start", "tokens"], dtype=object)
        df["item"] = pd.array([x[1] for x in got], dtype="Int64")
        df.insert(0, "shard", pdf["shard"].iloc[0])
        df.insert(0, "pack", pdf["pack"].iloc[0])
        return df

    return rows.groupBy("pack", "shard").applyInPandas(shard, out)
