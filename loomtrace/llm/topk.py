"""Most frequent values in bounded memory, exactly (problem 5): prefix refinement.

Values are hashed to 64 bits. A pass counts the rows of every hash prefix; a prefix
whose rows are fewer than a lower bound of the count that matters cannot hold a wanted
value and is dropped, with all its values. The kept prefixes are lengthened, and the
next pass counts only rows under them, until each prefix holds a single value, so that
its count is that value's. A pass counts about ``GROUPS`` prefixes at most; where more
are kept than fit, they are refined in several passes, those with most rows first.

The lower bound is a share of all rows, or that of the k-th largest count: the k-th of
exact counts of candidates from a sample to begin with (the counts of any k values bound
it from below), raised by values found. The sample decides only how soon prefixes are
dropped, never the result.
"""

from __future__ import annotations

from heapq import nlargest

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Prefixes counted in one pass at most, and so the memory a task or the driver needs.
GROUPS = 1 << 16
#: About so many rows are sampled for candidates.
SAMPLE = 100_000
BITS = 64


def _prefix(bits: int) -> Column:
    return F.shiftrightunsigned("_h", BITS - bits)


def _counts(rows: DataFrame, bits: int) -> DataFrame:
    return rows.groupBy("_g", _prefix(bits).alias("_p")).agg(F.count("*").alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))


def _candidate_floors(src: DataFrame, totals: dict, k: int) -> dict:
    """By group, the k-th largest of the exact counts of the values most frequent in a sample; groups with fewer are absent."""
    sample = src.sample(False, min(1.0, SAMPLE / max(1, sum(totals.values()))), 11)
    seen = sample.groupBy("_g", "_v").agg(F.count("*").alias("n"))
    best = seen.withColumn("i", F.row_number().over(W.partitionBy("_g").orderBy(F.desc("n"), "_v"))).where(F.col("i") <= 2 * k)
    best = best.select(F.col("_g").alias("cg"), F.col("_v").alias("cv"))
    exact = src.join(F.broadcast(best), F.col("_g").eqNullSafe(F.col("cg")) & (F.col("_v") == F.col("cv")), "left_semi").groupBy("_g", "_v").agg(F.count("*").alias("n"))
    by: dict = {}
    for r in exact.collect():  # at most 2 k values a group
        by.setdefault(r["_g"], []).append(r["n"])
    return {g: sorted(n, reverse=True)[k - 1] for g, n in by.items() if len(n) >= k}


def frequent(df: DataFrame, value: str, group: str | None = None, k: int | None = None, share: float | None = None, groups: int = GROUPS) -> DataFrame:
    """``item, rows`` (and ``group``): values with at least ``share`` of the group's rows, or the ``k`` most frequent.

    Counts are exact. With both ``k`` and ``share``, values that satisfy both; ties at
    the k-th place go to the smallest values. Null values neither count as rows nor come
    out; ``group`` (text, few different) separates results, null is a group. Jobs run on
    the way: ``df`` is read once for each pass, two to four in practice, so it should be
    a stored table. The driver receives kept prefixes only.
    """
    if k is None and share is None:
        raise ValueError("k or share is needed")
    spark = df.sparkSession
    g = F.lit(None).cast("string") if group is None else F.col(group).cast("string")
    src = df.where(F.col(value).isNotNull()).select(g.alias("_g"), F.col(value).alias("_v"), F.xxhash64(value).alias("_h"))
    kinds = dict(src.dtypes)
    # the first pass also gives the totals, and with a share the floors, without leaving the cluster
    totals = {r["_g"]: r["n"] for r in src.groupBy("_g").agg(F.count("*").alias("n")).collect()}
    floors = {x: max(1.0, (share or 0.0) * t * (1 - 1e-12)) for x, t in totals.items()}
    if k is not None:
        for x, c in _candidate_floors(src, totals, k).items():
            floors[x] = max(floors[x], float(c))
    found: dict = {x: [] for x in totals}

    def bar() -> DataFrame:
        return F.broadcast(spark.createDataFrame(list(floors.items()), "fg string, floor double"))

    def settle(g: str | None) -> None:
        if k is not None:
            found[g] = nlargest(k, found[g], key=lambda x: (x[0], _Reverse(x[1])))
            if len(found[g]) >= k:
                floors[g] = max(floors[g], float(found[g][-1][0]))

    pending: list[tuple[int, list]] = [(0, [(x, 0, t) for x, t in totals.items()])] if totals else []
    while pending:
        bits, batch = pending.pop()
        batch = [r for r in batch if r[2] >= floors[r[0]]]
        if not batch:
            continue
        longer = min(BITS, bits + max(1, (groups // len(batch)).bit_length() - 1))
        rows = src
        if bits:
            kept = spark.createDataFrame([(r[0], r[1]) for r in batch], "kg string, kp bigint")
            rows = src.join(F.broadcast(kept), F.col("_g").eqNullSafe(F.col("kg")) & (_prefix(bits) == F.col("kp")), "left_semi")
        counted = _counts(rows, longer).join(bar(), F.col("_g").eqNullSafe(F.col("fg"))).where(F.col("_n") >= F.col("floor"))
        open_: list = []
        for r in counted.collect():
            if r["_lo"] == r["_hi"]:
                found[r["_g"]].append((r["_n"], r["_lo"]))
            else:
                open_.append((r["_g"], r["_p"], r["_n"]))
        if longer >= BITS and open_:
            # values with one and the same hash: counted by value
            kept = spark.createDataFrame([(r[0], r[1]) for r in open_], "kg string, kp bigint")
            same = src.join(F.broadcast(kept), F.col("_g").eqNullSafe(F.col("kg")) & (_prefix(BITS) == F.col("kp")), "left_semi").groupBy("_g", "_v").agg(F.count("*").alias("n"))
            for r in same.collect():
                if r["n"] >= floors[r["_g"]]:
                    found[r["_g"]].append((r["n"], r["_v"]))
            open_ = []
        for x in found:
            settle(x)
        open_.sort(key=lambda r: r[2])
        size = max(1, groups // 4)
        pending += [(longer, open_[i : i + size]) for i in range(0, len(open_), size)]
    out = spark.createDataFrame([(x, v, n) for x, fs in found.items() for n, v in fs if n >= floors[x]], f"g string, item {kinds['_v']}, rows bigint")
    return out.drop("g") if group is None else out.withColumnRenamed("g", group)


class _Reverse:
    """Orders the other way round."""

    __slots__ = ("x",)

    def __init__(self, x: object):
        self.x = x

    def __lt__(self, other: _Reverse) -> bool:
        return other.x < self.x

    def __eq__(self, other: object) -> bool:
        return self.x == other.x
