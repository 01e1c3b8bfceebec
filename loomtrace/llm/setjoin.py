"""All similar pairs between set-valued records (problem 3).

Records with the same set form a class; the join runs over one representative a class.
Inverted lists are partitioned by prefix item: a pair with Jaccard similarity >= t shares
an item among the rarest ``s - ceil(t * s) + 1`` of each set of size ``s``. A partition's
records come in the order of size; the lists of a record's items are merged with a heap
that skips, the longest lists are searched by bisection, and records reaching the
required overlap are emitted, once, in the partition of the first item both share; then
the record joins the lists. An item with many records has a partition for each second
item that its pairs share, so that a hot item is taken apart by its sets and not by
copying probes; only where two items together are hot, a partition is split into shards.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.arrow import plain
from ..session import written

#: Records of one item that one task indexes; items with more are partitioned by a second item too, and split where that has more.
SHARD = 20_000
#: Bound of the broadcast list of partitions that are split.
MOST_SPLIT = 100_000


def needed(a: int, b: int, num: int, den: int) -> int:
    """Least overlap of sets of sizes ``a`` and ``b`` with Jaccard >= num/den."""
    return -(-num * (a + b) // (num + den))


def merge_skip(lists: list[list[int]], at: list[int], ends: list[int], t: int) -> Iterator[tuple[int, int]]:
    """(value, occurrences) of all values in at least ``t`` of the sorted lists, read from ``at`` to ``ends``."""
    heap = [(lists[i][at[i]], i) for i in range(len(lists)) if at[i] < ends[i]]
    heapify(heap)
    while len(heap) >= t:
        top, popped = heap[0][0], []
        while heap and heap[0][0] == top:
            popped.append(heappop(heap)[1])
        if len(popped) >= t:
            yield top, len(popped)
            for i in popped:
                at[i] += 1
                if at[i] < ends[i]:
                    heappush(heap, (lists[i][at[i]], i))
            continue
        while heap and len(popped) < t - 1:
            popped.append(heappop(heap)[1])
        if not heap:
            return
        target = heap[0][0]
        for i in popped:
            at[i] = bisect_left(lists[i], target, at[i], ends[i])
            if at[i] < ends[i]:
                heappush(heap, (lists[i][at[i]], i))


class Lists:
    """Inverted lists of records that come in the order of size, so lists are in that order."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den
        self.sizes: list[int] = []
        self.ids: list[int] = []
        self.lists: dict = {}

    def add(self, rid: int, items: list, *all_have: object) -> None:
        """A record; the items ``all_have`` are not listed, as every record of the partition has them."""
        n = len(self.ids)
        self.sizes.append(len(items))
        self.ids.append(rid)
        lists = self.lists
        if not n:
            self.lists = {x: [0] for x in items if x not in all_have}
            return
        for x in items:
            if x in all_have:
                continue
            if (found := lists.get(x)) is None:
                lists[x] = [n]
            else:
                found.append(n)

    def _has(self, item: object, n: int) -> bool:
        found = self.lists.get(item, ())
        k = bisect_left(found, n)
        return k < len(found) and found[k] == n

    def probe(self, items: list, first: int, second: int | None = None) -> Iterator[tuple[int, int, int]]:
        """(id, size, overlap) of the similar records held whose first shared item is ``items[first]`` (and the second ``items[second]``)."""
        size, num, den = len(items), self.num, self.den
        least = -(-num * size // den)
        lo, hi = bisect_left(self.sizes, least), len(self.sizes)
        known = 1 if second is None else 2
        t = needed(size, least, num, den) - known
        # items before the first one shared take no part, nor do those between the first two
        others = items[first + 1 :] if second is None else items[second + 1 :]
        if lo >= hi or len(others) < t:
            return
        # items come with the rarest first, so the last lists are the longest: they are left to bisection, and
        # the others must still show t - n_long occurrences
        n_long = min(t - 1, max(1, int(t / (0.01 * math.log2(hi - lo + 1) + 1)))) if t > 1 and hi - lo > 1 else max(t - 1, 0)
        cut = len(others) - n_long
        lists, at, ends = [], [], []
        for x in others[:cut]:
            if found := self.lists.get(x):
                a = bisect_left(found, lo) if lo else 0
                if a < len(found):
                    lists.append(found)
                    at.append(a)
                    ends.append(len(found))
        if len(lists) < t - n_long:
            return
        if t > 0:
            rest, candidates = others[cut:], merge_skip(lists, at, ends, t - n_long)
        else:
            rest, candidates = others, ((n, 0) for n in range(lo, hi))
        apart = items[:first] if second is None else items[:first] + items[first + 1 : second]
        total, sizes = num + den, self.sizes
        for n, count in candidates:
            # how many of the lists left may miss it
            spare = count + known + len(rest) - -(-num * (size + sizes[n]) // total)
            if spare < 0:
                continue
            for x in rest:
                if self._has(x, n):
                    count += 1
                elif spare:
                    spare -= 1
                else:
                    break
            else:
                if not any(self._has(x, n) for x in apart):
                    yield self.ids[n], sizes[n], count + known


def clean_sets(df: DataFrame, rid: str, items: str, keep: str | None = None) -> DataFrame:
    """``rid, items``: one row per id with its distinct, non-null values (that meet ``keep``, SQL on ``x``), sorted.

    Rows of one id are merged into one set; ids without values and null ids are left out,
    since empty sets are similar to nothing.
    """
    cond = f"x is not null and ({keep})" if keep else "x is not null"
    one = df.where(F.col(rid).isNotNull()).select(F.col(rid).alias("rid"), F.expr(f"array_sort(array_distinct(filter(`{items}`, x -> {cond})))").alias("items"))
    per = one.where(F.size("items") > 0).groupBy("rid").agg(F.collect_set("items").alias("all"))
    # ids with several different sets are few; only they are taken apart
    merged = F.when(F.size("all") == 1, F.element_at("all", 1)).otherwise(F.array_sort(F.array_distinct(F.flatten("all"))))
    return per.select("rid", merged.alias("items"))


def set_classes(sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(``class_id, items``, ``rid, class_id``): classes of equal sets, named by their smallest id, and who belongs to them."""
    classes = sets.groupBy("items").agg(F.min("rid").alias("class_id")).select("class_id", "items")
    members = sets.join(classes, "items").select("rid", "class_id")
    return classes, members


def _by_rarity(classes: DataFrame, own: list[str]) -> DataFrame:
    """``own`` columns, ``size, items, n``: items with the rarest first (ties by the item), and in how many classes each is.

    An item that a third of the classes hold has one row of each of them, which Spark's
    handling of skewed joins splits.
    """
    long = classes.select(*own, F.explode("items").alias("x"))
    counts = long.groupBy("x").agg(F.count("*").alias("n"))
    rows = long.join(counts, "x").groupBy(*own).agg(F.sort_array(F.collect_list(F.struct("n", "x"))).alias("o"))
    return rows.select(*own, F.size("o").alias("size"), F.col("o.x").alias("items"), F.col("o.n").alias("n"))


def similar_classes(classes: DataFrame, num: int, den: int, shard: int = SHARD, side: str | None = None) -> DataFrame:
    """``a, b, overlap, size_a, size_b``: each pair of classes with Jaccard >= num/den once, ``a < b``.

    Compared in integers, so a similarity of exactly num/den is in. Ids are BIGINT.
    With ``side`` (a column of two values) only pairs of different sides come out, ``a``
    being of the smaller one; an id may then occur once on each side. Two classes of one
    side must not have the same set. The classes are stored once on the way.
    """
    kind = dict(classes.dtypes)["items"]
    key = ["class_id", "side"] if side else ["class_id"]
    one = classes.select("class_id", *([F.col(side).cast("string").alias("side")] if side else []), "items")
    sets, _ = written(_by_rarity(one, key))
    prefix = F.col("size") - F.ceil(F.col("size") * num / F.lit(float(den)) - F.lit(1e-9)).cast("int") + 1
    own = [*key, "size", "items"]
    # an item no other class has is shared by no pair
    keyed = sets.select(*own, F.col("n").alias("ns"), prefix.alias("p"), F.posexplode(F.slice(F.arrays_zip(F.col("items").alias("x"), F.col("n").alias("n")), F.lit(1), prefix)).alias("pos", "s"))
    keyed = keyed.select(*own, "ns", "p", "pos", "s.x", "s.n").where("n > 1")
    # two different sets that share one item only are less than half alike, so others share a second one, among one item more
    paired = 2 * num > den
    few = (F.col("n") <= shard) if paired else F.lit(True)
    cold = keyed.where(few).select(*own, "pos", "x", F.lit(None).cast("int").alias("pos2"), F.lit(None).cast(kind[6:-1]).alias("y"))
    hot = keyed.where(~few)
    after = F.slice(F.arrays_zip(F.col("items").alias("x"), F.col("ns").alias("n")), F.col("pos") + 2, F.greatest(F.col("p") - F.col("pos"), F.lit(0)))
    hot = hot.select(*own, "pos", "x", F.posexplode(after).alias("k", "s")).where("s.n > 1").select(*own, "pos", "x", (F.col("pos") + 1 + F.col("k")).alias("pos2"), F.col("s.x").alias("y"))
    if side:
        # equal sets of one item each, one on either side
        hot = hot.unionByName(keyed.where(~few).where("size = 1").select(*own, "pos", "x", F.lit(None).cast("int").alias("pos2"), F.lit(None).cast(kind[6:-1]).alias("y")))
    rows = cold.unionByName(hot)
    large = rows if not paired else hot
    groups = large.groupBy("x", "y").agg(F.count("*").alias("n")).where(F.col("n") > shard)
    split = groups.orderBy(F.desc("n"), "x", "y").limit(MOST_SPLIT).select(F.col("x").alias("sx"), F.col("y").alias("sy"), F.ceil(F.col("n") / F.lit(float(shard))).cast("int").alias("shards"))
    rows = rows.join(F.broadcast(split), F.col("x").eqNullSafe(F.col("sx")) & F.col("y").eqNullSafe(F.col("sy")), "left").withColumn("shards", F.coalesce("shards", F.lit(1))).drop("sx", "sy")
    mine = F.pmod(F.xxhash64(*key), F.col("shards")).cast("int")
    # in a split partition every record is held by its shard and asks all shards
    rows = rows.withColumn("shard", F.explode(F.sequence(F.lit(0), F.col("shards") - 1))).withColumn("held", F.col("shard") == mine)
    cols = ["x", "y", "shard", "held", "pos", "pos2", "items", *key]
    rows = rows.repartition("x", "y", "shard").sortWithinPartitions("x", "y", "shard", "size", *key).select(*cols)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []

        def flush() -> pa.RecordBatch:
            got = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32()))], names=["a", "b", "overlap", "size_a", "size_b"])
            out.clear()
            return got

        current: tuple | None = None
        # the latest record joins the lists only when there is a next one
        waiting: tuple | None = None
        lists: dict[str, Lists] = {}
        for b in batches:
            columns = [plain(b.column(i)) for i in range(8)]
            sides = plain(b.column(8)) if side else [""] * b.num_rows
            for x, y, k, held, pos, pos2, items, rid, s in zip(*columns, sides):
                if (x, y, k) != current:
                    current, waiting, lists = (x, y, k), None, {}
                elif waiting is not None:
                    side_, *record = waiting
                    if (index := lists.get(side_)) is None:
                        index = lists[side_] = Lists(num, den)
                    index.add(*record, *((x,) if y is None else (x, y)))
                    waiting = None
                for t, index in lists.items():
                    if side is None or t != s:
                        for other, size, overlap in index.probe(items, pos, pos2):
                            flip = (t < s) if side is not None else (other < rid)
                            out.append((other, rid, overlap, size, len(items)) if flip else (rid, other, overlap, len(items), size))
                if held:
                    waiting = (s, rid, items)
                if len(out) >= 20_000:
                    yield flush()
        if out:
            yield flush()

    return rows.mapInArrow(run, "a bigint, b bigint, overlap int, size_a int, size_b int")


def similar_pairs(members: DataFrame, pairs: DataFrame) -> DataFrame:
    """``a, b``: the pairs of ids behind pairs of classes, and those within a class; smaller id first."""
    m, n = members.alias("m"), members.alias("n")
    across = pairs.join(m, F.col("a") == F.col("m.class_id")).join(n, F.col("b") == F.col("n.class_id"))
    across = across.select(F.least("m.rid", "n.rid").alias("a"), F.greatest("m.rid", "n.rid").alias("b"))
    within = m.join(n, (F.col("m.class_id") == F.col("n.class_id")) & (F.col("m.rid") < F.col("n.rid"))).select(F.col("m.rid").alias("a"), F.col("n.rid").alias("b"))
    return across.unionByName(within)
