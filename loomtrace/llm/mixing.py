"""Mixing sources to target shares of the total size (problem 8).

The records of a source are spread over shards, put in seeded order there and cut into
blocks of about equal size; a record larger than a block is one by itself. Sainte-Lague
apportionment allocates blocks to sources by the highest quotients ``share / (2 q + 1)``,
and a source's blocks to its shards likewise, which gives an integer quota per shard;
blocks are then chosen in seeded order until the quota's size is reached. All records are
used once before any a second time. The number of blocks is the largest for which no
source needs more than its capped repeats.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut

BLOCK = 1_024
SHARD_ROWS = 20_000


def sainte_lague(weights: Sequence[float], seats: int) -> np.ndarray:
    """Seats by highest quotients ``weight / (2 q + 1)``; of equal quotients the first weight's counts first.

    Found by a divisor search in place of a seat-by-seat count, so it takes as long for
    10^12 seats as for ten.
    """
    w = np.asarray(weights, dtype=np.float64)
    out = np.zeros(len(w), dtype=np.int64)
    if seats <= 0 or not (w > 0).any():
        return out
    rounded = lambda x: np.floor(w * x + 0.5)
    lo, hi = 0.0, 2.0 * (seats + len(w)) / w.sum()
    for _ in range(200):
        mid = (lo + hi) / 2
        if rounded(mid).sum() <= seats:
            lo = mid
        else:
            hi = mid
    out = rounded(lo).astype(np.int64)
    while (left := seats - int(out.sum())) > 0:
        # quotients that tie at the divisor
        for i in np.argsort(-w / (2 * out + 1), kind="stable")[:left]:
            if w[i] > 0:
                out[i] += 1
                break
    return out


def most_blocks(shares: Sequence[float], caps: Sequence[int]) -> tuple[int, np.ndarray]:
    """(blocks, blocks per source): as many as Sainte-Lague can allocate with no source above its cap."""
    s = np.asarray(shares, dtype=np.float64)
    c = np.asarray(caps, dtype=np.int64)
    if not (s > 0).any():
        return 0, np.zeros(len(s), dtype=np.int64)
    lo, hi = 0, int(min((c[s > 0] + 1) / s[s > 0] * s.sum())) + len(s) + 1
    while lo < hi:
        mid = (lo + hi + 1) // 2
        if (sainte_lague(s, mid) <= c).all():
            lo = mid
        else:
            hi = mid - 1
    return lo, sainte_lague(s, lo)


def normal_source(c: str) -> F.Column:
    return F.lower(F.btrim(F.col(c), F.lit(" \t\r\n")))


def chosen(sizes: Sequence[int], quota: float, block: float, seed: int) -> np.ndarray:
    """True for records that together come as close to ``quota`` as whole blocks, then single records, bring them without exceeding it.

    Records follow each other in blocks of at most ``block``; those larger than that are
    blocks by themselves. Blocks are taken in seeded order where they still fit, then
    records of the blocks left over where they do. Records of size 0 come with the record
    before them.
    """
    of, last, held = np.zeros(len(sizes), dtype=np.int64), -1, 0.0
    for i, s in enumerate(sizes):
        if last < 0 or (s and held + s > block):
            last, held = last + 1, 0.0
        of[i] = last
        held += s
    took = np.zeros(len(sizes), dtype=bool)
    if last < 0 or quota <= 0:
        return took
    weights = np.bincount(of, weights=np.asarray(sizes, dtype=np.float64))
    left, taken = quota + 1e-6, np.zeros(last + 1, dtype=bool)
    for k in np.random.default_rng(seed).permutation(last + 1):
        if weights[k] <= left:
            taken[k] = True
            left -= weights[k]
    took = taken[of]
    for i in np.flatnonzero(~took):
        if 0 < sizes[i] <= left:
            took[i] = True
            left -= sizes[i]
    # the rest is less than any record left; the smallest of them goes in where it brings the sum nearer
    rest = [i for i in np.flatnonzero(~took) if sizes[i] > 0]
    if rest and (i := min(rest, key=lambda j: (sizes[j], j))) is not None and sizes[i] - left < left:
        took[i] = True
    return took


def mix(records: DataFrame, rid: str, source: str, size: str, targets: Sequence[tuple[str, float, int]], block: int = BLOCK, shard_rows: int = SHARD_ROWS, seed: int = 1) -> DataFrame:
    """``rid, source, size, uses``: the records of listed sources with how often each is used (0 too).

    ``targets``: (source, share, most repeats), few; a source listed twice takes the sum
    of its shares and its lower cap. Sources are compared as they are: normalise them
    before. Null, unlisted and share-less sources take no part and do not come out. A
    listed source without size has nothing to give; its share goes to the others in
    proportion. Null sizes count as 0. The records are stored once on the way. A shard
    misses its quota by less than its smallest record that is left out.
    """
    wanted: dict[str, tuple[float, int]] = {}
    for s, share, most in targets:
        if s is not None and share is not None and share > 0 and most is not None and most > 0:
            old = wanted.get(s)
            wanted[s] = (share + old[0], min(most, old[1])) if old else (float(share), int(most))
    one = records.where(F.col(source).isin(list(wanted))).select(F.col(rid).alias("_id"), F.col(source).alias("source"), F.coalesce(F.col(size).cast("bigint"), F.lit(0)).alias("size"))
    one = cut(one)
    # one row per listed source
    stats = {r["source"]: r for r in one.groupBy("source").agg(F.count("*").alias("n"), F.sum("size").alias("size")).collect() if r["size"] > 0}
    if not stats:
        return one.select(F.col("_id").alias(rid), "source", "size", F.lit(0).cast("bigint").alias("uses"))
    shards = F.lit(1)
    for s, r in stats.items():
        shards = F.when(F.col("source") == s, F.lit(-(-r["n"] // shard_rows))).otherwise(shards)
    rows = one.withColumns({"shard": F.pmod(F.xxhash64("_id", F.lit(seed)), shards).cast("int"), "_h": F.xxhash64("_id", F.lit(seed), F.lit("place"))})
    # one row for each shard of shard_rows records
    per_shard = rows.groupBy("source", "shard").agg(F.sum("size").alias("all"))
    per_shard = per_shard.withColumn("blocks", F.when(F.col("all") > 0, F.greatest(F.lit(1), F.round(F.col("all") / block).cast("bigint"))).otherwise(F.lit(0)))
    blocks = {r["source"]: r["blocks"] for r in per_shard.groupBy("source").agg(F.sum("blocks").alias("blocks")).collect()}
    names = sorted(stats)
    # blocks of a source are of size (its size / its blocks): shares in blocks are corrected by that
    weights = [wanted[s][0] * blocks[s] / stats[s]["size"] for s in names]
    _, given = most_blocks(weights, [wanted[s][1] * blocks[s] for s in names])
    quota = dict(zip(names, map(int, given)))

    def by_shard(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("shard")
        return pdf.assign(quota=sainte_lague(pdf["blocks"].to_numpy(), quota.get(pdf["source"].iloc[0], 0)))[["source", "shard", "all", "blocks", "quota"]]

    quotas = per_shard.groupBy("source").applyInPandas(by_shard, "source string, shard int, all bigint, blocks bigint, quota bigint")
    kind = dict(records.dtypes)[rid]

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["_h", "_id"])
        first = pdf.iloc[0]
        n, q = int(first["blocks"]), int(first["quota"])
        uses = np.zeros(len(pdf), dtype=np.int64)
        if n:
            size = int(first["all"]) / n
            uses += q // n + chosen(pdf["size"].tolist(), q % n * size, size, seed + int(first["shard"]))
        return pd.DataFrame({rid: pdf["_id"], "source": pdf["source"], "size": pdf["size"], "uses": uses})

    # ids as text on the way through pandas, where a null would turn large numbers into floats
    rows = rows.join(quotas, ["source", "shard"]).withColumn("_id", F.col("_id").cast("string"))
    got = rows.groupBy("source", "shard").applyInPandas(choose, f"`{rid}` string, source string, size bigint, uses bigint")
    return got.withColumn(rid, F.col(rid).cast(kind))


def shares(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """Per listed source: target and reached share, size there is and size used, most uses of a record."""
    per = mixed.groupBy("source").agg(F.sum("size").alias("size"), F.sum(F.col("size") * F.col("uses")).alias("used"), F.max("uses").alias("most_uses"))
    t = targets.groupBy("source").agg(F.sum("target_share").alias("target_share"), F.min("max_repeats").alias("max_repeats"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    all_ = t.join(per, "source", "left").select("source", "target_share", "max_repeats", zero("size").alias("size"), zero("used").alias("used"), zero("most_uses").alias("most_uses"))
    total = per.agg(F.sum("used")).scalar()
    return all_.select("source", "target_share", F.round(F.col("used") / F.nullif(total, F.lit(0)), 6).alias("share"), "max_repeats", "most_uses", "size", "used")
