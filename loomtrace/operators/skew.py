"""Per-key results where a few keys hold most rows.

Heavy keys are found on a sample and their list, of at most ``MOST_HEAVY`` keys, is
broadcast: rows that join it are worked on in pieces where they lie or spread over all
tasks, all other keys go through an ordinary shuffle, and both are united. The sample
decides only which way a key goes, never a result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Rows from which a key is too much for one task and is worked on in pieces.
HEAVY_ROWS = 1 << 16
#: Bound of the broadcast list; beyond it the most frequent keys are in.
MOST_HEAVY = 100_000
SAMPLE_FRACTION = 0.02


def heavy_keys(df: DataFrame, keys: Sequence[str], rows: int = HEAVY_ROWS, fraction: float = SAMPLE_FRACTION, most: int = MOST_HEAVY, seed: int = 7) -> DataFrame:
    """The most frequent keys with at least about ``rows`` rows, counted on a sample: at most ``most``, in one scan.

    Small tables give no heavy keys. Null is a key like others.
    """
    sample = df.select(*keys).sample(False, fraction, seed).groupBy(*keys).agg(F.count("*").alias("_n"))
    return sample.where(F.col("_n") >= max(2.0, rows * fraction)).orderBy(F.desc("_n"), *keys).limit(most).select(*keys)


def _on(df: DataFrame, heavy: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, Column]:
    """The broadcast list and the condition of a join with it, null equal to null."""
    h = F.broadcast(heavy.select(*[F.col(k).alias(f"_h_{k}") for k in keys]))
    on = None
    for k in keys:
        c = df[k].eqNullSafe(F.col(f"_h_{k}"))
        on = c if on is None else on & c
    return h, on


def changes(df: DataFrame, keys: Sequence[str], order: str, segment: str, value: str, heavy: DataFrame) -> DataFrame:
    """Rows whose ``value`` differs from that of the previous row of their key, by ``order``.

    The first row of a key is no change. ``segment`` must not decrease with ``order``;
    it cuts the rows of heavy keys into pieces. A piece finds the changes inside it;
    its first row is compared with the last value of the piece before, out of a table
    with one row per heavy key and piece. Rows whose ``order`` or ``value`` is null take
    no part; rows of one key with the same ``order`` are copies and count once, with the
    smallest value. A null key is a key. The result has the columns named, no others.
    """
    df = df.where(F.col(order).isNotNull() & F.col(value).isNotNull()).select(*keys, order, segment, value)
    h, on = _on(df, heavy, keys)

    def steps(rows: DataFrame, *part: str) -> DataFrame:
        w = W.partitionBy(*part).orderBy(order, value)
        rows = rows.withColumn("_again", F.col(order).eqNullSafe(F.lag(order).over(w))).where(~F.col("_again")).drop("_again")
        return rows.withColumn("_before", F.lag(value).over(w))

    changed = F.col("_before") != F.col(value)
    ordinary = steps(df.join(h, on, "left_anti"), *keys).where(changed).select(*df.columns)
    # rows that lie by a part of these columns already are not moved
    pieces = steps(df.join(h, on, "left_semi"), *keys, segment)
    inside = pieces.where(changed).select(*df.columns)
    ends = pieces.groupBy(*keys, segment).agg(F.min_by(F.struct(*df.columns), order).alias("_first"), F.max_by(value, order).alias("_last"))
    seams = (
        ends.withColumn("_before", F.lag("_last").over(W.partitionBy(*keys).orderBy(segment)))
        .where(F.col("_before") != F.col(f"_first.{value}"))
        .select(*[F.col(f"_first.{c}").alias(c) for c in df.columns])
    )
    return ordinary.unionByName(inside).unionByName(seams)


def aggregate(df: DataFrame, keys: Sequence[str], partial: dict[str, Column], final: dict[str, Column], heavy: DataFrame, spread: Sequence[str], salts: int = 64) -> DataFrame:
    """``groupBy(keys)`` in which heavy keys are first aggregated in ``salts`` pieces each.

    ``partial``: aggregates over rows; ``final``: aggregates over the partial columns
    of the same name. ``spread`` are the columns whose hash picks the piece. A null key
    is a key; ``_salt`` is not to be used as a name.
    """
    h, on = _on(df, heavy, keys)
    aggs = [c.alias(n) for n, c in partial.items()]
    pieces = (
        df.join(h, on, "left_semi")
        .withColumn("_salt", F.pmod(F.xxhash64(*spread), F.lit(salts)))
        .groupBy(*keys, "_salt")
        .agg(*aggs)
        .groupBy(*keys)
        .agg(*[c.alias(n) for n, c in final.items()])
    )
    rest = df.join(h, on, "left_anti").groupBy(*keys).agg(*aggs).select(*keys, *partial)
    return pieces.unionByName(rest)
