"""Ordered scans over traces without one task per trace.

A trace may hold a third of all rows, so no window here is partitioned by the
trace alone. Lines are cut into chunks of ``CHUNK`` consecutive ``seq`` values;
each chunk is scanned by itself, and one summary row per chunk carries state
over to later chunks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.values import parse_id

#: Widest range of ``seq`` in one chunk, so also the most lines a chunk can have.
CHUNK = 1 << 16


def readable_lines(trace: DataFrame, keys: list[str], *extra: str) -> DataFrame:
    """``trace_id, seq, k, value`` (and ``extra``) of the readable rows with these keys.

    Copies of a line are still separate rows. Rows without ``seq`` have no place in
    a trace and are not lines; a null ``trace_id`` counts as a trace of its own.
    """
    return (
        trace.where(F.col("k").isin(keys) & F.col("seq").isNotNull())
        .select("trace_id", "seq", "k", parse_id("v").alias("value"), *extra)
        .where(F.col("value").isNotNull())
    )


def with_chunk(df: DataFrame, width: int = CHUNK) -> DataFrame:
    """``df`` with ``chunk``; as it is where it has one, so that rows stay where a shuffle has put them."""
    if "chunk" in df.columns:
        return df
    bits = width.bit_length() - 1
    at = F.shiftright("seq", bits) if width == 1 << bits else F.floor(F.col("seq") / F.lit(width)).cast("bigint")
    return df.withColumn("chunk", at)


def in_chunk(*more: str) -> W:
    return W.partitionBy("trace_id", "chunk", *more).orderBy("seq")


def first_copy() -> Column:
    """True for one of the copies of a line, within a chunk ordered by ``seq``."""
    return ~F.col("seq").eqNullSafe(F.lag("seq").over(in_chunk()))


def events(trace: DataFrame, keys: list[str], width: int | None = None) -> DataFrame:
    """``trace_id, seq, chunk, k, value``: one row per readable line with these keys.

    One shuffle by chunk and one sort serve this and the ordered scans that follow.
    """
    rows = readable_lines(trace, keys).drop("chunk")
    rows = with_chunk(rows) if width is None else with_chunk(rows, width)
    return rows.withColumn("_first", first_copy()).where("_first").drop("_first")


def writers(trace: DataFrame, width: int | None = None) -> DataFrame:
    """``trace_id, seq, chunk, addr, writer``: every readable store line with its writer.

    The writer is the block of the nearest earlier readable ``BBEnter`` line of the
    trace; stores without one are left out. Copies of a line give one row.
    """
    ev = events(trace, ["BBEnter", "StoreAddress"], width).select(
        "trace_id", "seq", "chunk",
        F.when(F.col("k") == "BBEnter", F.col("value")).alias("block"),
        F.when(F.col("k") == "StoreAddress", F.col("value")).alias("addr"),
    )
    local = ev.withColumn("local", F.last("block", ignorenulls=True).over(in_chunk().rowsBetween(W.unboundedPreceding, 0))).where(F.col("addr").isNotNull())
    # one row a chunk: its last block, and from it the last block of all earlier chunks
    carry = before_chunk(ev, ["trace_id"], {"carry": (F.max_by("block", F.when(F.col("block").isNotNull(), F.col("seq"))), "last")})
    rows = join_null_safe(local, carry, ["trace_id", "chunk"])
    return rows.select("trace_id", "seq", "chunk", "addr", F.coalesce("local", "carry").alias("writer")).where(F.col("writer").isNotNull())


def lines(trace: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """``trace_id, seq, chunk, k, v, value, ts``: one row per line; of its copies the greatest of each column.

    ``value`` is the readable value of ``v`` or NULL. Rows are shuffled once, by chunk.
    """
    rows = trace.where(F.col("seq").isNotNull())
    if keys is not None:
        rows = rows.where(F.col("k").isin(keys))
    rows = with_chunk(rows.select("trace_id", "seq", "k", "v", parse_id("v").alias("value"), "ts")).repartition("trace_id", "chunk")
    return rows.groupBy("trace_id", "chunk", "seq").agg(*[F.max(c).alias(c) for c in ("k", "v", "value", "ts")])


def before_chunk(df: DataFrame, keys: list[str], aggs: dict[str, tuple[Column, str]]) -> DataFrame:
    """Per ``keys`` and chunk the state left by all earlier chunks.

    ``aggs``: name -> (aggregate within a chunk, how chunks add up: ``sum``, ``max``,
    ``min`` or ``last``). One row per key and chunk takes part.
    """
    per = df.groupBy(*keys, "chunk").agg(*[c.alias(n) for n, (c, _) in aggs.items()])
    w = W.partitionBy(*keys).orderBy("chunk").rowsBetween(W.unboundedPreceding, -1)
    how = {"sum": F.sum, "max": F.max, "min": F.min, "last": lambda n: F.last(n, ignorenulls=True)}
    return per.select(*keys, "chunk", *[how[h](n).over(w).alias(n) for n, (_, h) in aggs.items()])


def join_null_safe(a: DataFrame, b: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """``a`` joined to ``b`` on ``keys`` with null equal to null; ``b`` brings its other columns."""
    r = b.select(*[F.col(k).alias(f"_k_{k}") for k in keys], *[c for c in b.columns if c not in keys])
    on = None
    for k in keys:
        c = a[k].eqNullSafe(r[f"_k_{k}"])
        on = c if on is None else on & c
    return a.join(r, on, how).drop(*[f"_k_{k}" for k in keys])


def numbered(df: DataFrame) -> DataFrame:
    """``df`` (``trace_id, seq, ...``, unique) with ``chunk`` and ``n``: the number of the row in its trace, from 1."""
    c = with_chunk(df)
    carry = before_chunk(c, ["trace_id"], {"_n": (F.count("*"), "sum")})
    rows = join_null_safe(c.withColumn("n", F.row_number().over(in_chunk())), carry, ["trace_id", "chunk"])
    return rows.withColumn("n", F.coalesce("_n", F.lit(0)) + F.col("n")).drop("_n")


#: The narrowest pieces of lines have 2^6; those that whole pieces are put together to, 2^14, 2^22, ...
FIRST, BITS, LEVELS = 6, 8, 7
#: Ends of a range that is open: as far as the widest pieces reach.
FROM_START, FOREVER = -(1 << FIRST + BITS * (LEVELS - 1)), (1 << FIRST + BITS * (LEVELS - 1)) - 1


def _pieces() -> Column:
    """Array of the pieces of size ``level`` that a range takes: of -1 the two narrowest ones that hold its ends, of others
    the aligned ones among the narrowest from ``a`` up to but not with ``b`` that no next larger one covers.

    At most 2^9 of each level, however long the range is.
    """
    upto = lambda x, y: f"if({x} < {y}, sequence({x}, {y} - 1), cast(array() as array<bigint>))"
    first = lambda w: f"shiftright(a + shiftleft(1L, {w}) - 1, {w})"
    w, v = f"level * {BITS}", f"level * {BITS} + {BITS}"
    a, b, a2, b2 = first(w), f"shiftright(b, {w})", first(v), f"shiftright(b, {v})"
    inner = f"concat({upto(a, f'{a2} * {1 << BITS}')}, {upto(f'{b2} * {1 << BITS}', b)})"
    return F.expr(f"case when level < 0 then array_distinct(array(a - 1, b)) when level < {LEVELS - 1} and {a2} < {b2} then {inner} else {upto(a, b)} end")


def blocks_in_ranges(rows: DataFrame, ranges: DataFrame, keep: str) -> DataFrame:
    """``trace_id, block_id, <keep>``, distinct: blocks of ``rows`` (``trace_id, seq, chunk, block_id``) in a range (``trace_id, lo, hi, <keep>``).

    Both ends belong to a range. The different blocks of each aligned piece are listed
    once per level, for the narrowest pieces with their lines. A range is the two pieces
    that hold its ends, whose lines are compared with it, and whole pieces between them,
    few however long it is. Lists and pieces meet in one equi-join.
    """
    at = lambda level: F.shiftright("seq", FIRST + BITS * level)
    struct = lambda level: F.struct(F.lit(level).alias("level"), at(level).alias("piece"))
    # pieces no wider than a chunk are listed where the chunk lies
    low = rows.groupBy("trace_id", "chunk", "block_id", at(0).alias("piece")).agg(F.collect_list("seq").alias("seqs"))
    low = low.select("trace_id", "chunk", "block_id", F.lit(0).alias("level"), "piece", "seqs")
    per = rows.groupBy("trace_id", "chunk", "block_id", at(1).alias("_q")).agg(F.min("seq").alias("seq"))
    more = per.select("trace_id", "block_id", F.explode(F.array(*[struct(i) for i in range(1, LEVELS)])).alias("s")).select("trace_id", "block_id", "s.*").distinct()
    index = low.drop("chunk").unionByName(more.withColumn("seqs", F.lit(None).cast("array<bigint>")))
    cut = ranges.where(F.col("lo") <= F.col("hi")).select("trace_id", "lo", "hi", keep, (F.shiftright("lo", FIRST) + 1).alias("a"), F.shiftright("hi", FIRST).alias("b"))
    sizes = F.when(F.col("a") < F.col("b"), F.sequence(F.lit(-1), F.lit(LEVELS - 1))).otherwise(F.array(F.lit(-1)))
    want = cut.withColumn("level", F.explode(sizes)).withColumn("piece", F.explode(_pieces()))
    want = want.select("trace_id", "lo", "hi", keep, F.greatest("level", F.lit(0)).alias("level"), "piece")
    hit = join_null_safe(index, want, ["trace_id", "level", "piece"], "inner")
    inside = F.col("seqs").isNull() | F.exists("seqs", lambda x: x.between(F.col("lo"), F.col("hi")))
    return hit.where(inside).select("trace_id", "block_id", keep).distinct()


def latest_before(df: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """``df`` (with ``seq`` and ``chunk``) with ``name``: the last non-null ``value`` in an earlier row of the same keys.

    Windows cover one chunk of a key; one row per key and chunk carries the rest.
    """
    w = W.partitionBy(*keys, "chunk").orderBy("seq").rowsBetween(W.unboundedPreceding, -1)
    last = F.max_by(value, F.when(F.col(value).isNotNull(), F.col("seq")))
    carry = before_chunk(df, keys, {"_carry": (last, "last")})
    local = df.withColumn(name, F.last(value, ignorenulls=True).over(w))
    return join_null_safe(local, carry, [*keys, "chunk"]).withColumn(name, F.coalesce(name, "_carry")).drop("_carry")
