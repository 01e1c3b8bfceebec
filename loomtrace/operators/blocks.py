"""Counts, co-occurrence, depth and labels of blocks in traces."""

from __future__ import annotations

from fractions import Fraction

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.values import squeezed_label
from .ordered import FOREVER, FROM_START, blocks_in_ranges, events, in_chunk, join_null_safe, lines

RADIUS = 5
HOT = 512


def entries(trace: DataFrame) -> DataFrame:
    """``trace_id, seq, chunk, block_id`` of readable ``BBEnter`` lines, copies once."""
    return events(trace, ["BBEnter"]).select("trace_id", "seq", "chunk", F.col("value").alias("block_id"))


def _openings(trace: DataFrame) -> DataFrame:
    """``trace_id, seq, chunk, block_id, d``: entries (d is 1) and exits (-1)."""
    return events(trace, ["BBEnter", "BBExit"]).select("trace_id", "seq", "chunk", F.col("value").alias("block_id"), F.when(F.col("k") == "BBEnter", 1).otherwise(-1).alias("d"))


def block_counts(trace: DataFrame) -> DataFrame:
    """Entries per trace and block."""
    return entries(trace).groupBy("trace_id", "block_id").agg(F.count("*").alias("cnt"))


def cooccurrence(trace: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``trace_id, block_id, nbr, cnt``: blocks among the last ``2 radius + 1`` entries, itself included.

    Counted for the newest entry of the window, once more than ``radius`` entries have
    been seen. The window trails; at the start of a chunk it reaches into the last
    entries of the chunks before, which come as one row a chunk.
    """
    reach = 2 * radius
    e = entries(trace)
    w = in_chunk()
    # newest first
    seen = F.filter(F.array(*[F.lag("block_id", i).over(w) for i in range(1, reach + 1)]), lambda x: x.isNotNull())
    rows = e.withColumns({"_n": F.row_number().over(w), "_seen": seen})
    chunks = rows.groupBy("trace_id", "chunk").agg(F.max("_n").alias("_size"), F.max_by(F.concat(F.array("block_id"), "_seen"), "_n").alias("_end"))
    along = W.partitionBy("trace_id").orderBy(F.desc("chunk"))
    back = W.partitionBy("trace_id").orderBy("chunk").rowsBetween(W.unboundedPreceding, -1)
    # every chunk has an entry, so the last ``reach`` of them hold all there is to see
    held = F.slice(F.flatten(F.collect_list("_end").over(along.rowsBetween(1, reach))), 1, reach)
    carry = chunks.select("trace_id", "chunk", held.alias("_held"), F.coalesce(F.sum("_size").over(back), F.lit(0)).alias("_base"))
    rows = join_null_safe(rows, carry, ["trace_id", "chunk"]).where(F.col("_base") + F.col("_n") > radius)
    more = F.slice("_held", F.lit(1), F.greatest(F.lit(reach) - F.size("_seen"), F.lit(0)))
    window = F.concat(F.array("block_id"), "_seen", F.when(F.col("_n") <= reach, more).otherwise(F.array().cast("array<bigint>")))
    pairs = rows.select("trace_id", "block_id", F.explode(window).alias("nbr"))
    return pairs.groupBy("trace_id", "block_id", "nbr").agg(F.count("*").alias("cnt"))


def neighbour_share(matrix: DataFrame) -> DataFrame:
    """``cooccurrence`` with ``prob``: the pair's share of its block's pairs."""
    return matrix.withColumn("prob", F.col("cnt") / F.sum("cnt").over(W.partitionBy("trace_id", "block_id")))


def greedy_kernels(counts: dict[int, int], matrix: dict[int, dict[int, int]], hot: int = HOT, threshold: Fraction = Fraction(9, 10)) -> list[list[int]]:
    """Kernels of one trace: from the hottest uncovered block on, neighbours by share until ``threshold`` is reached.

    Seeds by count downwards, then id; they end at the first below ``hot``. Neighbours by
    share downwards, then id, are taken while the shares taken so far stay below the
    threshold, compared as fractions. All taken blocks are covered. Equal kernels count
    once; a hot block without neighbours gives none.
    """
    covered: set[int] = set()
    out: set[tuple[int, ...]] = set()
    for b in sorted(counts, key=lambda x: (-counts[x], x)):
        if counts[b] < hot:
            break
        near = matrix.get(b)
        if b in covered or not near:
            continue
        total, taken, members = sum(near.values()), 0, []
        for x in sorted(near, key=lambda y: (-near[y], y)):
            if taken * threshold.denominator >= threshold.numerator * total:
                break
            members.append(x)
            taken += near[x]
        covered.update(members)
        out.add(tuple(sorted(members)))
    return [list(k) for k in sorted(out)]


def type1_kernels(trace: DataFrame, hot: int = HOT, threshold: Fraction = Fraction(9, 10), radius: int = RADIUS) -> DataFrame:
    """``trace_id, kid, blocks``: greedy kernels of each trace, numbered from 0 in order of their blocks.

    The cover is sequential over hot blocks, so a trace's matrix (bounded by the square of
    its program's hot blocks, not by the trace's length) is worked on in one task.
    """
    counts = block_counts(trace).withColumn("nbr", F.lit(None).cast("bigint"))
    hot_traces = counts.where(F.col("cnt") >= hot).select("trace_id", "block_id")
    rows = join_null_safe(counts, hot_traces.withColumn("_hot", F.lit(1)), ["trace_id", "block_id"], "inner").drop("_hot")
    pairs = join_null_safe(cooccurrence(trace, radius), hot_traces.withColumn("_hot", F.lit(1)), ["trace_id", "block_id"], "inner").drop("_hot")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        own = pdf["nbr"].isna()
        counts = dict(zip(pdf.loc[own, "block_id"].tolist(), pdf.loc[own, "cnt"].tolist()))
        matrix: dict[int, dict[int, int]] = {}
        rest = pdf[~own]
        for b, x, c in zip(rest["block_id"].tolist(), rest["nbr"].tolist(), rest["cnt"].tolist()):
            matrix.setdefault(b, {})[int(x)] = c
        got = greedy_kernels(counts, matrix, hot, threshold)
        return pd.DataFrame({"trace_id": [pdf["trace_id"].iloc[0]] * len(got), "kid": range(len(got)), "blocks": got})

    both = rows.select("trace_id", "block_id", "nbr", "cnt").unionByName(pairs)
    return both.groupBy("trace_id").applyInPandas(run, "trace_id string, kid bigint, blocks array<bigint>")


def open_depth(trace: DataFrame) -> DataFrame:
    """``trace_id, block_id, deepest, lowest, at_end``: running number of open activations of each block."""
    ev = _openings(trace)
    run = F.sum("d").over(in_chunk("block_id").rowsBetween(W.unboundedPreceding, 0))
    local = ev.withColumn("run", run).groupBy("trace_id", "block_id", "chunk").agg(F.max("run").alias("hi"), F.min("run").alias("lo"), F.sum("d").alias("d"))
    base = F.coalesce(F.sum("d").over(W.partitionBy("trace_id", "block_id").orderBy("chunk").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return (
        local.withColumn("base", base)
        .groupBy("trace_id", "block_id")
        .agg(F.max(F.col("base") + F.col("hi")).alias("deepest"), F.min(F.col("base") + F.col("lo")).alias("lowest"), F.sum("d").alias("at_end"))
    )


def label_events(trace: DataFrame) -> DataFrame:
    """``trace_id, seq, chunk, label, d``: region marks in one spelling, up to the first ``:``; d is 1 on entry, -1 on exit."""
    ev = lines(trace, ["KernelEnter", "KernelExit"])
    label = squeezed_label(F.split_part(F.coalesce("v", F.lit("")), F.lit(":"), F.lit(1)))
    return ev.select("trace_id", "seq", "chunk", label.alias("label"), F.when(F.col("k") == "KernelEnter", 1).otherwise(-1).alias("d")).where(F.col("label") != "")


def _label_depths(trace: DataFrame) -> DataFrame:
    """``label_events`` with ``depth``, the running sum of d by label, and ``next``, the ``seq`` of the label's next mark. Chunk by chunk."""
    ev = label_events(trace)
    keys = ["trace_id", "label"]
    w = W.partitionBy(*keys, "chunk").orderBy("seq")
    local = ev.withColumns({"depth": F.sum("d").over(w.rowsBetween(W.unboundedPreceding, 0)), "next": F.lead("seq").over(w)})
    chunks = ev.groupBy(*keys, "chunk").agg(F.sum("d").alias("_d"), F.min("seq").alias("_first"))
    along = W.partitionBy(*keys).orderBy("chunk")
    carry = chunks.select(*keys, "chunk", F.coalesce(F.sum("_d").over(along.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_base"), F.lead("_first").over(along).alias("_after"))
    rows = join_null_safe(local, carry, [*keys, "chunk"])
    return rows.withColumns({"depth": F.col("depth") + F.col("_base"), "next": F.coalesce("next", "_after")}).drop("_base", "_after")


def label_balance(trace: DataFrame) -> DataFrame:
    """Per trace and label: entries, exits, and the least running depth (below 0: an exit without entry)."""
    return (
        _label_depths(trace)
        .groupBy("trace_id", "label")
        .agg(F.sum(F.when(F.col("d") == 1, 1).otherwise(0)).alias("enters"), F.sum(F.when(F.col("d") == -1, 1).otherwise(0)).alias("exits"), F.min("depth").alias("lowest"))
    )


def _label_ranges(trace: DataFrame, stacked: bool) -> DataFrame:
    """``trace_id, label, lo, hi``: where a label is active: by running depth (``stacked``) or since a last event that is an entry."""
    rows = _label_depths(trace).where(F.col("depth" if stacked else "d") > 0)
    return rows.select("trace_id", "label", F.col("seq").alias("lo"), F.coalesce(F.col("next") - 1, F.lit(FOREVER)).alias("hi"))


def _labelled(rows: DataFrame, ranges: DataFrame) -> DataFrame:
    pairs = blocks_in_ranges(rows, ranges, "label")
    return pairs.groupBy("trace_id", "block_id").agg(F.array_sort(F.collect_set("label")).alias("labels"))


def block_labels(trace: DataFrame) -> DataFrame:
    """Per block the labels that were open, counted as a stack, at one of its entries; blocks without are left out."""
    return _labelled(entries(trace), _label_ranges(trace, True))


def block_labels_at_exit(trace: DataFrame) -> DataFrame:
    """Per block the labels active at one of its exits, where one exit mark ends a label however often it was entered; ``[]`` without."""
    exits = events(trace, ["BBExit"]).select("trace_id", "seq", "chunk", F.col("value").alias("block_id"))
    got = _labelled(exits, _label_ranges(trace, False))
    every = exits.select("trace_id", "block_id").distinct()
    return join_null_safe(every, got, ["trace_id", "block_id"]).withColumn("labels", F.coalesce("labels", F.array().cast("array<string>")))


def grown_kernels(trace: DataFrame, kernels: DataFrame) -> DataFrame:
    """``kernel_id, blocks``: kernels (``kernel_id, trace_id, block_id``) widened by what runs inside and between their blocks.

    A block is added if it is entered while a member is open, or between two member
    entries of which the later is not the kernel's first block seen. Depths and first
    blocks come from member lines alone; the ranges of lines they open are then met
    with the entries.
    """
    ev = _openings(trace)
    kb = kernels.where(F.col("trace_id").isNotNull()).select("kernel_id", "trace_id", "block_id").distinct()
    keys = ["kernel_id", "trace_id"]
    member = ev.join(kb, ["trace_id", "block_id"])
    enter = F.when(F.col("d") == 1, F.col("seq"))
    start = member.where("d = 1").groupBy("kernel_id").agg(F.min_by("block_id", "seq").alias("start"))
    chunks = member.groupBy(*keys, "chunk").agg(F.sum("d").alias("_d"), F.max(enter).alias("_enter"), F.min("seq").alias("_first"))
    along = W.partitionBy(*keys).orderBy("chunk")
    carry = chunks.select(
        *keys, "chunk",
        F.coalesce(F.sum("_d").over(along.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_d"),
        F.max("_enter").over(along.rowsBetween(W.unboundedPreceding, -1)).alias("_enter"),
        F.lead("_first").over(along).alias("_first"),
    )
    w = W.partitionBy(*keys, "chunk").orderBy("seq")
    run = (
        member.join(carry, [*keys, "chunk"])
        .withColumn("open", F.col("_d") + F.sum("d").over(w.rowsBetween(W.unboundedPreceding, 0)))
        .withColumn("next", F.coalesce(F.lead("seq").over(w), "_first"))
        .withColumn("prev", F.coalesce(F.max(enter).over(w.rowsBetween(W.unboundedPreceding, -1)), "_enter"))
    )
    run = run.join(start, "kernel_id", "left")
    inside = run.where("open > 0").select(*keys, F.col("seq").alias("lo"), F.coalesce(F.col("next") - 1, F.lit(FOREVER)).alias("hi"))
    # before the first member entry lie no member entries, so its gap starts with the trace
    between = run.where((F.col("d") == 1) & (F.col("block_id") != F.col("start"))).select(*keys, F.coalesce(F.col("prev") + 1, F.lit(FROM_START)).alias("lo"), F.col("seq").alias("hi"))
    entered = ev.where("d = 1").select("trace_id", "seq", "chunk", "block_id")
    got = blocks_in_ranges(entered, inside.unionByName(between), "kernel_id")
    return got.groupBy("kernel_id").agg(F.array_sort(F.collect_set("block_id")).alias("blocks"))


def first_members(trace: DataFrame, kernels: DataFrame) -> DataFrame:
    """``kernel_id, start, seq``: the first member block entered, and where."""
    hit = entries(trace).join(kernels.select("kernel_id", "trace_id", "block_id").distinct(), ["trace_id", "block_id"])
    return hit.groupBy("kernel_id").agg(F.min_by("block_id", "seq").alias("start"), F.min("seq").alias("seq"))
