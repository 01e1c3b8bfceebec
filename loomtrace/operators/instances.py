"""Kernel instances of traces and what they read from each other."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.arrow import plain
from ..session import written
from .blocks import entries
from .ordered import events, in_chunk, join_null_safe, latest_before, numbered, with_chunk


def follow(blocks: Sequence[Sequence], state: object) -> tuple[object, int, list[tuple[object, bool]]]:
    """(last state, new instances, per entry its state and whether an instance begins there).

    ``blocks``: for each entry the kernels holding its block, in order. The current
    kernel stays while it holds the block; else the first that does takes over, or none.
    """
    new, path = 0, []
    for ks in blocks:
        began = False
        if state is None or state not in ks:
            state = ks[0] if ks else None
            began = state is not None
            new += began
        path.append((state, began))
    return state, new, path


def transfer(blocks: Sequence[Sequence]) -> list[tuple[object, object, int]]:
    """(state before, state after, new instances) of a chunk for no kernel and every kernel its entries know.

    Kernels it doesn't know leave the chunk as no kernel does. A run that meets the
    path of another run stops there.
    """
    end, new, path = follow(blocks, None)
    left, total = [0] * (len(path) + 1), 0
    for i in range(len(path) - 1, -1, -1):
        total += path[i][1]
        left[i] = total
    out: list[tuple[object, object, int]] = [(None, end, new)]
    for k in sorted({k for ks in blocks for k in ks}):
        n = 0
        while n < len(blocks) and k in blocks[n]:
            n += 1
        # from the first entry outside the kernel on, the run is where the first run would be had it no kernel there
        if n == len(blocks):
            out.append((k, k, 0))
            continue
        state, fresh = (blocks[n][0] if blocks[n] else None), int(bool(blocks[n]))
        i = n
        while state != path[i][0]:
            i += 1
            if i == len(blocks):
                break
            if state is None or state not in blocks[i]:
                state = blocks[i][0] if blocks[i] else None
                fresh += state is not None
        out.append((k, end, fresh + left[i + 1]) if i < len(blocks) else (k, state, fresh))
    return out


def _groups(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[tuple, list[tuple]]]:
    """Rows of each (trace, ...) of ``width`` columns, of batches in which they follow each other."""
    key, held = None, []
    for b in batches:
        for row in zip(*(plain(c) for c in b.columns)):
            if row[:width] != key:
                if held:
                    yield key, held
                key, held = row[:width], []
            held.append(row[width:])
    if held:
        yield key, held


def _emit(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


_STEP = pa.schema([("trace_id", pa.string()), ("chunk", pa.int64()), ("a", pa.int32()), ("b", pa.int32()), ("n", pa.int64())])
_START = pa.schema([("trace_id", pa.string()), ("chunk", pa.int64()), ("state", pa.int32()), ("n", pa.int64())])
_BEGAN = pa.schema([("trace_id", pa.string()), ("chunk", pa.int64()), ("seq", pa.int64()), ("k", pa.int32()), ("uid", pa.int64())])


def activations(trace: DataFrame, kernels: DataFrame) -> DataFrame:
    """``trace_id, seq, chunk, kid, uid``: the entries at which an instance of a kernel begins, numbered from 0 in each trace.

    ``kernels``: ``trace_id, kid, block_id``; they may overlap. Of entries in a row whose
    blocks lie in the same kernels only the first can begin anything; those are stored
    once. Each chunk becomes a table from the state before it to the state after. An
    entry in at most one kernel leaves the same state whatever was before, so chunks with
    one end a stretch; chunks are followed one after the other only within a stretch.
    Then each is read again with its true first state.
    """
    keys = kernels.select("trace_id", "kid").distinct()
    named = keys.withColumn("k", F.row_number().over(W.partitionBy("trace_id").orderBy("kid")))
    kb = join_null_safe(kernels.select("trace_id", "kid", "block_id").distinct(), named, ["trace_id", "kid"], "inner")
    kb = kb.groupBy("trace_id", "block_id").agg(F.array_sort(F.collect_set("k")).alias("ks"))
    ev = join_null_safe(entries(trace), kb, ["trace_id", "block_id"]).select("trace_id", "chunk", "seq", F.coalesce("ks", F.array().cast("array<int>")).alias("ks"))
    heads, _ = written(ev.withColumn("_b", F.lag("ks").over(in_chunk())).where(~F.col("ks").eqNullSafe(F.col("_b"))).drop("_b"))

    def tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (t, c), rows in _groups(batches, 2):
            yield _emit([(t, c, *x) for x in transfer([ks for _, ks in rows])], _STEP)

    ordered = heads.repartition("trace_id", "chunk").sortWithinPartitions("trace_id", "chunk", "seq")
    steps = ordered.select("trace_id", "chunk", "seq", "ks").mapInArrow(tables, "trace_id string, chunk bigint, a int, b int, n bigint")
    per = steps.groupBy("trace_id", "chunk").agg(F.collect_list(F.struct("a", "b", "n")).alias("steps"))
    per, _ = written(per)
    along = W.partitionBy("trace_id").orderBy("chunk")
    # along a trace go small rows only: whether a chunk's end state depends on what was before, and the state
    ends = per.select("trace_id", "chunk", (F.size(F.array_distinct(F.transform("steps", lambda s: s["b"]))) == 1).alias("ends"), F.col("steps")[0]["b"].alias("b"))
    ends = ends.withColumn("_new", F.when(F.coalesce(F.lag("ends").over(along), F.lit(True)), 1).otherwise(0))
    ends = ends.select("trace_id", "chunk", F.sum("_new").over(along).alias("stretch"), F.lag(F.when(F.col("ends"), F.col("b"))).over(along).alias("before"))
    per = join_null_safe(per, ends, ["trace_id", "chunk"])

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for b in batches:
            out = []
            for t, stretch, c, before, steps in zip(*(plain(x) for x in b.columns)):
                if (t, stretch) != key:
                    key, state = (t, stretch), before
                by = {x["a"]: x for x in steps}
                x = by.get(state) or by[None]
                out.append((t, c, state, x["n"]))
                state = x["b"]
            if out:
                yield _emit(out, _START)

    starts = per.repartition("trace_id", "stretch").sortWithinPartitions("trace_id", "stretch", "chunk").select("trace_id", "stretch", "chunk", "before", "steps")
    starts = starts.mapInArrow(walk, "trace_id string, chunk bigint, state int, n bigint")
    starts = starts.select("trace_id", "chunk", "state", F.coalesce(F.sum("n").over(along.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("base"))

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (t, c), rows in _groups(batches, 2):
            _, _, path = follow([r[1] for r in rows], rows[0][2])
            began = [(t, c, r[0], k) for r, (k, new) in zip(rows, path) if new]
            if began:
                yield _emit([(*x, rows[0][3] + i) for i, x in enumerate(began)], _BEGAN)

    again_ = join_null_safe(heads, starts, ["trace_id", "chunk"]).repartition("trace_id", "chunk").sortWithinPartitions("trace_id", "chunk", "seq")
    got = again_.select("trace_id", "chunk", "seq", "ks", "state", "base").mapInArrow(again, "trace_id string, chunk bigint, seq bigint, k int, uid bigint")
    return join_null_safe(got, named, ["trace_id", "k"]).select("trace_id", "seq", "chunk", "kid", "uid")


def instances(trace: DataFrame, kernels: DataFrame) -> DataFrame:
    """``trace_id, uid, kid, first_seq``: activations of kernels in order, numbered from 0 in each trace."""
    return activations(trace, kernels).select("trace_id", "uid", "kid", F.col("seq").alias("first_seq"))


def _accesses(trace: DataFrame, marks: DataFrame, value: str) -> DataFrame:
    """``trace_id, seq, chunk, addr, store, at``: readable loads and stores with the ``value`` of the latest mark before them."""
    acc = events(trace, ["LoadAddress", "StoreAddress"])
    acc = acc.select("trace_id", "seq", "chunk", F.col("value").alias("addr"), (F.col("k") == "StoreAddress").alias("store"), F.lit(None).cast(dict(marks.dtypes)[value]).alias("_m"))
    none = with_chunk(marks).select("trace_id", "seq", "chunk", F.lit(None).cast("bigint").alias("addr"), F.lit(None).cast("boolean").alias("store"), F.col(value).alias("_m"))
    return latest_before(acc.unionByName(none), ["trace_id"], "_m", "at").where(F.col("addr").isNotNull()).drop("_m")


def _last_store(acc: DataFrame) -> DataFrame:
    """Loads with ``by``: what the latest earlier store to their address had as ``at``."""
    rows = acc.withColumn("_s", F.when(F.col("store"), F.col("at")))
    return latest_before(rows, ["trace_id", "addr"], "_s", "by").where(~F.col("store")).drop("_s")


def consumer_edges(trace: DataFrame, kernels: DataFrame, compat: bool = False) -> DataFrame:
    """``trace_id, consumer, producer``: instances that load what another instance stored last.

    Accesses outside all kernels belong to the latest instance. By default accesses
    before the first instance and loads of addresses never written give no edge. With
    ``compat`` the former belong to -1, which can consume but not produce, and the
    latter read from instance 0.
    """
    # between two beginnings the latest instance stays the same
    marks = activations(trace, kernels).select("trace_id", "seq", "chunk", "uid")
    acc = _accesses(trace, marks, "uid").withColumn("at", F.coalesce("at", F.lit(-1)))
    e = _last_store(acc).select("trace_id", F.col("at").alias("consumer"), F.col("by").alias("producer"))
    if compat:
        e = e.withColumn("producer", F.coalesce("producer", F.lit(0)))
    else:
        e = e.where("consumer >= 0")
    return e.where("producer >= 0 and producer <> consumer").distinct()


def contexts(trace: DataFrame, kernels: DataFrame) -> DataFrame:
    """``trace_id, seq, ctx``: per entry ``struct(kernel_id, start)`` of the innermost kernel holding its block.

    The innermost is the one of fewest blocks (ties by id). An instance of a kernel lasts
    while entries stay within its blocks, inner kernels included, and is named by the
    ``seq`` of its first entry, so leaving an inner kernel returns to the outer instance.
    ``kernels``: ``kernel_id, trace_id, block_id``.
    """
    kb = kernels.where(F.col("trace_id").isNotNull()).select("kernel_id", "trace_id", "block_id").distinct()
    sizes = kb.groupBy("kernel_id").agg(F.count("*").alias("size"))
    inner = kb.join(sizes, "kernel_id").groupBy("trace_id", "block_id").agg(F.min_by("kernel_id", F.struct("size", "kernel_id")).alias("inner"))
    ev = numbered(entries(trace))
    mem = latest_before(ev.join(kb, ["trace_id", "block_id"]), ["trace_id", "kernel_id"], "n", "prev")
    mem = mem.withColumn("begin", F.when(F.col("prev").isNull() | (F.col("n") - F.col("prev") > 1), F.col("seq")))
    mem = latest_before(mem, ["trace_id", "kernel_id"], "begin", "before").withColumn("start", F.coalesce("begin", "before"))
    at = mem.join(inner, ["trace_id", "block_id"]).where("kernel_id = inner").select("trace_id", "seq", "kernel_id", "start")
    return join_null_safe(ev.select("trace_id", "seq", "chunk"), at, ["trace_id", "seq"]).select("trace_id", "seq", "chunk", F.struct("kernel_id", "start").alias("ctx"))


def read_sets(trace: DataFrame, kernels: DataFrame) -> DataFrame:
    """``trace_id, kernel_id, start, from_kernel, from_start``: instances by innermost kernel and those they read from, themselves included."""
    acc = _accesses(trace, contexts(trace, kernels), "ctx")
    e = _last_store(acc).where("at.kernel_id is not null and by.kernel_id is not null")
    return e.select("trace_id", "at.kernel_id", "at.start", F.col("by.kernel_id").alias("from_kernel"), F.col("by.start").alias("from_start")).distinct()


def dag_texts(uids: DataFrame, edges: DataFrame, part: int) -> DataFrame:
    """``trace_id, section, part, body``: JSON of ``instances`` and ``consumer_edges`` in parts of ``part`` instances each.

    The bodies of a trace in order of section and part are its text: kernels by instance,
    then sorted producers by consumer, as lists of pairs. Traces without instances have none.
    """
    div = lambda c: F.floor(F.col(c) / F.lit(part)).cast("bigint")
    name = F.regexp_replace(F.regexp_replace("kid", r"\\", r"\\\\"), '"', r'\\"')
    inst = uids.select("trace_id", F.lit(1).alias("section"), div("uid").alias("part"), F.col("uid").alias("at"), F.concat(F.lit("["), "uid", F.lit(',"'), name, F.lit('"]')).alias("x"))
    per = edges.groupBy("trace_id", "consumer").agg(F.array_sort(F.collect_set("producer")).alias("p"))
    cons = per.select("trace_id", F.lit(3).alias("section"), div("consumer").alias("part"), F.col("consumer").alias("at"), F.concat(F.lit("["), "consumer", F.lit(","), F.to_json("p"), F.lit("]")).alias("x"))
    texts = inst.unionByName(cons).groupBy("trace_id", "section", "part").agg(F.array_sort(F.collect_list(F.struct("at", "x"))).alias("l"))
    comma = F.when(F.col("part") > F.min("part").over(W.partitionBy("trace_id", "section")), F.lit(",")).otherwise(F.lit(""))
    texts = texts.select("trace_id", "section", "part", F.concat(comma, F.concat_ws(",", F.transform("l", lambda s: s["x"]))).alias("body"))
    ends = F.explode(F.array(*[F.struct(F.lit(n).alias("section"), F.lit(b).alias("body")) for n, b in ((0, '{"KernelInstanceMap":['), (2, '],"ConsumerMap":['), (4, "]}"))]))
    frame = uids.select("trace_id").distinct().select("trace_id", ends.alias("e")).select("trace_id", "e.section", F.lit(0).cast("bigint").alias("part"), "e.body")
    return texts.unionByName(frame)


def instance_lines(uids: DataFrame, edges: DataFrame) -> DataFrame:
    """``trace_id, section, a, b, line``: in this order the lines of a GraphViz text per trace.

    Section 1 has the instances (``a``) with their kernels, 2 edges to the next instance,
    3 edges from producer ``a`` to consumer ``b``; 0 and 4 open and close the graph.
    Instances are named by number, not by kernel.
    """
    none = F.lit(None).cast("bigint")
    q = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    edge = lambda style: F.concat(q(F.col("a")), F.lit(" -> "), q(F.col("b")), F.lit(f" [style={style}];"))
    row = lambda df, n, line: df.select("trace_id", F.lit(n).alias("section"), "a", "b", line.alias("line"))
    ends = F.explode(F.array(*[F.struct(F.lit(n).alias("section"), none.alias("a"), none.alias("b"), F.lit(x).alias("line")) for n, x in ((0, "digraph {"), (4, "}"))]))
    frame = uids.select("trace_id").distinct().select("trace_id", ends.alias("e")).select("trace_id", "e.*")
    label = F.regexp_replace("kid", '"', r'\\"')
    nodes = uids.select("trace_id", F.lit(1).alias("section"), F.col("uid").alias("a"), none.alias("b"), F.concat(q(F.col("uid")), F.lit(' [label="'), label, F.lit('"];')).alias("line"))
    seq = row(uids.where("uid > 0").select("trace_id", (F.col("uid") - 1).alias("a"), F.col("uid").alias("b")), 2, edge("solid"))
    data = row(edges.select("trace_id", F.col("producer").alias("a"), F.col("consumer").alias("b")), 3, edge("dashed"))
    return frame.unionByName(nodes).unionByName(seq).unionByName(data)
