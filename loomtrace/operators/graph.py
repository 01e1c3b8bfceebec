"""Control-flow questions about kernels: pruning, splitting, entrances, exits, conditionals.

A kernel's part of the graph (edges leaving its blocks, and the successor edges of the
functions it touches) is gathered by joins, one row per kernel; its size is bounded by
static code, not by traces. Fixpoints and reachability then run inside that row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..functions.arrow import flat
from .meeting import meeting


@dataclass
class Block:
    func: int | None
    entry: bool
    term: str | None
    sites: int


@dataclass
class Graph:
    """A kernel's blocks and the edges its questions need, by kind and source."""

    blocks: dict[int, Block]
    out: dict[str, dict[int, set[int]]] = field(default_factory=dict)
    inside: dict[int, set[int]] = field(default_factory=dict)

    def add(self, src: int, dst: int, kind: str) -> None:
        self.out.setdefault(kind, {}).setdefault(src, set()).add(dst)

    def targets(self, b: int, *kinds: str) -> set[int]:
        got: set[int] = set()
        for k in kinds:
            got |= self.out.get(k, {}).get(b, set())
        return got

    def call_sites_inside(self, func: int | None, members: set[int]) -> set[int]:
        """Members that call the function, by edges into an entry block of it among the members."""
        entries = {b for b, x in self.blocks.items() if x.entry and x.func == func}
        return {s for s in members if self.targets(s, "call") & entries} | {s for s in members if func in self.calls.get(s, ())}

    calls: dict[int, set[int]] = field(default_factory=dict)


ALL = ("succ", "call", "ret", "resume")


def components(members: set[int], step: Callable[[int], set[int]]) -> dict[int, int]:
    """Strongly connected component of each member in the graph induced on ``members``."""
    index: dict[int, int] = {}
    low: dict[int, int] = {}
    comp: dict[int, int] = {}
    stack: list[int] = []
    on: set[int] = set()
    for root in sorted(members):
        if root in index:
            continue
        work: list[tuple[int, Iterator[int]]] = [(root, iter(sorted(step(root) & members)))]
        index[root] = low[root] = len(index)
        stack.append(root)
        on.add(root)
        while work:
            v, it = work[-1]
            for w in it:
                if w not in index:
                    index[w] = low[w] = len(index)
                    stack.append(w)
                    on.add(w)
                    work.append((w, iter(sorted(step(w) & members))))
                    break
                if w in on:
                    low[v] = min(low[v], index[w])
            else:
                work.pop()
                if work:
                    low[work[-1][0]] = min(low[work[-1][0]], low[v])
                if low[v] == index[v]:
                    while True:
                        w = stack.pop()
                        on.discard(w)
                        comp[w] = v
                        if w == v:
                            break
    return comp


def self_reachable(g: Graph, members: set[int]) -> set[int]:
    """Members on a cycle of the graph induced by edges of all kinds."""
    step = lambda b: g.targets(b, *ALL)
    comp = components(members, step)
    sizes: dict[int, int] = {}
    for c in comp.values():
        sizes[c] = sizes.get(c, 0) + 1
    return {b for b in members if sizes[comp[b]] > 1 or b in step(b)}


def reachable(g: Graph, base: int, valid: set[int]) -> set[int]:
    """Valid blocks reached from ``base`` over successor and call edges; ``base`` itself only if it is reached again."""
    seen: set[int] = set()
    todo = [base]
    while todo:
        for x in g.targets(todo.pop(), "succ", "call") & valid:
            if x not in seen:
                seen.add(x)
                todo.append(x)
    return seen


def leads_to(g: Graph, base: int, valid: set[int]) -> set[int]:
    """Blocks reached from ``base`` over edges of all kinds by way of valid blocks; the last one need not be valid."""
    seen: set[int] = set()
    todo, walked = [base], {base}
    while todo:
        for x in g.targets(todo.pop(), *ALL):
            seen.add(x)
            if x in valid and x not in walked:
                walked.add(x)
                todo.append(x)
    return seen


def is_reachable(g: Graph, base: int, target: int, valid: set[int]) -> bool:
    return target in leads_to(g, base, valid)


def pruned(g: Graph, members: set[int]) -> set[int]:
    """The largest subset whose blocks all have a predecessor and a successor in it.

    Predecessors of a function's entry block are its call sites only; successors of a
    return block are its function's call sites; otherwise successor edges count.
    """
    left = set(members)
    while True:
        preds: dict[int, set[int]] = {}
        for s in left:
            for d in g.targets(s, "succ"):
                preds.setdefault(d, set()).add(s)
        keep = set()
        for b in left:
            x = g.blocks[b]
            sites = g.call_sites_inside(x.func, left) if x.entry or x.term == "ret" else set()
            has_pred = bool(sites) if x.entry else bool(preds.get(b))
            has_succ = bool(sites) if x.term == "ret" else bool(g.targets(b, "succ") & left)
            if has_pred and has_succ:
                keep.add(b)
        if keep == left:
            return left
        left = keep


def entrances(g: Graph, members: set[int]) -> set[int]:
    """Where control can enter: function entries called only from outside, and blocks from which a walk
    backwards through blocks that are not members comes to their function's entry."""
    preds: dict[int, set[int]] = {}
    for s, ds in g.inside.items():
        for d in ds:
            preds.setdefault(d, set()).add(s)
    got = set()
    for b in members:
        x = g.blocks[b]
        if x.entry:
            inner = len(g.call_sites_inside(x.func, members))
            if inner == 0 and x.sites > 0:
                got.add(b)
            continue
        seen, todo = {b}, [b]
        while todo:
            for p in preds.get(todo.pop(), ()):
                if p in seen or p in members:
                    continue
                y = g.blocks.get(p)
                if y is not None and y.entry:
                    got.add(b)
                    todo = []
                    break
                seen.add(p)
                todo.append(p)
    return got


def split(g: Graph, members: set[int]) -> list[tuple[int, list[int]]]:
    """(entrance, blocks reached from it) among the self-reachable members."""
    cyclic = self_reachable(g, members)
    return [(e, sorted(reachable(g, e, cyclic))) for e in sorted(entrances(g, cyclic))]


def conditionals(g: Graph, members: set[int]) -> tuple[set[int], bool]:
    """(members with a successor outside or unable to get back, whether such a successor lies inside)."""
    comp = components(members, lambda b: g.targets(b, *ALL))
    found, epilogue = set(), False
    for b in members:
        for s in g.targets(b, "succ"):
            if s not in members:
                found.add(b)
            elif comp[s] != comp[b]:
                found.add(b)
                epilogue = True
    return found, epilogue


def _graphs(kernels: DataFrame, blocks: DataFrame, edges: DataFrame) -> DataFrame:
    """One row per kernel: ``kernel_id, members, blocks, edges, inside``."""
    e = edges.where("src is not null and dst is not null").select("src", "dst", "kind").distinct()
    info = blocks.select("block_id", "func_id", F.coalesce("is_entry", F.lit(False)).alias("entry"), "term_kind")
    funcs = info.select("block_id", "func_id")
    by_dst = e.join(info.select(F.col("block_id").alias("dst"), F.col("func_id").alias("df"), F.col("entry").alias("de")), "dst", "left")
    # number of call sites of a function, to tell that there are some outside a kernel
    sites = by_dst.where("kind = 'call' and de").groupBy(F.col("df").alias("func_id")).agg(F.countDistinct("src").alias("sites"))
    info = info.join(sites, "func_id", "left").select("block_id", "func_id", "entry", "term_kind", F.coalesce("sites", F.lit(0)).alias("sites"))
    kb = kernels.select("kernel_id", "block_id").distinct()
    member = kb.groupBy("kernel_id").agg(F.collect_set("block_id").alias("members"))
    leaving = kb.join(by_dst, kb["block_id"] == by_dst["src"]).groupBy("kernel_id").agg(F.collect_set(F.struct("src", "dst", "kind", F.when(F.col("de"), F.col("df")).alias("enters"))).alias("edges"))
    kf = kb.join(funcs, "block_id").where("func_id is not null").select("kernel_id", "func_id").distinct()
    around = kf.join(info, "func_id").groupBy("kernel_id").agg(F.collect_set(F.struct("block_id", "func_id", "entry", "term_kind", "sites")).alias("blocks"))
    within = by_dst.where("kind = 'succ'").join(funcs.select(F.col("block_id").alias("src"), F.col("func_id").alias("sf")), "src").where("sf = df")
    inside = kf.join(within, kf["func_id"] == within["df"]).groupBy("kernel_id").agg(F.collect_set(F.struct("src", "dst")).alias("inside"))
    return member.join(leaving, "kernel_id", "left").join(around, "kernel_id", "left").join(inside, "kernel_id", "left")


def _inner(kernels: DataFrame, edges: DataFrame) -> DataFrame:
    """One row per kernel with edges between its blocks: ``kernel_id, edges``."""
    e = edges.where("src is not null and dst is not null").select("src", "dst", "kind").distinct()
    kb = kernels.select("kernel_id", "block_id").distinct()
    within = kb.join(e, kb["block_id"] == e["src"]).select("kernel_id", "src", "dst", "kind")
    within = within.join(kb.withColumnRenamed("block_id", "dst"), ["kernel_id", "dst"], "left_semi")
    return within.groupBy("kernel_id").agg(F.collect_list(F.struct("src", "dst", "kind")).alias("edges"))


def _graph(row: dict) -> tuple[Graph, set[int]]:
    if "members" not in row:
        g = Graph({})
        for x in row["edges"]:
            g.add(x["src"], x["dst"], x["kind"])
        return g, {b for x in row["edges"] for b in (x["src"], x["dst"])}
    some = lambda x: [] if x is None else x
    g = Graph({b["block_id"]: Block(b["func_id"], b["entry"], b["term_kind"], b["sites"]) for b in some(row["blocks"])})
    members = {b for b in row["members"] if b in g.blocks}
    for x in some(row["edges"]):
        g.add(x["src"], x["dst"], x["kind"])
        if x["kind"] == "call" and x["enters"] is not None:
            g.calls.setdefault(x["src"], set()).add(x["enters"])
    for x in some(row["inside"]):
        g.inside.setdefault(x["src"], set()).add(x["dst"])
    return g, members


#: Rows of kernels turned into objects at once, and rows that come out together.
ROWS, OUT = 64, 1 << 15


def _per_kernel(graphs: DataFrame, f: Callable[[Graph, set[int]], list[tuple]], schema: str) -> DataFrame:
    """``f`` of each kernel's graph (of ``_graphs`` or ``_inner``). A batch has 10,000 graphs; only a few are objects at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        to = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), out)], schema=out)
        for batch in batches:
            for at in range(0, len(batch), ROWS):
                for r in batch.slice(at, ROWS).to_pylist():
                    rows += [(r["kernel_id"], *x) for x in f(*_graph(r))]
                    for i in range(0, len(rows) - OUT + 1, OUT):
                        yield to(rows[i : i + OUT])
                    rows = rows[len(rows) // OUT * OUT :]
        if rows:
            yield to(rows)

    kind = StructType.fromDDL(f"kernel_id bigint, {schema}")
    out = to_arrow_schema(kind)
    return graphs.mapInArrow(run, kind)


def pruned_kernels(kernels: DataFrame, blocks: DataFrame, edges: DataFrame) -> DataFrame:
    """``kernel_id, blocks``: what ``pruned`` leaves of each kernel (maybe nothing). Blocks outside the graph are dropped."""
    return _per_kernel(_graphs(kernels, blocks, edges), lambda g, m: [(sorted(pruned(g, m)),)], "blocks array<bigint>")


def split_kernels(kernels: DataFrame, blocks: DataFrame, edges: DataFrame) -> DataFrame:
    """``kernel_id, entrance, blocks``: one kernel per entrance of the self-reachable part."""
    return _per_kernel(_graphs(kernels, blocks, edges), split, "entrance bigint, blocks array<bigint>")


def _called(blocks: DataFrame, edges: DataFrame) -> DataFrame:
    """``func_id, src``: the call sites of functions, once each."""
    entries = blocks.where("is_entry and func_id is not null").select(F.col("block_id").alias("dst"), "func_id")
    return edges.where("kind = 'call'").select("src", "dst").join(entries, "dst").select("func_id", "src").distinct()


def _walked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``kernel_id, block_id``: members that are no entries and that a walk through blocks that aren't members reaches from an entry.

    Rows are kernels and functions: ``ids`` the function's blocks, ``doors`` its entries, ``src, dst`` its edges and
    ``own`` the members, all as positions in ``ids``. All rows of a batch are walked at once.
    """
    for batch in batches:
        kernel = batch["kernel_id"].to_numpy()
        ids, row = flat(batch["ids"])
        base = np.searchsorted(row, np.arange(len(kernel)))
        member, entry = np.zeros(len(ids), bool), np.zeros(len(ids), bool)
        for name, mark in (("own", member), ("doors", entry)):
            x, r = flat(batch[name])
            mark[base[r] + x] = True
        x, r = flat(batch["src"])
        src, dst = base[r] + x, base[r] + flat(batch["dst"])[0]
        seen = entry & ~member
        through = ~member[src] & ~member[dst]
        a, b = src[through], dst[through]
        while (go := seen[a]).any():
            seen[b[go]] = True
            a, b = a[~go], b[~go]
        got = np.unique(dst[seen[src] & member[dst] & ~entry[dst]])
        yield pa.RecordBatch.from_arrays([pa.array(kernel[row[got]]), pa.array(ids[got])], ["kernel_id", "block_id"])


def kernel_entrances(kernels: DataFrame, blocks: DataFrame, edges: DataFrame) -> DataFrame:
    """``kernel_id, block_id``: ``entrances`` of each kernel. Walks stay within a function, so functions are walked one by one and no kernel's graph is gathered."""
    kb = kernels.select("kernel_id", "block_id").distinct()
    called = _called(blocks, edges)
    info = blocks.where("func_id is not null").select("func_id", "block_id", F.coalesce("is_entry", F.lit(False)).alias("entry"))
    info = info.withColumn("at", F.row_number().over(W.partitionBy("func_id").orderBy("block_id")) - 1)
    own = kb.join(info, "block_id")
    doors = own.where("entry").join(called.select("func_id").distinct(), "func_id", "left_semi")
    inner = kb.join(called.withColumnRenamed("src", "block_id"), "block_id").select("kernel_id", "func_id")
    doors = doors.join(inner, ["kernel_id", "func_id"], "left_anti").select("kernel_id", "block_id")
    end = lambda n: info.select(F.col("block_id").alias(n), F.col("func_id").alias(f"_{n}"), F.col("at").alias(f"{n}_at"))
    within = edges.where("kind = 'succ'").select("src", "dst").distinct().join(end("src"), "src").join(end("dst"), "dst").where("_src = _dst")
    within = within.groupBy(F.col("_src").alias("func_id")).agg(F.collect_list(F.struct("src_at", "dst_at")).alias("e"))
    of = info.groupBy("func_id").agg(F.sort_array(F.collect_list("block_id")).alias("ids"), F.collect_list(F.when(F.col("entry"), F.col("at"))).alias("doors"))
    of = of.where("size(doors) > 0").join(within, "func_id").select("func_id", "ids", "doors", F.transform("e", lambda x: x["src_at"]).alias("src"), F.transform("e", lambda x: x["dst_at"]).alias("dst"))
    pieces = own.groupBy("kernel_id", "func_id").agg(F.collect_list("at").alias("own"), F.count_if("entry").alias("in"), F.count_if(~F.col("entry")).alias("no"))
    pieces = pieces.where(F.col("no") > 0).join(of, "func_id").where(F.col("in") < F.size("doors")).select("kernel_id", "own", "ids", "doors", "src", "dst")
    return doors.unionByName(pieces.mapInArrow(_walked, "kernel_id bigint, block_id bigint"))


def self_reachable_blocks(kernels: DataFrame, blocks: DataFrame, edges: DataFrame) -> DataFrame:
    return _per_kernel(_inner(kernels, edges), lambda g, m: [(b,) for b in sorted(self_reachable(g, m))], "block_id bigint")


def reachable_blocks(kernels: DataFrame, blocks: DataFrame, edges: DataFrame) -> DataFrame:
    """``kernel_id, base, block_id``: from each member the members it reaches."""
    return _per_kernel(_inner(kernels, edges.where("kind in ('succ', 'call')")), lambda g, m: [(a, b) for a in sorted(m) for b in sorted(reachable(g, a, m))], "base bigint, block_id bigint")


def kernel_conditionals(kernels: DataFrame, blocks: DataFrame, edges: DataFrame) -> DataFrame:
    return _per_kernel(_graphs(kernels, blocks, edges), lambda g, m: [(b,) for b in sorted(conditionals(g, m)[0])], "block_id bigint")


def exit_parts(kernels: DataFrame, blocks: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``kernel_exits`` in parts: kernels with the functions they return from (``kernel_id, own, skip``), lists of the
    call sites of functions (``any_of, items``), and exits that are not among those (``kernel_id, block_id``).

    A kernel's exits are the items of the lists that meet its functions, each once, without
    ``skip``, and the others. The call sites of a function that all programs share are many,
    and so are the kernels that return from it: their lists are not unfolded here.
    """
    e = edges.select("src", "dst", "kind").distinct()
    kb = kernels.select("kernel_id", "block_id").distinct()
    called = _called(blocks, edges)
    sites = called.groupBy("src").agg(F.sort_array(F.collect_set("func_id")).alias("any_of"))
    lists = sites.groupBy("any_of").agg(F.transform(F.collect_list(F.struct("src")), lambda x: x["src"]).alias("items"))
    returns = kb.join(blocks.where("term_kind = 'ret'").select("block_id", "func_id"), "block_id").join(called.select("func_id").distinct(), "func_id", "left_semi")
    own = returns.groupBy("kernel_id").agg(F.sort_array(F.collect_set("func_id")).alias("own"))
    after = kb.join(e.where("kind = 'succ'"), kb["block_id"] == e["src"]).select("kernel_id", F.col("dst").alias("block_id"), F.lit(0).alias("member"))
    near = kb.withColumn("member", F.lit(1)).unionByName(after).groupBy("kernel_id", "block_id").agg((F.max("member") == 1).alias("member"))
    near = near.join(sites.withColumnRenamed("any_of", "calls"), F.col("block_id").eqNullSafe(F.col("src")), "left").join(own, "kernel_id", "left")
    near = near.select("kernel_id", "block_id", "member", F.coalesce(F.arrays_overlap("calls", "own"), F.lit(False)).alias("listed"))
    skip = near.where("member and listed").groupBy("kernel_id").agg(F.collect_list("block_id").alias("skip"))
    own = own.join(skip, "kernel_id", "left").withColumn("skip", F.coalesce("skip", F.array().cast("array<bigint>")))
    return own, lists, near.where("not member and not listed").select("kernel_id", "block_id")


def kernel_exits(kernels: DataFrame, blocks: DataFrame, edges: DataFrame) -> DataFrame:
    """``kernel_id, block_id``: successors outside, and for return blocks the outside call sites of their function."""
    own, lists, others = exit_parts(kernels, blocks, edges)
    items = F.when(F.size("skip") == 0, F.col("items")).otherwise(F.array_except("items", "skip"))
    return meeting(own, lists).select("kernel_id", F.explode(items).alias("block_id")).unionByName(others)


def exit_counts(kernels: DataFrame, blocks: DataFrame, edges: DataFrame) -> DataFrame:
    """``kernel_id, exits, first``: how many exits kernels have and the least, of those with any; nothing is unfolded."""
    own, lists, others = exit_parts(kernels, blocks, edges)
    # a sorted list without ``skip`` begins within as many items and one more, or two with NULL
    least = F.array_min(F.array_except(F.slice("items", 1, F.size("skip") + 2), "skip"))
    n = meeting(own, lists.withColumn("items", F.sort_array("items"))).select("kernel_id", F.size("items").cast("bigint").alias("n"), least.alias("first"))
    n = n.unionByName(own.select("kernel_id", (-F.size("skip")).cast("bigint").alias("n"), F.lit(None).cast("bigint").alias("first")))
    n = n.unionByName(others.select("kernel_id", F.lit(1).cast("bigint").alias("n"), F.col("block_id").alias("first")))
    return n.groupBy("kernel_id").agg(F.sum("n").alias("exits"), F.min("first").alias("first"))


def function_exits(blocks: DataFrame, edges: DataFrame) -> DataFrame:
    """``func_id, block_id``: successors that belong to another function."""
    s = blocks.select(F.col("block_id").alias("src"), F.col("func_id").alias("func_id"))
    d = blocks.select(F.col("block_id").alias("dst"), F.col("func_id").alias("df"))
    return edges.where("kind = 'succ'").join(s, "src").join(d, "dst").where("func_id <> df").select("func_id", F.col("dst").alias("block_id")).distinct()


#: Rounds in which blocks without a predecessor or a successor are taken off before components are looked for.
TRIMS = 32


def _cyclic(n: int, src: np.ndarray, dst: np.ndarray) -> np.ndarray:
    """Number of each node's strongly connected component; -1 for a component of one node."""
    left = src != dst
    for _ in range(TRIMS):
        a, b = src[left], dst[left]
        into, out = np.zeros(n, bool), np.zeros(n, bool)
        into[b], out[a] = True, True
        keep = into[a] & out[b]
        if keep.all():
            break
        left[left] = keep
    comp = np.full(n, -1)
    a, b = src[left], dst[left]
    order = np.argsort(a, kind="stable")
    a, b = a[order], b[order]
    nodes = np.unique(np.concatenate([a, b]))
    to, begin, end = np.searchsorted(nodes, b).tolist(), np.searchsorted(a, nodes).tolist(), np.searchsorted(a, nodes, "right").tolist()
    got = np.full(len(nodes), -1)
    index, low = [-1] * len(nodes), [0] * len(nodes)
    done, stack, count = [False] * len(nodes), [], 0
    at = begin[:]
    for root in range(len(nodes)):
        if index[root] >= 0:
            continue
        work = [root]
        index[root] = low[root] = count
        count += 1
        stack.append(root)
        while work:
            v = work[-1]
            if at[v] < end[v]:
                w = to[at[v]]
                at[v] += 1
                if index[w] < 0:
                    index[w] = low[w] = count
                    count += 1
                    stack.append(w)
                    work.append(w)
                elif not done[w]:
                    low[v] = min(low[v], index[w])
                continue
            work.pop()
            if work:
                low[work[-1]] = min(low[work[-1]], low[v])
            if low[v] == index[v]:
                part = stack[(k := stack.index(v) if stack[-1] != v else len(stack) - 1) :]
                del stack[k:]
                for w in part:
                    done[w] = True
                if len(part) > 1:
                    got[part] = v
    comp[nodes] = got
    return comp


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``kernel_id, valid, conditionals, epilogue`` of rows with ``m``, a kernel's blocks in order, each with its targets; all kernels of a batch are one graph."""
    for batch in batches:
        kernel = batch["kernel_id"].to_numpy()
        m, row = flat(batch["m"])
        ids, n = m.field("block_id").to_numpy(), len(row)
        (succ, a), (other, b) = flat(m.field("succ")), flat(m.field("other"))
        src = np.concatenate([a, b])
        names, rank = np.unique(np.concatenate([ids, succ, other]), return_inverse=True)
        key = np.concatenate([row, row[src]]) * len(names) + rank
        dst = np.minimum(np.searchsorted(key[:n], key[n:]), n - 1)
        inside = key[:n][dst] == key[n:]
        comp = _cyclic(n, src[inside], dst[inside])
        back = inside & ((src == dst) | (comp[src] >= 0) & (comp[src] == comp[dst]))
        cyclic = comp >= 0
        cyclic[src[inside & (src == dst)]] = True
        cond = m.field("away").to_numpy(zero_copy_only=False).copy()
        is_succ = np.arange(len(src)) < len(succ)
        cond[src[is_succ & ~back]] = True
        count = lambda rows: np.bincount(rows, minlength=len(kernel))
        out = [pa.array(kernel), pa.array(count(row[~cyclic]) == 0), pa.array(count(row[cond])), pa.array(count(row[src[is_succ & inside & ~back]]) > 0)]
        yield pa.RecordBatch.from_arrays(out, ["kernel_id", "valid", "conditionals", "epilogue"])


def verify_kernels(kernels: DataFrame, blocks: DataFrame, edges: DataFrame) -> DataFrame:
    """One row per kernel: whether all blocks are self-reachable, numbers of entrances, exits and conditionals, and whether it has an epilogue.

    A kernel's row holds its blocks and what they lead to; the functions around them are not gathered.
    """
    kb = kernels.select("kernel_id", "block_id").distinct()
    e = edges.where("src is not null").groupBy(F.col("src").alias("block_id"))
    to = lambda ok: F.collect_set(F.when(ok, F.col("dst")))
    succ = F.coalesce(F.col("kind") == "succ", F.lit(False))
    e = e.agg(to(succ).alias("succ"), to(~succ).alias("other"), F.max(succ & F.col("dst").isNull()).alias("away"))
    none = F.array().cast("array<bigint>")
    m = kb.join(e, "block_id", "left").select("kernel_id", F.struct("block_id", F.coalesce("succ", none).alias("succ"), F.coalesce("other", none).alias("other"), F.coalesce("away", F.lit(False)).alias("away")).alias("m"))
    m = m.groupBy("kernel_id").agg(F.sort_array(F.collect_list("m")).alias("m"))
    got = m.mapInArrow(_verified, "kernel_id bigint, valid boolean, conditionals bigint, epilogue boolean")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("bigint")).alias(c)
    ways = kernel_entrances(kernels, blocks, edges).groupBy("kernel_id").agg(F.count("*").alias("entrances"))
    got = got.join(ways, "kernel_id", "left").join(exit_counts(kernels, blocks, edges), "kernel_id", "left")
    return got.select("kernel_id", "valid", zero("entrances"), "conditionals", "epilogue", zero("exits"))


def adjacency(blocks: DataFrame, edges: DataFrame) -> DataFrame:
    """``block_id, neighbours``: successors, callee entries and, after a return or resume, call sites; sorted, ``[]`` without."""
    e = edges.select("src", "dst", "kind").distinct().join(blocks.select(F.col("block_id").alias("src"), "term_kind"), "src")
    ok = F.col("kind").isin("succ", "call") | ((F.col("kind") == F.col("term_kind")) & F.col("kind").isin("ret", "resume"))
    per = e.where(ok).groupBy("src").agg(F.array_sort(F.collect_set("dst")).alias("neighbours"))
    return blocks.select("block_id").join(per.withColumnRenamed("src", "block_id"), "block_id", "left").withColumn("neighbours", F.coalesce("neighbours", F.array().cast("array<bigint>")))


def reached_outside(kernels: DataFrame, blocks: DataFrame, edges: DataFrame) -> DataFrame:
    """``kernel_id, base, target``: from each member the blocks outside that it reaches within the kernel and by one last step."""
    return _per_kernel(_graphs(kernels, blocks, edges), lambda g, m: [(a, b) for a in sorted(m) for b in sorted(leads_to(g, a, m) - m)], "base bigint, target bigint")


def edge_line(src: str, dst: str, style: str) -> Column:
    """Line of a GraphViz digraph for an edge."""
    return F.concat(F.lit('"'), F.col(src), F.lit('" -> "'), F.col(dst), F.lit('" [style='), F.col(style), F.lit("];"))


def kernel_graph_lines(kernels: DataFrame, edges: DataFrame) -> DataFrame:
    """``section, a, b, line``: in this order the lines of a GraphViz text.

    Section 1 has a cluster for each kernel (``a``) with its blocks, section 2 the edges
    (``src, dst, style``) from ``a`` to ``b``; 0 and 3 open and close the graph.
    """
    spark = kernels.sparkSession
    none = F.lit(None).cast("bigint")
    ends = spark.createDataFrame([(0, "digraph {"), (3, "}")], "section int, line string").select("section", none.alias("a"), none.alias("b"), "line")
    nodes = F.concat_ws(" ", F.transform(F.array_sort(F.collect_set("block_id")), lambda b: F.concat(F.lit('"k'), F.col("kernel_id"), F.lit("b"), b, F.lit('" [label="'), b, F.lit('"];'))))
    clusters = kernels.groupBy("kernel_id").agg(nodes.alias("n"))
    clusters = clusters.select(F.lit(1).alias("section"), F.col("kernel_id").alias("a"), none.alias("b"), F.concat(F.lit("subgraph cluster_"), F.col("kernel_id"), F.lit(' { label="Kernel '), F.col("kernel_id"), F.lit('"; '), F.col("n"), F.lit(" }")).alias("line"))
    lines = edges.select(F.lit(2).alias("section"), F.col("src").alias("a"), F.col("dst").alias("b"), edge_line("src", "dst", "style").alias("line"))
    return ends.unionByName(clusters).unionByName(lines)
