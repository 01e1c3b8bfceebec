"""Kernel graph operators against definitions by brute force."""

import os
import random
import re

import pytest

from loomtrace.operators import graph as G
from loomtrace.plans import flow


def random_case(rng):
    n = rng.randrange(2, 12)
    funcs = [rng.randrange(3) for _ in range(n)]
    entry = {min(b for b in range(n) if funcs[b] == f) for f in set(funcs)}
    blocks = [(b, funcs[b], b, b in entry, rng.choice(["br", "ret", None])) for b in range(n)]
    edges = [(rng.randrange(n), rng.randrange(n), rng.choice(["succ", "succ", "succ", "call", "ret", "resume"])) for _ in range(rng.randrange(3 * n))]
    members = rng.sample(range(n), rng.randrange(1, n + 1))
    return blocks, edges, members


def tables(spark, cases):
    base = 100
    rb = [(i * base + b, i * base + f, p, e, t, "p") for i, (bs, _, _) in enumerate(cases) for b, f, p, e, t in bs]
    re = [(i * base + s, i * base + d, k) for i, (_, es, _) in enumerate(cases) for s, d, k in es] * 2
    rk = [(i, i * base + b) for i, (_, _, ms) in enumerate(cases) for b in ms]
    return (
        spark.createDataFrame(rk, "kernel_id bigint, block_id bigint"),
        spark.createDataFrame(rb, "block_id bigint, func_id bigint, block_pos int, is_entry boolean, term_kind string, program string"),
        spark.createDataFrame([*re, (None, 1, "succ"), (1, None, None)], "src bigint, dst bigint, kind string"),
    )


class Model:
    def __init__(self, case):
        blocks, self.edges, members = case
        self.info = {b: (f, e, t) for b, f, _, e, t in blocks}
        self.m = set(members)

    def out(self, b, *kinds):
        return {d for s, d, k in self.edges if s == b and k in kinds}

    def reach(self, b, valid, *kinds):
        seen, todo = set(), [b]
        while todo:
            for d in self.out(todo.pop(), *kinds) & valid - seen:
                seen.add(d)
                todo.append(d)
        return seen

    def sites(self, f):
        return {s for s, d, k in self.edges if k == "call" and self.info[d][:2] == (f, True)}

    def pruned(self):
        left = set(self.m)
        while True:
            for b in sorted(left):
                f, e, t = self.info[b]
                pre = self.sites(f) & left if e else {s for s in left if b in self.out(s, "succ")}
                suc = self.sites(f) & left if t == "ret" else self.out(b, "succ") & left
                if not pre or not suc:
                    left.discard(b)
                    break
            else:
                return left

    def cyclic(self):
        return {b for b in self.m if b in self.reach(b, self.m, *G.ALL)}

    def entrances(self, m):
        got = set()
        for b in m:
            f, e, _ = self.info[b]
            if e:
                if self.sites(f) - m and not self.sites(f) & m:
                    got.add(b)
                continue
            seen, todo = {b}, [b]
            while todo:
                x = todo.pop()
                if self.info[x][1] and x != b:
                    got.add(b)
                todo += (new := {s for s in self.info if x in self.out(s, "succ") and self.info[s][0] == f and self.info[x][0] == f and s not in m} - seen)
                seen |= new
        return got

    def exits(self):
        got = set()
        for b in self.m:
            f, _, t = self.info[b]
            got |= self.out(b, "succ") | (self.sites(f) if t == "ret" else set())
        return got - self.m

    def conditionals(self):
        found, epilogue = set(), False
        for b in self.m:
            for s in self.out(b, "succ"):
                back = s == b or b in self.reach(s, self.m, *G.ALL)
                if s not in self.m or not back:
                    found.add(b)
                    epilogue |= s in self.m and not back
        return found, epilogue


def test_against_model(spark):
    rng = random.Random(5)
    cases = [random_case(rng) for _ in range(60)]
    args = tables(spark, cases)
    by = lambda df: {k: set() for k in range(len(cases))} | _group(df)
    pruned = {r.kernel_id: [b % 100 for b in r.blocks] for r in G.pruned_kernels(*args).collect()}
    cyclic, exits, ent, cond = (by(f(*args)) for f in (G.self_reachable_blocks, G.kernel_exits, G.kernel_entrances, G.kernel_conditionals))
    split = {(r.kernel_id, r.entrance % 100, tuple(b % 100 for b in r.blocks)) for r in G.split_kernels(*args).collect()}
    reached = {(r.kernel_id, r.base % 100, r.block_id % 100) for r in G.reachable_blocks(*args).collect()}
    verify = {r.kernel_id: r for r in G.verify_kernels(*args).collect()}
    want = set()
    for i, c in enumerate(cases):
        x = Model(c)
        assert set(pruned[i]) == x.pruned() and cyclic[i] == x.cyclic() and exits[i] == x.exits() and ent[i] == x.entrances(x.m), (i, c)
        assert cond[i] == x.conditionals()[0], (i, c)
        want |= {(i, e, tuple(sorted(x.reach(e, x.cyclic(), "succ", "call")))) for e in x.entrances(x.cyclic())}
        assert {(a, b) for k, a, b in reached if k == i} == {(a, b) for a in x.m for b in x.reach(a, x.m, "succ", "call")}
        v = verify[i]
        assert (v.valid, v.entrances, v.exits, v.conditionals, v.epilogue) == (x.cyclic() == x.m, len(ent[i]), len(exits[i]), len(cond[i]), x.conditionals()[1])
    assert split == want


def _group(df):
    got = {}
    for r in df.collect():
        got.setdefault(r.kernel_id, set()).add(r.block_id % 100)
    return got


def test_invariants(spark):
    rng = random.Random(6)
    kernels, blocks, edges = tables(spark, [random_case(rng) for _ in range(20)])
    once = G.pruned_kernels(kernels, blocks, edges)
    again = G.pruned_kernels(once.selectExpr("kernel_id", "explode(blocks) block_id"), blocks, edges)
    assert {(r.kernel_id, tuple(r.blocks)) for r in again.collect()} == {(r.kernel_id, tuple(r.blocks)) for r in once.collect() if r.blocks}
    assert G.verify_kernels(kernels.limit(0), blocks, edges).count() == 0


def test_closure_gathers_only_edges_within(spark):
    k = spark.createDataFrame([(1, b) for b in range(40)] + [(2, b) for b in range(0, 40, 2)], "kernel_id bigint, block_id bigint")
    e = spark.createDataFrame([(b, (b + 1) % 40, "succ") for b in range(40)] + [(0, 2, "ret"), (2, 0, "call"), (0, 999, "succ")], "src bigint, dst bigint, kind string")
    # neither functions nor blocks around are read, and edges that leave the kernel fall away before they are gathered
    assert {tuple(r) for r in G.reachable_blocks(k, None, e).collect()} == {(1, a, b) for a in range(40) for b in range(40)} | {(2, 2, 0)}
    assert {tuple(r) for r in G.self_reachable_blocks(k, None, e).collect()} == {(1, b) for b in range(40)} | {(2, 0), (2, 2)}
    assert "term_kind" not in G.reachable_blocks(k, None, e)._jdf.queryExecution().executedPlan().toString()


def test_exits_are_unfolded_last(spark):
    for i in range(3):
        cases = [random_case(random.Random(100 * i + j)) for j in range(20)]
        k, b, e = tables(spark, cases)
        df = G.kernel_exits(k, b, e)
        want = set()
        for n, c in enumerate(cases):
            m = Model(c)
            out = {d for x in m.m for d in m.out(x, "succ")} | {s for x in m.m if m.info[x][2] == "ret" for s in m.sites(m.info[x][0])}
            want |= {(n, n * 100 + x) for x in out - m.m}
        got = [tuple(r) for r in df.collect()]
        assert len(got) == len(set(got)) and set(got) == want
        counts = {}
        for n, _ in want:
            counts[n] = counts.get(n, 0) + 1
        assert {r.kernel_id: r.exits for r in G.exit_counts(k, b, e).where("exits > 0").collect()} == counts
        plan = df._jdf.queryExecution().sparkPlan().toString()
        assert "HashAggregate" not in plan[: plan.index("explode(CASE")]


def test_verify_gathers_no_functions(spark, monkeypatch):
    """Members without a row in ``blocks`` count as in SQL; a kernel's row holds no blocks of the functions around."""
    monkeypatch.setattr(G, "_graphs", None)
    # a function of 40 blocks in a row, of which block 5 is a member; 90 and 91 are a cycle of blocks that have no row, 92 leads away
    b = spark.createDataFrame([(n, 1, n == 0, "br") for n in range(40)], "block_id bigint, func_id bigint, is_entry boolean, term_kind string")
    e = spark.createDataFrame([(n, n + 1, "succ") for n in range(39)] + [(90, 91, "succ"), (91, 90, "succ"), (92, None, "succ")], "src bigint, dst bigint, kind string")
    k = spark.createDataFrame([(1, 5), (2, 90), (2, 91), (3, 0), (3, 5), (4, 92), (5, 5), (5, 7)], "kernel_id bigint, block_id bigint")
    got = {r.kernel_id: (r.valid, r.entrances, r.conditionals, r.epilogue, r.exits) for r in G.verify_kernels(k, b, e).collect()}
    assert got == {1: (False, 1, 1, False, 1), 2: (True, 0, 0, False, 0), 3: (False, 0, 2, False, 2), 4: (False, 0, 1, False, 1), 5: (False, 1, 2, False, 2)}
    assert sorted(map(tuple, G.kernel_entrances(k, b, e).collect())) == [(1, 5), (5, 5)]


def test_members_are_made_distinct_once(spark):
    folder = os.environ.get("TEST_DATA", "/root/testdata/sf0.001")
    if not os.path.isdir(folder):
        pytest.skip("no test tables")
    # with the catalogue's other columns there is a second shuffle in every place that reads it
    assert not re.search(r"Aggregate \[[^\]]*trace_id", flow.kernel_exits(spark, folder)._jdf.queryExecution().optimizedPlan().toString())
