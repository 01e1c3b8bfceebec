"""Trace operators against single-pass models of the state machines they stand for."""

import random
from collections import Counter, defaultdict
from fractions import Fraction

from loomtrace.operators import blocks as B
from loomtrace.operators import instances as I
from loomtrace.operators import ordered as O
from loomtrace.sources.trace_files import Stream, parse_stream, read_counters, read_traces, trace_status, write_counters, write_traces

TRACE = "trace_id string, seq bigint, k string, v string, ts timestamp, recv_ts timestamp, block_id string, n int"


def nested_trace(rng, size, blocks=8, labels=("a", "b")):
    rows, stack = [], []
    while len(rows) < size:
        r = rng.random()
        if r < 0.45 or not stack:
            stack.append(rng.randrange(blocks))
            rows.append(("BBEnter", f"0X{stack[-1]:X}" if stack[-1] else "0"))
        elif r < 0.8:
            rows.append(("BBExit", str(stack.pop())))
        elif r < 0.9:
            rows.append((rng.choice(["LoadAddress", "StoreAddress"]), str(rng.randrange(5))))
        else:
            rows.append((rng.choice(["KernelEnter", "KernelExit"]), rng.choice(labels)))
    return rows


def frame(spark, traces):
    rows = [(t, 2 * i, k, v, None, None, "x", 0) for t, ls in traces.items() for i, (k, v) in enumerate(ls)]
    rows += rows[::7]
    random.Random(0).shuffle(rows)
    return spark.createDataFrame(rows, TRACE)


def num(v):
    return int(v, 0) if v[:2] in ("0X", "0x") else int(v)


def grow(rows, members):
    """The state machine: blocks entered while a member is open, and those between members unless the later is the first."""
    depth, start, since, out = Counter(), None, [], set()
    for k, v in rows:
        if k == "BBEnter":
            b = num(v)
            since.append(b)
            if b in members:
                depth[b] += 1
                if start is None:
                    start = b
                elif b != start:
                    out.update(since)
                since = []
            if sum(depth.values()) > 0:
                out.add(b)
        elif k == "BBExit" and num(v) in members:
            depth[num(v)] -= 1
    return out


def test_state_machines(spark, monkeypatch):
    # chunks of a few lines, so that most state crosses chunks
    monkeypatch.setattr(O, "CHUNK", 16)
    monkeypatch.setattr(O.with_chunk, "__defaults__", (16,))
    rng = random.Random(2)
    traces = {f"t{i}": nested_trace(rng, n) for i, n in enumerate((0, 3, 9, 60, 250))}
    df = frame(spark, traces)
    entered = {t: [num(v) for k, v in ls if k == "BBEnter"] for t, ls in traces.items()}

    got = {(r.trace_id, r.block_id): r.cnt for r in B.block_counts(df).collect()}
    assert got == {(t, b): n for t, e in entered.items() for b, n in Counter(e).items()}

    want = Counter((t, e[i], x) for t, e in entered.items() for i in range(5, len(e)) for x in e[max(0, i - 10) : i + 1])
    assert {(r.trace_id, r.block_id, r.nbr): r.cnt for r in B.cooccurrence(df).collect()} == want

    kernels = [(i, t, b) for i, (t, size) in enumerate((t, s) for t in traces for s in (1, 2, 4)) for b in rng.sample(range(8), size)]
    kdf = spark.createDataFrame([*kernels, (999, None, 1)], "kernel_id bigint, trace_id string, block_id bigint")
    members = defaultdict(set)
    for i, t, b in kernels:
        members[i, t].add(b)
    grown = {r.kernel_id: set(r.blocks) for r in B.grown_kernels(df, kdf).collect()}
    assert grown == {i: g for (i, t), m in members.items() if (g := grow(traces[t], m))}

    deep = {(r.trace_id, r.block_id): (r.deepest, r.lowest, r.at_end) for r in B.open_depth(df).collect()}
    for t, ls in traces.items():
        run, hi, lo = Counter(), {}, {}
        for k, v in ls:
            if k in ("BBEnter", "BBExit"):
                b = num(v)
                run[b] += 1 if k == "BBEnter" else -1
                hi[b], lo[b] = max(hi.get(b, run[b]), run[b]), min(lo.get(b, run[b]), run[b])
        assert {b: x for (s, b), x in deep.items() if s == t} == {b: (hi[b], lo[b], run[b]) for b in hi}

    stack_want, set_want = defaultdict(set), defaultdict(set)
    for t, ls in traces.items():
        depth, active = Counter(), set()
        for k, v in ls:
            if k == "KernelEnter":
                depth[v] += 1
                active.add(v)
            elif k == "KernelExit":
                depth[v] -= 1
                active.discard(v)
            elif k == "BBEnter":
                stack_want[t, num(v)] |= {x for x, d in depth.items() if d > 0}
            elif k == "BBExit":
                set_want[t, num(v)] |= active
    assert {(r.trace_id, r.block_id): set(r.labels) for r in B.block_labels(df).collect()} == {k: v for k, v in stack_want.items() if v}
    assert {(r.trace_id, r.block_id): set(r.labels) for r in B.block_labels_at_exit(df).collect()} == dict(set_want)

    named = spark.createDataFrame([(t, str(i), b) for i, t, b in kernels], "trace_id string, kid string, block_id bigint")
    inst = {(r.trace_id, r.uid): (r.kid, r.first_seq) for r in I.instances(df, named).collect()}
    edges = {(r.trace_id, r.consumer, r.producer) for r in I.consumer_edges(df, named).collect()}
    compat = {(r.trace_id, r.consumer, r.producer) for r in I.consumer_edges(df, named, compat=True).collect()}
    want_inst, want_edges, want_compat = {}, set(), set()
    for t, ls in traces.items():
        ks = sorted((str(i), m) for (i, s), m in members.items() if s == t)
        cur, uid, wrote = None, -1, {}
        for i, (k, v) in enumerate(ls):
            if k == "BBEnter" and not (cur and num(v) in cur[1]):
                cur = next((x for x in ks if num(v) in x[1]), None)
                if cur:
                    uid += 1
                    want_inst[t, uid] = (cur[0], 2 * i)
            elif k == "LoadAddress":
                p = wrote.get(v)
                if p is not None and p >= 0 and uid >= 0 and p != uid:
                    want_edges.add((t, uid, p))
                p = 0 if p is None else p
                if p != -1 and p != uid:
                    want_compat.add((t, uid, p))
            elif k == "StoreAddress":
                wrote[v] = uid
    assert inst == want_inst and edges == want_edges and compat == want_compat


def test_ranges(spark):
    rng = random.Random(11)
    seqs = sorted({*range(0, 2000, 3), *(rng.randrange(1 << 20) for _ in range(300)), *(rng.randrange(1 << 40) for _ in range(50)), -5, -(1 << 30)})
    rows = [("t" if i % 3 else None, s, rng.randrange(12)) for i, s in enumerate(seqs)]
    ends = sorted(rng.sample(seqs, 60))
    ranges = [("t" if i % 2 else None, a + rng.randrange(-2, 3), b + rng.randrange(-2, 3), i) for i, (a, b) in enumerate(zip(rng.sample(ends, 60), ends))]
    ranges += [("t", O.FROM_START, O.FOREVER, 100), ("t", 5, 5, 101), (None, 9, 3, 102)]
    df = O.with_chunk(spark.createDataFrame(rows, "trace_id string, seq bigint, block_id int"))
    got = {tuple(r) for r in O.blocks_in_ranges(df, spark.createDataFrame(ranges, "trace_id string, lo bigint, hi bigint, r int"), "r").collect()}
    assert got == {(t, b, r) for t, lo, hi, r in ranges for u, s, b in rows if t == u and lo <= s <= hi}


def test_transfer():
    rng = random.Random(4)
    for _ in range(400):
        names = ["1", "10", "2", "3"]
        blocks = [sorted(rng.sample(names, rng.choice([0, 0, 1, 2, 3]))) for _ in range(rng.randrange(1, 12))]
        by = {a: (b, n) for a, b, n in I.transfer(blocks)}
        for s in [None, *names]:
            end, new, _ = I.follow(blocks, s)
            assert by.get(s, by[None]) == (end, new)


def test_greedy():
    counts, matrix = {1: 600, 2: 600, 3: 100}, {1: {1: 5, 2: 4, 3: 1}, 2: {2: 10}, 3: {3: 1}}
    assert B.greedy_kernels(counts, matrix) == [[1, 2]]  # 9 of 10 reach the threshold exactly
    assert B.greedy_kernels(counts, matrix, threshold=Fraction(95, 100)) == [[1, 2, 3]]
    assert B.greedy_kernels(counts, matrix, threshold=Fraction(2)) == [[1, 2, 3]]
    assert B.greedy_kernels(counts, {}, 1) == [] and B.greedy_kernels({}, {}) == []
    assert B.greedy_kernels({1: 5, 2: 5}, {1: {1: 1}, 2: {2: 1}}, 6) == []


def test_trace_files(spark, tmp_path):
    import zlib

    body = b"TraceVersion:3\nBBEnter:0\nKernelEnter:a:b\nx\n\nlast"
    assert list(parse_stream([zlib.compress(body)])) == [("TraceVersion", "3"), ("BBEnter", "0"), ("KernelEnter", "a"), ("x", None), ("", None)]
    z = zlib.compress(b"k:1\n" * 50_000)
    assert len(list(parse_stream(z[i : i + 3] for i in range(0, len(z), 3)))) == 50_000
    assert list(parse_stream([b"no stream"])) == [] and list(parse_stream([])) == []
    for data, damaged, unfinished in ((zlib.compress(body), False, True), (z[:-20], True, False), (b"", True, False), (z + b"more", False, False)):
        x = Stream(iter([data]))
        n = sum(1 for _ in x)
        assert (x.damaged, x.unfinished) == (damaged, unfinished) or (damaged and x.damaged and n < 50_000)
    big = zlib.compress(b"k:" + b"v" * 30_000_000 + b"\nlast:1\n")
    assert [(k, len(v)) for k, v in parse_stream([big])] == [("k", 30_000_000), ("last", 1)]
    df = spark.createDataFrame([("../x.y %", 1, "k", "v"), ("", 1, "k", "v")], "trace_id string, seq bigint, k string, v string")
    write_traces(df, f"file:{tmp_path}/odd")
    write_traces(df, f"file://{tmp_path}/odd")
    assert {tuple(r) for r in read_traces(spark, f"file:{tmp_path}/odd").collect()} == {("../x.y %", 0, "k", "v"), ("", 0, "k", "v")}
    (tmp_path / "odd" / "broken.trc").write_bytes(z[: len(z) // 2])
    assert {(r.trace_id, r.damaged, r.unfinished) for r in trace_status(spark, f"{tmp_path}/odd").collect()} >= {("../x.y %", False, False), ("", False, False)}
    assert trace_status(spark, f"{tmp_path}/odd").where("damaged").count() == 1
    (tmp_path / "none").mkdir()
    assert read_traces(spark, f"{tmp_path}/none").count() == 0
    df = spark.createDataFrame([("a", 5, "BBEnter", "1"), ("a", 2, "k", None), ("b", 1, "x", "y")], "trace_id string, seq bigint, k string, v string")
    write_traces(df, str(tmp_path / "t"))
    got = {tuple(r) for r in read_traces(spark, str(tmp_path / "t")).collect()}
    assert got == {("a", 0, "k", ""), ("a", 1, "BBEnter", "1"), ("b", 0, "x", "y")}
    write_counters(spark.createDataFrame([("PAPI_TOT_INS", 7), ("x,y", 8)], "event string, value bigint"), str(tmp_path / "c"))
    assert {tuple(r) for r in read_counters(spark, str(tmp_path / "c")).collect()} == {("PAPI_TOT_INS", 7), ("x,y", 8)}
