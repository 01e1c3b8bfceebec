"""Heavy keys: the same rows as plain loops, whatever is found heavy; nulls, copies, clashing names, empty tables."""

import random

from pyspark.sql import functions as F

from loomtrace.operators.ordered import lines, writers
from loomtrace.operators.skew import aggregate, changes, heavy_keys
from loomtrace.plans.p6 import block_totals, writer_changes

TRACE = "trace_id string, seq bigint, k string, v string, ts timestamp, recv_ts timestamp, value string, chunk string, _heavy int"


def trace_rows(n=3000, seed=3):
    rng, rows = random.Random(seed), []
    for i in range(n):
        t = None if i % 50 == 0 else f"t{min(3, int(rng.expovariate(1)))}"
        k = rng.choice(["BBEnter", "StoreAddress", "StoreAddress", "LoadAddress", None])
        x = rng.choice([0, 0, 0, 1, rng.randrange(50)])
        v = rng.choice([str(x), f"0X{x:X}", f" 0x{x:04x}\r", None, "0X", "??"] if rng.random() < 0.2 else [str(x), f"0X{x:X}"])
        row = (t, None if i % 97 == 0 else i * 3, k, v, None, None, "z", "z", 1)
        rows += [row] * rng.choice([1, 1, 1, 2])
    rng.shuffle(rows)
    return rows


def number(v):
    t = (v or "").strip(" \t\r")
    if t.isdigit():
        return int(t)
    try:
        return int(t[2:], 16) if t[:2] in ("0x", "0X") and t[2:] else None
    except ValueError:
        return None


def model(rows):
    seen = {}
    for t, s, k, v, *_ in rows:
        if s is not None and k in ("BBEnter", "StoreAddress") and number(v) is not None:
            seen[(t is None, t, s)] = (k, number(v))
    block, cell, out, blocks = {}, {}, set(), {}
    for (_, t, s), (k, x) in sorted(seen.items(), key=lambda i: (i[0][0], i[0][1] or "", i[0][2])):
        if k == "BBEnter":
            block[t] = x
            blocks.setdefault(x, []).append((t, s))
        elif t in block:
            if cell.get((t, x), block[t]) != block[t]:
                out.add((t, s, x, block[t]))
            cell[(t, x)] = block[t]
    return out, blocks


def test_writer_changes(spark):
    rows = trace_rows()
    df = spark.createDataFrame(rows, TRACE)
    want, blocks = model(rows)
    assert {tuple(r) for r in writer_changes(df).select("trace_id", "seq", "addr", "writer").collect()} == want
    # narrow chunks and every key heavy: pieces and seams do all the work
    stores = writers(df, width=40)
    heavy = stores.select("trace_id", "addr").distinct()
    got = changes(stores, ["trace_id", "addr"], "seq", "chunk", "writer", heavy)
    assert {(r.trace_id, r.seq, r.addr, r.writer) for r in got.collect()} == want
    totals = {r.block_id: r for r in block_totals(df).collect()}
    assert {b: len(x) for b, x in blocks.items()} == {b: r.entries for b, r in totals.items()}
    for b, x in blocks.items():
        first = min(x, key=lambda i: (i[0] is not None, i[0] or "", i[1]))
        assert (totals[b].first_trace, totals[b].first_seq) == first


def test_empty_and_copies(spark):
    none = spark.createDataFrame([], TRACE)
    assert writer_changes(none).count() == 0 and block_totals(none).count() == 0 and lines(none).count() == 0
    df = spark.createDataFrame([("a", 1, 0, 5), ("a", 1, 0, 5), ("a", 2, 0, None), ("a", 3, 0, 6), (None, 1, 0, 1), (None, 2, 0, 2), ("a", None, 0, 9)], "key string, at bigint, part bigint, val bigint")
    for heavy in (df.select("key").distinct(), df.select("key").limit(0)):
        got = {tuple(r) for r in changes(df, ["key"], "at", "part", "val", heavy).collect()}
        assert got == {("a", 3, 0, 6), (None, 2, 0, 2)}


def test_heavy_keys(spark):
    """Keys just below and above what one task takes, ties at the bound of the list, small and empty tables."""
    df = spark.createDataFrame([(k, None) for k, n in (("a", 99), ("b", 100), ("c", 101), (None, 300)) for _ in range(n)], "key string, x int")
    assert {r.key for r in heavy_keys(df, ["key"], rows=100, fraction=1.0).collect()} == {"b", "c", None}
    assert [r.key for r in heavy_keys(df, ["key"], rows=100, fraction=1.0, most=1).collect()] == [None]
    assert heavy_keys(df, ["key"]).count() == 0 and heavy_keys(df.limit(0), ["key"], fraction=1.0).count() == 0


def test_aggregate(spark):
    df = spark.createDataFrame([(i % 3 if i % 4 else None, i) for i in range(400)], "key bigint, x bigint")
    want = {tuple(r) for r in df.groupBy("key").agg(F.sum("x"), F.count("*")).collect()}
    for heavy in (df.select("key").where("key = 1 or key is null").distinct(), heavy_keys(df, ["key"], rows=70, fraction=1.0), df.select("key").limit(0)):
        got = aggregate(df, ["key"], {"s": F.sum("x"), "n": F.count("*")}, {"s": F.sum("s"), "n": F.sum("n")}, heavy, ["x"], 8)
        assert {tuple(r) for r in got.collect()} == want
