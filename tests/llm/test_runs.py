import random

import pytest
from pyspark.sql import functions as F

from loomtrace.llm.runs import collapse_runs

SCHEMA = "s string, p bigint, e string, t bigint, _s int, entries int, _run string"


def model(rows, max_gap=None):
    seen = {}
    for s, p, e, t, *_ in rows:
        if p is not None and e is not None:
            o = seen.setdefault((s is None, s, p), [e, []])
            o[0] = min(o[0], e)
            o[1] += [] if t is None else [t]
    out = []
    for (_, s, p), (e, ts) in sorted(seen.items(), key=lambda x: (x[0][0], x[0][1] or "", x[0][2])):
        last = out[-1] if out else None
        if last and last[:2] == [s, e] and (max_gap is None or p - last[3] <= max_gap):
            last[3], last[4], last[5] = p, last[4] + 1, last[5] + ts
        else:
            out.append([s, e, p, p, 1, ts])
    return {(s, e, a, b, n, min(ts, default=None), max(ts, default=None)) for s, e, a, b, n, ts in out}


@pytest.mark.parametrize("width", [1, 7, 1000])
@pytest.mark.parametrize("gap", [None, 4])
def test_runs(spark, width, gap):
    rng, rows = random.Random(width), []
    for s in ("a", "b", None, "one"):
        p = rng.randrange(5)
        for _ in range(1 if s == "one" else 120):
            p += rng.choice([1, 1, 2, 9])
            row = (s, p, rng.choice(["x", "x", "x", "y", None, ""]), rng.choice([None, p * 10]), 0, 1, "q")
            rows += [row] * rng.choice([1, 1, 2])
            if rng.random() < 0.1:
                rows.append((s, p, row[2], p * 10 + 5, 0, 1, "q"))
    rows += [("a", None, "x", 1, 0, 1, "q"), ("a", 3, "zz", None, 0, 1, "q")]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, SCHEMA)
    got = [tuple(r) for r in collapse_runs(df, "s", "p", "e", "t", gap, width).collect()]
    assert len(got) == len(set(got)) and set(got) == model(rows, gap)


@pytest.mark.parametrize("width", [1, 5, 1000])
def test_near_runs(spark, width):
    """Runs of numbers that drift: each near the one before, whatever the chunks."""
    rng, rows, x = random.Random(width), [], 0
    for p in range(200):
        x += rng.choice([0, 0, 1, -1, 2, 7, -9])
        rows.append(("a", p, x if p % 11 else None, p))
    df = spark.createDataFrame(rows, "s string, p bigint, e bigint, t bigint")
    want, last = [], None
    for _, p, e, t in rows:
        if e is not None:
            if last is not None and abs(e - last) <= 2:
                want[-1][2:5] = [p, want[-1][3] + 1, want[-1][4]]
            else:
                want.append([e, p, p, 1, t])
            last = e
    got = collapse_runs(df, "s", "p", "e", "t", width=width, within=2).collect()
    assert sorted((r.e, r.first_pos, r.last_pos, r.entries, r.first_ts) for r in got) == sorted(map(tuple, want))


def test_one_run_over_many_chunks(spark):
    df = spark.range(5000).select(F.lit("a").alias("s"), F.col("id").alias("p"), F.lit(1).alias("e"), F.col("id").alias("t"))
    assert [tuple(r) for r in collapse_runs(df, "s", "p", "e", "t", width=100).collect()] == [("a", 1, 0, 4999, 5000, 0, 4999)]
    assert collapse_runs(df.limit(0), "s", "p", "e", "t").count() == 0
