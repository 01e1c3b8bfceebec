import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomtrace.llm.mixing import chosen, mix, most_blocks, sainte_lague, shares


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 50), min_size=1, max_size=6), st.integers(0, 60))
def test_apportionment(weights, seats):
    got = sainte_lague(weights, seats).tolist()
    want = [0] * len(weights)
    if any(weights):
        for _ in range(seats):
            i = max(range(len(weights)), key=lambda i: (weights[i] / (2 * want[i] + 1), -i))
            want[i] += 1
    assert sum(got) == sum(want)
    # the same up to quotients that tie
    q = lambda s: sorted(weights[i] / (2 * j + 1) for i in range(len(weights)) for j in range(s[i]))
    assert all(abs(a - b) < 1e-9 for a, b in zip(q(got), q(want)))


def test_most_blocks():
    n, given_ = most_blocks([0.5, 0.5], [10, 100])
    assert n in (20, 21) and given_[0] == 10
    assert most_blocks([], [])[0] == 0 and most_blocks([0.0], [5])[0] == 0


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 60), max_size=40), st.integers(0, 1500), st.integers(1, 40), st.integers(0, 5))
def test_chosen(sizes, quota, block, seed):
    took = chosen(sizes, quota, block, seed)
    got, rest = sum(s for s, t in zip(sizes, took) if t), [s for s, t in zip(sizes, took) if not t and s > 0]
    assert (took == chosen(sizes, quota, block, seed)).all()
    if quota >= sum(sizes):
        assert not rest
    else:
        # off by at most half of the smallest record left out, or of the last one taken
        assert abs(got - quota) <= max([*sizes, 0]) and (got > quota or not rest or got + min(rest) > quota)


def test_large_records(spark):
    """Nearly half of the size is in records larger than a block, as in the tables; shares still hold."""
    rng = random.Random(6)
    rows = [(i, "abc"[i % 3], rng.choice([rng.randrange(50, 900)] * 9 + [rng.randrange(3000, 21_000)])) for i in range(900)]
    df = spark.createDataFrame(rows, "i bigint, source string, n bigint")
    targets = [("a", 0.55, 3), ("b", 0.3, 2), ("c", 0.15, 1)]
    used = {}
    for r in mix(df, "i", "source", "n", targets).collect():
        used[r.source] = used.get(r.source, 0) + r.uses * r.size
    assert all(abs(used[s] / sum(used.values()) - share) < 0.002 for s, share, _ in targets)


def test_mix(spark):
    rng, rows = random.Random(2), []
    for i in range(6000):
        s = rng.choices(["big", "mid", "low", "other", None], [60, 25, 5, 8, 2])[0]
        rows.append((i, s, rng.choice([None, 0, rng.randrange(1, 400), rng.randrange(1, 4000)]), 7, 8))
    df = spark.createDataFrame(rows, "doc_id bigint, source string, n bigint, uses int, _all int")
    targets = [("big", 0.5, 1), ("mid", 0.2, 2), ("low", 0.2, 3), ("none", 0.1, 2)]
    out = mix(df, "doc_id", "source", "n", targets, shard_rows=700)
    got = out.collect()
    assert sorted(r.doc_id for r in got) == sorted(i for i, s, *_ in rows if s in ("big", "mid", "low"))
    most = {s: m for s, _, m in targets}
    used = {}
    for r in got:
        assert 0 <= r.uses <= most[r.source]
        used[r.source] = used.get(r.source, 0) + r.uses * r.size
    total = sum(used.values())
    for s, share, _ in targets[:3]:
        assert abs(used[s] / total - share / 0.9) < 0.01
    low = sum(n or 0 for _, s, n, *_ in rows if s == "low")
    assert used["low"] > 2.8 * low  # the source that runs out sets the size
    assert sorted(map(tuple, got)) == sorted(map(tuple, mix(df.repartition(3), "doc_id", "source", "n", targets, shard_rows=700).collect()))
    t = spark.createDataFrame(targets, "source string, target_share double, max_repeats int")
    rep = {r.source: r for r in shares(out, t).collect()}
    assert rep["none"].used == 0 and rep["none"].share == 0 and abs(rep["big"].share - used["big"] / total) < 1e-6 and rep["low"].most_uses == 3


def test_nothing(spark):
    df = spark.createDataFrame([(1, "a", 0), (2, "a", None), (3, "b", 5)], "i bigint, source string, n bigint")
    assert mix(df.limit(0), "i", "source", "n", [("a", 1.0, 1)]).count() == 0
    assert [(r.i, r.uses) for r in mix(df, "i", "source", "n", [("a", 1.0, 1)]).orderBy("i").collect()] == [(1, 0), (2, 0)]
    assert mix(df, "i", "source", "n", []).count() == 0
    assert mix(df, "i", "source", "n", [("b", 1.0, 2)]).agg(F.sum("uses")).first()[0] == 2
