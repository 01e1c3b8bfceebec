import random
from itertools import combinations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loomtrace.llm.packing import closest, fill, pack


@settings(max_examples=300, deadline=None)
@given(st.dictionaries(st.integers(1, 30), st.integers(1, 3), min_size=1, max_size=5), st.integers(0, 60))
def test_closest_is_best(counts, gap):
    got = closest(sorted(counts), counts, gap)
    assert all(0 < n <= counts[s] for s, n in got.items())
    items = [s for s, c in counts.items() for _ in range(c)]
    best = max(t for r in range(len(items) + 1) for c in combinations(items, r) if (t := sum(c)) <= gap)
    assert sum(s * n for s, n in got.items()) == best


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 50), max_size=60), st.integers(50, 80))
def test_fill(sizes, capacity):
    out = fill(sizes, capacity)
    assert sorted(i for c in out for i in c) == list(range(len(sizes)))
    assert all(sum(sizes[i] for i in c) <= capacity for c in out)
    full = [sum(sizes[i] for i in c) for c in out]
    assert all(x > 0 for x in full) or len(out) == 1


def test_many_lengths():
    """Of more lengths than any window would hold, the ones in the middle are found."""
    lengths = [*range(2, 1202, 2), 2001]
    got = closest(lengths, dict.fromkeys(lengths, 1), 2602)
    assert sum(s * n for s, n in got.items()) == 2602
    odd = [3, 6, *range(1000, 1600, 3)]
    assert sum(s * n for s, n in closest(odd, dict.fromkeys(odd, 1), 1301).items()) == 1300
    sizes = random.Random(1).choices(range(1, 2000), k=3000)
    out = fill(sizes, 4096)
    assert len(out) <= -(-sum(sizes) // 4096) + 1


def test_kinds(spark):
    df = spark.createDataFrame([(i, 5) for i in range(8)], "i bigint, n bigint")
    got = pack(df, "i", "n", [("a", 20), ("a", 10), (None, 5), ("b", None)])
    assert {r["pack"] for r in got.collect()} == {"a"} and got.select("container").distinct().count() == 4


def test_pack(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice([None, 0, 3, 10, 11, 25, 100, rng.randrange(1, 60)]), 9, "x") for i in range(500)] + [(7, 5, 9, "x"), (None, 4, 9, "x"), ((1 << 60) + 1, 4, 9, "x")]
    df = spark.createDataFrame(rows, "item bigint, n bigint, container int, pack string")
    got = pack(df, "item", "n", [("small", 10), ("big", 64)], shard_items=60).collect()
    for kind, cap in (("small", 10), ("big", 64)):
        used, pieces = {}, {}
        for r in got:
            if r["pack"] == kind:
                used[r.shard, r.container] = used.get((r.shard, r.container), 0) + r.tokens
                pieces.setdefault(r["item"], []).append((r.part, r.start, r.tokens))
        assert max(used.values()) <= cap
        size = {}
        for i, n, *_ in rows:
            size.setdefault(i, []).append(n or 0)
        assert pieces.keys() == size.keys()
        for i, ns in size.items():
            assert sum(t for *_, t in pieces[i]) == sum(ns)
            if len(ns) == 1:
                p = sorted(pieces[i])
                assert [x for x, *_ in p] == list(range(len(p))) and (ns[0] > cap or len(p) == 1)
                assert [s for _, s, _ in p] == [k * cap for k in range(len(p))]
        assert sum(used.values()) / (len(used) * cap) > 0.9
    assert pack(df.limit(0), "item", "n", [("a", 5)]).count() == 0 and pack(df, "item", "n", []).count() == 0
    with pytest.raises(ValueError):
        pack(df, "item", "n", [("a", 0)])
    assert sorted(map(str, got)) == sorted(map(str, pack(df.repartition(5), "item", "n", [("small", 10), ("big", 64)], shard_items=60).collect()))
