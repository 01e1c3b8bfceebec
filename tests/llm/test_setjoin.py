import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loomtrace.llm.setjoin import clean_sets, merge_skip, needed, set_classes, similar_classes, similar_pairs


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.integers(0, 30), unique=True).map(sorted), min_size=1, max_size=8), st.integers(1, 8))
def test_merge_skip(lists, t):
    got = dict(merge_skip(lists, [0] * len(lists), [len(x) for x in lists], t))
    want = {v: n for v in range(31) if (n := sum(v in x for x in lists)) >= t}
    assert got == want


def test_needed():
    for a in range(1, 30):
        for b in range(1, 30):
            for o in range(min(a, b) + 1):
                assert (o >= needed(a, b, 7, 10)) == (10 * o >= 7 * (a + b - o))


@pytest.mark.parametrize("num,den,shard", [(7, 10, 20_000), (7, 10, 3), (1, 2, 5), (1, 1, 20_000), (9, 10, 2)])
def test_pairs(spark, num, den, shard):
    rng, sets = random.Random(num * shard), {}
    for i in range(150):
        if i % 4 and sets:
            s = set(sets[rng.choice(list(sets))])
            for _ in range(rng.randrange(3)):
                s ^= {rng.randrange(40)}
        else:
            s = set(rng.sample(range(40), rng.randrange(0, 14)))
        sets[i * 7 % 151] = s
    rows = [(i, [*s, -1, None, *list(s)[:2]], 5, 0) for i, s in sets.items()]
    rows += [rows[3], (None, [1, 2], 0, 0), (500, None, 0, 0), (501, [], 0, 0), (502, [None, -3], 0, 0), (503, [99], 0, 0), (503, [98], 0, 0), (504, [98, 99], 0, 0)]
    sets |= {503: {98, 99}, 504: {98, 99}}
    df = spark.createDataFrame(rows, "kernel_id bigint, blocks array<bigint>, class_id int, n int")
    classes, members = set_classes(clean_sets(df, "kernel_id", "blocks", "x >= 0"))
    got = [tuple(r) for r in similar_pairs(members, similar_classes(classes, num, den, shard)).collect()]
    want = {(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b])}
    assert len(got) == len(set(got)) and set(got) == want


@pytest.mark.parametrize("num,den,shard", [(7, 10, 20_000), (7, 10, 2), (1, 3, 2)])
def test_two_tables(spark, num, den, shard):
    """Pairs between two tables only; equal sets, sets of one item and equal ids on both sides."""
    rng = random.Random(5)
    left = {frozenset(rng.sample(range(12), rng.randrange(1, 7))) for _ in range(40)} | {frozenset([i]) for i in range(3)}
    right = {frozenset(rng.sample(range(12), rng.randrange(1, 7))) for _ in range(40)} | {frozenset([i]) for i in range(3)}
    sides = {"l": dict(enumerate(sorted(left, key=sorted))), "r": dict(enumerate(sorted(right, key=sorted)))}
    df = spark.createDataFrame([(i, t, sorted(x)) for t, xs in sides.items() for i, x in xs.items()], "class_id bigint, t string, items array<bigint>")
    got = [(r.a, r.b) for r in similar_classes(df, num, den, shard, side="t").collect()]
    want = {(a, b) for a, x in sides["l"].items() for b, y in sides["r"].items() if den * len(x & y) >= num * len(x | y)}
    assert len(got) == len(set(got)) and set(got) == want


def test_text_values_and_empty(spark):
    df = spark.createDataFrame([(1, ["a", "b", "c"]), (2, ["a", "b", "c", "d"]), (3, ["x"])], "i bigint, s array<string>")
    classes, members = set_classes(clean_sets(df, "i", "s"))
    assert [tuple(r) for r in similar_classes(classes, 7, 10).collect()] == [(1, 2, 3, 3, 4)]
    classes, members = set_classes(clean_sets(df.limit(0), "i", "s"))
    assert similar_pairs(members, similar_classes(classes, 7, 10)).count() == 0


def test_many_copies(spark):
    df = spark.createDataFrame([(i, [1, 2, 3]) for i in range(300)] + [(300, [1, 2, 3, 4])], "i bigint, s array<bigint>")
    classes, members = set_classes(clean_sets(df, "i", "s"))
    assert classes.count() == 2 and similar_classes(classes, 7, 10).count() == 1
    assert similar_pairs(members, similar_classes(classes, 7, 10)).count() == 300 * 299 // 2 + 300
