import random
from collections import Counter

import pytest

from loomtrace.llm.topk import frequent


def rows_of(seed, n=1200):
    rng = random.Random(seed)
    return [(rng.choice(["a", "a", "b", None]), rng.choice([None, 5, 5, 6, -7, rng.randrange(300)]), 0, 0) for _ in range(n)]


def model(rows, k=None, share=None):
    by = {}
    for g, v, *_ in rows:
        if v is not None:
            by.setdefault(g, Counter())[v] += 1
    out = set()
    for g, c in by.items():
        best = sorted(c.items(), key=lambda x: (-x[1], x[0]))
        out |= {(g, v, n) for v, n in best[:k] if share is None or n >= share * sum(c.values())}
    return out


@pytest.mark.parametrize("k,share,groups", [(5, None, 64), (20, None, 64), (None, 0.01, 64), (None, 0.0001, 1 << 16), (3, 0.05, 64), (5000, None, 256)])
def test_frequent(spark, k, share, groups):
    rows = rows_of(groups)
    df = spark.createDataFrame(rows, "g string, v bigint, rows int, item int")
    got = [(r.g, r.item, r.rows) for r in frequent(df, "v", "g", k, share, groups).collect()]
    assert len(got) == len(set(got)) and set(got) == model(rows, k, share)


def test_edges(spark):
    df = spark.createDataFrame([("x",), ("x",), ("y",), (None,), ("z",)], "v string")
    assert {tuple(r) for r in frequent(df, "v", k=2).collect()} == {("x", 2), ("y", 1)}
    assert frequent(df.limit(0), "v", k=2).count() == 0 and frequent(df.limit(0), "v", share=0.1).count() == 0
    # a share that is met exactly counts
    ten = spark.createDataFrame([(i // 10,) for i in range(1000)], "v bigint")
    assert frequent(ten, "v", share=0.01).count() == 100
    with pytest.raises(ValueError):
        frequent(df, "v")
