"""Streams over several micro-batches give what one pass in that order gives."""

import random
from collections import Counter

from compare import same

from loomtrace.plans import streams
from loomtrace.streaming import stateful as S


def test_batches(spark, tmp_path):
    rng = random.Random(8)
    events, files = [], 5
    for i in range(300):
        k = rng.choice(["BBEnter", "StoreAddress", "LoadAddress"])
        events.append((rng.choice(["a", "b"]), i, k, str(rng.randrange(4)), None, None))
    schema = S.TRACE
    for f in range(files):
        part = events[f * 60 : (f + 1) * 60]
        rows = part + part[::9]
        rng.shuffle(rows)
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    # one file a batch, in the order in which they were written
    src = lambda: S.stream_trace(spark, str(tmp_path / "in"), files_per_batch=1)
    at = lambda n: str(tmp_path / n)
    S.to_files(S.writers(src()), at("w"), at("w-state")).start().awaitTermination()
    stores = S.on_time(spark.read.schema(S.STORES).parquet(at("w")))
    block, want, entered = {}, set(), {}
    for t, s, k, v, *_ in events:
        if k == "BBEnter":
            block[t] = int(v)
            entered.setdefault(t, []).append(int(v))
        elif k == "StoreAddress" and t in block:
            want.add((t, s, int(v), block[t]))
    assert {tuple(r) for r in stores.collect()} == want
    second = S.on_time(spark.readStream.schema(S.STORES).parquet(at("w")))
    S.to_files(S.writer_changes(second), at("c"), at("c-state")).start().awaitTermination()
    cell, changed = {}, set()
    for t, s, a, w in sorted(want, key=lambda x: x[1]):
        if cell.get((t, a), w) != w:
            changed.add((t, s, a, w))
        cell[t, a] = w
    assert {tuple(r) for r in S.on_time(spark.read.schema(S.STORES).parquet(at("c"))).collect()} == changed
    S.to_latest(S.block_counts(src()), at("n"), at("n-state")).start().awaitTermination()
    assert {(r.trace_id, r.block_id): r.cnt for r in spark.read.parquet(at("n")).collect()} == {(t, b): n for t, e in entered.items() for b, n in Counter(e).items()}
    S.to_files(S.trailing_pairs(src()), at("p"), at("p-state")).start().awaitTermination()
    pairs = Counter((t, e[i], x) for t, e in entered.items() for i in range(5, len(e)) for x in e[max(0, i - 10) : i + 1])
    got = S.on_time(spark.read.schema("trace_id string, block_id bigint, nbr bigint, late boolean").parquet(at("p")))
    assert Counter(tuple(r) for r in got.collect()) == pairs


def small_batches(spark, f):
    """``f()`` where a key's lines of a micro-batch come in several Arrow batches, as those of large traces do."""
    conf = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(conf)
    spark.conf.set(conf, "7")
    try:
        return f()
    finally:
        spark.conf.set(conf, before)


def test_several_arrow_batches_of_a_key(spark, tmp_path):
    rng = random.Random(5)
    events = [("a", i, rng.choice(["BBEnter", "StoreAddress"]), str(rng.randrange(4)), None, None) for i in range(100)]
    for part in (events[:60], events):
        rng.shuffle(rows := list(part))
        spark.createDataFrame(rows, S.TRACE).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    at = lambda n: str(tmp_path / n)
    small_batches(spark, lambda: S.to_files(S.writers(S.stream_trace(spark, at("in"), files_per_batch=1)), at("w"), at("w-state")).start().awaitTermination())
    got, block, want = spark.read.schema(S.STORES).parquet(at("w")), None, []
    for _, s, k, v, *_ in events:
        if k == "BBEnter":
            block = int(v)
        elif block is not None:
            want.append((s, int(v), block))
    assert sorted((r.seq, r.addr, r.writer) for r in S.on_time(got).collect()) == want
    assert sorted((r.seq, r.addr) for r in S.late(got).select("seq", "addr").collect()) == [(s, int(v) if k == "StoreAddress" else None) for _, s, k, v, *_ in events[:60]]


def test_several_arrow_batches_of_a_cell(spark, tmp_path):
    rng = random.Random(6)
    stores = [("a", i, 3, rng.randrange(3), False) for i in range(60)]
    rng.shuffle(rows := list(stores))
    at = lambda n: str(tmp_path / n)
    spark.createDataFrame(rows, S.STORES).coalesce(1).write.parquet(at("in"))
    small_batches(spark, lambda: S.to_files(S.writer_changes(spark.readStream.schema(S.STORES).parquet(at("in"))), at("c"), at("c-state")).start().awaitTermination())
    got = S.on_time(spark.read.schema(S.STORES).parquet(at("c"))).collect()
    assert sorted(tuple(r) for r in got) == [y[:4] for x, y in zip(stores, stores[1:]) if x[3] != y[3]]


def test_many_cells_in_few_states(spark, tmp_path):
    rng, at = random.Random(7), lambda n: str(tmp_path / n)
    addrs = [-(1 << 63), (1 << 63) - 1, *range(500)]
    batches = [[(rng.choice(["a", "b", None]), rng.randrange(b * 400, b * 400 + 900), rng.choice(addrs), rng.randrange(3), False) for _ in range(4000)] for b in range(3)]
    cells, want = {}, Counter()
    for rows in batches:
        spark.createDataFrame(rows, S.STORES).coalesce(1).write.mode("append").parquet(at("in"))
        seen, held = {}, dict(cells)
        # of copies in a micro-batch the least writer counts
        for t, s, a, w, _ in sorted(rows, key=lambda r: (r[1], r[3])):
            if s in seen.setdefault((t, a), set()):
                continue
            seen[t, a].add(s)
            if (t, a) in held and s <= held[t, a][0]:
                want[t, s, a, w, True] += 1
                continue
            if cells.get((t, a), (s, w))[1] != w:
                want[t, s, a, w, False] += 1
            cells[t, a] = (s, w)
    stores = spark.readStream.schema(S.STORES).option("maxFilesPerTrigger", 1).parquet(at("in"))
    query = S.to_files(S.writer_changes(S.on_time(stores), buckets=8), at("c"), at("c-state")).start()
    query.awaitTermination()
    assert Counter(tuple(r) for r in spark.read.schema(S.STORES).parquet(at("c")).collect()) == want
    assert sum(1 for w in want if w[4]) > 100 and len(cells) > 1000
    # a group in Python for each cell would not end on large tables
    assert query.lastProgress.stateOperators[0].numRowsTotal == 8


def test_writer_changes_of_odd_lines(spark, tmp_path):
    rng, folder = random.Random(9), str(tmp_path / "t")
    # copies that differ, 64-bit values, unreadable ones, lines without seq, a trace without an id
    rows = [(rng.choice(["a", "b", None]), rng.choice([None, *range(400)]), None, rng.choice(["1", "0X2", "0x2", "-3", "0xFFFFFFFFFFFFFFFF", "9223372036854775807", "x", None]), None, None) for _ in range(3000)]
    rows = [(t, s, "BBEnter" if s is None or s % 3 else "StoreAddress", *more) for t, s, _, *more in rows]
    spark.createDataFrame(rows, S.TRACE).coalesce(2).write.parquet(f"{folder}/trace.parquet")
    assert same(streams.QUERIES["stream_writer_changes"](spark, folder), streams.ORACLE["stream_writer_changes"], folder) == ""
