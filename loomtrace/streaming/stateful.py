"""Single-pass analyses of traces as streams: counts, the writer of a store, changes of a cell's writer, trailing windows, kernel instances.

A stream is read once and in the order of arrival. Within a micro-batch lines are put in
the order of ``seq``; copies in it fall away. A line that arrives after a later one of
its key has been worked on, be it a late line or a late copy, comes out with ``late``
true and nothing derived, so that a sink can set it aside (``on_time``, ``late``); the
state is not changed by it. Batch operators give the exact answer for any order. A
trace's lines of one micro-batch are held by one task: ``files_per_batch`` bounds them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.values import parse_id
from ..operators.instances import follow

TRACE = "trace_id string, seq bigint, k string, v string, ts timestamp, recv_ts timestamp"


#: Files of a micro-batch.
FILES = 16


def stream_trace(spark: SparkSession, path: str, files_per_batch: int = FILES) -> DataFrame:
    """The trace's Parquet files, old and new ones, as a stream."""
    return spark.readStream.schema(TRACE).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def on_time(rows: DataFrame) -> DataFrame:
    return rows.where("not late").drop("late")


def late(rows: DataFrame) -> DataFrame:
    """The lines that came too late: those of their columns that the lines have themselves."""
    return rows.where("late").drop("late")


def _in_order(pdfs: Iterator[pd.DataFrame], last: int, by: list[str]) -> tuple[pd.DataFrame, pd.DataFrame]:
    """(new lines in order, once each; lines not after ``last``) of a key's part of a micro-batch."""
    # numbered anew: each Arrow batch has an index of its own from 0
    pdf = pd.concat(list(pdfs), ignore_index=True).sort_values(by).drop_duplicates("seq")
    return pdf[pdf["seq"] > last], pdf[pdf["seq"] <= last]


def _lines(stream: DataFrame, keys: list[str]) -> DataFrame:
    return stream.where(F.col("k").isin(keys)).select("trace_id", "seq", "k", parse_id("v").alias("value"), "recv_ts").where("value is not null and seq is not null")


def block_counts(stream: DataFrame, delay: str = "60 days") -> DataFrame:
    """Entries per trace and block so far; copies count once if received within ``delay`` of each other.

    The state holds the lines of the last ``delay``; a copy received later than that
    counts again, which the batch operator ``block_counts`` does not do.
    """
    rows = _lines(stream, ["BBEnter"]).withWatermark("recv_ts", delay).dropDuplicatesWithinWatermark(["trace_id", "seq"])
    return rows.groupBy("trace_id", F.col("value").alias("block_id")).agg(F.count("*").alias("cnt"))


STORES = "trace_id string, seq bigint, addr bigint, writer bigint, late boolean"


def _numbers(pdfs: Iterator[pd.DataFrame], *columns: str) -> tuple[pd.DataFrame, list[np.ndarray]]:
    """A key's part of a micro-batch, its rows numbered anew, and columns of it without nulls as arrays."""
    pdf = pd.concat(list(pdfs), ignore_index=True)
    return pdf, [pdf[c].to_numpy("int64") for c in columns]


def writers(stream: DataFrame) -> DataFrame:
    """``trace_id, seq, addr, writer, late``: each store with the last block entered before it. State: one block a trace.

    Late entries come out too, with neither address nor writer.
    """

    def step(key: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        block, last = state.get if state.exists else (None, -1)
        pdf, (seq, value) = _numbers(pdfs, "seq", "value")
        enters = pdf["enters"].to_numpy(bool)
        # by seq; of copies an entry first, then the greatest value
        at = np.lexsort((~value, ~enters, seq))
        at = at[np.append(True, np.diff(seq[at]) != 0)]
        cut = np.searchsorted(seq[at], last, "right")
        if cut:
            old = at[:cut]
            addr = pd.arrays.IntegerArray(value[old], enters[old])
            yield pd.DataFrame({"trace_id": key[0], "seq": seq[old], "addr": addr, "writer": pd.array([None] * cut, dtype="Int64"), "late": True})
        if cut < len(at):
            seq, value, enters = seq[at[cut:]], value[at[cut:]], enters[at[cut:]]
            entry = np.maximum.accumulate(np.where(enters, np.arange(len(seq)), -1))
            writer = np.where(entry < 0, 0 if block is None else block, value[entry])
            out = ~enters if block is not None else ~enters & (entry >= 0)
            state.update((int(writer[-1]) if block is not None or entry[-1] >= 0 else None, int(seq[-1])))
            yield pd.DataFrame({"trace_id": key[0], "seq": seq[out], "addr": value[out], "writer": writer[out], "late": False})

    rows = _lines(stream, ["BBEnter", "StoreAddress"]).select("trace_id", "seq", (F.col("k") == "BBEnter").alias("enters"), "value")
    return rows.groupBy("trace_id").applyInPandasWithState(step, STORES, "block bigint, last bigint", "append", GroupStateTimeout.NoTimeout)


#: Groups that the cells are parted into: a group costs Python as much as thousands of rows, and most cells have few.
BUCKETS = 1 << 10
_CELL = np.dtype([("trace", "i4"), ("addr", "i8"), ("writer", "i8"), ("last", "i8")])


def writer_changes(stores: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """Of a stream of ``writers`` rows those whose writer is not that of the cell's store before, and the late ones. State: one writer a cell.

    Cells are worked on by the bucket, a hash of trace and address, and held in one
    state per bucket: its traces, and 28 bytes a cell. A micro-batch writes the states of
    the buckets that it has stores of. ``buckets`` is fixed for a checkpoint. Rows without
    an address or a writer, as late ones of ``writers``, take no part.
    """

    def step(key: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        names, cells = state.get if state.exists else ([], b"")
        cells, known = np.frombuffer(cells, _CELL), len(names)
        pdf, (addr, seq, writer) = _numbers(pdfs, "addr", "seq", "writer")
        # numbers of traces, -1 for that without an id; those held keep theirs
        trace, names = pd.factorize(np.array([*names, *pdf["trace_id"]], dtype=object))
        rows = np.empty(len(cells) + len(pdf), _CELL)
        rows[: len(cells)] = cells
        for name, x in (("trace", trace[known:]), ("addr", addr), ("last", seq), ("writer", writer)):
            rows[name][len(cells) :] = x
        # what is held of a cell lies among its stores as the last one worked on; of copies the least writer counts
        new = np.arange(len(rows)) >= len(cells)
        at = np.lexsort((rows["writer"], new, rows["last"], rows["addr"], rows["trace"]))
        rows, new = rows[at], new[at]
        again = lambda x: np.append(False, (x["trace"][1:] == x["trace"][:-1]) & (x["addr"][1:] == x["addr"][:-1]))
        copy = again(rows) & new & np.append(False, (rows["last"][1:] == rows["last"][:-1]) & new[:-1])
        rows, new = rows[~copy], new[~copy]
        cell = np.cumsum(~again(rows)) - 1
        last = np.full(cell[-1] + 1, np.iinfo("int64").min)
        last[cell[~new]] = rows["last"][~new]
        late = new & (rows["last"] <= last[cell])
        done, new = rows[~late], new[~late]
        same = again(done)
        changed = done[new & same & np.append(False, done["writer"][1:] != done["writer"][:-1])]
        state.update((names.tolist(), done[np.append(~same[1:], True)].tobytes()))
        out, names = np.concatenate([rows[late], changed]), np.append(names, None)
        yield pd.DataFrame({"trace_id": names[out["trace"]], "seq": out["last"], "addr": out["addr"], "writer": out["writer"], "late": np.arange(len(out)) < late.sum()})

    rows = stores.where("seq is not null and addr is not null and writer is not null").select("trace_id", "seq", "addr", "writer", F.expr(f"pmod(xxhash64(trace_id, addr), {buckets})").alias("bucket"))
    return rows.groupBy("bucket").applyInPandasWithState(step, STORES, "traces array<string>, cells binary", "append", GroupStateTimeout.NoTimeout)


def trailing_pairs(stream: DataFrame, radius: int = 5) -> DataFrame:
    """``trace_id, block_id, nbr, late``, one row per pair: the newest block and each of the last ``2 radius + 1``, once more than ``radius`` were seen.

    State: those blocks. A late entry gives one row without ``nbr``.
    """
    reach = 2 * radius

    def step(key: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, n, last = state.get if state.exists else ([], 0, -1)
        pdf, old = _in_order(pdfs, last, ["seq"])
        if len(old):
            yield pd.DataFrame({"trace_id": key[0], "block_id": old["value"], "nbr": pd.array([None] * len(old), dtype="Int64"), "late": True})
        if not len(pdf):
            return
        held, a, b = list(held), [], []
        for x in pdf["value"].tolist():
            held = [*held[-reach:], x]
            n += 1
            if n > radius:
                a += [x] * len(held)
                b += held
        state.update((held[-reach:], n, int(pdf["seq"].iloc[-1])))
        yield pd.DataFrame({"trace_id": key[0], "block_id": a, "nbr": b, "late": False})

    rows = _lines(stream, ["BBEnter"]).select("trace_id", "seq", "value")
    return rows.groupBy("trace_id").applyInPandasWithState(step, "trace_id string, block_id bigint, nbr bigint, late boolean", "held array<bigint>, n bigint, last bigint", "append", GroupStateTimeout.NoTimeout)


def instances(stream: DataFrame, kernels: DataFrame) -> DataFrame:
    """``trace_id, uid, kid, first_seq, late``: activations of kernels, numbered from 0 in each trace. State: the current kernel and the number.

    ``kernels`` (``trace_id, kid, block_id``, static) may overlap. A late entry gives one
    row with its ``seq`` alone. Entries of traces without an id have no kernels.
    """
    kb = kernels.groupBy(F.col("trace_id").alias("_t"), F.col("block_id").alias("_b")).agg(F.array_sort(F.collect_set("kid")).alias("ks"))
    rows = _lines(stream, ["BBEnter"]).select("trace_id", "seq", "value")
    rows = rows.join(kb, (F.col("trace_id") == F.col("_t")) & (F.col("value") == F.col("_b")), "left").select("trace_id", "seq", F.coalesce("ks", F.array().cast("array<string>")).alias("ks"))

    def step(key: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        kid, uid, last = state.get if state.exists else (None, -1, -1)
        pdf, old = _in_order(pdfs, last, ["seq"])
        if len(old):
            none = [None] * len(old)
            yield pd.DataFrame({"trace_id": key[0], "uid": pd.array(none, dtype="Int64"), "kid": none, "first_seq": old["seq"], "late": True})
        if len(pdf):
            end, new, path = follow([list(x) for x in pdf["ks"]], kid)
            began = [(s, k) for s, (k, b) in zip(pdf["seq"].tolist(), path) if b]
            state.update((end, uid + new, int(pdf["seq"].iloc[-1])))
            yield pd.DataFrame({"trace_id": key[0], "uid": range(uid + 1, uid + 1 + new), "kid": [k for _, k in began], "first_seq": [s for s, _ in began], "late": False})

    return rows.groupBy("trace_id").applyInPandasWithState(step, "trace_id string, uid bigint, kid string, first_seq bigint, late boolean", "kid string, uid bigint, last bigint", "append", GroupStateTimeout.NoTimeout)


def to_files(stream: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    """A writer of an append-only stream into Parquet files, exactly once, for all data there is now."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True)


def to_latest(stream: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    """A writer of a stream of totals that keeps the latest state as a table."""
    return (
        stream.writeStream.outputMode("complete")
        .option("checkpointLocation", checkpoint)
        .foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(path))
        .trigger(availableNow=True)
    )
