"""A callback of one's own on every event of a trace, in order."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from ..functions.arrow import plain
from .ordered import lines

Visitor = Callable[[int, str | None, str | None], Iterable[tuple] | None]


def visit(trace: DataFrame, make: Callable[[str | None], tuple[Visitor, Callable[[], Iterable[tuple]]]], schema: str, keys: list[str] | None = None) -> DataFrame:
    """Rows ``trace_id`` and ``schema`` that visitors give for the lines of each trace, in order of ``seq``.

    ``make(trace_id)`` gives a new visitor, called with ``seq, k, v`` of each line, and a
    function called after the last; both give rows (or None). The state of a visitor is
    Python's own, so a trace streams through one task, whatever its length; the operators
    of ``ordered`` are the way where a trace holds a large part of all rows. A null
    ``trace_id`` is a trace. Only lines with ``keys``, if given, are visited.
    """
    names = [f.strip().split()[0].strip("`") for f in schema.split(",")]
    rows = lines(trace, keys).select("trace_id", "seq", "k", "v").repartition("trace_id").sortWithinPartitions("trace_id", "seq")
    spark = trace.sparkSession
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(spark.createDataFrame([], f"trace_id string, {schema}").schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current: object = run
        step = end = None
        out: list[tuple] = []

        def flush() -> pa.RecordBatch:
            got = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), arrow)], names=["trace_id", *names])
            out.clear()
            return got

        for b in batches:
            for t, seq, k, v in zip(*(plain(c) for c in b.columns)):
                if t != current:
                    if end is not None:
                        out += [(current, *x) for x in end() or ()]
                    current, (step, end) = t, make(t)
                out += [(t, *x) for x in step(seq, k, v) or ()]
                if len(out) >= 50_000:
                    yield flush()
        if end is not None:
            out += [(current, *x) for x in end() or ()]
        if out:
            yield flush()

    return rows.mapInArrow(run, f"trace_id string, {schema}")
