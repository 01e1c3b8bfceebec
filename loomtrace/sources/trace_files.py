"""Raw trace files: one zlib stream of ``key:value`` lines a run, read into rows and written.

Files are opened by address through ``pyarrow.fs`` (local, HDFS, S3, ...), by the task that
needs them, and read and written as streams, so their size is not bounded by memory.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .addresses import address, escaped, files, opened, unescaped

TRACE_SCHEMA = "trace_id string, seq bigint, k string, v string"
STATUS_SCHEMA = "trace_id string, lines bigint, damaged boolean, unfinished boolean"
#: Rows that a task holds before it passes them on, and bytes it reads at once.
BATCH, READ = 50_000, 1 << 20
LEVEL = 5


class Stream:
    """Complete lines of a zlib stream, and how it ended.

    ``damaged``: the stream broke off or holds bytes that don't inflate; the lines before
    the break are given. ``unfinished``: the last line has no line feed and is not given.
    """

    def __init__(self, chunks: Iterator[bytes]):
        self.chunks = chunks
        self.damaged = self.unfinished = False

    def _pieces(self) -> Iterator[bytes]:
        z = zlib.decompressobj()
        try:
            for c in self.chunks:
                while c and not z.eof:
                    yield z.decompress(c, 4 * READ)
                    c = z.unconsumed_tail
                if z.eof:
                    break
            yield z.flush()
        except zlib.error:
            pass
        self.damaged = not z.eof

    def __iter__(self) -> Iterator[tuple[str, str | None]]:
        """(key, value): the first two ``:`` fields, None without a second. Bytes that are not UTF-8 become replacement marks."""
        rest = b""
        for data in self._pieces():
            parts = (rest + data).split(b"\n")
            rest = parts.pop()
            for line in parts:
                f = line.decode("utf-8", "replace").split(":")
                yield f[0], f[1] if len(f) > 1 else None
        self.unfinished = bool(rest)


def parse_stream(chunks: Iterator[bytes]) -> Iterator[tuple[str, str | None]]:
    return iter(Stream(chunks))


def _chunks(at, path: str) -> Iterator[bytes]:
    with at.open_input_stream(path) as f:
        while data := f.read(READ):
            yield data


def read_traces(spark: SparkSession, path: str, suffix: str = ".trc") -> DataFrame:
    """``trace_id, seq, k, v`` of all trace files under ``path``; the file's name without ``suffix`` is the trace.

    A stream can't be split, so a file is one task's; ``seq`` is the line's number. Store
    the result as Parquet once. ``trace_status`` tells which files are damaged.
    """
    base = address(path)

    def run(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, _ = opened(base)
        for pdf in pdfs:
            for name, p in zip(pdf["name"], pdf["path"]):
                rows = []
                for n, (k, v) in enumerate(Stream(_chunks(at, p))):
                    rows.append((unescaped(name), n, k, v))
                    if len(rows) >= BATCH:
                        yield pd.DataFrame(rows, columns=["trace_id", "seq", "k", "v"])
                        rows = []
                if rows:
                    yield pd.DataFrame(rows, columns=["trace_id", "seq", "k", "v"])

    return files(spark, path, suffix).mapInPandas(run, TRACE_SCHEMA)


def trace_status(spark: SparkSession, path: str, suffix: str = ".trc") -> DataFrame:
    """``trace_id, lines, damaged, unfinished`` of all trace files under ``path``."""
    base = address(path)

    def run(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, _ = opened(base)
        for pdf in pdfs:
            rows = []
            for name, p in zip(pdf["name"], pdf["path"]):
                s = Stream(_chunks(at, p))
                rows.append((unescaped(name), sum(1 for _ in s), s.damaged, s.unfinished))
            yield pd.DataFrame(rows, columns=["trace_id", "lines", "damaged", "unfinished"])

    return files(spark, path, suffix).mapInPandas(run, STATUS_SCHEMA)


def write_traces(lines: DataFrame, path: str, level: int = LEVEL, suffix: str = ".trc") -> None:
    """One file per trace in the folder ``path``, which all executors share, lines in order of ``seq``.

    A null value leaves the key and ``:``. Lines of a trace stream through one task and
    are compressed as they come. Traces with a null id are refused.
    """
    if lines.where(F.col("trace_id").isNull()).limit(1).count():
        raise ValueError("a trace without an id has no file name")
    base = address(path)
    at, root = opened(base)
    at.create_dir(root, recursive=True)
    rows = lines.select("trace_id", "seq", "k", "v").repartition("trace_id").sortWithinPartitions("trace_id", "seq")

    def run(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, root = opened(base)
        name, out, z, n, part = None, None, None, 0, ""

        def close() -> None:
            out.write(z.flush())
            out.close()
            # a repeated attempt of the task writes a file of its own and replaces the other's
            to = f"{root}/{escaped(name)}{suffix}"
            if at.get_file_info(to).is_file:
                at.delete_file(to)
            at.move(part, to)

        for pdf in pdfs:
            for t, k, v in zip(pdf["trace_id"], pdf["k"], pdf["v"]):
                if t != name:
                    if out is not None:
                        close()
                    name, z, part = t, zlib.compressobj(level), f"{root}/.{uuid.uuid4().hex}"
                    out = at.open_output_stream(part)
                    n += 1
                if data := z.compress(f"{k}:{'' if v is None else v}\n".encode()):
                    out.write(data)
        if out is not None:
            close()
        yield pd.DataFrame({"files": [n]})

    rows.mapInPandas(run, "files bigint").agg(F.sum("files")).collect()


def read_counters(spark: SparkSession, path: str) -> DataFrame:
    """``event, value`` rows of counter files (CSV without a header)."""
    return spark.read.schema("event string, value bigint").csv(path)


def write_counters(df: DataFrame, path: str) -> None:
    df.select("event", "value").write.mode("overwrite").csv(path)
