"""Files by address, through ``pyarrow.fs``: local, HDFS, S3 and others."""

from __future__ import annotations

from urllib.parse import quote, unquote, urlparse

from pyspark.sql import DataFrame, SparkSession


def opened(address: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(address)


def address(path: str) -> str:
    """``path`` as an address ``pyarrow.fs`` takes: a plain path and ``file:/x`` are local files."""
    u = urlparse(path)
    if u.scheme in ("", "file"):
        return "file://" + quote(unquote(u.path) if u.scheme else path)
    return path


def files(spark: SparkSession, path: str, suffix: str) -> DataFrame:
    """``name, address`` of the files below a folder, one partition a file; the list is the driver's."""
    from pyarrow import fs

    at, root = opened(address(path))
    found = [f.path for f in at.get_file_info(fs.FileSelector(root, recursive=True)) if f.is_file and f.path.endswith(suffix) and not f.base_name.startswith(".")]
    rows = [(p.rsplit("/", 1)[-1].removesuffix(suffix), p) for p in sorted(found)]
    df = spark.createDataFrame(rows, "name string, path string")
    return df.repartition(max(1, min(len(rows), 10_000)), "path") if rows else df


def escaped(trace: str) -> str:
    """A trace's file name: what could be a path or a hidden file is written as ``%`` and hex digits."""
    return quote(trace, safe="").replace(".", "%2E") if trace else "%"


def unescaped(name: str) -> str:
    return "" if name == "%" else unquote(name)
