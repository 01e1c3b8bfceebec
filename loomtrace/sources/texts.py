"""Texts as one file each, in parts that need not fit into one row."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .addresses import address, escaped, files, opened, unescaped


def write_texts(parts: DataFrame, path: str, suffix: str = ".txt") -> None:
    """One file per ``name`` in the folder ``path``, which all executors share: its ``body`` texts in order of ``part``, one after the other.

    Parts of a file stream through one task. Null names are refused, null bodies are empty.
    """
    if parts.where(F.col("name").isNull()).limit(1).count():
        raise ValueError("a text without a name has no file")
    base = address(path)
    at, root = opened(base)
    at.create_dir(root, recursive=True)
    rows = parts.select("name", "part", "body").repartition("name").sortWithinPartitions("name", "part")

    def run(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, root = opened(base)
        name, out, temporary, n = None, None, "", 0

        def close() -> None:
            out.close()
            to = f"{root}/{escaped(name)}{suffix}"
            if at.get_file_info(to).is_file:
                at.delete_file(to)
            at.move(temporary, to)

        for pdf in pdfs:
            for t, body in zip(pdf["name"], pdf["body"]):
                if out is None or t != name:
                    if out is not None:
                        close()
                    # a repeated attempt of the task writes a file of its own and replaces the other's
                    name, temporary = t, f"{root}/.{uuid.uuid4().hex}"
                    out = at.open_output_stream(temporary)
                    n += 1
                if body:
                    out.write(body.encode())
        if out is not None:
            close()
        yield pd.DataFrame({"files": [n]})

    rows.mapInPandas(run, "files bigint").agg(F.sum("files")).collect()


def read_texts(spark: SparkSession, path: str, suffix: str = ".txt") -> DataFrame:
    """``name, body`` of the files of a folder, a row each. Bytes that are not UTF-8 become replacement marks."""
    base = address(path)

    def run(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, _ = opened(base)
        for pdf in pdfs:
            for name, p in zip(pdf["name"], pdf["path"]):
                with at.open_input_stream(p) as f:
                    yield pd.DataFrame({"name": [unescaped(name)], "body": [f.read().decode("utf-8", "replace")]})

    return files(spark, path, suffix).mapInPandas(run, "name string, body string")
