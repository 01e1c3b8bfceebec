"""Queries on blocks and cells that hold most lines (problem 6)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.values import PARSE_ID_SQL
from ..operators.ordered import readable_lines, writers
from ..operators.skew import aggregate, changes, heavy_keys
from ..sources.tables import table


def writer_changes(trace: DataFrame) -> DataFrame:
    """``trace_id, seq, addr, writer``: stores by another writer than that of the cell's previous store.

    A cell is an address of one trace. Hot cells are found on a sample of the store
    lines and worked on chunk by chunk, the others each in one shuffle partition.
    """
    cells = readable_lines(trace, ["StoreAddress"]).select("trace_id", F.col("value").alias("addr"))
    heavy = heavy_keys(cells, ["trace_id", "addr"])
    return changes(writers(trace), ["trace_id", "addr"], "seq", "chunk", "writer", heavy).drop("chunk")


def block_totals(trace: DataFrame) -> DataFrame:
    """Per block of readable ``BBEnter`` lines: lines, first and last line (by ``trace_id``, then ``seq``)."""
    lines = readable_lines(trace, ["BBEnter"]).groupBy("trace_id", "seq").agg(F.max("value").alias("block_id"))
    at = F.struct("trace_id", "seq")
    sample = readable_lines(trace, ["BBEnter"]).select(F.col("value").alias("block_id"))
    out = aggregate(
        lines,
        ["block_id"],
        {"entries": F.count("*"), "first": F.min(at), "last": F.max(at)},
        {"entries": F.sum("entries"), "first": F.min("first"), "last": F.max("last")},
        heavy_keys(sample, ["block_id"]),
        ["trace_id", "seq"],
    )
    return out.select(
        "block_id", "entries", F.col("first.trace_id").alias("first_trace"), F.col("first.seq").alias("first_seq"),
        F.col("last.trace_id").alias("last_trace"), F.col("last.seq").alias("last_seq"),
    )


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return writer_changes(table(spark, folder, "trace")).select("trace_id", "seq")


def p6_cells(spark: SparkSession, folder: str) -> DataFrame:
    return writer_changes(table(spark, folder, "trace"))


def p6_blocks(spark: SparkSession, folder: str) -> DataFrame:
    return block_totals(table(spark, folder, "trace"))


_LINES = f"""WITH lines AS (SELECT trace_id, seq, any_value(k) AS k, max({PARSE_ID_SQL}) AS x FROM trace
  WHERE k IN ('BBEnter', 'StoreAddress') AND seq IS NOT NULL AND ({PARSE_ID_SQL}) IS NOT NULL GROUP BY trace_id, seq)"""
_CHANGES = f"""{_LINES}, w AS (SELECT trace_id, seq, k, x AS addr,
  last_value(CASE WHEN k = 'BBEnter' THEN x END IGNORE NULLS) OVER (PARTITION BY trace_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS writer FROM lines),
c AS (SELECT *, lag(writer) OVER (PARTITION BY trace_id, addr ORDER BY seq) AS before FROM w WHERE k = 'StoreAddress' AND writer IS NOT NULL)
SELECT COLUMNS FROM c WHERE before <> writer"""

QUERIES = {"p6_found": p6_found, "p6_cells": p6_cells, "p6_blocks": p6_blocks}
ORACLE = {
    "p6_found": _CHANGES.replace("COLUMNS", "trace_id, seq"),
    "p6_cells": _CHANGES.replace("COLUMNS", "trace_id, seq, addr, writer"),
    "p6_blocks": f"""{_LINES} SELECT x AS block_id, count(*) AS entries, min(struct_pack(t := trace_id, s := seq)).t AS first_trace,
  min(struct_pack(t := trace_id, s := seq)).s AS first_seq, max(struct_pack(t := trace_id, s := seq)).t AS last_trace,
  max(struct_pack(t := trace_id, s := seq)).s AS last_seq FROM lines WHERE k = 'BBEnter' GROUP BY x""",
}
