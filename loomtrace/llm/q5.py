"""Queries on the most frequent blocks and addresses (problem 5)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.values import PARSE_ID_SQL
from ..operators.ordered import readable_lines
from ..session import discard, written
from ..sources.tables import table
from .topk import frequent

KEYS = ["BBEnter", "LoadAddress"]
SHARE = 0.01
TOP = 50


def _frequent(spark: SparkSession, folder: str, **wanted: float) -> DataFrame:
    """Of lines, copies once; their values are stored between the passes."""
    rows = readable_lines(table(spark, folder, "trace"), KEYS)
    lines, path = written(rows.groupBy("trace_id", "seq").agg(F.max("k").alias("k"), F.max("value").alias("value")).select("k", "value"))
    try:
        return frequent(lines, "value", "k", **wanted)
    finally:
        discard(spark, path)


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return _frequent(spark, folder, share=SHARE).select("k", "item")


def p5_top(spark: SparkSession, folder: str) -> DataFrame:
    """The 50 most frequent blocks and addresses with their numbers of lines."""
    return _frequent(spark, folder, k=TOP).withColumnRenamed("rows", "lines")


_LINES = f"""WITH lines AS (SELECT trace_id, seq, max(k) AS k, max({PARSE_ID_SQL}) AS item FROM trace
  WHERE k IN ('BBEnter', 'LoadAddress') AND seq IS NOT NULL AND ({PARSE_ID_SQL}) IS NOT NULL GROUP BY trace_id, seq),
c AS (SELECT k, item, count(*) AS n FROM lines GROUP BY k, item)"""

QUERIES = {"p5_found": p5_found, "p5_top": p5_top}
ORACLE = {
    "p5_found": f"{_LINES}, t AS (SELECT k, count(*) AS t FROM lines GROUP BY k) SELECT c.k, item FROM c JOIN t ON t.k = c.k WHERE 100 * n >= t",
    "p5_top": f"{_LINES}, r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY n DESC, item) AS i FROM c) SELECT k, item, n AS lines FROM r WHERE i <= {TOP}",
}
