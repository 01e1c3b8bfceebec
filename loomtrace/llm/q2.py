"""Queries on runs of block entries (problem 2)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.values import PARSE_ID_SQL
from ..operators.ordered import readable_lines
from ..sources.tables import table
from .runs import collapse_runs


def block_runs(trace: DataFrame) -> DataFrame:
    entries = readable_lines(trace, ["BBEnter"], "ts").withColumnRenamed("value", "block_id")
    return collapse_runs(entries, "trace_id", "seq", "block_id", "ts")


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    runs = block_runs(table(spark, folder, "trace")).where(F.col("entries") > 1)
    return runs.select("trace_id", F.col("first_pos").alias("first_seq"), F.col("last_pos").alias("last_seq"))


def p2_runs(spark: SparkSession, folder: str) -> DataFrame:
    """All runs, single entries too, with block, entries and duration in microseconds."""
    runs = block_runs(table(spark, folder, "trace"))
    return runs.select(
        "trace_id", "block_id", F.col("first_pos").alias("first_seq"), F.col("last_pos").alias("last_seq"), "entries",
        (F.unix_micros("last_ts") - F.unix_micros("first_ts")).alias("duration_us"),
    )


_RUNS = f"""WITH lines AS (SELECT trace_id, seq, min({PARSE_ID_SQL}) AS b, min(ts) AS t0, max(ts) AS t1 FROM trace
  WHERE k = 'BBEnter' AND seq IS NOT NULL AND ({PARSE_ID_SQL}) IS NOT NULL GROUP BY trace_id, seq),
f AS (SELECT *, CASE WHEN b = lag(b) OVER (PARTITION BY trace_id ORDER BY seq) THEN 0 ELSE 1 END AS starts FROM lines),
r AS (SELECT *, sum(starts) OVER (PARTITION BY trace_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS run FROM f)
SELECT COLUMNS FROM r GROUP BY trace_id, run"""

QUERIES = {"p2_found": p2_found, "p2_runs": p2_runs}
ORACLE = {
    "p2_found": _RUNS.replace("COLUMNS", "trace_id, min(seq) AS first_seq, max(seq) AS last_seq") + " HAVING count(*) > 1",
    "p2_runs": _RUNS.replace("COLUMNS", "trace_id, any_value(b) AS block_id, min(seq) AS first_seq, max(seq) AS last_seq, count(*) AS entries, date_diff('microsecond', min(t0), max(t1)) AS duration_us"),
}
