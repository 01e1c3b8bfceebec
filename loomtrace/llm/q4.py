"""Queries on numbers of different addresses (problem 4)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.values import PARSE_ID_SQL
from ..operators.ordered import readable_lines, with_chunk
from ..sources.tables import table
from .kmv import K, Z, cube_sketches, merge_sketches, partial_sketches, with_estimate, with_set_operations

DIMS = ["day", "program", "opt_level", "machine"]


def trace_sketches(trace: DataFrame) -> DataFrame:
    """``trace_id, k, day, hashes``: partial sketches of the addresses of load and store lines.

    A line's day is that of its known time, which one of its copies may lack; lines
    without any have the day NULL.
    """
    lines = (
        with_chunk(readable_lines(trace, ["LoadAddress", "StoreAddress"], "ts"))
        .repartition("trace_id", "chunk")
        .groupBy("trace_id", "chunk", "seq")
        .agg(F.max("k").alias("k"), F.max("value").alias("value"), F.max("ts").alias("ts"))
        .select("trace_id", "k", F.to_date("ts").alias("day"), "value")
    )
    return partial_sketches(lines, ["trace_id", "k", "day"], "value")


def run_dims(runs: DataFrame) -> DataFrame:
    """One row per trace; of differing rows of a trace the greatest counts."""
    return runs.groupBy("trace_id").agg(F.max(F.struct("program", "opt_level", "machine")).alias("r")).select("trace_id", "r.*")


def cell_sketches(trace: DataFrame, runs: DataFrame) -> DataFrame:
    """One sketch per kind of line, day, program, optimisation level and machine; NULL where there is no run."""
    s, r = trace_sketches(trace).alias("s"), run_dims(runs).alias("r")
    cells = s.join(r, F.col("s.trace_id") == F.col("r.trace_id"), "left").select("k", *DIMS, "hashes")
    return merge_sketches(cells, ["k", *DIMS])


def p4_distinct(spark: SparkSession, folder: str) -> DataFrame:
    """Estimates with bounds for every combination of the dimensions.

    ``level``: bits day, program, opt_level, machine from 8 down to 1; a set bit means
    summed over.
    """
    cells = cell_sketches(table(spark, folder, "trace"), table(spark, folder, "runs"))
    return with_estimate(cube_sketches(cells, DIMS, ["k"]))


def p4_overlap(spark: SparkSession, folder: str) -> DataFrame:
    """Per program: addresses loaded or stored, both, only loaded, only stored."""
    s, r = trace_sketches(table(spark, folder, "trace")).alias("s"), run_dims(table(spark, folder, "runs")).alias("r")
    per = merge_sketches(s.join(r, F.col("s.trace_id") == F.col("r.trace_id"), "left").select("k", "program", "hashes"), ["k", "program"])
    side = lambda k: F.max(F.when(F.col("k") == k, F.col("hashes")))
    return with_set_operations(per.groupBy("program").agg(side("LoadAddress").alias("loaded"), side("StoreAddress").alias("stored")), "loaded", "stored")


_H = "CAST('0x' || substr(md5(CAST(x AS VARCHAR)), 1, 15) AS BIGINT)"
_BASE = f"""WITH lines AS (SELECT trace_id, seq, max(k) AS k, max({PARSE_ID_SQL}) AS x, max(ts) AS ts FROM trace
  WHERE k IN ('LoadAddress', 'StoreAddress') AND seq IS NOT NULL AND ({PARSE_ID_SQL}) IS NOT NULL GROUP BY trace_id, seq),
r AS (SELECT DISTINCT trace_id, program, opt_level, machine FROM runs),
b AS (SELECT DISTINCT l.k, CAST(l.ts AS DATE) AS day, program, opt_level, machine, {_H} AS h FROM lines AS l LEFT JOIN r ON r.trace_id = l.trace_id)"""
_T = f"CASE WHEN n >= {K} THEN CAST(top AS DOUBLE) / 1152921504606846976.0 ELSE 1.0 END"
_C = f"CASE WHEN n >= {K} THEN {K - 1} ELSE n END"


def _three(c: str, th: str) -> tuple[str, str, str]:
    half = f"{Z} * sqrt({c} * (1.0 - {th})) / {th}"
    return (
        f"CAST(floor({c} / {th} + 0.5) AS BIGINT)",
        f"CAST(greatest({c}, floor({c} / {th} - {half})) AS BIGINT)",
        f"CAST(ceil(CASE WHEN {c} = 0 AND {th} < 1 THEN 3.0 / {th} ELSE {c} / {th} + {half} END) AS BIGINT)",
    )


_E = _three("c", "t")
_OPS = ", ".join(
    f"{sql} AS {name}_{what}"
    for name, col in (("union", "cu"), ("both", "cb"), ("loaded_only", "cl"), ("stored_only", "cs"))
    for sql, what in zip(_three(col, "t"), ("estimate", "lower", "upper"))
)

QUERIES = {"p4_distinct": p4_distinct, "p4_overlap": p4_overlap}
ORACLE = {
    "p4_distinct": f"""{_BASE}, x AS (SELECT DISTINCT k, CASE WHEN l // 8 % 2 = 0 THEN day END AS day, CASE WHEN l // 4 % 2 = 0 THEN program END AS program,
  CASE WHEN l // 2 % 2 = 0 THEN opt_level END AS opt_level, CASE WHEN l % 2 = 0 THEN machine END AS machine, l AS level, h FROM b, range(16) AS g(l)),
o AS (SELECT *, row_number() OVER (PARTITION BY k, day, program, opt_level, machine, level ORDER BY h) AS i FROM x),
s AS (SELECT k, day, program, opt_level, machine, level, count(*) AS n, max(h) AS top FROM o WHERE i <= {K} GROUP BY ALL),
e AS (SELECT *, CAST({_C} AS DOUBLE) AS c, {_T} AS t FROM s)
SELECT k, day, program, opt_level, machine, CAST(level AS INTEGER) AS level, {_E[0]} AS estimate, {_E[1]} AS lower, {_E[2]} AS upper, n < {K} AS exact FROM e""",
    "p4_overlap": f"""{_BASE}, x AS (SELECT DISTINCT k, program, h FROM b),
o AS (SELECT *, row_number() OVER (PARTITION BY k, program ORDER BY h) AS i FROM x), s AS (SELECT * FROM o WHERE i <= {K}),
u AS (SELECT program, h, bool_or(k = 'LoadAddress') AS l, bool_or(k = 'StoreAddress') AS s FROM s GROUP BY program, h),
v AS (SELECT *, row_number() OVER (PARTITION BY program ORDER BY h) AS i FROM u),
tt AS (SELECT program, n, top FROM (SELECT program, k, count(*) AS n, max(h) AS top FROM s GROUP BY 1, 2
  UNION ALL SELECT program, '', count(*), max(h) FROM v WHERE i <= {K} GROUP BY 1)),
t AS (SELECT program, min({_T}) AS t FROM tt GROUP BY program),
c AS (SELECT v.program, any_value(t) AS t, CAST(count(*) AS DOUBLE) AS cu, CAST(count(*) FILTER (l AND s) AS DOUBLE) AS cb, CAST(count(*) FILTER (l AND NOT s) AS DOUBLE) AS cl,
  CAST(count(*) FILTER (s AND NOT l) AS DOUBLE) AS cs FROM v JOIN t ON t.program IS NOT DISTINCT FROM v.program WHERE CAST(h AS DOUBLE) / 1152921504606846976.0 < t GROUP BY v.program)
SELECT program, {_OPS} FROM c""",
}
