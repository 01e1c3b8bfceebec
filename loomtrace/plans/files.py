"""Queries that go through file formats: raw traces, counter files, kernel JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.blocks import block_counts
from ..operators.ordered import lines
from ..session import shared_folder
from ..sources.kernel_files import kernel_rows, to_kernel_files
from ..sources.tables import table
from ..sources.texts import read_texts, write_texts
from ..sources.trace_files import read_counters, read_traces, trace_status, write_counters, write_traces
from .traces import L


def _written(spark: SparkSession, folder: str) -> str:
    path = shared_folder(spark, "traces")
    write_traces(lines(table(spark, folder, "trace")), path)
    return path


def trace_scan(spark: SparkSession, folder: str) -> DataFrame:
    """The trace's lines written as raw files and read again."""
    return read_traces(spark, _written(spark, folder))


def trace_files(spark: SparkSession, folder: str) -> DataFrame:
    """The raw files with their numbers of lines, and whether they are whole."""
    return trace_status(spark, _written(spark, folder))


def papi_counters(spark: SparkSession, folder: str) -> DataFrame:
    """Numbers of lines by key as a counter file, read again and added up by event."""
    path = shared_folder(spark, "counters")
    write_counters(table(spark, folder, "trace").groupBy(F.col("k").alias("event")).agg(F.count("*").alias("value")), path)
    return read_counters(spark, path).groupBy("event").agg(F.sum("value").alias("value"))


def kernels_read(spark: SparkSession, folder: str) -> DataFrame:
    """Outermost kernels of the files with their sorted blocks, by file."""
    rows = kernel_rows(table(spark, folder, "kernel").select("file_id", "body"), ["file_id"])
    one = rows.where("child = 'block' and depth = 1").select("file_id", "kid", F.col("item").try_cast("bigint").alias("b")).where("b is not null")
    return one.groupBy("file_id", "kid").agg(F.array_sort(F.collect_set("b")).alias("blocks"))


def _all_kernels(spark: SparkSession, folder: str) -> DataFrame:
    """The catalogue's kernels as sorted sets with trace, stage and label."""
    k = table(spark, folder, "kernel_sets").where("trace_id is not null")
    one = k.select("kernel_id", "trace_id", "stage", F.array_sort(F.array_distinct(F.filter("blocks", lambda x: x >= 0))).alias("blocks"), "label")
    return one.groupBy("kernel_id", "trace_id", "stage", "blocks").agg(F.max("label").alias("label"))


def kernel_files(spark: SparkSession, folder: str) -> DataFrame:
    """The kernel file of each trace with all its members, as JSON text."""
    return to_kernel_files(_all_kernels(spark, folder), block_counts(table(spark, folder, "trace")))


def kernel_json(spark: SparkSession, folder: str) -> DataFrame:
    """The traces' kernel files, one file each, written, read again and taken apart into blocks of the last stage."""
    path = shared_folder(spark, "kernels")
    write_texts(kernel_files(spark, folder).select(F.col("trace_id").alias("name"), F.lit(0).alias("part"), "body"), path, ".json")
    rows = kernel_rows(read_texts(spark, path, ".json"), ["name"])
    return rows.where("child = 'block'").select(F.col("name").alias("trace_id"), F.col("kid").cast("bigint").alias("kid"), F.col("item").cast("bigint").alias("block_id"))


_SETS = f"""WITH {L}, k AS (SELECT kernel_id, trace_id, stage, list_sort(list_distinct(list_filter(blocks, lambda x: x >= 0))) AS blocks, label FROM kernel_sets WHERE trace_id IS NOT NULL),
s AS (SELECT trace_id, stage, blocks, max(label) AS label FROM k WHERE len(blocks) > 0 GROUP BY 1, 2, 3),
n AS (SELECT *, row_number() OVER (PARTITION BY trace_id, stage ORDER BY blocks) - 1 AS kid, '[' || array_to_string(blocks, ',') || ']' AS list FROM s)"""

QUERIES = {f.__name__: f for f in (trace_scan, trace_files, papi_counters, kernels_read, kernel_files, kernel_json)}
ORACLE = {
    "trace_scan": """WITH l AS (SELECT trace_id, seq, max(k) AS k, max(v) AS v FROM trace GROUP BY 1, 2)
SELECT trace_id, row_number() OVER (PARTITION BY trace_id ORDER BY seq) - 1 AS seq, k, split_part(coalesce(v, ''), ':', 1) AS v FROM l""",
    "trace_files": "SELECT trace_id, count(DISTINCT seq) AS lines, false AS damaged, false AS unfinished FROM trace WHERE seq IS NOT NULL GROUP BY 1",
    "papi_counters": "SELECT k AS event, CAST(count(*) AS BIGINT) AS value FROM trace GROUP BY 1",
    "kernel_files": f"""{_SETS},
m AS (SELECT trace_id, CASE stage WHEN 'TypeOne' THEN 1 WHEN 'TypeTwo' THEN 2 WHEN 'TypeTwoFive' THEN 3 WHEN 'TypeThree' THEN 4 WHEN 'TypeFour' THEN 5 ELSE 6 END AS o, stage,
  string_agg('"' || kid || '":' || list, ',' ORDER BY CAST(kid AS VARCHAR)) AS body, string_agg('"' || kid || '":{{"Blocks":' || list || CASE WHEN label <> '' THEN ',"Label":' || CAST(to_json(label) AS VARCHAR) ELSE '' END || '}}', ',' ORDER BY CAST(kid AS VARCHAR)) AS final FROM n GROUP BY 1, 2, 3),
st AS (SELECT trace_id, stage, o FROM (SELECT trace_id FROM m UNION SELECT trace_id FROM counts WHERE trace_id IS NOT NULL) CROSS JOIN (VALUES (1, 'TypeOne'), (2, 'TypeTwo'), (3, 'TypeTwoFive'), (4, 'TypeThree'), (5, 'TypeFour'), (6, 'TypeThreeFive')) AS v(o, stage)),
sm AS (SELECT st.trace_id, string_agg('"' || st.stage || '":{{' || coalesce(body, '') || '}}', ',' ORDER BY st.o) AS stages, max(final) FILTER (st.o = 6) AS final FROM st LEFT JOIN m ON m.trace_id = st.trace_id AND m.stage = st.stage GROUP BY 1),
c AS (SELECT trace_id, string_agg(CAST(block_id AS VARCHAR), ',' ORDER BY block_id) AS valid, string_agg('"' || block_id || '":' || cnt, ',' ORDER BY CAST(block_id AS VARCHAR)) AS counts FROM counts GROUP BY 1)
SELECT sm.trace_id, '{{"Kernels":{{' || coalesce(final, '') || '}},"ValidBlocks":[' || coalesce(valid, '') || '],"BlockCounts":{{' || coalesce(c.counts, '') || '}},' || stages || '}}' AS body FROM sm LEFT JOIN c ON c.trace_id = sm.trace_id""",
    "kernel_json": f"{_SETS} SELECT trace_id, kid, unnest(blocks) AS block_id FROM n WHERE stage = 'TypeThreeFive'",
}
