"""Queries on kernel instances and their dependencies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import instances as I
from ..session import shared_folder
from ..sources.tables import table
from ..sources.texts import read_texts, write_texts
from .traces import KB, L, kernel_blocks

STAGE = "TypeTwo"


def kernels(spark: SparkSession, folder: str) -> DataFrame:
    """Kernels of a stage under a text key that sorts as their ``kid`` does and is unique."""
    kb = kernel_blocks(spark, folder, STAGE).where(F.col("trace_id").isNotNull())
    return kb.select("trace_id", F.concat_ws("/", "kid", F.col("kernel_id").cast("string")).alias("kid"), "block_id")


def _t(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "trace")


def instances(spark: SparkSession, folder: str) -> DataFrame:
    return I.instances(_t(spark, folder), kernels(spark, folder))


def instance_seq(spark: SparkSession, folder: str) -> DataFrame:
    """Edges from each instance to the next of its trace; instances are numbered without gaps."""
    return instances(spark, folder).where("uid > 0").select("trace_id", (F.col("uid") - 1).alias("src"), F.col("uid").alias("dst"))


def consumer_edges(spark: SparkSession, folder: str) -> DataFrame:
    return I.consumer_edges(_t(spark, folder), kernels(spark, folder))


def consumer_edges_compat(spark: SparkSession, folder: str) -> DataFrame:
    return I.consumer_edges(_t(spark, folder), kernels(spark, folder), compat=True)


def read_sets(spark: SparkSession, folder: str) -> DataFrame:
    return I.read_sets(_t(spark, folder), kernel_blocks(spark, folder, STAGE))


#: Instances whose entries make one part of a DAG's text.
PART = 4096


def dag_json(spark: SparkSession, folder: str) -> DataFrame:
    """Per trace the JSON text of kernels by instance and producers by consumer, as lists of pairs, in parts to be put together in order of ``section, part``."""
    t, k = _t(spark, folder), kernels(spark, folder)
    return I.dag_texts(I.instances(t, k), I.consumer_edges(t, k), PART)


def dag_files(spark: SparkSession, folder: str) -> DataFrame:
    """``dag_json`` written as one file per trace and read again: numbers of instances and of consumers."""
    path = shared_folder(spark, "dag")
    write_texts(dag_json(spark, folder).select(F.col("trace_id").alias("name"), F.struct("section", "part").alias("part"), "body"), path, ".json")
    j = F.from_json("body", "KernelInstanceMap array<array<string>>, ConsumerMap array<array<string>>")
    got = read_texts(spark, path, ".json").select(F.col("name").alias("trace_id"), j.alias("j"))
    return got.select("trace_id", F.size("j.KernelInstanceMap").alias("instances"), F.size("j.ConsumerMap").alias("consumers"))


def instance_graph(spark: SparkSession, folder: str) -> DataFrame:
    """Per trace the lines of a GraphViz text of its instances: nodes, solid edges to the next instance, dashed ones from producer to consumer."""
    t, k = _t(spark, folder), kernels(spark, folder)
    return I.instance_lines(I.instances(t, k), I.consumer_edges(t, k))


QUERIES = {f.__name__: f for f in (instances, instance_seq, consumer_edges, consumer_edges_compat, read_sets, dag_json, dag_files, instance_graph)}

_EDGES = f"""WITH RECURSIVE {L}, {KB}, kk AS (SELECT trace_id, kid || '/' || kernel_id AS kid, block_id FROM kb WHERE stage = '{STAGE}' AND trace_id IS NOT NULL),
ks AS (SELECT trace_id, block_id, list_sort(list(DISTINCT kid)) AS ks FROM kk GROUP BY 1, 2),
n AS MATERIALIZED (SELECT e.trace_id, e.seq, coalesce(ks.ks, CAST([] AS VARCHAR[])) AS ks, row_number() OVER (PARTITION BY e.trace_id ORDER BY e.seq) AS n FROM enter AS e LEFT JOIN ks ON ks.trace_id = e.trace_id AND ks.block_id = e.block_id),
r(trace_id, seq, n, kid, uid, began) AS (SELECT trace_id, seq, n, ks[1], CASE WHEN len(ks) > 0 THEN 0 ELSE -1 END, len(ks) > 0 FROM n WHERE n = 1
  UNION ALL SELECT n.trace_id, n.seq, n.n, CASE WHEN r.kid IS NOT NULL AND list_contains(n.ks, r.kid) THEN r.kid ELSE n.ks[1] END,
  r.uid + CASE WHEN (r.kid IS NULL OR NOT list_contains(n.ks, r.kid)) AND len(n.ks) > 0 THEN 1 ELSE 0 END, (r.kid IS NULL OR NOT list_contains(n.ks, r.kid)) AND len(n.ks) > 0
  FROM r JOIN n ON n.trace_id = r.trace_id AND n.n = r.n + 1),
a AS (SELECT trace_id, seq, x AS addr, k = 'StoreAddress' AS store FROM lines WHERE k IN ('LoadAddress', 'StoreAddress') AND x IS NOT NULL),
u AS (SELECT trace_id, seq, addr, store, CAST(NULL AS INTEGER) AS uid FROM a UNION ALL SELECT trace_id, seq, NULL, NULL, uid FROM r),
w AS (SELECT trace_id, seq, addr, store, coalesce(last_value(uid IGNORE NULLS) OVER (PARTITION BY trace_id ORDER BY seq ROWS UNBOUNDED PRECEDING), -1) AS uid FROM u),
p AS (SELECT *, last_value(CASE WHEN store THEN uid END IGNORE NULLS) OVER (PARTITION BY trace_id, addr ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prod FROM w WHERE addr IS NOT NULL)"""

_DAG = f"""{_EDGES}, u0 AS (SELECT trace_id, CAST(uid AS BIGINT) AS uid, kid FROM r WHERE began), ce AS (SELECT DISTINCT trace_id, CAST(uid AS BIGINT) AS c, CAST(prod AS BIGINT) AS q FROM p WHERE NOT store AND uid >= 0 AND prod >= 0 AND prod <> uid)"""

ORACLE = {
    "dag_json": f"""{_DAG}, pc AS (SELECT trace_id, c, '[' || c || ',[' || string_agg(CAST(q AS VARCHAR), ',' ORDER BY q) || ']]' AS x FROM ce GROUP BY 1, 2),
g AS (SELECT trace_id, 1 AS section, uid // {PART} AS part, string_agg('[' || uid || ',"' || kid || '"]', ',' ORDER BY uid) AS body FROM u0 GROUP BY 1, 2, 3
  UNION ALL SELECT trace_id, 3, c // {PART}, string_agg(x, ',' ORDER BY c) FROM pc GROUP BY 1, 2, 3)
SELECT trace_id, section, CAST(part AS BIGINT) AS part, CASE WHEN part > min(part) OVER (PARTITION BY trace_id, section) THEN ',' ELSE '' END || body AS body FROM g
UNION ALL SELECT trace_id, s, 0, b FROM (SELECT DISTINCT trace_id FROM u0) CROSS JOIN (VALUES (0, '{{"KernelInstanceMap":['), (2, '],"ConsumerMap":['), (4, ']}}')) AS v(s, b)""",
    "dag_files": f"""{_DAG} SELECT trace_id, CAST(count(*) AS INTEGER) AS instances, CAST((SELECT count(DISTINCT c) FROM ce WHERE ce.trace_id = u0.trace_id) AS INTEGER) AS consumers FROM u0 GROUP BY 1""",
    "instance_graph": f"""{_DAG} SELECT trace_id, section, a, b, line FROM (
SELECT DISTINCT trace_id, 0 AS section, CAST(NULL AS BIGINT) AS a, CAST(NULL AS BIGINT) AS b, 'digraph {{' AS line FROM u0 UNION ALL SELECT DISTINCT trace_id, 4, NULL, NULL, '}}' FROM u0
UNION ALL SELECT trace_id, 1, uid, NULL, '"' || uid || '" [label="' || kid || '"];' FROM u0 UNION ALL SELECT trace_id, 2, uid - 1, uid, '"' || (uid - 1) || '" -> "' || uid || '" [style=solid];' FROM u0 WHERE uid > 0
UNION ALL SELECT trace_id, 3, q, c, '"' || q || '" -> "' || c || '" [style=dashed];' FROM ce)""",
    "instances": f"{_EDGES} SELECT trace_id, CAST(uid AS BIGINT) AS uid, kid, seq AS first_seq FROM r WHERE began",
    "instance_seq": f"{_EDGES} SELECT trace_id, CAST(uid - 1 AS BIGINT) AS src, CAST(uid AS BIGINT) AS dst FROM r WHERE began AND uid > 0",
    "consumer_edges": f"{_EDGES} SELECT DISTINCT trace_id, CAST(uid AS BIGINT) AS consumer, CAST(prod AS BIGINT) AS producer FROM p WHERE NOT store AND uid >= 0 AND prod >= 0 AND prod <> uid",
    "consumer_edges_compat": f"{_EDGES} SELECT DISTINCT trace_id, CAST(uid AS BIGINT) AS consumer, CAST(coalesce(prod, 0) AS BIGINT) AS producer FROM p WHERE NOT store AND coalesce(prod, 0) >= 0 AND coalesce(prod, 0) <> uid",
    "read_sets": f"""WITH {L}, {KB}, kt AS (SELECT DISTINCT kernel_id, trace_id, block_id FROM kb WHERE stage = '{STAGE}' AND trace_id IS NOT NULL), z AS (SELECT kernel_id, count(*) AS n FROM kt GROUP BY 1),
small AS (SELECT trace_id, block_id, arg_min(kt.kernel_id, row(n, kt.kernel_id)) AS kernel_id FROM kt JOIN z ON z.kernel_id = kt.kernel_id GROUP BY 1, 2),
n AS (SELECT *, row_number() OVER (PARTITION BY trace_id ORDER BY seq) AS n FROM enter),
m AS (SELECT n.trace_id, n.seq, n.n, n.block_id, kt.kernel_id FROM n JOIN kt ON kt.trace_id = n.trace_id AND kt.block_id = n.block_id),
f AS (SELECT *, CASE WHEN n - lag(n) OVER (PARTITION BY kernel_id ORDER BY n) = 1 THEN NULL ELSE seq END AS b FROM m),
g AS (SELECT *, last_value(b IGNORE NULLS) OVER (PARTITION BY kernel_id ORDER BY n ROWS UNBOUNDED PRECEDING) AS start FROM f),
c AS (SELECT n.trace_id, n.seq, g.kernel_id, g.start FROM n LEFT JOIN (SELECT g.* FROM g JOIN small AS s ON s.trace_id = g.trace_id AND s.block_id = g.block_id AND s.kernel_id = g.kernel_id) AS g ON g.trace_id = n.trace_id AND g.seq = n.seq),
u AS (SELECT trace_id, seq, x AS addr, k = 'StoreAddress' AS store, NULL AS ctx FROM lines WHERE k IN ('LoadAddress', 'StoreAddress') AND x IS NOT NULL
  UNION ALL SELECT trace_id, seq, NULL, NULL, struct_pack(k := kernel_id, s := start) FROM c),
w AS (SELECT trace_id, seq, addr, store, last_value(ctx IGNORE NULLS) OVER (PARTITION BY trace_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS ctx FROM u),
p AS (SELECT *, last_value(CASE WHEN store THEN ctx END IGNORE NULLS) OVER (PARTITION BY trace_id, addr ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prod FROM w WHERE addr IS NOT NULL)
SELECT DISTINCT trace_id, ctx.k AS kernel_id, ctx.s AS start, prod.k AS from_kernel, prod.s AS from_start FROM p WHERE NOT store AND ctx.k IS NOT NULL AND prod.k IS NOT NULL""",
}
