"""Queries on kernels with similar block sets (problem 3)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import written
from ..sources.tables import table
from .setjoin import clean_sets, set_classes, similar_classes, similar_pairs

NUM, DEN = 7, 10


def _classes(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    sets, _ = written(clean_sets(table(spark, folder, "kernel_sets"), "kernel_id", "blocks", "x >= 0"))
    return set_classes(sets)


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    classes, members = _classes(spark, folder)
    pairs = similar_pairs(members, similar_classes(classes, NUM, DEN))
    return pairs.select(F.col("a").alias("kernel_a"), F.col("b").alias("kernel_b"))


def p3_links(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of classes of equal sets (named by the smallest kernel id) with overlap and sizes."""
    classes, _ = _classes(spark, folder)
    return similar_classes(classes, NUM, DEN).withColumnsRenamed({"a": "class_a", "b": "class_b"})


def p3_classes(spark: SparkSession, folder: str) -> DataFrame:
    """Every kernel with a non-empty set: its class and the number of classes linked to that."""
    classes, members = _classes(spark, folder)
    links = similar_classes(classes, NUM, DEN)
    n = links.select(F.explode(F.array("a", "b")).alias("class_id")).groupBy("class_id").agg(F.count("*").alias("links"))
    return members.join(n, "class_id", "left").select(F.col("rid").alias("kernel_id"), "class_id", F.coalesce("links", F.lit(0)).alias("links"))


_SETS = """WITH x AS (SELECT DISTINCT kernel_id AS id, b FROM (SELECT kernel_id, unnest(blocks) AS b FROM kernel_sets) WHERE b >= 0 AND kernel_id IS NOT NULL),
z AS (SELECT id, count(*) AS n FROM x GROUP BY id),
p AS (SELECT x.id AS a, y.id AS b, count(*) AS overlap FROM x JOIN x AS y ON x.b = y.b AND x.id < y.id GROUP BY 1, 2),
f AS (SELECT p.*, za.n AS size_a, zb.n AS size_b FROM p JOIN z AS za ON za.id = a JOIN z AS zb ON zb.id = b WHERE 10 * overlap >= 7 * (za.n + zb.n - overlap)),
s AS (SELECT id, list(b ORDER BY b) AS items FROM x GROUP BY id),
m AS (SELECT id, min(id) OVER (PARTITION BY items) AS class_id FROM s),
l AS (SELECT f.* FROM f JOIN m AS ma ON ma.id = a AND ma.class_id = a JOIN m AS mb ON mb.id = b AND mb.class_id = b)"""

QUERIES = {"p3_found": p3_found, "p3_links": p3_links, "p3_classes": p3_classes}
ORACLE = {
    "p3_found": f"{_SETS} SELECT a AS kernel_a, b AS kernel_b FROM f",
    "p3_links": f"{_SETS} SELECT a AS class_a, b AS class_b, CAST(overlap AS INTEGER) AS overlap, CAST(size_a AS INTEGER) AS size_a, CAST(size_b AS INTEGER) AS size_b FROM l",
    "p3_classes": f"""{_SETS}, e AS (SELECT a AS class_id FROM l UNION ALL SELECT b FROM l), n AS (SELECT class_id, count(*) AS links FROM e GROUP BY 1)
SELECT m.id AS kernel_id, m.class_id, coalesce(links, 0) AS links FROM m LEFT JOIN n ON n.class_id = m.class_id""",
}
