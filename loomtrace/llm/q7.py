"""Queries on documents in containers (problem 7)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import table
from .packing import pack
from .tokens import with_tokens


def _packed(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    # the capacities are parameters: a handful of rows
    sizes = [(r["pack"], r["capacity_tokens"]) for r in table(spark, folder, "pack_sizes").select("pack", "capacity_tokens").distinct().collect()]
    return pack(with_tokens(docs.select("doc_id", "text"), "text"), "doc_id", "n_tokens", sorted(sizes), total=docs.count())


def p7_packed(spark: SparkSession, folder: str) -> DataFrame:
    """Every document, or piece of one larger than the container, with its container of each kind."""
    return _packed(spark, folder).withColumnRenamed("item", "doc_id")


def p7_fill(spark: SparkSession, folder: str) -> DataFrame:
    """Per kind of container: containers, tokens, share of space filled, and the least number that could hold the tokens."""
    sizes = table(spark, folder, "pack_sizes").groupBy("pack").agg(F.min("capacity_tokens").alias("capacity_tokens"))
    per = _packed(spark, folder).groupBy("pack").agg(F.countDistinct("shard", "container").alias("containers"), F.count("*").alias("pieces"), F.sum("tokens").alias("tokens"))
    cap = F.col("capacity_tokens")
    return per.join(sizes, "pack").select(
        "pack", cap.cast("bigint").alias("capacity"), "containers", "pieces", "tokens",
        F.round(F.col("tokens") / (F.col("containers") * cap), 6).alias("filled"), F.ceil(F.col("tokens") / cap).alias("least_containers"),
    )


def p7_rules(spark: SparkSession, folder: str) -> DataFrame:
    """Per kind of container what must hold: documents in it, those not whole or in twice, containers above capacity, documents cut though they fit."""
    per = _packed(spark, folder)
    sizes = table(spark, folder, "pack_sizes").groupBy("pack").agg(F.min("capacity_tokens").alias("cap"))
    docs = per.groupBy("pack", "item").agg(F.count("*").alias("n"), F.countDistinct("part").alias("parts"), F.max("part").alias("last"), F.sum("tokens").alias("tokens"))
    docs = docs.join(sizes, "pack").groupBy("pack").agg(
        F.count("*").alias("documents"), F.count(F.when((F.col("n") != F.col("parts")) | (F.col("n") != F.col("last") + 1), 1)).alias("broken"),
        F.count(F.when((F.col("n") > 1) & (F.col("tokens") <= F.col("cap")), 1)).alias("needless"),
    )
    full = per.groupBy("pack", "shard", "container").agg(F.sum("tokens").alias("tokens")).join(sizes, "pack").groupBy("pack").agg(F.count(F.when(F.col("tokens") > F.col("cap"), 1)).alias("overfull"))
    return docs.join(full, "pack")


QUERIES = {"p7_packed": p7_packed, "p7_fill": p7_fill, "p7_rules": p7_rules}
ORACLE: dict[str, str] = {
    "p7_rules": "SELECT pack, (SELECT count(*) FROM documents) AS documents, CAST(0 AS BIGINT) AS broken, CAST(0 AS BIGINT) AS needless, CAST(0 AS BIGINT) AS overfull FROM pack_sizes GROUP BY pack",
}
