"""Queries on the quality of document texts (problem 9)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut
from ..sources.tables import table
from .quality import CLASSES, STATS, classify, fit, learn_common, not_prose, with_statistics


def _stats(spark: SparkSession, folder: str) -> tuple[DataFrame, frozenset[str]]:
    docs = table(spark, folder, "documents").select("doc_id", "text", F.lower(F.substring("lang", 1, 2)).alias("_lang"))
    common = learn_common(docs, "text", "_lang")
    return with_statistics(docs.drop("_lang"), "text", common), common


def _classified(spark: SparkSession, folder: str) -> DataFrame:
    stats, common = _stats(spark, folder)
    stats = cut(stats)
    g = fit(stats, common)
    if g is None:
        return spark.createDataFrame([], ", ".join(["doc_id bigint", *(f"{s} double" for s in STATS), *(f"p_{c} double" for c in CLASSES), "kind string"]))
    return classify(stats, g)


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    """Documents whose class is not prose."""
    return not_prose(_classified(spark, folder)).select("doc_id")


def p9_stats(spark: SparkSession, folder: str) -> DataFrame:
    """The statistics of every document."""
    return _stats(spark, folder)[0]


def p9_kinds(spark: SparkSession, folder: str) -> DataFrame:
    """Every document with the probabilities of the four kinds and the likeliest."""
    return _classified(spark, folder).drop(*STATS)


QUERIES = {"p9_found": p9_found, "p9_stats": p9_stats, "p9_kinds": p9_kinds}
ORACLE: dict[str, str] = {}
