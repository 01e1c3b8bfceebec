"""Queries on mixtures of sources (problem 8)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import table
from .mixing import BLOCK, mix, normal_source, shares
from .tokens import with_tokens


def _targets(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "mix_targets").select(normal_source("source").alias("source"), "target_share", "max_repeats")


def _mixed(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", normal_source("source").alias("source"), "text")
    # the targets are parameters: a handful of rows
    targets = [tuple(r) for r in _targets(spark, folder).collect()]
    listed = docs.where(F.col("source").isin([t[0] for t in targets if t[0] is not None]))
    return mix(with_tokens(listed, "text"), "doc_id", "source", "n_tokens", targets)


def p8_mix(spark: SparkSession, folder: str) -> DataFrame:
    """The documents used, with source, tokens and number of uses."""
    return _mixed(spark, folder).where(F.col("uses") > 0).withColumnRenamed("size", "n_tokens")


def p8_shares(spark: SparkSession, folder: str) -> DataFrame:
    return shares(_mixed(spark, folder), _targets(spark, folder))


#: Shares are kept to this, or to a block where all that is used is less than a hundred blocks.
SHARE_ERROR = 0.005


def p8_rules(spark: SparkSession, folder: str) -> DataFrame:
    """Per listed source what must hold: its documents, none used too often, and its share of what sources with text can give reached."""
    mixed, targets = _mixed(spark, folder), _targets(spark, folder)
    docs = mixed.groupBy("source").agg(F.count("*").alias("documents"))
    rep = shares(mixed, targets)
    total = rep.agg(F.sum("used")).scalar()
    error = F.when(total >= 100 * BLOCK, F.lit(SHARE_ERROR)).otherwise(BLOCK / total)
    due = F.col("target_share") / rep.where("size > 0").agg(F.sum("target_share")).scalar()
    return rep.join(docs, "source", "left").select(
        "source", F.coalesce("documents", F.lit(0)).alias("documents"), (F.col("most_uses") <= F.col("max_repeats")).alias("within"),
        F.when(F.col("size") > 0, F.abs(F.col("share") - due) <= error).otherwise(F.col("used") == 0).alias("reached"),
    )


QUERIES = {"p8_mix": p8_mix, "p8_shares": p8_shares, "p8_rules": p8_rules}
_NAME = "lower(trim(source, ' ' || chr(9) || chr(10) || chr(13)))"
ORACLE: dict[str, str] = {
    "p8_rules": f"""WITH t AS (SELECT DISTINCT {_NAME} AS source FROM mix_targets), d AS (SELECT {_NAME} AS source FROM documents)
SELECT t.source, count(d.source) AS documents, true AS within, true AS reached FROM t LEFT JOIN d ON d.source = t.source GROUP BY 1""",
}
