"""Kernel detection from a trace to the last stage, in one call, and what is written of it."""

from __future__ import annotations

from dataclasses import dataclass
from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import blocks as B
from ..operators import graph as G
from ..session import written
from ..sources.kernel_files import STAGES, numbered_sets, to_kernel_files
from ..sources.tables import table


@dataclass(frozen=True)
class Options:
    """Share of an entry's neighbours that a first kernel takes, entries from which a block is hot, reach of the window, and whether kernels are labelled."""

    threshold: Fraction = Fraction(9, 10)
    hot: int = B.HOT
    radius: int = B.RADIUS
    labels: bool = True


def detect(trace: DataFrame, blocks: DataFrame, edges: DataFrame, options: Options = Options()) -> DataFrame:
    """``trace_id, stage, kernel_id, blocks, label``: the different kernels of each stage, numbered within trace and stage.

    Each stage works on the kernels of the stage before: greedy sets, twice grown along the
    trace, pruned, split at entrances and pruned again in the graph. Every stage is stored
    once. Traces without an id take no part; a kernel that comes out empty is dropped.
    """
    trace = trace.where(F.col("trace_id").isNotNull())
    found: DataFrame | None = None
    labels = B.block_labels(trace).select("trace_id", "block_id", F.explode("labels").alias("l")) if options.labels else None

    def keep(stage: str, sets: DataFrame) -> DataFrame:
        """Number and store the sets (``trace_id, blocks``) of a stage; their blocks under an id of their own."""
        nonlocal found
        n = numbered_sets(sets.select("trace_id", F.lit(stage).alias("stage"), "blocks", F.lit(None).cast("string").alias("label")))
        # the operators need ids that are numbers; once stored they stay the same
        n, _ = written(n.select("trace_id", "stage", "kid", "blocks", F.monotonically_increasing_id().alias("kernel_id")))
        found = n if found is None else found.unionByName(n)
        return n.select("kernel_id", "trace_id", F.explode("blocks").alias("block_id"))

    def again(stage: str, members: DataFrame, sets: DataFrame) -> DataFrame:
        return keep(stage, sets.join(members.select("kernel_id", "trace_id").distinct(), "kernel_id").select("trace_id", F.array_sort("blocks").alias("blocks")))

    one = keep(STAGES[0], B.type1_kernels(trace, options.hot, options.threshold, options.radius).select("trace_id", "blocks"))
    two = again(STAGES[1], one, B.grown_kernels(trace, one))
    more = again(STAGES[2], two, B.grown_kernels(trace, two))
    three = again(STAGES[3], more, G.pruned_kernels(more, blocks, edges))
    four = again(STAGES[4], three, G.split_kernels(three, blocks, edges))
    again(STAGES[5], four, G.pruned_kernels(four, blocks, edges))
    if labels is None:
        return found.select("trace_id", "stage", "kid", "blocks", F.lit("").alias("label"))
    long = found.select("trace_id", "stage", "kid", F.explode("blocks").alias("block_id")).join(labels, ["trace_id", "block_id"])
    named = long.groupBy("trace_id", "stage", "kid").agg(F.concat_ws(";", F.array_sort(F.collect_set("l"))).alias("label"))
    return found.drop("kernel_id").join(named, ["trace_id", "stage", "kid"], "left").withColumn("label", F.coalesce("label", F.lit("")))


def _detected(spark: SparkSession, folder: str) -> DataFrame:
    return detect(table(spark, folder, "trace"), table(spark, folder, "blocks"), table(spark, folder, "edges"), Options(hot=16))


def detected_kernels(spark: SparkSession, folder: str) -> DataFrame:
    """All stages of kernel detection on the traces themselves."""
    return _detected(spark, folder)


def detected_files(spark: SparkSession, folder: str) -> DataFrame:
    """The kernel file of each trace as detection writes it."""
    return to_kernel_files(_detected(spark, folder), B.block_counts(table(spark, folder, "trace")))


QUERIES = {f.__name__: f for f in (detected_kernels, detected_files)}
ORACLE: dict[str, str] = {}
