"""Queries that run the stream operators over all data there is."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_folder
from ..sources.tables import table
from ..streaming import stateful as S
from . import dag, p6, traces


def _source(spark: SparkSession, folder: str) -> DataFrame:
    # as a pattern, since a stream's plain path must be a folder and a table may be one file; its files
    # are in no order of arrival, so they come as one batch
    return S.stream_trace(spark, f"{folder}/trace.parque[t]", files_per_batch=1 << 30)


def _place(spark: SparkSession) -> tuple[str, str]:
    at = shared_folder(spark, "stream")
    return f"{at}/data", f"{at}/state"


def stream_block_counts(spark: SparkSession, folder: str) -> DataFrame:
    path, state = _place(spark)
    S.to_latest(S.block_counts(_source(spark, folder)), path, state).start().awaitTermination()
    return spark.read.parquet(path)


_STORES = "trace_id string, seq bigint, addr bigint, writer bigint, late boolean"


def stream_writer_changes(spark: SparkSession, folder: str) -> DataFrame:
    """Two streams in a row: stores with their writers, then changes of a cell's writer."""
    first, state = _place(spark)
    S.to_files(S.writers(_source(spark, folder)), first, state).start().awaitTermination()
    stores = S.on_time(spark.readStream.schema(_STORES).parquet(first))
    path, state = _place(spark)
    S.to_files(S.writer_changes(stores), path, state).start().awaitTermination()
    return S.on_time(spark.read.schema(_STORES).parquet(path)).select("trace_id", "seq")


def stream_cooccurrence(spark: SparkSession, folder: str) -> DataFrame:
    path, state = _place(spark)
    S.to_files(S.trailing_pairs(_source(spark, folder)), path, state).start().awaitTermination()
    rows = S.on_time(spark.read.schema("trace_id string, block_id bigint, nbr bigint, late boolean").parquet(path))
    return rows.groupBy("trace_id", "block_id", "nbr").agg(F.count("*").alias("cnt"))


def stream_instances(spark: SparkSession, folder: str) -> DataFrame:
    path, state = _place(spark)
    S.to_files(S.instances(_source(spark, folder), dag.kernels(spark, folder)), path, state).start().awaitTermination()
    return S.on_time(spark.read.schema("trace_id string, uid bigint, kid string, first_seq bigint, late boolean").parquet(path))


def stream_late(spark: SparkSession, folder: str) -> DataFrame:
    """Stores and entries in three micro-batches, by the parity of ``seq`` and again: what is worked on and what comes too late, by trace.

    The second batch brings every second line after the first has brought the others, so
    that state passes between batches and most of its lines are late; the third repeats all.
    """
    at, state = _place(spark)
    rows = table(spark, folder, "trace").select(*[c.split()[0] for c in S.TRACE.split(", ")])
    for part in ("seq % 2 = 0", "seq % 2 = 1", "true"):
        rows.where(part).coalesce(1).write.mode("append").parquet(at)
    path, _ = _place(spark)
    S.to_files(S.writers(S.stream_trace(spark, at, files_per_batch=1)), path, state).start().awaitTermination()
    return spark.read.schema(_STORES).parquet(path).groupBy("trace_id").agg(F.count(F.when(F.col("late"), 1)).alias("late"), F.max("seq").alias("last"))


# the first batch works on all even lines; an odd one is late unless it follows the trace's last even one; of the third none is new
_LATE = f"""WITH {traces.L}, x AS (SELECT trace_id, seq, k, max(seq) FILTER (seq % 2 = 0) OVER (PARTITION BY trace_id) AS top FROM lines WHERE k IN ('BBEnter', 'StoreAddress') AND x IS NOT NULL),
w AS (SELECT *, count(*) FILTER (k = 'BBEnter' AND (seq % 2 = 0 OR seq > coalesce(top, -1))) OVER (PARTITION BY trace_id ORDER BY seq) AS entered FROM x),
g AS (SELECT trace_id, count(*) + count(*) FILTER (seq % 2 = 1 AND seq <= coalesce(top, -1)) AS late, max(seq) AS last FROM w GROUP BY 1) SELECT * FROM g"""

QUERIES = {f.__name__: f for f in (stream_block_counts, stream_writer_changes, stream_cooccurrence, stream_instances, stream_late)}
ORACLE = {"stream_block_counts": traces.ORACLE["block_counts"], "stream_writer_changes": p6.ORACLE["p6_found"], "stream_cooccurrence": traces.ORACLE["cooccurrence"], "stream_instances": dag.ORACLE["instances"],
          "stream_late": _LATE}
