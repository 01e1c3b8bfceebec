"""Runs of repeated consecutive events (problem 2).

Each event is compared with its predecessor by a lag window, changes are flagged, the
flags are summed up into run numbers and the runs aggregated. The window covers one
chunk of a sequence, so a sequence with a third of all rows is spread over many tasks.
The runs at the edges of chunks, at most two a chunk, then go through the same steps
once more, over the whole sequence; runs inside a chunk are final.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.ordered import CHUNK

#: Columns of a run besides its sequence and its event.
RUN = ("first_pos", "last_pos", "entries", "first_ts", "last_ts")


def _number(df: DataFrame, group: list[str], order: list[str], first: str, last: str, cut: Column, within: float | None) -> DataFrame:
    """``df`` with ``_run``: changes from the ``last`` event of a row to the ``first`` of the next (or ``cut``) summed up along ``order``."""
    w = W.partitionBy(*group).orderBy(*order)
    other = F.col(first) != F.col("_prev") if within is None else F.abs(F.col(first) - F.col("_prev")) > within
    starts = F.col("_prev").isNull() | other | cut
    return (
        df.withColumn("_prev", F.lag(last).over(w))
        .withColumn("_run", F.sum(F.when(starts, 1).otherwise(0)).over(w.rowsBetween(W.unboundedPreceding, 0)))
        .drop("_prev")
    )


def collapse_runs(df: DataFrame, sequence: str, position: str, event: str, ts: str, max_gap: int | None = None, width: int = CHUNK, within: float | None = None) -> DataFrame:
    """One row per longest run of equal ``event`` values: ``sequence``, ``event`` and the columns ``RUN``.

    Rows whose ``position`` or ``event`` is null are no events; they neither count nor
    interrupt a run. Rows with the same sequence and position are copies of one event and
    count once (if they disagree, the smallest value is taken). A null sequence is one
    like others. ``ts`` may be null; ``first_ts`` and ``last_ts`` are the earliest and
    latest known time in the run. With ``max_gap`` a run also ends where positions are
    further apart. With ``within``, events are numbers and a run goes on while each differs
    from the one before by no more than that; it has the event of its first row.
    """
    ev = df.where(F.col(position).isNotNull() & F.col(event).isNotNull()).select(
        F.col(sequence).alias("_s"), F.col(position).alias("_p"), F.col(event).alias("_e"), F.col(ts).alias("_t"),
        F.floor(F.col(position) / F.lit(width)).cast("bigint").alias("_c"),
    )
    w = W.partitionBy("_s", "_c").orderBy("_p", "_e")
    # copies stay for their times, with the event of the first copy; only that one counts
    ev = (
        ev.withColumn("_pp", F.lag("_p").over(w))
        .withColumn("_new", F.col("_pp").isNull() | (F.col("_p") != F.col("_pp")))
        .withColumn("_e", F.last(F.when(F.col("_new"), F.col("_e")), ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, 0)))
    )
    gap = F.lit(False) if max_gap is None else F.coalesce(F.col("_p") - F.col("_pp") > max_gap, F.lit(False))
    local = (
        _number(ev, ["_s", "_c"], ["_p", "_e"], "_e", "_e", gap, within)
        .groupBy("_s", "_c", "_run")
        .agg(
            *([F.first("_e").alias("_e"), F.first("_e").alias("_l")] if within is None else [F.min_by("_e", "_p").alias("_e"), F.max_by("_e", "_p").alias("_l")]),
            F.min("_p").alias("first_pos"), F.max("_p").alias("last_pos"),
            F.sum(F.col("_new").cast("bigint")).alias("entries"), F.min("_t").alias("first_ts"), F.max("_t").alias("last_ts"),
        )
    )
    at_edge = (F.col("_run") == 1) | (F.col("_run") == F.col("_runs"))
    local = local.withColumn("_runs", F.max("_run").over(W.partitionBy("_s", "_c")))
    inner = local.where(~at_edge).select("_s", "_e", *RUN)
    edge = local.where(at_edge).withColumn("_at", F.struct("_c", "_run"))
    along = W.partitionBy("_s").orderBy("_at")
    edge = edge.withColumn("_lastpos", F.lag("last_pos").over(along))
    # a run that fills neither edge of its chunk lies between: two edge runs of one chunk never join
    gap = (F.coalesce(F.lag("_c").over(along) == F.col("_c"), F.lit(False)))
    edge = edge.withColumn("_cut", gap if max_gap is None else gap | F.coalesce(F.col("first_pos") - F.col("_lastpos") > max_gap, F.lit(False)))
    joined = (
        _number(edge.drop("_run"), ["_s"], ["_at"], "_e", "_l", F.col("_cut"), within)
        .groupBy("_s", "_run")
        .agg(
            (F.first("_e") if within is None else F.min_by("_e", "first_pos")).alias("_e"), F.min("first_pos").alias("first_pos"), F.max("last_pos").alias("last_pos"),
            F.sum("entries").alias("entries"), F.min("first_ts").alias("first_ts"), F.max("last_ts").alias("last_ts"),
        )
        .select("_s", "_e", *RUN)
    )
    return inner.unionByName(joined).select(F.col("_s").alias(sequence), F.col("_e").alias(event), *RUN)
