"""Queries on traces: parsing, counts, windows, labels, kernel growth."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.values import PARSE_ID_SQL, decode_bytes, parse_id, parse_line
from ..operators import blocks as B
from ..operators.ordered import lines
from ..operators.visit import visit
from ..sources.tables import table

ID_KEYS = ["BBEnter", "BBExit", "LoadAddress", "StoreAddress"]


def _t(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "trace")


def kernel_blocks(spark: SparkSession, folder: str, stage: str | None = None) -> DataFrame:
    """``kernel_id, trace_id, kid, block_id``: members >= 0 of the catalogue's kernels, once each."""
    k = table(spark, folder, "kernel_sets")
    if stage:
        k = k.where(F.col("stage") == stage)
    return k.select("kernel_id", "trace_id", "kid", F.explode("blocks").alias("block_id")).where("block_id >= 0").distinct()


def trace_parse(spark: SparkSession, folder: str) -> DataFrame:
    text = F.concat(F.col("k"), F.lit(":"), F.coalesce("v", F.lit("")))
    return _t(spark, folder).select("trace_id", "seq", parse_line(text).alias("p")).select("trace_id", "seq", "p.key", "p.value")


def event_counts(spark: SparkSession, folder: str) -> DataFrame:
    return lines(_t(spark, folder)).groupBy("k").agg(F.count("*").alias("cnt"), F.count("value").alias("readable"))


def _counter(_: str | None):
    seen: Counter = Counter()
    return (lambda seq, k, v: seen.update([k])), (lambda: seen.items())


def visited_events(spark: SparkSession, folder: str) -> DataFrame:
    """Lines per trace and key, counted by a visitor."""
    return visit(_t(spark, folder), _counter, "k string, cnt bigint")


def parse_ids(spark: SparkSession, folder: str) -> DataFrame:
    return _t(spark, folder).where(F.col("k").isin(ID_KEYS)).select("trace_id", "seq", "v", parse_id("v").alias("value"))


def decode_values(spark: SparkSession, folder: str) -> DataFrame:
    """Bytes of every value that is written as a dump; addresses serve as dumps, as the tables have no others."""
    return _t(spark, folder).where(F.col("k").isin(ID_KEYS)).select("trace_id", "seq", F.hex(decode_bytes("v")).alias("bytes"), F.length(decode_bytes("v")).alias("size"))


def block_counts(spark: SparkSession, folder: str) -> DataFrame:
    return B.block_counts(_t(spark, folder))


def hot_seeds(spark: SparkSession, folder: str) -> DataFrame:
    return B.block_counts(_t(spark, folder)).where(F.col("cnt") >= 16)


def valid_blocks(spark: SparkSession, folder: str) -> DataFrame:
    return B.entries(_t(spark, folder)).select("trace_id", "block_id").distinct()


def ranked_blocks(spark: SparkSession, folder: str) -> DataFrame:
    w = W.partitionBy("trace_id").orderBy(F.desc("cnt"), "block_id")
    return B.block_counts(_t(spark, folder)).withColumn("rank", F.row_number().over(w).cast("bigint"))


def cooccurrence(spark: SparkSession, folder: str) -> DataFrame:
    return B.cooccurrence(_t(spark, folder))


def cooccur_prob(spark: SparkSession, folder: str) -> DataFrame:
    return B.neighbour_share(B.cooccurrence(_t(spark, folder))).select("trace_id", "block_id", "nbr", F.round("prob", 9).alias("prob"))


def type1_kernels(spark: SparkSession, folder: str) -> DataFrame:
    return B.type1_kernels(_t(spark, folder), hot=16)


def open_blocks(spark: SparkSession, folder: str) -> DataFrame:
    return B.open_depth(_t(spark, folder))


def label_balance(spark: SparkSession, folder: str) -> DataFrame:
    return B.label_balance(_t(spark, folder))


def block_labels(spark: SparkSession, folder: str) -> DataFrame:
    return B.block_labels(_t(spark, folder))


def block_labels_exit(spark: SparkSession, folder: str) -> DataFrame:
    return B.block_labels_at_exit(_t(spark, folder))


def kernel_starts(spark: SparkSession, folder: str) -> DataFrame:
    return B.first_members(_t(spark, folder), kernel_blocks(spark, folder))


def type2_kernels(spark: SparkSession, folder: str) -> DataFrame:
    return B.grown_kernels(_t(spark, folder), kernel_blocks(spark, folder, "TypeOne"))


def type25_kernels(spark: SparkSession, folder: str) -> DataFrame:
    t, seeds = _t(spark, folder), kernel_blocks(spark, folder, "TypeOne")
    once = B.grown_kernels(t, seeds).select("kernel_id", F.explode("blocks").alias("block_id"))
    return B.grown_kernels(t, once.join(seeds.select("kernel_id", "trace_id").distinct(), "kernel_id"))


def kernel_labels(spark: SparkSession, folder: str) -> DataFrame:
    """Labels of a kernel's blocks in its trace, joined by ``;``."""
    lab = B.block_labels(_t(spark, folder)).select("trace_id", "block_id", F.explode("labels").alias("label"))
    got = kernel_blocks(spark, folder).join(lab, ["trace_id", "block_id"]).groupBy("kernel_id").agg(F.collect_set("label").alias("l"))
    every = table(spark, folder, "kernel_sets").select("kernel_id").distinct()
    return every.join(got, "kernel_id", "left").select("kernel_id", F.coalesce(F.concat_ws(";", F.array_sort("l")), F.lit("")).alias("label"))


L = f"""lines AS (SELECT trace_id, seq, max(k) AS k, max(v) AS v, max({PARSE_ID_SQL}) AS x, max(ts) AS ts FROM trace WHERE seq IS NOT NULL GROUP BY trace_id, seq),
enter AS (SELECT trace_id, seq, x AS block_id FROM lines WHERE k = 'BBEnter' AND x IS NOT NULL),
counts AS (SELECT trace_id, block_id, count(*) AS cnt FROM enter GROUP BY 1, 2)"""
_NUM = f"WITH {L}, n AS (SELECT *, row_number() OVER (PARTITION BY trace_id ORDER BY seq) AS n FROM enter)"
_PAIRS = f"""{_NUM}, m AS (SELECT a.trace_id, a.block_id, b.block_id AS nbr, count(*) AS cnt FROM n AS a JOIN n AS b
  ON a.trace_id = b.trace_id AND b.n > a.n - 11 AND b.n <= a.n WHERE a.n > 5 GROUP BY 1, 2, 3)"""
_LABEL = f"""WITH {L}, le AS (SELECT trace_id, seq, CASE WHEN k = 'KernelEnter' THEN 1 ELSE -1 END AS d,
  lower(regexp_replace(trim(split_part(coalesce(v, ''), ':', 1), ' ' || chr(9) || chr(13)), '[ \\-]+', '_', 'g')) AS label FROM lines WHERE k IN ('KernelEnter', 'KernelExit')),
ls AS (SELECT *, sum(d) OVER (PARTITION BY trace_id, label ORDER BY seq) AS depth, lead(seq) OVER (PARTITION BY trace_id, label ORDER BY seq) AS nxt FROM le WHERE label <> ''),
bl AS (SELECT e.trace_id, e.block_id, list_sort(list(DISTINCT label)) AS labels FROM enter AS e JOIN ls ON ls.trace_id = e.trace_id AND depth > 0 AND e.seq > ls.seq AND (nxt IS NULL OR e.seq < nxt) GROUP BY 1, 2)"""
KB = "kb AS (SELECT DISTINCT kernel_id, trace_id, kid, stage, block_id FROM (SELECT kernel_id, trace_id, kid, stage, unnest(blocks) AS block_id FROM kernel_sets) WHERE block_id >= 0)"


def _grow(seeds: str, name: str) -> str:
    """CTEs of kernel growth; ``seeds`` has kernel_id, trace_id, block_id."""
    return f"""{name}_s AS ({seeds}),
{name}_x AS (SELECT k.kernel_id, ev.seq, ev.block_id, ev.d, m.block_id IS NOT NULL AS mem FROM (SELECT DISTINCT kernel_id, trace_id FROM {name}_s WHERE trace_id IS NOT NULL) AS k
  JOIN ev ON ev.trace_id = k.trace_id LEFT JOIN {name}_s AS m ON m.kernel_id = k.kernel_id AND m.block_id = ev.block_id),
{name}_w AS (SELECT *, sum(CASE WHEN mem THEN d ELSE 0 END) OVER (PARTITION BY kernel_id ORDER BY seq) AS op,
  last_value(CASE WHEN mem AND d = 1 THEN block_id END IGNORE NULLS) OVER (PARTITION BY kernel_id ORDER BY seq DESC ROWS UNBOUNDED PRECEDING) AS nxt,
  first_value(CASE WHEN mem AND d = 1 THEN block_id END IGNORE NULLS) OVER (PARTITION BY kernel_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS st FROM {name}_x),
{name} AS (SELECT kernel_id, list_sort(list(DISTINCT block_id)) AS blocks FROM {name}_w WHERE d = 1 AND (op > 0 OR (nxt IS NOT NULL AND nxt <> st)) GROUP BY 1)"""


_EV = f"WITH {L}, ev AS (SELECT trace_id, seq, x AS block_id, CASE WHEN k = 'BBEnter' THEN 1 ELSE -1 END AS d FROM lines WHERE k IN ('BBEnter', 'BBExit') AND x IS NOT NULL), {KB}"
_SEEDS = "SELECT DISTINCT kernel_id, trace_id, block_id FROM kb WHERE stage = 'TypeOne'"
_ONCE = _grow(_SEEDS, "g1")

QUERIES = {
    f.__name__: f
    for f in (trace_parse, event_counts, visited_events, parse_ids, decode_values, block_counts, hot_seeds, valid_blocks, ranked_blocks, cooccurrence, cooccur_prob, type1_kernels,
              open_blocks, label_balance, block_labels, block_labels_exit, kernel_starts, type2_kernels, type25_kernels, kernel_labels)
}
# seeds in order, the neighbours each would take, then one step a seed with the blocks covered so far
_GREEDY = f"""{_PAIRS.replace('WITH ', 'WITH RECURSIVE ', 1)}, seeds AS (SELECT trace_id, block_id, row_number() OVER (PARTITION BY trace_id ORDER BY cnt DESC, block_id) AS i FROM counts WHERE cnt >= 16),
near AS (SELECT trace_id, block_id, nbr, sum(cnt) OVER (PARTITION BY trace_id, block_id ORDER BY cnt DESC, nbr ROWS UNBOUNDED PRECEDING) - cnt AS before, sum(cnt) OVER (PARTITION BY trace_id, block_id) AS total FROM m),
sets AS (SELECT s.trace_id, s.i, s.block_id, list_sort(list(nbr)) AS blocks FROM seeds AS s JOIN near ON near.trace_id = s.trace_id AND near.block_id = s.block_id WHERE 10 * before < 9 * total GROUP BY 1, 2, 3),
g(trace_id, i, covered, took, blocks) AS (SELECT DISTINCT trace_id, CAST(0 AS BIGINT), CAST([] AS BIGINT[]), false, CAST([] AS BIGINT[]) FROM seeds
  UNION ALL SELECT g.trace_id, g.i + 1, CASE WHEN sets.blocks IS NULL OR list_contains(covered, s.block_id) THEN covered ELSE list_concat(covered, sets.blocks) END,
  sets.blocks IS NOT NULL AND NOT list_contains(covered, s.block_id), coalesce(sets.blocks, CAST([] AS BIGINT[]))
  FROM g JOIN seeds AS s ON s.trace_id = g.trace_id AND s.i = g.i + 1 LEFT JOIN sets ON sets.trace_id = s.trace_id AND sets.i = s.i)
SELECT trace_id, row_number() OVER (PARTITION BY trace_id ORDER BY blocks) - 1 AS kid, blocks FROM (SELECT DISTINCT trace_id, blocks FROM g WHERE took)"""

ORACLE = {
    "type1_kernels": _GREEDY,
    "trace_parse": "SELECT trace_id, seq, k AS key, split_part(coalesce(v, ''), ':', 1) AS value FROM trace",
    "event_counts": f"WITH {L} SELECT k, count(*) AS cnt, count(x) AS readable FROM lines GROUP BY k",
    "visited_events": f"WITH {L} SELECT trace_id, k, count(*) AS cnt FROM lines GROUP BY 1, 2",
    "parse_ids": f"SELECT trace_id, seq, v, {PARSE_ID_SQL} AS value FROM trace WHERE k IN ('BBEnter', 'BBExit', 'LoadAddress', 'StoreAddress')",
    "decode_values": """WITH d AS (SELECT trace_id, seq, trim(v, ' ' || chr(9) || chr(13)) AS t FROM trace WHERE k IN ('BBEnter', 'BBExit', 'LoadAddress', 'StoreAddress')),
u AS (SELECT trace_id, seq, CASE WHEN regexp_full_match(t, '0[xX]([0-9a-fA-F]{2})*') THEN upper(t[3:]) END AS h FROM d)
SELECT trace_id, seq, h AS bytes, CAST(length(h) // 2 AS INTEGER) AS size FROM u""",
    "block_counts": f"WITH {L} SELECT * FROM counts",
    "hot_seeds": f"WITH {L} SELECT * FROM counts WHERE cnt >= 16",
    "valid_blocks": f"WITH {L} SELECT trace_id, block_id FROM counts",
    "ranked_blocks": f"WITH {L} SELECT *, row_number() OVER (PARTITION BY trace_id ORDER BY cnt DESC, block_id) AS rank FROM counts",
    "cooccurrence": f"{_PAIRS} SELECT * FROM m",
    "cooccur_prob": f"{_PAIRS} SELECT trace_id, block_id, nbr, round(cnt / sum(cnt) OVER (PARTITION BY trace_id, block_id), 9) AS prob FROM m",
    "open_blocks": f"""{_EV}, r AS (SELECT trace_id, block_id, seq, d, sum(d) OVER (PARTITION BY trace_id, block_id ORDER BY seq) AS run FROM ev)
SELECT trace_id, block_id, CAST(max(run) AS BIGINT) AS deepest, CAST(min(run) AS BIGINT) AS lowest, CAST(sum(d) AS BIGINT) AS at_end FROM r GROUP BY 1, 2""",
    "label_balance": f"{_LABEL} SELECT trace_id, label, count(*) FILTER (d = 1) AS enters, count(*) FILTER (d = -1) AS exits, CAST(min(depth) AS BIGINT) AS lowest FROM ls GROUP BY 1, 2",
    "block_labels": f"{_LABEL} SELECT * FROM bl",
    "block_labels_exit": f"""{_LABEL}, ex AS (SELECT trace_id, seq, x AS block_id FROM lines WHERE k = 'BBExit' AND x IS NOT NULL),
g AS (SELECT e.trace_id, e.block_id, list_sort(list(DISTINCT label)) AS labels FROM ex AS e JOIN ls ON ls.trace_id = e.trace_id AND d = 1 AND e.seq > ls.seq AND (nxt IS NULL OR e.seq < nxt) GROUP BY 1, 2)
SELECT e.trace_id, e.block_id, coalesce(g.labels, CAST([] AS VARCHAR[])) AS labels FROM (SELECT DISTINCT trace_id, block_id FROM ex) AS e LEFT JOIN g ON g.trace_id = e.trace_id AND g.block_id = e.block_id""",
    "kernel_starts": f"WITH {L}, {KB} SELECT kernel_id, arg_min(e.block_id, seq) AS start, min(seq) AS seq FROM enter AS e JOIN kb ON kb.trace_id = e.trace_id AND kb.block_id = e.block_id GROUP BY 1",
    "type2_kernels": f"{_EV}, {_ONCE} SELECT * FROM g1",
    "type25_kernels": f"""{_EV}, {_ONCE}, {_grow('SELECT DISTINCT g.kernel_id, s.trace_id, g.block_id FROM (SELECT kernel_id, unnest(blocks) AS block_id FROM g1) AS g JOIN (SELECT DISTINCT kernel_id, trace_id FROM g1_s) AS s ON s.kernel_id = g.kernel_id', 'g2')}
SELECT * FROM g2""",
    "kernel_labels": f"""{_LABEL}, {KB}, g AS (SELECT kernel_id, string_agg(DISTINCT label, ';' ORDER BY label) AS label FROM kb JOIN (SELECT trace_id, block_id, unnest(labels) AS label FROM bl) AS b
  ON b.trace_id = kb.trace_id AND b.block_id = kb.block_id GROUP BY 1) SELECT k.kernel_id, coalesce(g.label, '') AS label FROM (SELECT DISTINCT kernel_id FROM kernel_sets) AS k LEFT JOIN g ON g.kernel_id = k.kernel_id""",
}
