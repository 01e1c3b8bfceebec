"""Queries on the control-flow graph and on kernels in it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import graph as G
from ..sources.tables import table
from .traces import KB, kernel_blocks

STAGE = "TypeTwoFive"


def _args(spark: SparkSession, folder: str, stage: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    return kernel_blocks(spark, folder, stage), table(spark, folder, "blocks"), table(spark, folder, "edges")


def members(spark: SparkSession, folder: str) -> DataFrame:
    """``kernel_id, block_id`` of ``kernel_blocks``, maybe several times, for operators that make them distinct: one shuffle less each."""
    return table(spark, folder, "kernel_sets").select("kernel_id", F.explode("blocks").alias("block_id")).where("block_id >= 0")


#: Functions whose blocks are counted together on the way to dense numbers.
FUNCTIONS = 4096


def block_ids(spark: SparkSession, folder: str) -> DataFrame:
    """Dense numbers of blocks in order of function, then position: running totals over groups of functions, over the functions of a group, and a row number within one."""
    b = table(spark, folder, "blocks")
    per = b.groupBy("func_id").agg(F.count("*").alias("n")).withColumn("g", F.floor(F.col("func_id") / FUNCTIONS))
    groups = per.groupBy("g").agg(F.sum("n").alias("gn"))
    # one row for each group of functions
    groups = groups.select("g", (F.sum("gn").over(W.orderBy("g")) - F.col("gn")).alias("gbase"))
    base = per.withColumn("base", F.sum("n").over(W.partitionBy("g").orderBy("func_id")) - F.col("n")).join(groups, "g")
    w = W.partitionBy("func_id").orderBy("block_pos", "block_id")
    return b.join(base.select("func_id", (F.col("base") + F.col("gbase")).alias("base")), "func_id").select("block_id", (F.col("base") + F.row_number().over(w) - 1).alias("number"))


def adjacency_dump(spark: SparkSession, folder: str) -> DataFrame:
    return G.adjacency(table(spark, folder, "blocks"), table(spark, folder, "edges"))


def dot_edges(spark: SparkSession, folder: str) -> DataFrame:
    """Edges of the kernel graph: solid where both ends are in some kernel, dashed from kernel blocks to callees anywhere."""
    inside = kernel_blocks(spark, folder, "TypeThreeFive").select("block_id").distinct()
    e = table(spark, folder, "edges").select("src", "dst", "kind").distinct().join(inside, F.col("src") == F.col("block_id"), "left_semi")
    solid = e.where("kind = 'succ'").join(inside, F.col("dst") == F.col("block_id"), "left_semi").select("src", "dst", F.lit("solid").alias("style"))
    return solid.unionByName(e.where("kind = 'call'").select("src", "dst", F.lit("dashed").alias("style")))


def kernel_graph(spark: SparkSession, folder: str) -> DataFrame:
    """The kernel graph as lines of a GraphViz text: clusters of kernels, then ``dot_edges``."""
    return G.kernel_graph_lines(kernel_blocks(spark, folder, "TypeThreeFive"), dot_edges(spark, folder))


def type3_kernels(spark: SparkSession, folder: str) -> DataFrame:
    return G.pruned_kernels(*_args(spark, folder, STAGE))


def type4_kernels(spark: SparkSession, folder: str) -> DataFrame:
    return G.split_kernels(*_args(spark, folder, "TypeThree"))


def type35_kernels(spark: SparkSession, folder: str) -> DataFrame:
    return G.pruned_kernels(*_args(spark, folder, "TypeFour"))


def reachable(spark: SparkSession, folder: str) -> DataFrame:
    return G.reachable_blocks(*_args(spark, folder))


def reached_outside(spark: SparkSession, folder: str) -> DataFrame:
    return G.reached_outside(*_args(spark, folder))


def self_reachable(spark: SparkSession, folder: str) -> DataFrame:
    return G.self_reachable_blocks(*_args(spark, folder))


def kernel_entrances(spark: SparkSession, folder: str) -> DataFrame:
    return G.kernel_entrances(members(spark, folder), table(spark, folder, "blocks"), table(spark, folder, "edges"))


def kernel_exits(spark: SparkSession, folder: str) -> DataFrame:
    return G.kernel_exits(members(spark, folder), table(spark, folder, "blocks"), table(spark, folder, "edges"))


def function_exits(spark: SparkSession, folder: str) -> DataFrame:
    return G.function_exits(table(spark, folder, "blocks"), table(spark, folder, "edges"))


def kernel_conditionals(spark: SparkSession, folder: str) -> DataFrame:
    return G.kernel_conditionals(*_args(spark, folder))


def verify_kernels(spark: SparkSession, folder: str) -> DataFrame:
    return G.verify_kernels(members(spark, folder), table(spark, folder, "blocks"), table(spark, folder, "edges"))


def final_kernels(spark: SparkSession, folder: str) -> DataFrame:
    """Different non-empty block sets of a trace's last stage, numbered from 0 in order of their sorted blocks."""
    k = kernel_blocks(spark, folder, "TypeThreeFive").groupBy("kernel_id", "trace_id").agg(F.array_sort(F.collect_set("block_id")).alias("blocks"))
    sets = k.where(F.col("trace_id").isNotNull()).select("trace_id", "blocks").distinct()
    return sets.withColumn("kid", (F.row_number().over(W.partitionBy("trace_id").orderBy("blocks")) - 1).cast("bigint"))


def _pairs(spark: SparkSession, folder: str) -> DataFrame:
    """``parent_id, kernel_id, trace_id``: proper containment between kernels of one trace.

    A kernel that holds all of another's blocks holds the one of them that the fewest
    kernels of the trace hold; those are the candidates, of which the block lists are compared.
    """
    kb = kernel_blocks(spark, folder).where(F.col("trace_id").isNotNull()).select("kernel_id", "trace_id", "block_id").distinct()
    in_all = kb.groupBy("trace_id", "block_id").agg(F.count("*").alias("holders"))
    sets = kb.groupBy("kernel_id", "trace_id").agg(F.collect_set("block_id").alias("blocks"))
    rare = kb.join(in_all, ["trace_id", "block_id"]).groupBy("kernel_id", "trace_id").agg(F.min_by("block_id", F.struct("holders", "block_id")).alias("block_id"))
    found = rare.join(kb.withColumnRenamed("kernel_id", "parent_id"), ["trace_id", "block_id"]).where("kernel_id <> parent_id").drop("block_id")
    found = found.join(sets.select("kernel_id", "trace_id", "blocks"), ["kernel_id", "trace_id"])
    found = found.join(sets.select(F.col("kernel_id").alias("parent_id"), "trace_id", F.col("blocks").alias("outer")), ["parent_id", "trace_id"])
    inside = (F.size("blocks") < F.size("outer")) & (F.size(F.array_except("blocks", "outer")) == 0)
    return found.where(inside).select("parent_id", "kernel_id", "trace_id")


def kernel_nesting(spark: SparkSession, folder: str) -> DataFrame:
    return _pairs(spark, folder).select("parent_id", "kernel_id")


def top_kernels(spark: SparkSession, folder: str) -> DataFrame:
    k = kernel_blocks(spark, folder).where(F.col("trace_id").isNotNull()).select("kernel_id").distinct()
    return k.join(_pairs(spark, folder).select("kernel_id"), "kernel_id", "left_anti")


def smallest_kernel(spark: SparkSession, folder: str) -> DataFrame:
    """Per block of a trace's kernels the one of fewest blocks holding it; ties by id. Other executed blocks have none."""
    kb = kernel_blocks(spark, folder).where(F.col("trace_id").isNotNull())
    n = kb.groupBy("kernel_id").agg(F.count("*").alias("n"))
    return kb.join(n, "kernel_id").groupBy("trace_id", "block_id").agg(F.min_by("kernel_id", F.struct("n", "kernel_id")).alias("kernel_id"))


def bottom_blocks(spark: SparkSession, folder: str) -> DataFrame:
    """Blocks of each kernel that no smaller kernel of its trace holds."""
    return smallest_kernel(spark, folder).select("kernel_id", "block_id")


def conversion_order(spark: SparkSession, folder: str) -> DataFrame:
    """Level of each kernel when kernels are converted after all kernels within them: 0 without any, else one above the highest of those.

    Containment is transitive, so the level is found from a trace's pairs (code-sized) in one task a trace.
    """
    import pandas as pd

    kb = kernel_blocks(spark, folder).where(F.col("trace_id").isNotNull()).select("kernel_id", "trace_id").distinct()
    rows = kb.select("trace_id", "kernel_id", F.lit(None).cast("bigint").alias("child_id")).unionByName(_pairs(spark, folder).select("trace_id", F.col("parent_id").alias("kernel_id"), F.col("kernel_id").alias("child_id")))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        inner: dict[int, list[int]] = {}
        for k, c in zip(pdf["kernel_id"].tolist(), pdf["child_id"].tolist()):
            inner.setdefault(k, [])
            if c == c and c is not None:
                inner[k].append(int(c))
        level: dict[int, int] = {}
        for k in sorted(inner, key=lambda k: len(inner[k])):
            level[k] = 1 + max((level[c] for c in inner[k]), default=-1)
        return pd.DataFrame({"kernel_id": list(level), "level": list(level.values())})

    return rows.groupBy("trace_id").applyInPandas(run, "kernel_id bigint, level bigint")


def kernel_names(spark: SparkSession, folder: str) -> DataFrame:
    """A usable name per kernel: its label, ``Kernel_<id>`` without one, ``K`` before a leading digit; whether another kernel of the trace has it too."""
    k = table(spark, folder, "kernel_sets").groupBy("kernel_id").agg(F.max("trace_id").alias("trace_id"), F.max("label").alias("label"))
    t = F.trim("label")
    name = F.when(F.coalesce(t, F.lit("")) == "", F.concat(F.lit("Kernel_"), "kernel_id")).when(t.rlike("^[0-9]"), F.concat(F.lit("K"), t)).otherwise(t)
    k = k.withColumn("name", name)
    return k.select("kernel_id", "name", (F.count("*").over(W.partitionBy("trace_id", "name")) > 1).alias("shared"))


def kernel_functions(spark: SparkSession, folder: str) -> DataFrame:
    b = table(spark, folder, "blocks").select("block_id", "func_id")
    return kernel_blocks(spark, folder).join(b, "block_id").groupBy("kernel_id").agg(F.array_sort(F.collect_set("func_id")).alias("functions"))


def kernel_libs(spark: SparkSession, folder: str) -> DataFrame:
    """Programs (the library a block comes from) per kernel."""
    b = table(spark, folder, "blocks").where(F.col("program").isNotNull()).select("block_id", "program")
    return kernel_blocks(spark, folder).join(b, "block_id").groupBy("kernel_id").agg(F.array_sort(F.collect_set("program")).alias("libs"))


def recursion_check(spark: SparkSession, folder: str) -> DataFrame:
    """Per kernel: members that call their own function, members that end in ``invoke``, functions of its entrances, and whether it can be converted."""
    kb, b, e = _args(spark, folder)
    s, d = b.select(F.col("block_id").alias("src"), F.col("func_id").alias("sf")), b.select(F.col("block_id").alias("dst"), F.col("func_id").alias("df"))
    own = e.where("kind = 'call'").join(s, "src").join(d, "dst").where("sf = df").select(F.col("src").alias("block_id")).distinct().withColumn("rec", F.lit(1))
    k = kb.join(b.select("block_id", "term_kind"), "block_id").join(own, "block_id", "left")
    per = k.groupBy("kernel_id").agg(F.count("rec").alias("recursive"), F.count(F.when(F.col("term_kind") == "invoke", 1)).alias("invokes"))
    return per.withColumn("convertible", (F.col("recursive") == 0) & (F.col("invokes") == 0))


def entrance_functions(spark: SparkSession, folder: str) -> DataFrame:
    """Per kernel with entrances: in how many functions they lie, and whether that is one, as extraction needs it."""
    ent = kernel_entrances(spark, folder).join(table(spark, folder, "blocks").select("block_id", "func_id"), "block_id")
    return ent.groupBy("kernel_id").agg(F.countDistinct("func_id").alias("functions")).withColumn("single", F.col("functions") == 1)


_B = f"WITH {KB}, kx AS (SELECT DISTINCT kernel_id, block_id FROM kb), e AS (SELECT DISTINCT src, dst, kind FROM edges)"
_NEST = f"""WITH {KB}, kt AS (SELECT DISTINCT kernel_id, trace_id, block_id FROM kb WHERE trace_id IS NOT NULL), n AS (SELECT kernel_id, count(*) AS n FROM kt GROUP BY 1),
nest AS (SELECT b.kernel_id AS parent_id, a.kernel_id FROM kt AS a JOIN kt AS b ON a.trace_id = b.trace_id AND a.block_id = b.block_id JOIN n AS na ON na.kernel_id = a.kernel_id
  JOIN n AS nb ON nb.kernel_id = b.kernel_id WHERE na.n < nb.n GROUP BY 1, 2, na.n HAVING count(*) = na.n),
small AS (SELECT trace_id, block_id, arg_min(kt.kernel_id, row(n, kt.kernel_id)) AS kernel_id FROM kt JOIN n ON n.kernel_id = kt.kernel_id GROUP BY 1, 2)"""

_CLOSURE = f"""WITH RECURSIVE {KB}, kx AS (SELECT DISTINCT kernel_id, block_id FROM kb), e AS (SELECT DISTINCT src, dst, kind FROM edges), b AS (SELECT block_id, func_id, coalesce(is_entry, false) AS entry, term_kind FROM blocks),
i AS (SELECT DISTINCT a.kernel_id, src, dst FROM kx AS a JOIN e ON e.src = a.block_id JOIN kx AS b ON b.kernel_id = a.kernel_id AND b.block_id = e.dst),
r(kernel_id, s, d) AS (SELECT kernel_id, src, dst FROM i UNION SELECT r.kernel_id, r.s, i.dst FROM r JOIN i ON i.kernel_id = r.kernel_id AND i.src = r.d),
su AS (SELECT kx.kernel_id, src, dst, m.block_id IS NOT NULL AS inside, src = dst OR r.s IS NOT NULL AS back FROM kx JOIN e ON src = kx.block_id AND kind = 'succ'
  LEFT JOIN kx AS m ON m.kernel_id = kx.kernel_id AND m.block_id = dst LEFT JOIN r ON r.kernel_id = kx.kernel_id AND r.s = dst AND r.d = src),
cond AS (SELECT DISTINCT kernel_id, src AS block_id FROM su WHERE NOT inside OR NOT back),
calls AS (SELECT DISTINCT func_id, src FROM e JOIN b ON block_id = dst AND entry WHERE kind = 'call'),
pre AS (SELECT src, dst FROM e JOIN b AS x ON x.block_id = src JOIN b AS y ON y.block_id = dst AND y.func_id = x.func_id WHERE kind = 'succ'),
w(kernel_id, start, cur) AS (SELECT kernel_id, kx.block_id, kx.block_id FROM kx JOIN b ON b.block_id = kx.block_id AND NOT entry
  UNION SELECT w.kernel_id, start, src FROM w JOIN pre ON dst = cur LEFT JOIN kx AS m ON m.kernel_id = w.kernel_id AND m.block_id = src WHERE m.block_id IS NULL),
ent AS (SELECT DISTINCT kernel_id, start AS block_id FROM w JOIN b ON b.block_id = cur AND entry
  UNION SELECT kx.kernel_id, kx.block_id FROM kx JOIN b ON b.block_id = kx.block_id AND entry JOIN calls USING (func_id) LEFT JOIN kx AS m ON m.kernel_id = kx.kernel_id AND m.block_id = calls.src
  GROUP BY 1, 2 HAVING count(m.block_id) = 0)"""
_EXITS = """xc AS (SELECT kernel_id, dst AS block_id FROM kx JOIN e ON src = block_id AND kind = 'succ'
  UNION SELECT kernel_id, calls.src FROM kx JOIN b ON b.block_id = kx.block_id AND term_kind = 'ret' JOIN calls ON calls.func_id = b.func_id), ex AS (SELECT * FROM xc ANTI JOIN kx USING (kernel_id, block_id))"""

#: Rounds of removal after which the SQL below stops; kernels here are pruned in far fewer.
_ROUNDS = 48


def _pruned(stage: str) -> str:
    """Rounds of removal: a block stays while it has a predecessor and a successor among those that are left."""
    return f"""WITH RECURSIVE {KB}, kx AS (SELECT DISTINCT kernel_id, block_id FROM kb JOIN blocks USING (block_id) WHERE stage = '{stage}'), e AS (SELECT DISTINCT src, dst, kind FROM edges),
b AS (SELECT block_id, func_id, coalesce(is_entry, false) AS entry, term_kind FROM blocks), calls AS (SELECT DISTINCT func_id, src FROM e JOIN b ON block_id = dst AND entry WHERE kind = 'call'),
pre AS (SELECT b.block_id, src AS other FROM b JOIN e ON dst = b.block_id AND kind = 'succ' WHERE NOT entry UNION SELECT b.block_id, src FROM b JOIN calls USING (func_id) WHERE entry),
post AS (SELECT b.block_id, dst AS other FROM b JOIN e ON src = b.block_id AND kind = 'succ' WHERE term_kind IS DISTINCT FROM 'ret' UNION SELECT b.block_id, src FROM b JOIN calls USING (func_id) WHERE term_kind = 'ret'),
r(step, kernel_id, blocks) AS (SELECT 0, kernel_id, list(block_id) FROM kx GROUP BY 2
  UNION ALL SELECT step + 1, kernel_id, list(x) FILTER (has_pre AND has_post) FROM (SELECT step, kernel_id, x, blocks,
    EXISTS (SELECT 1 FROM pre WHERE pre.block_id = x AND list_contains(blocks, other)) AS has_pre, EXISTS (SELECT 1 FROM post WHERE post.block_id = x AND list_contains(blocks, other)) AS has_post
    FROM (SELECT *, unnest(blocks) AS x FROM r WHERE step < {_ROUNDS})) GROUP BY step, kernel_id)
SELECT k.kernel_id, coalesce(list_sort(r.blocks), CAST([] AS BIGINT[])) AS blocks FROM (SELECT DISTINCT kernel_id FROM kb WHERE stage = '{stage}') AS k LEFT JOIN r ON r.kernel_id = k.kernel_id AND step = {_ROUNDS}"""


# the closure over the self-reachable blocks of a stage in place of all kernels' blocks
_SPLIT = f"""WITH RECURSIVE {KB}, k0 AS (SELECT DISTINCT kernel_id, block_id FROM kb JOIN blocks USING (block_id) WHERE stage = 'TypeThree'), e AS (SELECT DISTINCT src, dst, kind FROM edges),
b AS (SELECT block_id, func_id, coalesce(is_entry, false) AS entry, term_kind FROM blocks), i AS (SELECT DISTINCT a.kernel_id, src, dst FROM k0 AS a JOIN e ON e.src = a.block_id JOIN k0 AS b ON b.kernel_id = a.kernel_id AND b.block_id = e.dst),
r(kernel_id, s, d) AS (SELECT kernel_id, src, dst FROM i UNION SELECT r.kernel_id, r.s, i.dst FROM r JOIN i ON i.kernel_id = r.kernel_id AND i.src = r.d), kx AS (SELECT kernel_id, s AS block_id FROM r WHERE s = d),
{_CLOSURE[_CLOSURE.index("calls AS"):]}"""

QUERIES = {
    f.__name__: f
    for f in (block_ids, adjacency_dump, dot_edges, kernel_graph, type3_kernels, type4_kernels, type35_kernels, reachable, reached_outside, self_reachable, kernel_entrances, kernel_exits, function_exits,
              kernel_conditionals, verify_kernels, final_kernels, kernel_nesting, top_kernels, smallest_kernel, bottom_blocks, conversion_order, kernel_names,
              kernel_functions, kernel_libs, recursion_check, entrance_functions)
}
ORACLE = {
    "block_ids": "SELECT block_id, row_number() OVER (ORDER BY func_id, block_pos, block_id) - 1 AS number FROM blocks",
    "adjacency_dump": """WITH a AS (SELECT src, list_sort(list(DISTINCT dst)) AS neighbours FROM edges JOIN blocks ON block_id = src
  WHERE kind IN ('succ', 'call') OR (kind IN ('ret', 'resume') AND kind = term_kind) GROUP BY 1) SELECT block_id, coalesce(neighbours, CAST([] AS BIGINT[])) AS neighbours FROM blocks LEFT JOIN a ON src = block_id""",
    "dot_edges": f"""{_B}, i AS (SELECT DISTINCT block_id FROM kb WHERE stage = 'TypeThreeFive')
SELECT src, dst, 'solid' AS style FROM e WHERE kind = 'succ' AND src IN (FROM i) AND dst IN (FROM i) UNION ALL SELECT src, dst, 'dashed' FROM e WHERE kind = 'call' AND src IN (FROM i)""",
    "kernel_graph": f"""{_B}, i AS (SELECT DISTINCT kernel_id, block_id FROM kb WHERE stage = 'TypeThreeFive'), j AS (SELECT DISTINCT block_id FROM i),
d AS (SELECT src, dst, 'solid' AS style FROM e WHERE kind = 'succ' AND src IN (FROM j) AND dst IN (FROM j) UNION ALL SELECT src, dst, 'dashed' FROM e WHERE kind = 'call' AND src IN (FROM j)), n AS (SELECT CAST(NULL AS BIGINT) AS x)
SELECT 0 AS section, x AS a, x AS b, 'digraph {{' AS line FROM n UNION ALL SELECT 3, x, x, '}}' FROM n
UNION ALL SELECT 1, kernel_id, NULL, 'subgraph cluster_' || kernel_id || ' {{ label="Kernel ' || kernel_id || '"; ' || string_agg('"k' || kernel_id || 'b' || block_id || '" [label="' || block_id || '"];', ' ' ORDER BY block_id) || ' }}' FROM i GROUP BY kernel_id
UNION ALL SELECT 2, src, dst, '"' || src || '" -> "' || dst || '" [style=' || style || '];' FROM d""",
    "reached_outside": f"""{_CLOSURE}, c AS (SELECT kernel_id, s, d FROM r UNION SELECT kernel_id, block_id, block_id FROM kx JOIN b USING (block_id))
SELECT DISTINCT c.kernel_id, s AS base, e.dst AS target FROM c JOIN e ON e.src = c.d LEFT JOIN kx ON kx.kernel_id = c.kernel_id AND kx.block_id = e.dst WHERE kx.block_id IS NULL""",
    "type3_kernels": _pruned("TypeTwoFive"),
    "type35_kernels": _pruned("TypeFour"),
    "type4_kernels": f"""{_SPLIT}, rc(kernel_id, s, d) AS (SELECT ent.kernel_id, ent.block_id, e.dst FROM ent JOIN e ON e.src = ent.block_id AND kind IN ('succ', 'call') JOIN kx ON kx.kernel_id = ent.kernel_id AND kx.block_id = e.dst
  UNION SELECT rc.kernel_id, rc.s, e.dst FROM rc JOIN e ON e.src = rc.d AND kind IN ('succ', 'call') JOIN kx ON kx.kernel_id = rc.kernel_id AND kx.block_id = e.dst)
SELECT ent.kernel_id, ent.block_id AS entrance, coalesce(list_sort(list(DISTINCT rc.d) FILTER (rc.d IS NOT NULL)), CAST([] AS BIGINT[])) AS blocks FROM ent LEFT JOIN rc ON rc.kernel_id = ent.kernel_id AND rc.s = ent.block_id GROUP BY 1, 2""",
    "self_reachable": f"""WITH RECURSIVE {KB}, kx AS (SELECT DISTINCT kernel_id, block_id FROM kb), e AS (SELECT DISTINCT src, dst FROM edges),
i AS (SELECT a.kernel_id, src, dst FROM kx AS a JOIN e ON e.src = a.block_id JOIN kx AS b ON b.kernel_id = a.kernel_id AND b.block_id = e.dst),
r(kernel_id, s, d) AS (SELECT kernel_id, src, dst FROM i UNION SELECT r.kernel_id, r.s, i.dst FROM r JOIN i ON i.kernel_id = r.kernel_id AND i.src = r.d)
SELECT kernel_id, s AS block_id FROM r WHERE s = d""",
    "reachable": f"""WITH RECURSIVE {KB}, kx AS (SELECT DISTINCT kernel_id, block_id FROM kb), e AS (SELECT DISTINCT src, dst FROM edges WHERE kind IN ('succ', 'call')),
i AS (SELECT a.kernel_id, src, dst FROM kx AS a JOIN e ON e.src = a.block_id JOIN kx AS b ON b.kernel_id = a.kernel_id AND b.block_id = e.dst),
r(kernel_id, s, d) AS (SELECT kernel_id, src, dst FROM i UNION SELECT r.kernel_id, r.s, i.dst FROM r JOIN i ON i.kernel_id = r.kernel_id AND i.src = r.d)
SELECT kernel_id, s AS base, d AS block_id FROM r""",
    "kernel_exits": f"""{_B}, c AS (SELECT DISTINCT func_id, src FROM e JOIN blocks ON block_id = dst AND is_entry WHERE kind = 'call'),
o AS (SELECT kernel_id, dst AS block_id FROM kx JOIN e ON src = block_id AND kind = 'succ' UNION SELECT kernel_id, c.src FROM kx JOIN blocks AS b ON b.block_id = kx.block_id AND term_kind = 'ret' JOIN c ON c.func_id = b.func_id)
SELECT * FROM o ANTI JOIN kx USING (kernel_id, block_id)""",
    "function_exits": "SELECT DISTINCT s.func_id, e.dst AS block_id FROM edges AS e JOIN blocks AS s ON s.block_id = src JOIN blocks AS d ON d.block_id = dst WHERE kind = 'succ' AND s.func_id <> d.func_id",
    "kernel_conditionals": f"{_CLOSURE} SELECT * FROM cond",
    "kernel_entrances": f"{_CLOSURE} SELECT * FROM ent",
    "entrance_functions": f"{_CLOSURE} SELECT kernel_id, count(DISTINCT func_id) AS functions, count(DISTINCT func_id) = 1 AS single FROM ent JOIN b USING (block_id) GROUP BY 1",
    "verify_kernels": f"""{_CLOSURE}, {_EXITS}, n AS (SELECT kernel_id, count(*) AS n FROM kx GROUP BY 1), cy AS (SELECT kernel_id, count(*) AS n FROM r WHERE s = d GROUP BY 1),
en AS (SELECT kernel_id, count(*) AS n FROM ent GROUP BY 1), co AS (SELECT kernel_id, count(*) AS n FROM cond GROUP BY 1), xn AS (SELECT kernel_id, count(*) AS n FROM ex GROUP BY 1),
ep AS (SELECT DISTINCT kernel_id FROM su WHERE inside AND NOT back)
SELECT n.kernel_id, n.n = coalesce(cy.n, 0) AS valid, coalesce(en.n, 0) AS entrances, coalesce(co.n, 0) AS conditionals, ep.kernel_id IS NOT NULL AS epilogue, coalesce(xn.n, 0) AS exits
FROM n LEFT JOIN cy USING (kernel_id) LEFT JOIN en USING (kernel_id) LEFT JOIN co USING (kernel_id) LEFT JOIN xn USING (kernel_id) LEFT JOIN ep USING (kernel_id)""",
    "final_kernels": f"""WITH {KB}, s AS (SELECT DISTINCT trace_id, blocks FROM (SELECT kernel_id, trace_id, list_sort(list(DISTINCT block_id)) AS blocks FROM kb WHERE stage = 'TypeThreeFive' AND trace_id IS NOT NULL GROUP BY 1, 2))
SELECT trace_id, blocks, row_number() OVER (PARTITION BY trace_id ORDER BY blocks) - 1 AS kid FROM s""",
    "kernel_nesting": f"{_NEST} SELECT parent_id, kernel_id FROM nest",
    "top_kernels": f"{_NEST} SELECT kernel_id FROM n WHERE kernel_id NOT IN (SELECT kernel_id FROM nest)",
    "smallest_kernel": f"{_NEST} SELECT * FROM small",
    "bottom_blocks": f"{_NEST} SELECT kernel_id, block_id FROM small",
    "conversion_order": f"""WITH RECURSIVE {_NEST[5:]}, l(kernel_id, level) AS (SELECT kernel_id, CAST(0 AS BIGINT) FROM n UNION SELECT nest.parent_id, l.level + 1 FROM l JOIN nest ON nest.kernel_id = l.kernel_id)
SELECT kernel_id, max(level) AS level FROM l GROUP BY 1""",
    "kernel_names": """WITH k AS (SELECT kernel_id, max(trace_id) AS trace_id, max(label) AS label FROM kernel_sets GROUP BY 1),
n AS (SELECT kernel_id, trace_id, CASE WHEN coalesce(trim(label), '') = '' THEN 'Kernel_' || kernel_id WHEN regexp_matches(trim(label), '^[0-9]') THEN 'K' || trim(label) ELSE trim(label) END AS name FROM k)
SELECT kernel_id, name, count(*) OVER (PARTITION BY trace_id, name) > 1 AS shared FROM n""",
    "kernel_functions": f"{_B} SELECT kernel_id, list_sort(list(DISTINCT func_id)) AS functions FROM kx JOIN blocks USING (block_id) GROUP BY 1",
    "kernel_libs": f"{_B} SELECT kernel_id, list_sort(list(DISTINCT program)) AS libs FROM kx JOIN blocks USING (block_id) WHERE program IS NOT NULL GROUP BY 1",
    "recursion_check": f"""{_B}, o AS (SELECT DISTINCT src FROM e JOIN blocks AS s ON s.block_id = src JOIN blocks AS d ON d.block_id = dst WHERE kind = 'call' AND s.func_id = d.func_id),
p AS (SELECT kernel_id, count(o.src) AS recursive, count(*) FILTER (term_kind = 'invoke') AS invokes FROM kx JOIN blocks USING (block_id) LEFT JOIN o ON o.src = block_id GROUP BY 1)
SELECT *, recursive = 0 AND invokes = 0 AS convertible FROM p""",
}
