"""Text quality of documents, and what it tells (problem 9).

Statistics of whole texts (``text_stats``) are taken in two passes: the first learns the
common words of each group of documents, the second counts. A Gaussian mixture with
diagonal covariances is fitted to the standardised statistics of all documents by
expectation maximisation: each step sends every partition's sufficient statistics, never
rows, to the driver. Its components start at inspected documents (``examples``) and are
mapped to prose, list, table or junk by the examples they are responsible for; the class
of a document is that of its likeliest components, and nothing else decides it.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator, Set

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .examples import EXAMPLES
from .text_stats import STATS, free_words, statistics

CLASSES = ("prose", "list", "table", "junk")
#: Share of the documents of a group in which a common word occurs, and least number of documents.
COMMON_SHARE, COMMON_LEAST = 0.1, 3
#: Groups with a smaller share of the documents count as one group.
LEAST_GROUP = 0.01
#: Different words a task holds before it passes their counts on.
HELD_WORDS = 200_000
STEPS = 12
#: Variance below which no component goes, in units of the standardised statistics.
LEAST_VARIANCE = 0.05


def learn_common(df: DataFrame, text: str, group: str | None = None) -> frozenset[str]:
    """Words that occur in at least ``COMMON_SHARE`` of the texts of some group, in lower case; markup's own words are not counted.

    ``group`` is a column such as the language; null is a group, and groups with less
    than ``LEAST_GROUP`` of the texts are taken together. Null texts count as empty ones.
    So the list has at most (mean number of different words in a text) / ``COMMON_SHARE``
    words for each of at most 1 / ``LEAST_GROUP`` + 1 groups, which the driver holds.
    """
    one = df.select((F.col(group).cast("string") if group else F.lit(None).cast("string")).alias("g"), F.col(text).alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def flush() -> pa.RecordBatch:
            keys = list(held)
            got = pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()), pa.array(list(held.values()), pa.int64())], names=["g", "w", "n"])
            held.clear()
            return got

        for b in batches:
            for g, words in zip(b.column(0).to_pylist(), free_words(b.column(1).to_pylist())):
                held.update((g, w) for w in words)
                if len(held) > HELD_WORDS:
                    yield flush()
        if held:
            yield flush()

    counts = one.mapInArrow(run, "g string, w string, n bigint").groupBy("g", "w").agg(F.sum("n").alias("n"))
    # one row per group: the number of its texts
    sizes = one.groupBy("g").agg(F.count("*").alias("size"))
    total = sizes.agg(F.sum("size")).scalar()
    named = sizes.select(F.col("g").alias("g0"), F.when(F.col("size") >= LEAST_GROUP * total, F.struct("g")).alias("at"), "size")
    large = named.groupBy("at").agg(F.sum("size").alias("size"))
    rows = counts.join(named.select("g0", "at"), F.col("g").eqNullSafe(F.col("g0"))).groupBy("at", "w").agg(F.sum("n").alias("n"))
    rows = rows.join(large.withColumnRenamed("at", "at2"), F.col("at").eqNullSafe(F.col("at2")))
    return frozenset(r["w"] for r in rows.where((F.col("n") >= F.col("size") * COMMON_SHARE) & (F.col("n") >= COMMON_LEAST)).select("w").distinct().collect())


def with_statistics(df: DataFrame, text: str, common: Set[str]) -> DataFrame:
    """``df`` with the columns ``STATS`` in place of ``text``; columns that had these names are replaced."""
    keep = [c for c in df.columns if c != text and c not in STATS]
    kinds = dict(df.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = statistics(b.column(b.schema.get_field_index(text)).to_pylist(), common)
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(c)) for c in keep), *(pa.array(x[:, i]) for i in range(len(STATS)))], names=[*keep, *STATS])

    return df.select(*keep, text).mapInArrow(run, ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), *(f"{s} double" for s in STATS)]))


def _matrix(b: pa.RecordBatch) -> np.ndarray:
    x = np.column_stack([b.column(b.schema.get_field_index(s)).to_numpy(zero_copy_only=False) for s in STATS])
    return features(x)


def features(x: np.ndarray) -> np.ndarray:
    """Statistics as the mixture sees them: the first three as logarithms."""
    x = np.array(x, dtype=np.float64).reshape(-1, len(STATS))
    x[:, :3] = np.log1p(x[:, :3])
    return x


class Mixture:
    """Weights, means and variances of the components, and the standardisation before them."""

    def __init__(self, shift: np.ndarray, scale: np.ndarray, weight: np.ndarray, mean: np.ndarray, var: np.ndarray):
        self.shift, self.scale, self.weight, self.mean, self.var = shift, scale, weight, mean, var
        self.classes: list[str] = []

    def responsibilities(self, x: np.ndarray) -> np.ndarray:
        z = (x - self.shift) / self.scale
        at = np.log(self.weight) - 0.5 * (np.log(2 * math.pi * self.var) + self.mean**2 / self.var).sum(axis=1)
        p = at[None, :] + z @ (self.mean / self.var).T - 0.5 * (z * z) @ (1 / self.var).T
        p -= p.max(axis=1, keepdims=True)
        p = np.exp(p)
        return p / p.sum(axis=1, keepdims=True)

    def class_probabilities(self, x: np.ndarray) -> np.ndarray:
        r = self.responsibilities(x)
        return np.column_stack([r[:, [i for i, c in enumerate(self.classes) if c == k]].sum(axis=1) for k in CLASSES])


def _gather(stats: DataFrame, run, width: int) -> np.ndarray:
    """Sum over all rows of what ``run`` gives for a partition: ``width`` numbers each, added up on the cluster."""
    sums = stats.select(*STATS).mapInArrow(run, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()
    out = np.zeros(width)
    for r in sums:
        out[r["i"]] = r["v"]
    return out


def _emit(v: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.arange(v.size, dtype=np.int32)), pa.array(v.ravel().astype(np.float64))], names=["i", "v"])


def fit(stats: DataFrame, common: Set[str], steps: int = STEPS) -> Mixture | None:
    """The mixture after ``steps`` of expectation maximisation over all rows; None for an empty table.

    The labelled sample is ``EXAMPLES``, of a fixed size: it places the components at the
    start and names them at the end.
    """
    d = len(STATS)

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 + 2 * d)
        for b in batches:
            x = _matrix(b)
            total += np.concatenate([[len(x)], x.sum(axis=0), (x * x).sum(axis=0)])
        yield _emit(total)

    m = _gather(stats, moments, 1 + 2 * d)
    n = m[0]
    if n == 0:
        return None
    shift = m[1 : 1 + d] / n
    scale = np.sqrt(np.maximum(m[1 + d :] / n - shift**2, 1e-12))
    scale[scale < 1e-5] = 1.0
    examples = features(statistics([t for _, _, t in EXAMPLES], common))
    k = len(EXAMPLES)
    g = Mixture(shift, scale, np.full(k, 1 / k), (examples - shift) / scale, np.full((k, d), 0.25))
    for _ in range(steps):

        def step(batches: Iterator[pa.RecordBatch], g: Mixture = g) -> Iterator[pa.RecordBatch]:
            total = np.zeros((k, 1 + 2 * d))
            for b in batches:
                x = _matrix(b)
                if len(x):
                    r = g.responsibilities(x)
                    z = (x - g.shift) / g.scale
                    total += np.column_stack([r.sum(axis=0), r.T @ z, r.T @ (z * z)])
            yield _emit(total)

        t = _gather(stats, step, k * (1 + 2 * d)).reshape(k, 1 + 2 * d)
        # a component that loses its documents stays where it is, with next to no weight
        c = np.maximum(t[:, :1], 1e-9)
        alive = t[:, 0] > 1e-3
        mean = np.where(alive[:, None], t[:, 1 : 1 + d] / c, g.mean)
        var = np.where(alive[:, None], np.maximum(t[:, 1 + d :] / c - mean**2, LEAST_VARIANCE), g.var)
        weight = np.maximum(t[:, 0], 1e-6)
        g = Mixture(shift, scale, weight / weight.sum(), mean, var)
    r = g.responsibilities(examples)
    votes = np.array([[r[[j for j, (_, c, _) in enumerate(EXAMPLES) if c == name], i].sum() for name in CLASSES] for i in range(k)])
    # a component no example belongs to takes the class of the example nearest to its mean
    z = (examples - shift) / scale
    for i in range(k):
        if votes[i].max() < 1e-3:
            near = int((((z - g.mean[i]) ** 2) / g.var[i]).sum(axis=1).argmin())
            votes[i, CLASSES.index(EXAMPLES[near][1])] = 1
    g.classes = [CLASSES[int(v.argmax())] for v in votes]
    return g


def classify(stats: DataFrame, g: Mixture) -> DataFrame:
    """``stats`` with ``p_<class>`` for each class and ``kind``, the likeliest; columns that had these names are replaced.

    A text without a visible character is junk.
    """
    stats = stats.drop("kind", *(f"p_{c}" for c in CLASSES))
    cols = stats.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _matrix(b)
            p = g.class_probabilities(x) if b.num_rows else np.zeros((0, len(CLASSES)))
            p[x[:, STATS.index("mean_line")] == 0] = [float(c == "junk") for c in CLASSES]
            kind = [CLASSES[i] for i in p.argmax(axis=1)]
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(p[:, i]) for i in range(len(CLASSES))), pa.array(kind, pa.string())], names=[*cols, *(f"p_{c}" for c in CLASSES), "kind"])

    kinds = dict(stats.dtypes)
    return stats.mapInArrow(run, ", ".join([*(f"`{c}` {kinds[c]}" for c in cols), *(f"p_{c} double" for c in CLASSES), "kind string"]))


def not_prose(classified: DataFrame) -> DataFrame:
    """Rows of which the mixture's class is not prose."""
    return classified.where(F.col("kind") != "prose")
