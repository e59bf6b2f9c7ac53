"""Isolation Forest (Liu, Ting and Zhou, ICDM 2008): sampled tree growth per group, vectorised scoring per batch."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TREES = 200
SAMPLE = 256
EULER = 0.5772156649
NODE_SCHEMA = "tree int, node int, feature int, threshold double, left int, right int, size int, depth int"
# Rows drawn per tree relative to the rows used, so that a short draw is all but impossible.
OVERSAMPLE = 1.5
SCORE_CHUNK = 8192


def average_path(n) -> np.ndarray:
    """Mean path length of an unsuccessful search among n points."""
    n = np.asarray(n, dtype="float64")
    many = np.maximum(n, 3.0)
    long = 2.0 * (np.log(many - 1.0) + EULER) - 2.0 * (many - 1.0) / many
    return np.where(n > 2, long, np.where(n == 2, 1.0, 0.0))


def grow_tree(x: np.ndarray, limit: int, rng: np.random.Generator) -> list[tuple]:
    """Nodes of one isolation tree: (node, feature, threshold, left, right, size, depth); feature -1 is a leaf."""
    nodes: list[list] = []

    def add(depth: int, size: int) -> int:
        nodes.append([len(nodes), -1, 0.0, -1, -1, size, depth])
        return len(nodes) - 1

    todo = [(add(0, len(x)), np.arange(len(x)))]
    while todo:
        node, rows = todo.pop()
        depth = nodes[node][6]
        if depth >= limit or len(rows) <= 1:
            continue
        points = x[rows]
        low, high = points.min(axis=0), points.max(axis=0)
        varied = np.flatnonzero(high > low)
        if len(varied) == 0:
            continue
        feature = int(rng.choice(varied))
        threshold = float(low[feature] + rng.random() * (high[feature] - low[feature]))
        if threshold >= high[feature]:
            threshold = float(low[feature])
        goes_right = points[:, feature] > threshold
        sides = rows[~goes_right], rows[goes_right]
        left, right = (add(depth + 1, len(side)) for side in sides)
        nodes[node][1:5] = [feature, threshold, left, right]
        todo += [(left, sides[0]), (right, sides[1])]
    return [tuple(n) for n in nodes]


@dataclass(frozen=True)
class Forest:
    """Trees as complete binary heaps, so that a walk is arithmetic on node numbers.

    ``feature`` and ``threshold`` are (trees, 2^depth - 1); ``path`` is (trees, 2^depth), the path length at the bottom.
    A leaf above the bottom sends all rows left and hands its path length down.
    """

    columns: list[str]
    sample: int
    feature: np.ndarray
    threshold: np.ndarray
    path: np.ndarray
    nodes: pd.DataFrame

    @property
    def trees(self) -> int:
        return len(self.path)

    @staticmethod
    def from_nodes(nodes: pd.DataFrame, columns: list[str], sample: int) -> Forest:
        depth = max(1, int(nodes["depth"].max()))
        inner, bottom = 2**depth - 1, 2**depth
        trees = sorted(nodes["tree"].unique())
        feature = np.zeros((len(trees), inner), dtype=np.intp)
        threshold = np.full((len(trees), inner), np.inf)
        path = np.zeros((len(trees), bottom))
        for t, (_, part) in enumerate(nodes.groupby("tree", sort=True)):
            by_node = {r.node: r for r in part.itertuples()}
            todo = [(0, by_node[0])]
            while todo:
                slot, n = todo.pop()
                if n.feature >= 0:
                    feature[t, slot], threshold[t, slot] = n.feature, n.threshold
                    todo += [(2 * slot + 1, by_node[n.left]), (2 * slot + 2, by_node[n.right])]
                else:
                    first = ((slot + 1) << (depth - n.depth)) - 1 - inner
                    path[t, first : first + (1 << (depth - n.depth))] = n.depth + average_path(n.size)
        return Forest(list(columns), sample, feature, threshold, path, nodes)

    def score(self, x: np.ndarray) -> np.ndarray:
        return forest_score(x, self.arrays())

    def arrays(self) -> tuple:
        return self.sample, self.feature, self.threshold, self.path


def forest_score(x: np.ndarray, forest: tuple) -> np.ndarray:
    """M4: -2^(-mean path / c(sample)) of each row; lower is more anomalous."""
    sample, feature, threshold, path = forest
    out = np.empty(len(x))
    norm = len(path) * max(float(average_path(sample)), 1e-12)
    for start in range(0, len(x), SCORE_CHUNK):
        part = np.ascontiguousarray(x[start : start + SCORE_CHUNK])
        out[start : start + SCORE_CHUNK] = -np.exp2(-_path_sum(part, feature, threshold, path) / norm)
    return out


def _path_sum(x: np.ndarray, feature: np.ndarray, threshold: np.ndarray, path: np.ndarray) -> np.ndarray:
    """Sum over the trees of each row's path length; all rows of the chunk step down one level at a time."""
    n, width = x.shape
    flat, first = x.ravel(), np.arange(n) * width
    total, inner = np.zeros(n), feature.shape[1]
    node, at = np.empty(n, np.intp), np.empty(n, np.intp)
    value, limit, above = np.empty(n), np.empty(n), np.empty(n, bool)
    levels = int(math.log2(path.shape[1]))
    for feat, thr, lengths in zip(feature, threshold, path):
        np.add(x[:, feat[0]] > thr[0], 1, out=node)
        for _ in range(levels - 1):
            np.take(feat, node, out=at, mode="clip")
            at += first
            np.take(flat, at, out=value, mode="clip")
            np.take(thr, node, out=limit, mode="clip")
            np.greater(value, limit, out=above)
            node *= 2
            node += 1
            node += above
        node -= inner
        total += np.take(lengths, node, out=value, mode="clip")
    return total


def score_column(spark: SparkSession, forest: Forest, inputs: list[Column]) -> Column:
    """The score as a column. The forest (at most trees * 2^depth nodes) is broadcast; no shuffle."""
    shared = spark.sparkContext.broadcast(forest.arrays())

    @F.pandas_udf("double")
    def score(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        arrays = shared.value
        for batch in batches:
            x = np.column_stack([s.to_numpy(dtype="float64") for s in batch])
            yield pd.Series(forest_score(x, arrays))

    return score(*inputs)


def score_rows(scaled: DataFrame, forest: Forest) -> DataFrame:
    """M4: add ``raw_score`` to a table of scaled features."""
    column = score_column(scaled.sparkSession, forest, [F.col(c) for c in forest.columns])
    return scaled.withColumn("raw_score", column)


def _unit(*parts: Column) -> Column:
    """Uniform double in [0, 1) from a hash."""
    return F.shiftrightunsigned(F.xxhash64(*parts), 2) / F.lit(float(2**62))


def tree_samples(
    data: DataFrame, columns: list[str], rows: int, trees: int, sample: int, seed: int, key: list[str] | None, factor: float
) -> DataFrame:
    """Uniform draws for each tree, a little more than needed: (tree, u, features). One pass, no shuffle of the input.

    A row joins ``rate`` trees on average: with n draws the i-th is a random tree of the i-th of n equal spans of trees.
    ``key`` must tell rows apart; without it rows are told apart by their position in the input.
    """
    ident = [F.col(c) for c in key] if key else [F.monotonically_increasing_id()]
    rate = min(float(trees), factor * sample * trees / rows)
    keyed = data.select(*columns, F.xxhash64(F.lit(seed), *ident).alias("_h"))
    count = F.floor(F.lit(rate) + _unit(F.col("_h"), F.lit("draws"))).cast("int")
    draws = keyed.withColumn("_n", count).where("_n > 0")

    def pick(i: Column) -> Column:
        return F.floor((i + _unit(F.col("_h"), i)) * F.lit(float(trees)) / F.col("_n")).cast("int")

    picks = F.array_distinct(F.transform(F.sequence(F.lit(0), F.col("_n") - 1), pick))
    drawn = draws.select(*columns, "_h", F.explode(picks).alias("tree"))
    return drawn.withColumn("u", _unit(F.col("_h"), F.col("tree"), F.lit("order"))).drop("_h")


def forest_nodes(
    data: DataFrame,
    columns: list[str],
    rows: int,
    trees: int = TREES,
    sample: int = SAMPLE,
    seed: int = 42,
    key: list[str] | None = None,
    factor: float = OVERSAMPLE,
) -> DataFrame:
    """M3: the forest as a node table. Each group holds about ``factor * sample`` rows, whatever the input size.

    A tree whose draw fell short is returned as one row with node -1.
    """
    size = min(sample, rows)
    limit = math.ceil(math.log2(max(size, 2)))
    names = list(columns)

    def grow(part: pd.DataFrame) -> pd.DataFrame:
        tree = int(part["tree"].iloc[0])
        fields = ["node", "feature", "threshold", "left", "right", "size", "depth"]
        if len(part) < size:
            out = pd.DataFrame([(-1, -1, 0.0, -1, -1, len(part), 0)], columns=fields)
        else:
            first = part.sort_values(["u", *names]).head(size)
            x = first[names].to_numpy(dtype="float64")
            out = pd.DataFrame(grow_tree(x, limit, np.random.default_rng([seed, tree])), columns=fields)
        out.insert(0, "tree", tree)
        return out

    draws = tree_samples(data, names, rows, trees, size, seed, key, factor)
    return draws.groupBy("tree").applyInPandas(grow, NODE_SCHEMA)


def fit_forest(
    data: DataFrame,
    columns: list[str],
    trees: int = TREES,
    sample: int = SAMPLE,
    seed: int = 42,
    key: list[str] | None = None,
    rows: int | None = None,
) -> Forest:
    """M3: grow the forest and bring its nodes (at most trees * 2 * sample) to the driver; a short draw is repeated."""
    rows = data.count() if rows is None else rows
    if rows == 0:
        raise ValueError("nothing to train on")
    factor = OVERSAMPLE
    while True:
        nodes = forest_nodes(data, columns, rows, trees, sample, seed, key, factor).toPandas()
        if len(nodes) and nodes["tree"].nunique() == trees and nodes["node"].min() == 0:
            return Forest.from_nodes(nodes, columns, min(sample, rows))
        if factor * min(sample, rows) >= rows:
            raise ValueError("there are fewer rows than stated")
        factor *= 2
