"""A random forest of binary classes, grown level by level from histograms.

Each feature has at most ``bins`` - 1 places to split at, so what a node has to know are counts per
(feature, bin, class). All open nodes of a group of trees are served by one pass: tasks walk their
rows down the trees grown so far, count, and Spark adds the counts up and finds the best split of
every node. Only splits reach the driver, at most one a node. A tree's rows are drawn with
replacement by a hash of the row's key (Poisson weights), so a lost task draws the same rows again.

A node is split if it has ``min_split`` drawn rows or more of both classes; each child has at least
one. The split of the least weighted Gini impurity is taken, of equal ones that of the first feature
and the lowest place.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import DenseVector, Vectors
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stratamart.session import ship_package, stable

BINS = 256
PASS_COUNTS = 4_000_000  # counts that a pass may send from a task
_POISSON = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(16)])


def mixed(x: np.ndarray) -> np.ndarray:
    """64 well-spread bits of each number (the finalizer of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def draws(keys: np.ndarray, tree: int, seed: int) -> np.ndarray:
    """How often a tree draws each row: Poisson of mean one, by the row's key."""
    salt = mixed(np.array([seed * 1_000_003 + tree], np.uint64))
    unit = (mixed(keys.view(np.uint64) + salt) >> np.uint64(11)).astype(np.float64) / (1 << 53)
    return np.searchsorted(_POISSON, unit, side="right")


def chosen(tree: int, node: int, features: int, seed: int) -> list[int]:
    """The features a node may split on: the root of their number, rounded up, by a hash."""
    salt = mixed(np.array([(seed * 1_000_003 + tree) * 1_000_003 + node], np.uint64))
    order = np.argsort(mixed(np.arange(1, features + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + salt), kind="stable")
    return sorted(order[:math.ceil(math.sqrt(features))].tolist())


class Tree:
    """Nodes as lists: the feature and bin split on (rows of that bin or less go left; feature -1: a
    leaf), the left child (the right one follows) and the drawn weight of both classes."""

    def __init__(self) -> None:
        self.feature: list[int] = [-1]
        self.bin: list[int] = [0]
        self.left: list[int] = [0]
        self.counts: list[tuple[int, int]] = [(0, 0)]

    def grow(self, node: int, feature: int, at: int, left: tuple[int, int], right: tuple[int, int]) -> tuple[int, int]:
        self.feature[node], self.bin[node], self.left[node] = feature, at, len(self.left)
        for counts in (left, right):
            self.feature.append(-1)
            self.bin.append(0)
            self.left.append(0)
            self.counts.append(counts)
        return self.left[node], self.left[node] + 1

    def leaves(self, binned: np.ndarray, depth: int) -> np.ndarray:
        """The node that each row of ``binned`` (rows x features) comes to."""
        feature, at, left = (np.array(x) for x in (self.feature, self.bin, self.left))
        node, rows = np.zeros(len(binned), np.int64), np.arange(len(binned))
        for _ in range(depth):
            own = feature[node]
            down = left[node] + (binned[rows, np.maximum(own, 0)] > at[node])
            node = np.where(own >= 0, down, node)
        return node


def binned(values: np.ndarray, cuts: Sequence[np.ndarray]) -> np.ndarray:
    """For each value how many of its feature's cuts are below it."""
    return np.stack([np.searchsorted(c, values[:, k], side="left") for k, c in enumerate(cuts)], 1) if len(cuts) else np.zeros((len(values), 0), int)


def _cuts(rows: DataFrame, features: int, bins: int) -> list[np.ndarray]:
    """Places to split at: halfway between neighbouring distinct values if a feature has at most
    ``bins`` of them, else between values at even ranks."""
    values = rows.select(F.posexplode("x").alias("k", "v")).where("NOT isnan(v)")
    few = values.groupBy("k", "v").count().groupBy("k").agg(F.count("*").alias("n"))
    n = {r["k"]: r["n"] for r in few.collect()}
    even = [i / bins for i in range(1, bins)]
    parts = {r["k"]: r["p"] for r in values.groupBy("k").agg(F.percentile_approx("v", even, 100_000).alias("p")).collect()} if any(c > bins for c in n.values()) else {}
    exact = values.where(F.col("k").isin([k for k, c in n.items() if c <= bins])).distinct().collect()
    out = []
    for k in range(features):
        if n.get(k, 0) > bins:
            out.append(np.unique(np.array(parts[k], np.float64)))
        else:
            own = np.unique([r["v"] for r in exact if r["k"] == k]) + 0.0
            out.append((own[1:] + own[:-1]) / 2)
    return out


def _added(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Counts by cell (the first row), added up."""
    every = np.concatenate([a, b], axis=1)
    cells, place = np.unique(every[0], return_inverse=True)
    return np.stack([cells, *[np.bincount(place, every[k], len(cells)).astype(np.int64) for k in range(1, len(every))]])


def _count(trees: dict[int, Tree], slots: dict[int, dict[int, int]], allowed: dict[int, np.ndarray], cuts: list[np.ndarray], depth: int, seed: int):
    """Counts ``(tree, node, feature, bin, w0, w1, rows)`` of a task's rows in the open nodes."""
    width = max(map(len, cuts), default=0) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            keys = batch.column(0).to_numpy(zero_copy_only=False)
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(len(keys), -1)
            label = batch.column(2).to_numpy(zero_copy_only=False).astype(np.int64)
            b = binned(x, cuts)
            for t, open_ in slots.items():
                weight = draws(keys, t, seed)
                number = np.full(len(trees[t].feature), -1)
                number[list(open_)] = list(open_.values())
                slot = number[trees[t].leaves(b, depth)]
                some = np.flatnonzero((slot >= 0) & (weight > 0))
                own = allowed[t][slot[some]]
                cell = ((slot[some, None] * own.shape[1] + np.arange(own.shape[1])) * width + b[some[:, None], own]).ravel()
                times = own.shape[1]
                w, y = np.repeat(weight[some], times), np.repeat(label[some], times)
                cells, place = np.unique(cell, return_inverse=True)
                part = np.stack([cells, np.bincount(place, w * (y == 0), len(cells)).astype(np.int64),
                                 np.bincount(place, w * (y == 1), len(cells)).astype(np.int64), np.bincount(place, minlength=len(cells))])
                held[t] = _added(held[t], part) if t in held else part
        for t, (cells, *sums) in held.items():
            times = allowed[t].shape[1]
            slot, j, at = cells // width // times, cells // width % times, cells % width
            node = np.array(list(slots[t]))[slot]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in (np.full(len(cells), t), node, allowed[t][slot, j], at, *sums)],
                                             ["tree", "node", "feature", "bin", "w0", "w1", "n"])

    return run


def _best_splits(counts: DataFrame) -> DataFrame:
    """Per open node its totals and its best split, if it has one."""
    summed = counts.groupBy("tree", "node", "feature", "bin").agg(*[F.sum(c).alias(c) for c in ("w0", "w1", "n")])
    group = Window.partitionBy("tree", "node", "feature")
    upto = group.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    sums = summed.select("tree", "node", "feature", "bin", *[F.sum(c).over(upto).alias(f"l{c}") for c in ("w0", "w1", "n")],
                         *[F.sum(c).over(group).alias(c) for c in ("w0", "w1", "n")])
    left, right = F.col("lw0") + F.col("lw1"), F.col("w0") + F.col("w1") - F.col("lw0") - F.col("lw1")

    def square(c):
        return c.cast("double") * c.cast("double")

    # the sum of squares over the weight of each side: the greater, the purer
    pure = (square(F.col("lw0")) + square(F.col("lw1"))) / left + (square(F.col("w0") - F.col("lw0")) + square(F.col("w1") - F.col("lw1"))) / right
    split = F.when(right > 0, F.struct(pure.alias("pure"), (-F.col("feature")).alias("feature"), (-F.col("bin")).alias("bin"), "lw0", "lw1", "ln"))
    best = sums.groupBy("tree", "node").agg(F.first("w0").alias("w0"), F.first("w1").alias("w1"), F.first("n").alias("n"), F.max(split).alias("s"))
    return best.select("tree", "node", "w0", "w1", "n", "s.pure", (-F.col("s.feature")).alias("feature"), (-F.col("s.bin")).alias("bin"), "s.lw0", "s.lw1", "s.ln")


class HistogramForestModel(Model, DefaultParamsReadable, DefaultParamsWritable):
    """A grown forest; ``nodes`` holds its trees and cuts as JSON."""

    nodes = Param(Params._dummy(), "nodes", "trees, cuts and importances", typeConverter=TypeConverters.toString)
    featuresCol = Param(Params._dummy(), "featuresCol", "the vector of features", typeConverter=TypeConverters.toString)

    def __init__(self, nodes: str = "", features_col: str = "features") -> None:
        super().__init__()
        self._set(nodes=nodes, featuresCol=features_col)

    @property
    def _state(self) -> dict:
        return json.loads(self.getOrDefault(self.nodes))

    @property
    def featureImportances(self) -> DenseVector:
        return Vectors.dense(self._state["importances"])

    def trees(self) -> list[Tree]:
        out = []
        for parts in self._state["trees"]:
            tree = Tree()
            tree.feature, tree.bin, tree.left, tree.counts = (parts[k] for k in ("feature", "bin", "left", "counts"))
            out.append(tree)
        return out

    def _transform(self, dataset: DataFrame) -> DataFrame:
        """The rows with ``probability``, a vector of both classes, and ``prediction``."""
        ship_package(dataset.sparkSession)
        state, trees = self._state, self.trees()
        cuts, depth = [np.array(c) for c in state["cuts"]], state["depth"]
        shares = [np.array([b / max(a + b, 1) for a, b in tree.counts]) for tree in trees]

        @F.pandas_udf("double")
        def positive(x: pd.Series) -> pd.Series:
            if not len(x):
                return pd.Series([], dtype="float64")
            b = binned(np.stack(x.to_numpy()).astype(np.float64), cuts)
            return pd.Series(sum(share[tree.leaves(b, depth)] for tree, share in zip(trees, shares, strict=True)) / len(trees))

        share = dataset.withColumn("_share", positive(vector_to_array(self.getOrDefault(self.featuresCol))))
        return share.withColumns({"probability": array_to_vector(F.array(1 - F.col("_share"), F.col("_share"))),
                                  "prediction": F.when(F.col("_share") > 0.5, 1.0).otherwise(0.0)}).drop("_share")


class HistogramForest(Estimator):
    """Grows a ``HistogramForestModel`` on a vector column and a label of 0 and 1."""

    def __init__(self, features_col: str, label_col: str, key: Sequence[str], trees: int, depth: int, min_split: int, seed: int, bins: int = BINS) -> None:
        super().__init__()
        self.columns, self.key = (features_col, label_col), list(key)
        self.sizes = (trees, depth, min_split, seed, bins)

    def _fit(self, dataset: DataFrame) -> HistogramForestModel:
        features_col, label_col = self.columns
        count, depth, min_split, seed, bins = self.sizes
        ship_package(dataset.sparkSession)
        rows = stable(dataset.select(F.xxhash64(*[F.col(f"`{k}`") for k in self.key]).alias("key"), vector_to_array(features_col).alias("x"), F.col(label_col).cast("double").alias("y")))
        seen = rows.agg(F.max(F.size("x")), F.count_if(F.col("y").isNull() | ~F.col("y").isin(0.0, 1.0)), F.count("*")).first()
        if seen[1]:
            raise ValueError("the label has to be 0 or 1")
        features = seen[0] or 0
        cuts = _cuts(rows, features, bins) if seen[2] else [np.zeros(0)] * features
        trees = {t: Tree() for t in range(count)}
        gains = np.zeros((count, features))
        opened = {t: [0] for t in trees} if seen[2] and features else {}
        width = max(map(len, cuts), default=0) + 1
        for level in range(max(depth, 1)):
            following: dict[int, list[int]] = {}
            times = math.ceil(math.sqrt(features))
            for group in _groups(opened, width * times, seen[2] * times):
                slots = {t: {node: k for k, node in enumerate(opened[t])} for t in group}
                allowed = {t: np.array([chosen(t, node, features, seed) for node in opened[t]]) for t in group}
                run = _count({t: trees[t] for t in group}, slots, allowed, cuts, level, seed)
                counts = rows.mapInArrow(run, "tree bigint, node bigint, feature bigint, bin bigint, w0 bigint, w1 bigint, n bigint")
                for r in sorted(_best_splits(counts).collect(), key=lambda r: (r["tree"], r["node"])):
                    tree = trees[r["tree"]]
                    if r["node"] == 0:
                        tree.counts[0] = (r["w0"], r["w1"])
                    if not depth or r["n"] < min_split or not r["w0"] or not r["w1"] or r["pure"] is None:
                        continue
                    sides = (r["lw0"], r["lw1"]), (r["w0"] - r["lw0"], r["w1"] - r["lw1"])
                    children = tree.grow(r["node"], r["feature"], r["bin"], *sides)
                    weight = r["w0"] + r["w1"]
                    gains[r["tree"], r["feature"]] += max(r["pure"] - (r["w0"] ** 2 + r["w1"] ** 2) / weight, 0.0)
                    rows_of = (r["ln"], r["n"] - r["ln"])
                    wanted = [c for c, side, n in zip(children, sides, rows_of, strict=True) if n >= min_split and side[0] and side[1]]
                    if level + 1 < depth:
                        following.setdefault(r["tree"], []).extend(wanted)
            opened = {t: nodes for t, nodes in following.items() if nodes}
            if not opened:
                break
        sums = gains.sum(axis=1, keepdims=True)
        shares = np.divide(gains, sums, out=np.zeros_like(gains), where=sums > 0).sum(axis=0)
        importances = (shares / shares.sum() if shares.sum() else shares).tolist()
        state = {"cuts": [c.tolist() for c in cuts], "depth": depth, "importances": importances,
                 "trees": [{"feature": t.feature, "bin": t.bin, "left": t.left, "counts": t.counts} for t in trees.values()]}
        return HistogramForestModel(json.dumps(state), features_col)


def _groups(opened: dict[int, list[int]], counts: int, most: int) -> Iterator[list[int]]:
    """Trees whose open nodes are served by one pass: a tree may have ``counts`` a node, and ``most`` in all."""
    group, held = [], 0
    for t, nodes in opened.items():
        own = min(len(nodes) * counts, most)
        if group and held + own > PASS_COUNTS:
            yield group
            group, held = [], 0
        group.append(t)
        held += own
    if group:
        yield group
