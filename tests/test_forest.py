"""The forest of histograms against one grown node by node from the rows."""

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from stratamart.ml import forest, training


def plain_tree(x, y, weight, tree, depth, min_split, seed, cuts):
    """{path: (counts, split)} of one tree; a path is the turns taken from the root."""
    b = forest.binned(x, cuts)
    numbers = {"": 0}
    out, level, following = {}, [("", np.flatnonzero(weight > 0))], 1
    for at in range(depth + 1):
        next_level = []
        for path, rows in level:
            w = [int(weight[rows][y[rows] == c].sum()) for c in (0, 1)]
            best = None
            if at < depth and len(rows) >= min_split and all(w):
                for f in forest.chosen(tree, numbers[path], x.shape[1], seed):
                    for cut in np.unique(b[rows, f])[:-1]:
                        side = b[rows, f] <= cut
                        lw = [int(weight[rows][side & (y[rows] == c)].sum()) for c in (0, 1)]
                        rw = [w[0] - lw[0], w[1] - lw[1]]
                        pure = (lw[0] ** 2 + lw[1] ** 2) / sum(lw) + (rw[0] ** 2 + rw[1] ** 2) / sum(rw)
                        if best is None or pure > best[0]:
                            best = (pure, f, int(cut))
            out[path] = (tuple(w), best and best[1:])
            if best:
                side = b[rows, best[1]] <= best[2]
                numbers[path + "l"], numbers[path + "r"] = following, following + 1
                following += 2
                next_level += [(path + "l", rows[side]), (path + "r", rows[~side])]
        level = next_level
    return out


def paths(tree, node=0, path=""):
    split = (tree.feature[node], tree.bin[node]) if tree.feature[node] >= 0 else None
    out = {path: (tuple(tree.counts[node]), split)}
    if split:
        out |= paths(tree, tree.left[node], path + "l") | paths(tree, tree.left[node] + 1, path + "r")
    return out


@pytest.mark.parametrize("bins,passes", [(256, 10**9), (8, 60)])
def test_equal_to_a_plain_forest(spark, monkeypatch, bins, passes):
    monkeypatch.setattr(forest, "PASS_COUNTS", passes)
    dealt = np.random.default_rng(4)
    x = np.round(dealt.normal(size=(150, 5)), 1)
    y = ((x[:, 0] + x[:, 1] > 0) ^ (dealt.random(150) < 0.1)).astype(int)
    df = spark.createDataFrame([(i, *map(float, r), float(t)) for i, (r, t) in enumerate(zip(x, y))], "id int, a double, b double, c double, d double, e double, y double").repartition(5)
    ready = VectorAssembler(inputCols=list("abcde"), outputCol="v").transform(df)
    model = forest.HistogramForest("v", "y", ["id"], 6, 4, 5, 42, bins).fit(ready)
    keys = np.array([r[0] for r in df.orderBy("id").select(F.xxhash64("id")).collect()], np.int64)
    cuts = [np.array(c) for c in model._state["cuts"]]
    if bins == 256:
        assert all(np.allclose(c, (u[1:] + u[:-1]) / 2) for c, u in zip(cuts, map(np.unique, x.T)))
    assert all(len(c) < bins for c in cuts)
    for t, tree in enumerate(model.trees()):
        found = paths(tree)
        assert found == plain_tree(x, y, forest.draws(keys, t, 42), t, 4, 5, 42, cuts)
    scored = model.transform(ready).orderBy("id").select(vector_to_array("probability").alias("p"), "prediction").collect()
    shares = [np.mean([tree.counts[n][1] / max(sum(tree.counts[n]), 1) for tree in model.trees() for n in [tree.leaves(forest.binned(x[[i]], cuts), 4)[0]]]) for i in range(150)]
    assert [r.p[1] for r in scored] == pytest.approx(shares) and [r.prediction for r in scored] == [float(s > 0.5) for s in shares]
    assert model.featureImportances.toArray().sum() == pytest.approx(1) and model.featureImportances.toArray()[:2].sum() > 0.5


def test_draws_are_of_mean_one_and_repeat():
    keys = np.random.default_rng(1).integers(-2**63, 2**63 - 1, 20_000)
    weight = forest.draws(keys, 3, 42)
    assert abs(weight.mean() - 1) < 0.03 and abs((weight == 0).mean() - np.exp(-1)) < 0.02
    assert (weight == forest.draws(keys, 3, 42)).all() and (weight != forest.draws(keys, 4, 42)).any()


def test_small_nodes_and_odd_tables(spark, tmp_path):
    schema = "id int, a double, y int"
    few = spark.createDataFrame([(i, float(i), i % 2) for i in range(4)], schema)
    model = training.train_classifier(few, ["a"], "y", trees=8, depth=3, key=["id"])
    assert all(tree.feature == [-1] for tree in model.stages[-1].trees())  # under 5 rows nothing is split
    one_class = training.train_classifier(few.withColumn("y", F.lit(1)), ["a"], "y", trees=4, depth=3)
    assert one_class.transform(few).select("prediction").distinct().collect()[0][0] == 1.0
    with pytest.raises(ValueError, match="0 or 1"):
        training.train_classifier(few.withColumn("y", F.lit(2)), ["a"], "y", trees=2)
    many = spark.range(3000).selectExpr("CAST(id AS INT) AS id", "IF(id % 50 = 0, NULL, id * 1.0D) AS a", "CAST(id > 1234 AS INT) AS y")
    model = training.train_classifier(many, ["a"], "y", trees=5, depth=3, key=["id"])
    scored = model.transform(many.where("a IS NOT NULL"))
    assert scored.where("prediction <> y").count() < 40
    model.write().save(str(tmp_path / "m"))
    again = PipelineModel.load(str(tmp_path / "m")).transform(many)
    assert again.select("id", "prediction").exceptAll(model.transform(many).select("id", "prediction")).count() == 0
