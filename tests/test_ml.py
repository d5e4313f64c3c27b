import math

import numpy as np
import pytest
from table_rows import rows
from pyspark.sql import functions as F

from stratamart.checks import science
from stratamart.ml import features, scoring, segments, training
from stratamart.ml.scoring import NamedModel
from stratamart.ml.store import ModelStore
from stratamart.operators.search import semantic_topk, semantic_topk_batch
from stratamart.sources import Tables


@pytest.fixture(scope="module")
def t(spark, small):
    return Tables(spark, small)


@pytest.fixture(scope="module")
def churn(t):
    return features.churn_features(science.churn_base(t)).cache()


@pytest.fixture(scope="module")
def forest(churn):
    model = training.train_classifier(churn, science.CHURN_FEATURES, "churned", trees=5, depth=4)
    return NamedModel("churn", model, science.CHURN_FEATURES)


def test_split_is_whole_disjoint_and_repeatable(spark):
    df = spark.range(20_000)
    train, test = training.train_test_split(df, "id")
    assert train.count() + test.count() == 20_000 and train.intersect(test).count() == 0
    assert 0.18 < test.count() / 20_000 < 0.22
    again = training.train_test_split(df.repartition(7), "id")[1]
    assert again.exceptAll(test).count() == 0


def test_classification_identities(spark):
    def rates(data):
        return training.eval_classification(spark.createDataFrame(data, "l int, p int"), "l", "p").first()

    assert tuple(rates([(0, 0), (1, 1)])) == (1.0, 1.0, 1.0, 1.0)
    assert tuple(rates([(0, 1), (1, 0)])) == (0.0, 0.0, 0.0, 0.0)
    one_sided = rates([(0, 0), (0, 0), (0, 0), (1, 0)])  # class 1 is never predicted
    assert one_sided.accuracy == 0.75 and one_sided.precision == pytest.approx(0.5625)


def test_auc(spark):
    df = spark.createDataFrame([(0, 0.1), (0, 0.4), (1, 0.35), (1, 0.8)], "l int, s double")
    assert training.roc_auc(df, "l", "s") == pytest.approx(0.75)


def test_regression(spark):
    df = spark.createDataFrame([(1.0, 1.5), (2.0, 2.0), (3.0, 2.5)], "y double, p double")
    got = training.eval_regression(df, "y", "p").first()
    assert got.mse == pytest.approx(1 / 6) and got.rmse == pytest.approx(math.sqrt(1 / 6))
    assert got.mae == pytest.approx(1 / 3) and got.r2_score == pytest.approx(0.75)


def test_encoding_is_alphabetical(spark):
    df = spark.createDataFrame([("b",), ("a",), ("C",), (None,)], "c string")
    coded = training.encode_categoricals(df.withColumn("text", F.col("c")), ["c"])
    assert rows(coded) == [(0, "C"), (1, None), (2, "a"), (3, "b")]


def test_forest_learns_the_rule_and_repeats(churn, forest):
    scored = scoring.predict(forest, churn)
    assert training.eval_classification(scored, "churned", "churn_prediction").first().accuracy > 0.9
    again = NamedModel("churn", training.train_classifier(churn, forest.features, "churned", trees=5, depth=4), forest.features)
    both = scored.join(scoring.predict(again, churn).select("customer_id", F.col("churn_prediction").alias("p")), "customer_id")
    assert both.where("churn_prediction <> p").count() == 0
    assert scored.count() == churn.count()


def test_probabilities_and_missing_features(churn, forest, spark):
    proba = scoring.predict(forest, churn, proba=True)
    assert proba.where((F.col("churn_proba") < 0) | (F.col("churn_proba") > 1)).count() == 0
    with pytest.raises(ValueError, match="missing features: recency"):
        scoring.predict(forest, churn.drop("recency"))
    row = churn.first().asDict()
    one = scoring.predict_one(forest, spark, {f: row[f] for f in forest.features}, proba=True)
    assert one == pytest.approx(proba.where(F.col("customer_id") == row["customer_id"]).first().churn_proba)


def test_importance_is_ranked(forest, spark):
    got = scoring.feature_importance(forest, spark, limit=3).collect()
    assert len(got) == 3 and got[0].importance >= got[1].importance >= got[2].importance
    assert sum(r.importance for r in scoring.feature_importance(forest, spark, 99).collect()) == pytest.approx(1)


def test_categorical_features(spark):
    data = [(f"{i % 2}-{i}", None if i % 10 == 0 else float(i), i % 2) for i in range(100)]  # 100 categories
    df = spark.createDataFrame(data, "contract string, charge double, churned int")
    model = training.train_classifier(df, ["contract", "charge"], "churned", ["contract"], trees=9, depth=5)
    scored = scoring.predict(NamedModel("m", model, ["contract", "charge"]), df)
    assert scored.where("m_prediction <> churned").count() == 0


def test_store(spark, forest, tmp_path):
    store = ModelStore(spark, str(tmp_path))
    assert store.list_models().count() == 0
    with pytest.raises(ValueError, match="no model 'churn'"):
        store.load("churn")
    assert store.register(forest.model, "churn", "classification", forest.features, "churned", "1", {"accuracy": 0.5}) == "churn_v1"
    store.register(forest.model, "churn", "classification", forest.features, "churned", "2", tags=["b"])
    assert [r.version for r in store.versions("churn").collect()] == ["2", "1"]
    assert store.metadata("churn", "1")["metrics"] == {"accuracy": 0.5}
    assert store.metadata("churn")["version"] == "2"
    assert store.load("churn").features == forest.features
    store.delete("churn", "2")
    assert store.metadata("churn")["version"] == "1" and store.list_models().first().total_versions == 1
    store.delete("churn")
    assert store.records().count() == 0
    with pytest.raises(ValueError):
        store.load("churn")


def test_segments(t):
    found = science.rfm(t)
    got = segments.assign_segments(segments.train_segments(found), found)
    assert got.count() == found.count() and got.select("segment").distinct().count() == 4
    assert segments.segment_profile(got).agg(F.sum("customers")).first()[0] == found.count()


def test_risk_bands(spark):
    df = spark.createDataFrame([(0.71,), (0.7,), (0.41,), (0.4,)], "p double")
    assert [r[0] for r in df.select(scoring.risk_band(F.col("p"))).collect()] == ["HIGH", "MEDIUM", "MEDIUM", "LOW"]


def test_search_matches_brute_force(t, spark):
    vectors = {r.vec_id: np.array(r.embedding, dtype=float) for r in t.embeddings.collect()}
    query = vectors[3]
    scores = sorted(((-v @ query / np.linalg.norm(v) / np.linalg.norm(query), k) for k, v in vectors.items()))
    want = [(k, -s) for s, k in scores if -s >= 0.1][:7]
    got = [tuple(r) for r in semantic_topk(t.embeddings, list(query), "vec_id", "embedding", 7, 0.1).collect()]
    assert [k for k, _ in got] == [k for k, _ in want]
    assert [s for _, s in got] == pytest.approx([s for _, s in want])


def test_search_edge_cases(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [-1.0, 0.0])], "id int, v array<float>")
    assert rows(semantic_topk(df, [2.0, 0.0], "id", "v")) == [(1, 1.0)]
    with pytest.raises(ValueError):
        semantic_topk(df, [0.0, 0.0], "id", "v")
    with pytest.raises(Exception, match="every vector needs 3"):
        semantic_topk(df, [1.0, 0.0, 0.0], "id", "v").collect()


@pytest.mark.parametrize("blocks", [(8192, 32768), (7, 11)])
def test_batch_search_in_blocks(spark, blocks):
    dealt = np.random.default_rng(2)
    vectors = dealt.normal(size=(60, 4))
    vectors[10:14] = vectors[9]  # equal scores go by id
    corpus = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)] + [(100, [0.0] * 4), (101, None)], "id int, v array<double>")
    queries = corpus.where("id % 3 = 0 OR id >= 100").union(corpus.where("id = 3"))  # a query twice
    got = sorted(tuple(r) for r in semantic_topk_batch(corpus, queries, "id", "v", 5, 0.1, *blocks).collect())
    unit = vectors / np.linalg.norm(vectors, axis=1)[:, None]
    want = []
    for q in [*range(0, 60, 3), 3]:
        scores = np.round(unit @ unit[q], 12)
        want += [(q, i, scores[i]) for i in sorted(range(60), key=lambda i: (-scores[i], i))[:5] if scores[i] >= 0.1]
    assert [r[:2] for r in got] == [r[:2] for r in sorted(want)]
    assert [r[2] for r in got] == pytest.approx([r[2] for r in sorted(want)])
    assert semantic_topk_batch(corpus, queries.limit(0), "id", "v").count() == 0
    with pytest.raises(ValueError, match="same number"):
        semantic_topk_batch(corpus, spark.createDataFrame([(1, [1.0])], "id int, v array<double>"), "id", "v")


def test_batch_search_scans_the_corpus_once_and_collects_no_vector(t, spark):
    found = semantic_topk_batch(t.embeddings, t.embeddings, "vec_id", "embedding", query_block=100, corpus_block=64)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("embeddings.parquet") == 0 and plan.count("MapInArrow") == 0  # both sides were read before, once
    assert found.count() > 0


def test_codes_of_many_columns(spark):
    df = spark.createDataFrame([("b", "x", 1), ("a", None, 2), ("b", "y", 3), ("é", "x", 4)], "c string, d string, n int")
    assert rows(training.encode_categoricals(df, ["c", "d"])) == [(0, 0, 2), (1, 1, 1), (1, 2, 3), (2, 1, 4)]
    assert training.encode_categoricals(df, []).columns == df.columns
