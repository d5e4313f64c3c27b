"""Features, models, scoring and vector search.

Trained models have no SQL counterpart: their queries state what has to hold of any good model
(rows, ranges, totals, quality), and tests check the rest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratamart.checks.registry import ORDERS_AS_OF, check, orders_mart
from stratamart.checks.sql import VIEWS, exact_avg
from stratamart.ml import features, scoring, segments, training
from stratamart.ml.scoring import NamedModel
from stratamart.ml.store import ModelStore
from stratamart.operators.search import semantic_topk, semantic_topk_batch
from stratamart.session import scratch_path, stable
from stratamart.sources import Tables
from stratamart.sources import raw

TODAY = "DATE '2001-08-01'"
CHURN_FEATURES = ["recency", "frequency", "monetary", "avg_order_value", "days_since_signup", "avg_spend_per_order",
                  "engagement_score"]

VIEWS["rfm"] = f"""
SELECT customer_id, count(*) AS order_count, sum(total_amount) AS total_spent, {exact_avg('total_amount')}
  AS avg_order_value, max(order_date) AS last_order_date,
  date_diff('day', CAST(max(order_date) AS DATE), {TODAY}) AS recency_days
FROM raw_orders GROUP BY customer_id
"""
VIEWS["churn_base"] = f"""
SELECT customer_id, recency_days AS recency, order_count AS frequency, total_spent AS monetary, avg_order_value,
  date_diff('day', CAST(created_at AS DATE), {TODAY}) AS days_since_signup,
  CASE WHEN recency_days > 90 THEN 1 ELSE 0 END AS churned
FROM rfm JOIN raw_customers c ON c.id = customer_id
"""


def rfm(t: Tables) -> DataFrame:
    return features.rfm_features(raw.orders(t).withColumnRenamed("id", "order_id"), ORDERS_AS_OF)


def churn_base(t: Tables) -> DataFrame:
    ctx = orders_mart(t)
    return features.churn_base_table(ctx.ref("stg_orders"), ctx.ref("stg_customers"), ORDERS_AS_OF)


@check("rfm_features", "long: customer_id order_count recency_days, double: total_spent avg_order_value, "
       "text: last_order_date", "SELECT * FROM rfm")
def rfm_features(t: Tables) -> DataFrame:
    return rfm(t)


@check("churn_base_table", "long: customer_id recency frequency days_since_signup churned, "
       "double: monetary avg_order_value", "SELECT * FROM churn_base")
def churn_base_table(t: Tables) -> DataFrame:
    return churn_base(t)


@check("churn_features", "long: customer_id churned, double: monetary frequency recency avg_spend_per_order "
       "engagement_score",
       """SELECT customer_id, churned,
            round(least(CAST(monetary AS DOUBLE), (SELECT quantile_cont(CAST(monetary AS DOUBLE), 0.99) FROM churn_base)), 4)
              AS monetary,
            round(least(frequency, (SELECT quantile_cont(CAST(frequency AS DOUBLE), 0.99) FROM churn_base)), 4) AS frequency,
            round(least(recency, (SELECT quantile_cont(CAST(recency AS DOUBLE), 0.99) FROM churn_base)), 4) AS recency,
            CAST(monetary AS DOUBLE) / (frequency + 1) AS avg_spend_per_order,
            CAST(frequency AS DOUBLE) / (recency + 1) AS engagement_score FROM churn_base""")
def churn_features(t: Tables) -> DataFrame:
    made = features.churn_features(churn_base(t))
    return made.withColumns({c: F.round(c, 4) for c in ("monetary", "frequency", "recency")})


@check("churn_label_rule", "long: customer_id churned, double: churn_score",
       """WITH s AS (SELECT customer_id, recency / (SELECT CAST(max(recency) AS DOUBLE) FROM churn_base)
            - frequency / (SELECT CAST(max(frequency) AS DOUBLE) FROM churn_base) AS score FROM churn_base)
          SELECT customer_id, round(score, 9) AS churn_score, CAST(score > 0.2 AS INT) AS churned FROM s""")
def churn_label_rule(t: Tables) -> DataFrame:
    return features.churn_labels(churn_base(t)).withColumn("churn_score", F.round("churn_score", 9))


@check("train_test_split", "long: churned rows customers test_rows",
       "SELECT o_orderpriority = '1-URGENT' AS churned, count(*) AS rows, count(*) AS customers, round(count(*) * 0.2) AS test_rows "
       "FROM orders GROUP BY 1")
def train_test_split(t: Tables) -> DataFrame:
    """Both sides of a split of all orders together: whole, disjoint and of the exact share per class."""
    labelled = t.orders.select("o_orderkey", (F.col("o_orderpriority") == "1-URGENT").cast("int").alias("churned"))
    train, test = training.train_test_split(labelled, "o_orderkey", label="churned")
    both = train.withColumn("test", F.lit(0)).unionByName(test.withColumn("test", F.lit(1)))
    return both.groupBy("churned").agg(
        F.count("*").alias("rows"), F.count_distinct("o_orderkey").alias("customers"), F.sum("test").alias("test_rows"))


@check("encode_categoricals", "long: p_partkey p_brand p_type",
       """SELECT p_partkey, (SELECT count(DISTINCT b.p_brand) FROM part b WHERE b.p_brand < p.p_brand) AS p_brand,
            (SELECT count(DISTINCT b.p_type) FROM part b WHERE b.p_type < p.p_type) AS p_type FROM part p""")
def encode_categoricals(t: Tables) -> DataFrame:
    return training.encode_categoricals(t.part.select("p_partkey", "p_brand", "p_type"), ["p_brand", "p_type"])


def guessed_returns(t: Tables) -> DataFrame:
    """A rule as the classifier: large and heavily discounted lines are guessed to be returned."""
    guess = (F.col("l_quantity") > 20) & (F.col("l_discount") > 0.03)
    return t.lineitem.select((F.col("l_returnflag") == "R").cast("int").alias("label"), guess.cast("int").alias("guess"),
                             (F.col("l_quantity") * F.col("l_linenumber")).alias("score"))


_GUESSES = """SELECT CAST(l_returnflag = 'R' AS INT) AS label, CAST(l_quantity > 20 AND l_discount > 0.03 AS INT) AS guess,
    l_quantity * l_linenumber AS score FROM lineitem"""


@check("eval_classification", "double: accuracy precision recall f1_score roc_auc",
       f"""WITH g AS ({_GUESSES}),
           c AS (SELECT k.c, count(*) FILTER (label = k.c) AS support, count(*) FILTER (guess = k.c) AS predicted,
             count(*) FILTER (label = k.c AND guess = k.c) AS hit FROM g, (VALUES (0), (1)) k(c) GROUP BY k.c),
           r AS (SELECT *, hit / predicted AS p, hit / support AS r FROM c),
           s AS (SELECT score, count(*) FILTER (label = 1) AS pos, count(*) FILTER (label = 0) AS neg FROM g GROUP BY score),
           a AS (SELECT sum(pos * (coalesce(below, 0) + neg / 2)) / (sum(pos) * sum(neg)) AS auc FROM (
             SELECT *, sum(neg) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS below FROM s) w)
           SELECT round(sum(hit) / sum(support), 9) AS accuracy, round(sum(p * support) / sum(support), 9) AS precision,
             round(sum(r * support) / sum(support), 9) AS recall,
             round(sum(2 * p * r / (p + r) * support) / sum(support), 9) AS f1_score,
             round((SELECT auc FROM a), 9) AS roc_auc FROM r""")
def eval_classification(t: Tables) -> DataFrame:
    guessed = guessed_returns(t)
    rates = training.eval_classification(guessed, "label", "guess")
    area = training.roc_auc(guessed, "label", "score")
    return rates.select(*[F.round(c, 9).alias(c) for c in rates.columns], F.round(F.lit(area), 9).alias("roc_auc"))


@check("eval_regression", "double: mse rmse mae r2_score",
       """WITH g AS (SELECT l_extendedprice AS y, l_quantity * 1500 AS p FROM lineitem),
            m AS (SELECT avg(power(y - p, 2)) AS mse, avg(abs(y - p)) AS mae, var_pop(y) AS spread FROM g)
          SELECT round(mse / 1000000, 4) AS mse, round(sqrt(mse), 4) AS rmse, round(mae, 4) AS mae,
            round(1 - mse / spread, 6) AS r2_score FROM m""")
def eval_regression(t: Tables) -> DataFrame:
    guessed = t.lineitem.select(F.col("l_extendedprice").alias("y"), (F.col("l_quantity") * 1500).alias("p"))
    errors = training.eval_regression(guessed, "y", "p")
    return errors.select(F.round(F.col("mse") / 1000000, 4).alias("mse"), F.round("rmse", 4).alias("rmse"),
                         F.round("mae", 4).alias("mae"), F.round("r2_score", 6).alias("r2_score"))


@check("ml_risk_bands", "long: l_orderkey l_linenumber, text: band",
       "SELECT l_orderkey, l_linenumber, CASE WHEN l_discount > 0.07 THEN 'HIGH' WHEN l_discount > 0.04 THEN 'MEDIUM' "
       "ELSE 'LOW' END AS band FROM lineitem")
def ml_risk_bands(t: Tables) -> DataFrame:
    proba = F.col("l_discount").cast("decimal(4,2)") * 10
    return t.lineitem.select("l_orderkey", "l_linenumber", scoring.risk_band(proba).alias("band"))


# -- trained models ----------------------------------------------------------------------

def churn_model(t: Tables, trees: int = training.TREES) -> tuple[NamedModel, list[dict]]:
    """A churn forest trained on a folder's tables, and its metrics on the rows kept back."""
    ready = stable(features.churn_features(churn_base(t)))
    train, test = training.train_test_split(ready, "customer_id", label="churned")
    model = training.train_classifier(train, CHURN_FEATURES, "churned", trees=trees, key=["customer_id"])
    named = NamedModel("customer_churn", model, CHURN_FEATURES)
    scored = scoring.predict(named, scoring.predict(named, test), proba=True)
    metrics = training.eval_classification(scored, "churned", "customer_churn_prediction").first().asDict()
    metrics["roc_auc"] = training.roc_auc(scored, "churned", "customer_churn_proba")
    metrics["tested"] = float(test.count())
    return named, [{"metric": k, "value": v} for k, v in metrics.items()]


_METRICS = ["accuracy", "precision", "recall", "f1_score", "roc_auc"]
# the label is a rule on recency (over 90 days); well away from its border a forest has to state it
EARLY, LATE = 45, 180


def _sure(value: Column) -> Column:
    return F.when((F.col("recency") <= EARLY) | (F.col("recency") >= LATE), value)


def _rule(early: str, late: str) -> str:
    return f"CASE WHEN recency <= {EARLY} THEN {early} WHEN recency >= {LATE} THEN {late} END"


@check("train_classifier", "text: metric, bool: reached, long: tested",
       f"SELECT unnest({_METRICS}) AS metric, true AS reached, tested FROM (SELECT sum(round(n * 0.2)) AS tested FROM ("
       "SELECT count(*) AS n FROM churn_base GROUP BY churned) c) b")
def train_classifier(t: Tables) -> DataFrame:
    """The churn label is a rule on a feature, so a forest has to reach 0.9 in every metric on the rows kept back."""
    found = {m["metric"]: m["value"] for m in churn_model(t)[1]}
    rows = [(m, found[m] >= 0.9, int(found["tested"])) for m in _METRICS]
    return t.spark.createDataFrame(rows, "metric string, reached boolean, tested long")


@check("ml_predict", "long: customer_id churned, bool: valid",
       f"SELECT customer_id, {_rule('0', '1')} AS churned, true AS valid FROM churn_base")
def ml_predict(t: Tables) -> DataFrame:
    """A prediction of 0 or 1 for every customer with orders, and that of the rule away from its border."""
    base = churn_base(t)
    found = scoring.predict(churn_model(t)[0], features.churn_features(base)).drop("recency").join(base.select("customer_id", "recency"), "customer_id")
    guess = F.col("customer_churn_prediction")
    return found.select("customer_id", _sure(guess).alias("churned"), guess.isin(0.0, 1.0).alias("valid"))


@check("ml_batch_predict", "long: customer_id, text: band, bool: valid",
       f"""SELECT customer_id, {_rule("'LOW'", "'HIGH'")} AS band, true AS valid FROM churn_base""")
def ml_batch_predict(t: Tables) -> DataFrame:
    """A chance between 0 and 1 for every customer, and its risk band away from the border of the rule."""
    base = churn_base(t)
    scored = scoring.predict(churn_model(t)[0], features.churn_features(base), proba=True).drop("recency").join(base.select("customer_id", "recency"), "customer_id")
    proba = F.col("customer_churn_proba")
    return scored.select("customer_id", _sure(scoring.risk_band(proba)).alias("band"), proba.between(0, 1).alias("valid"))


@check("ml_predict_from_query", "long: customer_id churned, bool: valid",
       f"SELECT customer_id, {_rule('0', '1')} AS churned, true AS valid FROM churn_base WHERE frequency >= 5")
def ml_predict_from_query(t: Tables) -> DataFrame:
    base = churn_base(t)
    found = scoring.predict_from_query(
        churn_model(t)[0], t.spark, "SELECT * FROM {features} WHERE frequency >= 5",
        features=features.churn_features(base)).drop("recency").join(base.select("customer_id", "recency"), "customer_id")
    guess = F.col("customer_churn_prediction")
    return found.select("customer_id", _sure(guess).alias("churned"), guess.isin(0.0, 1.0).alias("valid"))


_SEPARATES = " UNION ALL ".join(
    f"SELECT '{f}' AS feature, max({c}) FILTER (churned = 0) < min({c}) FILTER (churned = 1) AS leads FROM churn_base"
    for f, c in [*[(f, f) for f in CHURN_FEATURES[:5]], ("avg_spend_per_order", "CAST(monetary AS DOUBLE) / (frequency + 1)"),
                 ("engagement_score", "CAST(frequency AS DOUBLE) / (recency + 1)")])


@check("ml_feature_importance", "text: feature, bool: leads valid", f"SELECT feature, leads, true AS valid FROM ({_SEPARATES}) f")
def ml_feature_importance(t: Tables) -> DataFrame:
    """Shares of all features, which add up to one; the one that parts the classes has the greatest."""
    found = scoring.feature_importance(churn_model(t)[0], t.spark, limit=len(CHURN_FEATURES))
    whole = Window.partitionBy(F.lit(1))
    total, most = F.sum("importance").over(whole), F.max("importance").over(whole)
    return found.select("feature", (F.col("importance") == most).alias("leads"),
                        (F.col("importance").between(0, 1) & (F.abs(total - 1) < 1e-6)).alias("valid"))


@check("model_store", "text: model_name latest_version target_column features status, long: total_versions customers churned",
       "SELECT 'customer_churn' AS model_name, 'b' AS latest_version, 'churned' AS target_column, "
       f"'{', '.join(CHURN_FEATURES)}' AS features, 'active' AS status, 2 AS total_versions, count(*) AS customers, sum(churned) AS churned FROM churn_base")
def model_store(t: Tables) -> DataFrame:
    """Three versions of the churn forest are registered with what they were trained for, and the last is deleted again."""
    named, metrics = churn_model(t)
    store = ModelStore(t.spark, scratch_path(t.spark, "models"))
    base = churn_base(t).agg(F.count("*"), F.sum("churned")).first()
    for version in ("a", "b", "c"):
        store.register(named.model, named.name, "classification", named.features, "churned", version,
                       {**{m["metric"]: m["value"] for m in metrics}, "customers": float(base[0]), "churned": float(base[1])})
    store.delete(named.name, "c")
    return store.list_models().select("*", F.array_join("feature_columns", ", ").alias("features"),
                                      F.col("metrics")["customers"].alias("customers"), F.col("metrics")["churned"].alias("churned"))


@check("rfm_kmeans", "long: customer_id, bool: in_range", "SELECT customer_id, true AS in_range FROM rfm")
def rfm_kmeans(t: Tables) -> DataFrame:
    found = rfm(t)
    assigned = segments.assign_segments(segments.train_segments(found), found)
    return assigned.select("customer_id", F.col("segment").between(0, 3).alias("in_range"))


@check("rfm_segment_profile", "long: customers orders, double: spent",
       "SELECT count(*) AS customers, sum(order_count) AS orders, round(CAST(sum(total_spent) AS DOUBLE), 0) AS spent FROM rfm")
def rfm_segment_profile(t: Tables) -> DataFrame:
    """The segments' sizes and means put together again: nothing is lost or counted twice."""
    found = rfm(t)
    profile = segments.segment_profile(segments.assign_segments(segments.train_segments(found), found))
    return profile.agg(F.sum("customers").alias("customers"), F.round(F.sum(F.col("customers") * F.col("avg_order_count"))).alias("orders"),
                       F.round(F.sum(F.col("customers") * F.col("avg_total_spent")).cast("double"), 0).alias("spent"))


# -- search ------------------------------------------------------------------------------

@check("semantic_topk", "long: vec_id, double: similarity_score",
       """WITH q AS (SELECT CAST(embedding AS DOUBLE[]) AS v FROM embeddings ORDER BY vec_id LIMIT 1)
          SELECT vec_id, round(s, 6) AS similarity_score FROM (
            SELECT vec_id, list_cosine_similarity(CAST(embedding AS DOUBLE[]), (SELECT v FROM q)) AS s FROM embeddings) e
          WHERE s >= 0.25 ORDER BY s DESC, vec_id LIMIT 5""")
def semantic_topk_check(t: Tables) -> DataFrame:
    """The nearest vectors to the one with the smallest id."""
    query = t.embeddings.agg(F.min_by("embedding", "vec_id")).first()[0]
    found = semantic_topk(t.embeddings, query, "vec_id", "embedding")
    return found.withColumn("similarity_score", F.round("similarity_score", 6))


@check("semantic_topk_batch", "long: query_id vec_id, double: similarity_score",
       """SELECT query_id, vec_id, round(s, 6) AS similarity_score FROM (
            SELECT q.vec_id AS query_id, e.vec_id, list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])) AS s,
              row_number() OVER (PARTITION BY q.vec_id ORDER BY s DESC, e.vec_id) AS n
            FROM embeddings q CROSS JOIN embeddings e) r WHERE n <= 5 AND s >= 0.25""")
def semantic_topk_batch_check(t: Tables) -> DataFrame:
    """The five nearest vectors of every vector."""
    found = semantic_topk_batch(t.embeddings, t.embeddings, "vec_id", "embedding")
    return found.withColumn("similarity_score", F.round("similarity_score", 6))
