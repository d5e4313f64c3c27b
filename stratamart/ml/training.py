"""Splitting, training and evaluating."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import Imputer, StringIndexer, VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratamart.ml.forest import HistogramForest
from stratamart.operators.windows import ranked_within

# Share of the test set and seed; forest size, depth and the least rows of a node that is split.
TEST_SHARE, SEED = 0.2, 42
TREES, DEPTH, SPLIT_ROWS = 100, 10, 5


def train_test_split(df: DataFrame, key: str, test_share: float = TEST_SHARE, seed: int = SEED,
                     label: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Split by a hash of the row's unique key.

    A row falls on the same side in every run and after a lost task, which a random draw
    per partition does not guarantee. With a ``label`` each class is split in exactly the given
    share (rounded to whole rows): the rows of the smallest hashes are its test rows.
    """
    hashed = F.xxhash64(F.col(key), F.lit(seed))
    if label is None:
        draw = F.pmod(hashed, F.lit(1_000_000)) / 1_000_000
        return df.where(draw >= test_share), df.where(draw < test_share)
    ranked = ranked_within(df.withColumn("_draw", hashed), [label], "_draw", [key], "_n")
    wanted = df.groupBy(F.col(label).alias("_label")).agg(F.round(F.count("*") * test_share).alias("_test"))
    split = ranked.join(wanted, F.col(label).eqNullSafe(F.col("_label")))
    return (split.where(F.col("_n") > F.col("_test")).select(df.columns), split.where(F.col("_n") <= F.col("_test")).select(df.columns))


def encode_categoricals(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Replace text columns by codes in alphabetical order from 0; NULL counts as the text 'None'.

    One dictionary of all (column, value) pairs is numbered in one go; a column's codes begin at its
    first number. They are joined back as a table, so a column may have any number of values.
    """
    texts = {c: F.coalesce(F.col(c).cast("string"), F.lit("None")) for c in columns}
    if not texts:
        return df
    pairs = F.array(*[F.struct(F.lit(i).alias("_column"), text.alias("_value")) for i, text in enumerate(texts.values())])
    known = df.select(F.inline(pairs)).distinct()
    codes = ranked_within(known, ["_column"], "_value", [], "_code")
    for i, (c, text) in enumerate(texts.items()):
        own = codes.where(F.col("_column") == i).select(F.col("_value").alias("_key"), (F.col("_code") - 1).alias("_new"))
        df = df.withColumn("_text", text).join(own, F.col("_text") == F.col("_key")).select(
            *[F.col("_new").alias(x) if x == c else F.col(f"`{x}`") for x in df.columns])
    return df


def train_classifier(df: DataFrame, features: Sequence[str], label: str, categorical: Sequence[str] = (),
                     trees: int = TREES, depth: int = DEPTH, seed: int = SEED, key: Sequence[str] = (),
                     min_split: int = SPLIT_ROWS) -> PipelineModel:
    """A random forest on the listed features: medians for missing numbers, codes for text.

    ``key`` names the columns that tell the rows apart, by default all; by it a tree draws its rows.
    The codes of a categorical feature are part of the model and must fit in memory.
    """
    numeric = [f for f in features if f not in categorical]
    filled = [f"_{f}_filled" for f in numeric]
    indexed = [f"_{f}_index" for f in categorical]
    stages = [Imputer(strategy="median", inputCols=numeric, outputCols=filled)] if numeric else []
    if categorical:
        # codes are split on as ordered numbers
        stages.append(StringIndexer(inputCols=list(categorical), outputCols=indexed, handleInvalid="keep",
                                    stringOrderType="alphabetAsc"))
    by_name = dict(zip([*numeric, *categorical], [*filled, *indexed]))
    stages.append(VectorAssembler(inputCols=[by_name[f] for f in features], outputCol="features"))
    stages.append(HistogramForest("features", label, list(key) or df.columns, trees, depth, min_split, seed))
    ready = df.withColumns({f: F.col(f).cast("double") for f in numeric}).withColumn(label, F.col(label).cast("double"))
    return Pipeline(stages=stages).fit(ready)


def eval_classification(scored: DataFrame, label: str, prediction: str) -> DataFrame:
    """Accuracy and support-weighted precision, recall and F1, from the counts per (label, prediction)."""
    cells = scored.groupBy(F.col(label).cast("double").alias("l"), F.col(prediction).cast("double").alias("p")).agg(
        F.count("*").alias("n"))
    actual = cells.groupBy(F.col("l").alias("c")).agg(
        F.sum("n").alias("support"), F.coalesce(F.sum(F.when(F.col("l") == F.col("p"), F.col("n"))), F.lit(0)).alias("hit"))
    predicted = cells.groupBy(F.col("p").alias("c")).agg(F.sum("n").alias("predicted"))
    per_class = actual.join(predicted, "c", "left").na.fill(0, ["predicted"])

    def share(top, bottom):
        return F.when(bottom > 0, top / bottom).otherwise(F.lit(0.0))

    support, hit = F.col("support"), F.col("hit")
    rates = per_class.withColumns({"precision": share(hit, F.col("predicted")), "recall": share(hit, support)})
    both = F.col("precision") + F.col("recall")
    rates = rates.withColumn("f1", share(2 * F.col("precision") * F.col("recall"), both))

    def weighted(c: str):
        return F.sum(F.col(c) * support) / F.sum(support)

    return rates.agg((F.sum(hit) / F.sum(support)).alias("accuracy"), weighted("precision").alias("precision"),
                     weighted("recall").alias("recall"), weighted("f1").alias("f1_score"))


def roc_auc(scored: DataFrame, label: str, score: str) -> float:
    """Area under the ROC curve over all distinct scores."""
    ready = scored.select(F.col(label).cast("double").alias("label"), F.col(score).cast("double").alias("score"))
    evaluator = BinaryClassificationEvaluator(rawPredictionCol="score", labelCol="label", numBins=0)
    return evaluator.evaluate(ready)


def eval_regression(scored: DataFrame, label: str, prediction: str) -> DataFrame:
    """Mean squared, root mean squared and mean absolute error, and R squared, in one pass."""
    y, gap = F.col(label).cast("double"), F.col(label).cast("double") - F.col(prediction).cast("double")
    sums = scored.agg(F.avg(gap * gap).alias("mse"), F.avg(F.abs(gap)).alias("mae"), F.var_pop(y).alias("spread"))
    return sums.select("mse", F.sqrt("mse").alias("rmse"), "mae",
                       (1 - F.col("mse") / F.nullif(F.col("spread"), F.lit(0.0))).alias("r2_score"))
