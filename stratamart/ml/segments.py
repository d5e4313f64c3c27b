"""Customer segments by k-means on scaled features."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The clustered features, number of segments and seed.
FEATURES = ["order_count", "total_spent", "avg_order_value", "recency_days"]
SEGMENTS, SEED = 4, 42


def train_segments(rfm: DataFrame, k: int = SEGMENTS, seed: int = SEED) -> PipelineModel:
    numbers = rfm.select(*[F.col(c).cast("double") for c in FEATURES])
    return Pipeline(stages=[
        VectorAssembler(inputCols=FEATURES, outputCol="raw_features"),
        StandardScaler(withMean=True, withStd=True, inputCol="raw_features", outputCol="scaled"),
        KMeans(k=k, seed=seed, featuresCol="scaled", predictionCol="segment", maxIter=50),
    ]).fit(numbers)


def assign_segments(model: PipelineModel, rfm: DataFrame) -> DataFrame:
    """The features with their ``segment``."""
    numbers = rfm.select("customer_id", *[F.col(c).cast("double") for c in FEATURES])
    return model.transform(numbers).select("customer_id", *FEATURES, "segment")


def segment_profile(segmented: DataFrame) -> DataFrame:
    """Size and mean features of each segment."""
    return segmented.groupBy("segment").agg(
        F.count("*").alias("customers"), *[F.avg(c).alias(f"avg_{c}") for c in FEATURES])
