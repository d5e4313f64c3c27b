"""Scoring tables with stored models."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass
from typing import Any

from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class NamedModel:
    name: str
    model: PipelineModel
    features: list[str]


def predict(named: NamedModel, rows: DataFrame, proba: bool = False) -> DataFrame:
    """The rows with ``<model>_prediction``, or ``<model>_proba`` of the positive class."""
    missing = sorted(set(named.features) - set(rows.columns))
    if missing:
        raise ValueError(f"missing features: {', '.join(missing)}")
    numeric = {f for f, kind in rows.dtypes if f in named.features and kind != "string"}
    ready = rows.withColumns({f: F.col(f).cast("double") for f in numeric})
    kept = [F.col(c) for c in rows.columns]
    scored = named.model.transform(ready)
    if proba:
        result = vector_to_array("probability")[1].alias(f"{named.name}_proba")
    else:
        result = F.col("prediction").alias(f"{named.name}_prediction")
    return scored.select(*kept, result)


def predict_one(named: NamedModel, spark: SparkSession, features: Mapping[str, Any], proba: bool = False) -> float:
    """The prediction for a single set of features."""
    row = predict(named, spark.createDataFrame([dict(features)]), proba)
    return float(row.first()[-1])


def predict_from_query(named: NamedModel, spark: SparkSession, query: str, proba: bool = False,
                       **tables: DataFrame) -> DataFrame:
    """Score what a SELECT returns; ``{name}`` in it stands for the table given under that name."""
    return predict(named, spark.sql(query, **tables), proba)


def risk_band(proba: Column) -> Column:
    # The band limits.
    return F.when(proba > 0.7, "HIGH").when(proba > 0.4, "MEDIUM").otherwise("LOW")


def feature_importance(named: NamedModel, spark: SparkSession, limit: int = 10) -> DataFrame:
    """The features with the greatest importance, or the greatest absolute weight of a linear model."""
    last = named.model.stages[-1]
    if hasattr(last, "featureImportances"):
        weights = last.featureImportances.toArray()
    elif hasattr(last, "coefficients"):
        weights = abs(last.coefficients.toArray())
    else:
        raise AttributeError(f"model {named.name} has no feature importance")
    rows = [(f, float(w)) for f, w in zip(named.features, weights)]
    ranked = spark.createDataFrame(rows, "feature string, importance double")
    return ranked.orderBy(F.desc("importance"), "feature").limit(limit)
