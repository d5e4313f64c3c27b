"""Versioned models in a shared folder, with one metadata row per version.

Registering and deleting append a row; the newest row of a version is its state. Nothing is
rewritten, so readers need no lock.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import datetime, timezone

from pyspark.errors import AnalysisException
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratamart.ml.scoring import NamedModel

RECORD = (
    "model_name string, version string, model_type string, model_class string, path string, registered_at string, "
    "metrics map<string,double>, feature_columns array<string>, target_column string, description string, "
    "tags array<string>, hyperparameters map<string,string>, status string"
)


class ModelStore:
    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark = spark
        self.folder = folder.rstrip("/")

    def _append(self, record: Mapping[str, object]) -> None:
        row = self.spark.createDataFrame([record], RECORD)
        row.coalesce(1).write.mode("append").json(f"{self.folder}/records")

    def records(self) -> DataFrame:
        """The current state of every version that is not deleted."""
        try:
            rows = self.spark.read.schema(RECORD).json(f"{self.folder}/records")
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            rows = self.spark.createDataFrame([], RECORD)  # nothing registered yet
        newest = rows.groupBy("model_name", "version").agg(
            F.max_by(F.struct("*"), "registered_at").alias("_row"), F.min("registered_at").alias("_first"))
        current = newest.select("_row.*", "_first").where(F.col("status") == "active")
        return current.withColumn("registered_at", F.col("_first")).drop("_first")

    def register(self, model: PipelineModel, name: str, model_type: str, features: Sequence[str],
                 target: str | None = None, version: str | None = None, metrics: Mapping[str, float] | None = None,
                 description: str = "", tags: Sequence[str] = ()) -> str:
        """Save a model as a version, by default named by the time. Returns the model id."""
        now = datetime.now(timezone.utc)
        version = version or now.strftime("%Y%m%d_%H%M%S_%f")
        path = f"{self.folder}/models/{name}/{version}"
        last = model.stages[-1]
        model.write().save(path)
        # the trees of a forest are in its folder
        params = {p.name: str(v) for p, v in last.extractParamMap().items() if p.name != "nodes"}
        self._append({
            "model_name": name, "version": version, "model_type": model_type, "model_class": type(last).__name__,
            "path": path, "registered_at": now.isoformat(), "metrics": dict(metrics or {}),
            "feature_columns": list(features), "target_column": target, "description": description,
            "tags": list(tags), "hyperparameters": params, "status": "active"})
        return f"{name}_v{version}"

    def versions(self, name: str) -> DataFrame:
        return self.records().where(F.col("model_name") == name).orderBy(F.desc("registered_at"))

    def metadata(self, name: str, version: str | None = None) -> dict:
        """The record of a version, by default the latest."""
        found = self.versions(name)
        row = (found.where(F.col("version") == version) if version else found).first()
        if row is None:
            raise ValueError(f"no model {name!r}" + (f" in version {version!r}" if version else ""))
        return row.asDict(recursive=True)

    def load(self, name: str, version: str | None = None) -> NamedModel:
        record = self.metadata(name, version)
        return NamedModel(name, PipelineModel.load(record["path"]), record["feature_columns"])

    def list_models(self) -> DataFrame:
        """Each model with its latest version and the number of versions."""
        latest = self.records().groupBy("model_name").agg(
            F.max_by(F.struct("*"), "registered_at").alias("_row"), F.count("*").alias("total_versions"))
        return latest.select(
            "model_name", F.col("_row.version").alias("latest_version"), "_row.model_type", "_row.description",
            "total_versions", F.col("_row.registered_at").alias("last_updated"), "_row.metrics", "_row.tags",
            "_row.feature_columns", "_row.target_column", "_row.status")

    def delete(self, name: str, version: str | None = None) -> None:
        """Hide a version, or all versions; its files stay for readers that hold it."""
        gone = [self.metadata(name, version)] if version else [r.asDict(recursive=True) for r in self.versions(name).collect()]
        if not gone:
            raise ValueError(f"no model {name!r}")
        for record in gone:
            now = datetime.now(timezone.utc).isoformat()
            self._append({**record, "registered_at": now, "status": "deleted"})
