"""Run records: written and read as JSON, and analysed per run, model and schedule."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


# Fixed value: the layout of a run record.
RUN_SCHEMA = (
    "run_id string, timestamp string, summary struct<total_models: bigint, successes: bigint, failures: bigint, "
    "total_execution_time: double, models: map<string, struct<execution_time: double, timestamp: string, "
    "status: string, error: string>>>, logs array<string>"
)


def read_runs(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Run records under ``path``: one pretty-printed record per file, or one per line."""
    return spark.read.schema(RUN_SCHEMA).option("multiLine", multi_line).json(path)


def write_runs(runs: DataFrame, path: str) -> None:
    runs.write.mode("append").json(path)


def recent_runs(runs: DataFrame, limit: int = 50) -> DataFrame:
    return runs.orderBy(F.desc("run_id")).limit(limit)


def records_from_log(log: DataFrame) -> DataFrame:
    """Run records from one row per (run_id, model) with execution_time, timestamp, status and error.

    A record holds one entry per model that ran, so its size follows the number of models.
    """
    entry = F.struct("execution_time", "timestamp", "status", "error")
    line = F.concat(F.lit("["), F.col("timestamp"), F.lit("] ["),
                    F.when(F.col("status") == "success", "INFO").otherwise("ERROR"), F.lit("] "),
                    F.col("model"), F.lit(": "), F.col("status"))
    ok: Column = F.col("status") == "success"
    return log.groupBy("run_id").agg(
        F.max("timestamp").alias("timestamp"),
        F.struct(
            F.count("*").alias("total_models"), F.count_if(ok).alias("successes"), F.count_if(~ok).alias("failures"),
            F.sum("execution_time").alias("total_execution_time"),
            F.map_from_entries(F.collect_list(F.struct("model", entry))).alias("models"),
        ).alias("summary"),
        F.sort_array(F.collect_list(line)).alias("logs"),
    )


def model_rows(runs: DataFrame) -> DataFrame:
    """One row per run and model."""
    return runs.select("run_id", "timestamp", "logs", F.explode("summary.models").alias("model", "info")).select(
        "run_id", "timestamp", "model", "info.status", "info.execution_time", "info.error", "logs")


def run_summary(runs: DataFrame) -> DataFrame:
    """Totals per run, counted from the models rather than taken from the stored summary."""
    ok = F.col("status") == "success"
    return model_rows(runs).groupBy("run_id").agg(
        F.count("*").alias("total_models"),
        F.count_if(ok).alias("successes"),
        F.count_if(~ok).alias("failures"),
        F.sum("execution_time").alias("total_execution_time"),
    )


def model_history(runs: DataFrame, model: str, limit: int | None = None) -> DataFrame:
    """A model's runs with the log lines that name it, newest first; the last ``limit`` if given."""
    rows = model_rows(runs).where(F.col("model") == model)
    lines = F.filter("logs", lambda line: line.contains(model))
    ordered = rows.withColumn("logs", lines).orderBy(F.desc("run_id"))
    return ordered if limit is None else ordered.limit(limit)


def entity_status(entities: DataFrame, log: DataFrame, items: DataFrame, key: str, newest_by: Sequence[str],
                  counts: dict[str, Column]) -> DataFrame:
    """Every entity with its last log row, conditional counts and its ordered item list.

    Last row and counts come from one aggregate over the log, combined on the map side.
    ``items`` has ``(key, item, position)``; an item listed twice keeps its first position.
    """
    rest = [c for c in log.columns if c not in (key, *newest_by)]
    seen = log.groupBy(key).agg(
        F.max(F.struct(*newest_by, *rest)).alias("_last"), *[F.count_if(cond).alias(n) for n, cond in counts.items()])
    last = [F.col(f"_last.{c}").alias(f"last_{c}") for c in (*newest_by, *rest)]
    listed = items.groupBy(key, "item").agg(F.min("position").alias("position"))
    names = F.transform(F.sort_array(F.collect_list(F.struct("position", "item"))), lambda e: e["item"])
    lists = listed.groupBy(key).agg(F.array_join(names, ", ").alias("items"), F.count("*").alias("item_count"))
    joined = entities.join(seen.select(key, *counts, *last), key, "left").join(lists, key, "left")
    return joined.na.fill(0, [*counts, "item_count"])
