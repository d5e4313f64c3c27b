"""CSV files in and out: typed ingest, preview and lookup assets."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratamart.operators.filters import filter_map

# Row limits of a dataset preview and a file preview.
PREVIEW_MIN, PREVIEW_MAX, PREVIEW_DEFAULT, FILE_PREVIEW = 1, 10_000, 100, 10


def read_csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A CSV file with a header. Types are inferred in a pass of its own unless ``schema`` is given."""
    reader = spark.read.option("header", True)
    return reader.schema(schema).csv(path) if schema else reader.option("inferSchema", True).csv(path)


def csv_table_name(name: str) -> str:
    """The table a CSV dataset is stored under."""
    stem = name[:-4] if name.endswith(".csv") else name
    return "csv_" + "".join(c if c.isalnum() or c == "_" else "_" for c in stem.lower())


def csv_preview(df: DataFrame) -> dict[str, Any]:
    """First rows, column types and the total number of rows."""
    return {
        "columns": [{"name": f.name, "type": f.dataType.simpleString()} for f in df.schema.fields],
        "data": [r.asDict() for r in df.limit(FILE_PREVIEW).collect()],
        "row_count": df.count(),
    }


def dataset_preview(df: DataFrame, limit: int = PREVIEW_DEFAULT, filters: Mapping[str, Any] | None = None,
                    order_by: Sequence[str] = ()) -> DataFrame:
    """Up to ``limit`` rows that match the filters."""
    if not PREVIEW_MIN <= limit <= PREVIEW_MAX:
        raise ValueError(f"limit must be from {PREVIEW_MIN} to {PREVIEW_MAX}")
    rows = filter_map(df, filters or {})
    return (rows.orderBy(*order_by) if order_by else rows).limit(limit)


def date_spine(days: DataFrame, first: str = "first", last: str = "last") -> DataFrame:
    """One row ``date`` for each day from ``first`` to ``last`` of a one-row table."""
    return days.select(F.explode(F.sequence(F.col(first).cast("date"), F.col(last).cast("date"))).alias("date"))
