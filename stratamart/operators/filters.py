"""Filters as the chart and dataset requests state them: field maps, expressions, operators."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The operators a request may name.
OPERATORS: dict[str, Callable[[Column, Any], Column]] = {
    "=": lambda c, v: c == v,
    "!=": lambda c, v: c != v,
    ">": lambda c, v: c > v,
    "<": lambda c, v: c < v,
    ">=": lambda c, v: c >= v,
    "<=": lambda c, v: c <= v,
    "LIKE": F.like,
}


def require_columns(df: DataFrame, names: Iterable[str]) -> None:
    unknown = sorted(set(names) - set(df.columns))
    if unknown:
        raise ValueError(f"unknown columns: {', '.join(unknown)}")


def filter_map(df: DataFrame, filters: Mapping[str, Any], expressions: Mapping[str, str] | None = None) -> DataFrame:
    """Keep rows where every field equals its value; None and '' mean no restriction.

    A field listed in ``expressions`` compares that SQL expression instead of a column.
    """
    expressions = expressions or {}
    active = {f: v for f, v in filters.items() if v is not None and v != ""}
    require_columns(df, [f for f in active if not expressions.get(f)])
    for field, wanted in active.items():
        left = F.expr(expressions[field]) if expressions.get(field) else F.col(field)
        df = df.where(left == F.lit(wanted))
    return df


def filter_ops(df: DataFrame, conditions: Iterable[tuple[str, str, Any]]) -> DataFrame:
    """Keep rows that meet every ``(field, operator, value)`` condition."""
    conditions = list(conditions)
    require_columns(df, [f for f, _, _ in conditions])
    for field, op, wanted in conditions:
        if op not in OPERATORS:
            raise ValueError(f"unknown operator {op!r}")
        df = df.where(OPERATORS[op](F.col(field), F.lit(wanted)))
    return df


def matching_ops(df: DataFrame, conditions: Iterable[tuple[str, str, Any]], out: str) -> DataFrame:
    """Each row once for every condition it meets, with the operator in ``out``; one scan serves all."""
    conditions = list(conditions)
    require_columns(df, [f for f, _, _ in conditions])
    unknown = [op for _, op, _ in conditions if op not in OPERATORS]
    if unknown:
        raise ValueError(f"unknown operator {unknown[0]!r}")
    met = F.array_compact(F.array(*[F.when(OPERATORS[op](F.col(f), F.lit(v)), op) for f, op, v in conditions]))
    return df.withColumn(out, F.explode(met))


def not_true(df: DataFrame, flag: str) -> DataFrame:
    """Rows whose flag is false; a NULL flag drops the row, as ``<> TRUE`` does."""
    return df.where(F.col(flag) != F.lit(True))


def distinct_values(df: DataFrame, field: str | None = None, expression: str | None = None,
                    limit: int | None = None, filters: Mapping[str, Any] | None = None,
                    expressions: Mapping[str, str] | None = None) -> DataFrame:
    """The distinct non-NULL values in order, given the other selections; the first ``limit`` if given."""
    if bool(field) == bool(expression):
        raise ValueError("give either a field or an expression")
    if field:
        require_columns(df, [field])
    chosen = filter_map(df, filters or {}, expressions)
    c = (F.col(field) if field else F.expr(expression)).alias("value")
    values = chosen.select(c).where(F.col("value").isNotNull()).distinct().orderBy("value")
    return values if limit is None else values.limit(limit)


# Column name parts that make a column a dashboard filter.
FILTER_NAME_PARTS = ("year", "month", "tier", "status", "category", "warehouse")


def filter_options(df: DataFrame, limit: int | None = None, filters: Mapping[str, Any] | None = None) -> DataFrame:
    """``(field, label, value)``: the values of every column whose name marks it as a filter.

    One scan serves all columns: values are paired with their field and made distinct on the
    map side. With a ``limit`` only the first values of each field are kept.
    """
    fields = [f for f in df.schema.fields if any(part in f.name.lower() for part in FILTER_NAME_PARTS)]
    if not fields:
        raise ValueError("no column looks like a filter")
    pairs = []
    for f in fields:
        number = F.col(f.name).cast("double") if isinstance(f.dataType, T.NumericType) else F.lit(None).cast("double")
        pairs.append(F.struct(
            F.lit(f.name).alias("field"), F.lit(f.name.replace("_", " ").title()).alias("label"),
            number.alias("_number"), F.col(f.name).cast("string").alias("value")))
    values = filter_map(df, filters or {}).select(F.inline(F.array(*pairs))).where(F.col("value").isNotNull())
    if limit is None:
        return values.distinct().select("field", "label", "value")
    in_order = Window.partitionBy("field").orderBy("_number", "value")
    first = values.distinct().withColumn("_place", F.row_number().over(in_order)).where(F.col("_place") <= limit)
    return first.select("field", "label", "value")
