"""Chart queries: a chart spec over a relation gives one small, ordered DataFrame."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratamart.operators.aggregates import aggregation
from stratamart.operators.filters import filter_map, filter_ops, require_columns

# Fixed value: what a series without a category is called.
NO_CATEGORY = "None"
MOST_CATEGORIES = 1000  # each becomes a column


@dataclass(frozen=True)
class Chart:
    kind: str = "bar"  # bar, line, pie, doughnut, bar-stacked, metric, multi, table
    x_axis: str | None = None
    y_axis: str | None = None
    aggregation: str = "sum"
    category: str | None = None
    columns: Sequence[str] = ()
    metrics: Sequence[tuple[str, str]] = ()
    filters: Mapping[str, Any] = field(default_factory=dict)
    expressions: Mapping[str, str] = field(default_factory=dict)
    conditions: Sequence[tuple[str, str, Any]] = ()
    title: str | None = None
    limit: int | None = None  # rows of a table, labels of any other chart; none by default


def _needed(**named: object) -> None:
    missing = [n for n, v in named.items() if not v]
    if missing:
        raise ValueError(f"chart needs {', '.join(missing)}")


def _chosen(df: DataFrame, chart: Chart) -> DataFrame:
    return filter_ops(filter_map(df, chart.filters, chart.expressions), chart.conditions)


def _plotted(df: DataFrame, chart: Chart) -> DataFrame:
    _needed(x_axis=chart.x_axis)
    require_columns(df, [chart.x_axis])
    return _chosen(df, chart).where(F.col(chart.x_axis).isNotNull())


def _limited(rows: DataFrame, chart: Chart) -> DataFrame:
    return rows if chart.limit is None else rows.limit(chart.limit)


def table_chart(df: DataFrame, chart: Chart, order_by: Sequence[str] = ()) -> DataFrame:
    """Chosen columns of the filtered rows; ``order_by`` makes limited rows repeatable."""
    _needed(columns=chart.columns)
    require_columns(df, chart.columns)
    rows = _chosen(df, chart)
    rows = rows.orderBy(*order_by) if order_by else rows
    return _limited(rows.select(*chart.columns), chart)


def metric_chart(df: DataFrame, chart: Chart) -> DataFrame:
    """One value; 0 when there is none."""
    _needed(y_axis=chart.y_axis)
    require_columns(df, [chart.y_axis])
    total = _chosen(df, chart).agg(aggregation(df, chart.aggregation, chart.y_axis).cast("double").alias("value"))
    return total.select(F.nanvl(F.coalesce("value", F.lit(0.0)), F.lit(0.0)).alias("value"))


def metric_charts(df: DataFrame, field: str, hows: Sequence[str], filters: Mapping[str, Any]) -> DataFrame:
    """``(how, value)``: several metrics of one field and one selection, from one scan."""
    require_columns(df, [field])
    measures = [aggregation(df, how, field).cast("double").alias(how) for how in hows]
    values = F.array(*[F.struct(F.lit(how).alias("how"), F.nanvl(F.coalesce(how, F.lit(0.0)), F.lit(0.0)).alias("value")) for how in hows])
    return filter_map(df, filters).agg(*measures).select(F.inline(values))


def xy_chart(df: DataFrame, chart: Chart) -> DataFrame:
    """``(label, value)`` in label order: bar, line, pie and doughnut charts."""
    _needed(x_axis=chart.x_axis, y_axis=chart.y_axis)
    require_columns(df, [chart.y_axis])
    grouped = _plotted(df, chart).groupBy(F.col(chart.x_axis).alias("label")).agg(
        aggregation(df, chart.aggregation, chart.y_axis).alias("value"))
    return _limited(grouped.orderBy("label"), chart)


def multi_chart(df: DataFrame, chart: Chart) -> DataFrame:
    """``label`` with one column ``<aggregation>_<field>`` per metric."""
    _needed(metrics=chart.metrics)
    require_columns(df, [f for f, _ in chart.metrics])
    measures = [aggregation(df, how, f).alias(f"{how.lower()}_{f}") for f, how in chart.metrics]
    grouped = _plotted(df, chart).groupBy(F.col(chart.x_axis).alias("label")).agg(*measures).orderBy("label")
    return _limited(grouped, chart)


def stacked_series(df: DataFrame, chart: Chart) -> DataFrame:
    """``(label, category, value)``: the ordered cells of a stacked chart, whole labels only.

    Rows without a category are a series of their own, ``NO_CATEGORY``.
    """
    _needed(x_axis=chart.x_axis, y_axis=chart.y_axis, category=chart.category)
    require_columns(df, [chart.y_axis, chart.category])
    cells = _plotted(df, chart).groupBy(
        F.col(chart.x_axis).alias("label"), F.coalesce(F.col(chart.category).cast("string"), F.lit(NO_CATEGORY)).alias("category")
    ).agg(aggregation(df, chart.aggregation, chart.y_axis).alias("value"))
    if chart.limit is not None:
        first = cells.select("label").distinct().orderBy("label").limit(chart.limit)
        cells = cells.join(first, "label", "left_semi")
    return cells.orderBy("label", "category")


def stacked_chart(df: DataFrame, chart: Chart, categories: Sequence[str] | None = None) -> DataFrame:
    """One row per label and one column per category, 0 where a cell is empty.

    Without given ``categories`` they are read from the cells; each becomes a column. More than
    ``MOST_CATEGORIES`` are refused, so that no more are ever brought to the driver; ``stacked_series``
    has them all as rows.
    """
    cells = stacked_series(df, chart)
    if categories is None:
        found = cells.select("category").distinct().orderBy("category").limit(MOST_CATEGORIES + 1).collect()
        if len(found) > MOST_CATEGORIES:
            raise ValueError(f"more than {MOST_CATEGORIES} categories: name the wanted ones")
        categories = [r[0] for r in found]
    wide = cells.groupBy("label").pivot("category", list(categories)).agg(F.first("value"))
    return wide.na.fill(0, list(categories)).orderBy("label")


def chart_data(df: DataFrame, chart: Chart) -> DataFrame:
    """The data of any chart, by its kind."""
    if chart.kind == "table":
        return table_chart(df, chart)
    if chart.kind == "metric":
        return metric_chart(df, chart)
    if chart.metrics:
        return multi_chart(df, chart)
    if chart.kind == "bar-stacked" and chart.category:
        return stacked_chart(df, chart)
    return xy_chart(df, chart)


def labelled(df: DataFrame, chart: Chart) -> DataFrame:
    """An xy chart as ``(chart, label, value)`` with text labels, for reports over many charts."""
    return xy_chart(df, chart).select(
        F.lit(chart.title).alias("chart"), F.col("label").cast("string"), F.col("value").cast("double"))


def export_chart(df: DataFrame, chart: Chart, path: str) -> None:
    """Write all rows of a chart as CSV parts; a limit of the chart is for showing it only."""
    chart = replace(chart, limit=None)
    if chart.kind == "table":
        data = table_chart(df, chart)
    elif chart.kind == "metric":
        data = metric_chart(df, chart)
    elif chart.metrics:
        data = multi_chart(df, chart)
    elif chart.kind == "bar-stacked" and chart.category:
        data = stacked_series(df, chart)
    else:
        data = xy_chart(df, chart)
    data.write.mode("errorifexists").csv(path, header=True)


def dashboard_rows(charts: Sequence[tuple[DataFrame, Chart]]) -> DataFrame:
    """The rows of all xy charts; metric, multi and incomplete charts are left out."""
    out = None
    for df, chart in charts:
        if chart.kind in ("metric", "table") or chart.metrics or not (chart.x_axis and chart.y_axis):
            continue
        rows = labelled(df, chart)
        out = rows if out is None else out.unionByName(rows)
    if out is None:
        raise ValueError("no chart to export")
    return out


def export_dashboard(charts: Sequence[tuple[DataFrame, Chart]], path: str) -> None:
    """Write all xy charts of a dashboard, one folder per chart."""
    dashboard_rows(charts).write.mode("errorifexists").partitionBy("chart").csv(path, header=True)


# The sample dashboard's four charts, by raw table.
SAMPLE_CHARTS = (
    ("customers", Chart("pie", "segment", "id", "count", title="Customers by Segment")),
    ("orders", Chart("doughnut", "status", "id", "count", title="Orders by Status")),
    ("orders", Chart("line", "order_date", "total_amount", "sum", title="Revenue Over Time")),
    ("products", Chart("bar", "category", "id", "count", title="Products by Category")),
)
