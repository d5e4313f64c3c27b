"""Chart, dashboard and ad-hoc queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratamart.checks.registry import check, orders_mart
from stratamart.checks.sql import exact_avg
from stratamart.functions import clean_output
from stratamart.operators import charts, filters
from stratamart.operators.charts import Chart
from stratamart.session import scratch_path
from stratamart.sources import Tables
from stratamart.sources import raw

PRICE = "CAST(o_totalprice AS DECIMAL(12,2))"


def priced_orders(t: Tables) -> DataFrame:
    return t.orders.withColumn("price", F.col("o_totalprice").cast("decimal(12,2)"))


@check("chart_table", "long: o_orderkey o_custkey, text: o_orderpriority",
       "SELECT o_orderkey, o_custkey, o_orderpriority FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 400000 "
       "ORDER BY o_orderkey LIMIT 100")
def chart_table(t: Tables) -> DataFrame:
    chart = Chart("table", columns=["o_orderkey", "o_custkey", "o_orderpriority"], filters={"o_orderstatus": "F"},
                  conditions=[("o_totalprice", ">", 400000.0)], limit=100)
    return charts.table_chart(t.orders, chart, order_by=["o_orderkey"])


@check("chart_metric", "text: how, double: value",
       f"""SELECT 'sum' AS how, CAST(sum({PRICE}) AS DOUBLE) AS value FROM orders WHERE o_orderstatus = 'F' UNION ALL
           SELECT 'avg', {exact_avg(PRICE)} FROM orders WHERE o_orderstatus = 'F' UNION ALL
           SELECT 'count', count(*) FROM orders WHERE o_orderstatus = 'F' UNION ALL
           SELECT 'max', max(o_totalprice) FROM orders WHERE o_orderstatus = 'F' UNION ALL
           SELECT 'min', min(o_totalprice) FROM orders WHERE o_orderstatus = 'F' UNION ALL
           SELECT 'none', 0""")
def chart_metric(t: Tables) -> DataFrame:
    """All metrics of one selection from one scan, and a selection without rows."""
    hows = ("sum", "avg", "count", "max", "min")
    some = charts.metric_charts(priced_orders(t), "price", hows, {"o_orderstatus": "F"})
    none = charts.metric_chart(priced_orders(t), Chart("metric", y_axis="price", filters={"o_orderstatus": "?"}))
    return some.unionByName(none.withColumn("how", F.lit("none")))


@check("chart_multi_metric", "text: label, double: sum_price avg_price max_price, long: count_o_custkey",
       f"""SELECT o_orderpriority AS label, sum({PRICE}) AS sum_price, {exact_avg(PRICE)} AS avg_price,
             max(o_totalprice) AS max_price, count(o_custkey) AS count_o_custkey
           FROM orders WHERE year(o_orderdate) = 1997 GROUP BY o_orderpriority""")
def chart_multi_metric(t: Tables) -> DataFrame:
    chart = Chart(x_axis="o_orderpriority",
                  metrics=[("price", "sum"), ("price", "avg"), ("price", "max"), ("o_custkey", "count")],
                  filters={"order_year": 1997}, expressions={"order_year": "year(o_orderdate)"})
    return charts.multi_chart(priced_orders(t), chart)


check("agg_multi_measures", "text: label, double: sum_price avg_price max_price, long: count_o_custkey",
      f"""SELECT o_orderstatus AS label, sum({PRICE}) AS sum_price, {exact_avg(PRICE)} AS avg_price,
            max(o_totalprice) AS max_price, count(o_custkey) AS count_o_custkey FROM orders GROUP BY o_orderstatus""")(
    lambda t: charts.multi_chart(priced_orders(t), Chart(
        x_axis="o_orderstatus",
        metrics=[("price", "sum"), ("price", "avg"), ("price", "max"), ("o_custkey", "count")])))


@check("chart_xy", "text: label, double: value",
       f"""SELECT strftime(o_orderdate, '%Y-%m') AS label, sum({PRICE}) AS value FROM orders GROUP BY 1""")
def chart_xy(t: Tables) -> DataFrame:
    """Revenue per month."""
    monthly = priced_orders(t).withColumn("month", F.date_format("o_orderdate", "yyyy-MM"))
    return charts.xy_chart(monthly, Chart("line", "month", "price", "sum"))


_STACKED = """SELECT CAST(ts AS DATE) AS label, coalesce(nullif(event_type, 'view'), 'None') AS category,
    sum(CAST(value AS DECIMAL(12,2))) AS value FROM events GROUP BY ALL"""
_KINDS = ["None", "click", "error", "purchase", "signup"]


def stacked_events(t: Tables) -> tuple[DataFrame, Chart]:
    """Value per day and event type; views count as events without a type."""
    kind = F.nullif("event_type", F.lit("view")).alias("kind")
    daily = t.events.select(F.to_date("ts").alias("day"), kind, F.col("value").cast("decimal(12,2)").alias("v"))
    return daily, Chart("bar-stacked", "day", "v", "sum", category="kind")


_WIDE = (f"SELECT label, " + ", ".join(f"coalesce(sum(value) FILTER (category = '{k}'), 0) AS \"{k}\"" for k in _KINDS)
         + f" FROM ({_STACKED}) s GROUP BY label")


@check("chart_stacked", f"text: label, double: {' '.join(_KINDS)}", _WIDE)
def chart_stacked(t: Tables) -> DataFrame:
    return charts.stacked_chart(*stacked_events(t))


@check("pivot_stacked", f"text: label, double: {' '.join(_KINDS)}", _WIDE)
def pivot_stacked(t: Tables) -> DataFrame:
    """The same with the categories given, which saves reading them first."""
    return charts.stacked_chart(*stacked_events(t), categories=_KINDS)


@check("filter_values", "text: value",
       "SELECT DISTINCT p_brand AS value FROM part WHERE p_brand IS NOT NULL")
def filter_values(t: Tables) -> DataFrame:
    return filters.distinct_values(t.part, "p_brand")


@check("distinct_values", "text: value",
       "SELECT DISTINCT year(o_orderdate) * 100 + month(o_orderdate) AS value FROM orders")
def distinct_values(t: Tables) -> DataFrame:
    return filters.distinct_values(t.orders, expression="extract(year FROM o_orderdate) * 100 + extract(month FROM o_orderdate)")


_OPTION_FIELDS = {"status": "Status", "order_year": "Order Year", "order_month": "Order Month",
                  "order_value_tier": "Order Value Tier"}
_OPTION_SOURCE = """(SELECT status, CAST(year(order_date) AS VARCHAR) AS order_year, CAST(month(order_date) AS VARCHAR)
    AS order_month, CASE WHEN total_amount >= 1000 THEN 'High Value' WHEN total_amount >= 100 THEN 'Medium Value' 
    ELSE 'Low Value' END AS order_value_tier FROM raw_orders)"""


@check("dashboard_filter_options", "text: field label value",
       " UNION ALL ".join(f"SELECT DISTINCT '{f}' AS field, '{label}' AS label, {f} AS value FROM {_OPTION_SOURCE} o"
                          for f, label in _OPTION_FIELDS.items()))
def dashboard_filter_options(t: Tables) -> DataFrame:
    return filters.filter_options(orders_mart(t).ref("fct_orders"))


@check("dashboard_cascading_filters", "text: value",
       "SELECT DISTINCT year(order_date) AS value FROM raw_orders JOIN raw_customers c ON c.id = customer_id "
       "WHERE segment = 'BUILDING' AND status = 'pending'")
def dashboard_cascading_filters(t: Tables) -> DataFrame:
    """Years that still occur once a segment and a status are chosen."""
    people = raw.customers(t).select(F.col("id").alias("customer_id"), "segment")
    joined = raw.orders(t).join(people, "customer_id").withColumn("order_year", F.year("order_date"))
    return filters.distinct_values(joined, "order_year", filters={"segment": "BUILDING", "status": "pending"})


_SAMPLE = """
  SELECT 'Customers by Segment' AS chart, segment AS label, CAST(count(*) AS DOUBLE) AS value FROM raw_customers GROUP BY 2
  UNION ALL SELECT 'Orders by Status', status, count(*) FROM raw_orders GROUP BY 2
  UNION ALL (SELECT 'Revenue Over Time', CAST(order_date AS VARCHAR), CAST(sum(total_amount) AS DOUBLE) FROM raw_orders
    GROUP BY order_date)
  UNION ALL SELECT 'Products by Category', category, count(*) FROM raw_products GROUP BY 2"""


@check("dashboard_sample_charts", "text: chart label, double: value", _SAMPLE)
def dashboard_sample_charts(t: Tables) -> DataFrame:
    out = None
    for table, chart in charts.SAMPLE_CHARTS:
        rows = charts.labelled(raw.RAW_TABLES[table](t), chart)
        out = rows if out is None else out.unionByName(rows)
    return out


@check("export_dashboard", "text: chart label, double: value", _SAMPLE)
def export_dashboard(t: Tables) -> DataFrame:
    """All sample charts in full, written as CSV by chart and read back; a metric chart is left out."""
    path = scratch_path(t.spark, "dashboard")
    listed = [(raw.RAW_TABLES[table](t), chart) for table, chart in charts.SAMPLE_CHARTS]
    listed.append((raw.orders(t), Chart("metric", y_axis="total_amount", title="Total")))
    charts.export_dashboard(listed, path)
    return t.spark.read.csv(path, header=True, schema="label string, value double, chart string")


@check("export_chart", "text: label, double: value",
       f"SELECT CAST(o_orderdate AS DATE) AS label, sum({PRICE}) AS value FROM orders GROUP BY 1")
def export_chart(t: Tables) -> DataFrame:
    """A chart with more labels than are shown is exported whole."""
    path = scratch_path(t.spark, "chart")
    daily = priced_orders(t).withColumn("day", F.to_date("o_orderdate"))
    charts.export_chart(daily, Chart("line", "day", "price", "sum"), path)
    return t.spark.read.csv(path, header=True, schema="label string, value double")


@check("adhoc_sql", "text: o_orderpriority first_order, long: orders, double: total",
       f"""SELECT o_orderpriority, strftime(min(o_orderdate), '%Y-%m-%dT%H:%M:%S') AS first_order, count(*) AS orders,
             sum({PRICE}) AS total FROM orders WHERE o_orderdate >= TIMESTAMP '1996-01-01' GROUP BY o_orderpriority""")
def adhoc_sql(t: Tables) -> DataFrame:
    found = t.spark.sql("""
        WITH recent AS (SELECT * FROM {orders} WHERE o_orderdate >= TIMESTAMP_NTZ '1996-01-01 00:00:00')
        SELECT o_orderpriority, min(o_orderdate) AS first_order, count(*) AS orders,
          sum(CAST(o_totalprice AS DECIMAL(12,2))) AS total
        FROM recent GROUP BY o_orderpriority""", orders=t.orders)
    return clean_output(found)
