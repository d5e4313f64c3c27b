"""Aggregations, windows, top-k and the end-to-end dataflows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratamart.checks.registry import check
from stratamart.checks.sql import VIEWS, exact_avg, exact_ratio
from stratamart.functions import mean, ratio
from stratamart.operators import aggregates, windows
from stratamart.operators.quantiles import exact_quantiles
from stratamart.plans import demos
from stratamart.sources import Tables
from stratamart.sources import raw

PRICE = "CAST(o_totalprice AS DECIMAL(12,2))"


def price(c: str = "o_totalprice"):
    return F.col(c).cast("decimal(12,2)")


# -- aggregations ------------------------------------------------------------------------

@check("agg_basic", "text: l_returnflag l_linestatus, long: n, double: total average smallest largest",
       f"""SELECT l_returnflag, l_linestatus, count(*) AS n, sum(CAST(l_extendedprice AS DECIMAL(12,2))) AS total,
             {exact_avg('CAST(l_quantity AS BIGINT)', scale=0)} AS average, min(l_extendedprice) AS smallest,
             max(l_extendedprice) AS largest FROM lineitem GROUP BY ALL""")
def agg_basic(t: Tables) -> DataFrame:
    return t.lineitem.groupBy("l_returnflag", "l_linestatus").agg(
        F.count("*").alias("n"), F.sum(price("l_extendedprice")).alias("total"),
        mean(F.col("l_quantity").cast("int")).alias("average"), F.min("l_extendedprice").alias("smallest"),
        F.max("l_extendedprice").alias("largest"))


@check("group_by_ordinals", "text: day o_orderstatus, long: order_year order_month n",
       "SELECT CAST(o_orderdate AS DATE) AS day, year(o_orderdate) AS order_year, month(o_orderdate) AS order_month, "
       "o_orderstatus, count(*) AS n FROM orders GROUP BY 1, 2, 3, 4")
def group_by_ordinals(t: Tables) -> DataFrame:
    return t.orders.groupBy(
        F.to_date("o_orderdate").alias("day"), F.year("o_orderdate").alias("order_year"),
        F.month("o_orderdate").alias("order_month"), "o_orderstatus").agg(F.count("*").alias("n"))


@check("agg_stddev_variance", "text: o_orderpriority, double: spread variance",
       "SELECT o_orderpriority, round(stddev(o_totalprice), 3) AS spread, round(variance(o_totalprice) / 1000000, 3) "
       "AS variance FROM orders GROUP BY o_orderpriority")
def agg_stddev_variance(t: Tables) -> DataFrame:
    return t.orders.groupBy("o_orderpriority").agg(
        F.round(F.stddev("o_totalprice"), 3).alias("spread"),
        F.round(F.variance("o_totalprice") / 1000000, 3).alias("variance"))


@check("agg_multi_distinct", "text: o_orderpriority, long: orders customers days",
       "SELECT o_orderpriority, count(DISTINCT o_orderkey) AS orders, count(DISTINCT o_custkey) AS customers, "
       "count(DISTINCT CAST(o_orderdate AS DATE)) AS days FROM orders GROUP BY o_orderpriority")
def agg_multi_distinct(t: Tables) -> DataFrame:
    return t.orders.groupBy("o_orderpriority").agg(
        F.count_distinct("o_orderkey").alias("orders"), F.count_distinct("o_custkey").alias("customers"),
        F.count_distinct(F.to_date("o_orderdate")).alias("days"))


@check("agg_conditional_sum", "long: l_suppkey returned open big",
       "SELECT l_suppkey, count(*) FILTER (l_returnflag = 'R') AS returned, count(*) FILTER (l_linestatus = 'O') AS open, "
       "count(*) FILTER (l_quantity >= 45) AS big FROM lineitem GROUP BY l_suppkey")
def agg_conditional_sum(t: Tables) -> DataFrame:
    def hits(cond):
        return F.sum(F.when(cond, 1).otherwise(0))

    return t.lineitem.groupBy("l_suppkey").agg(
        hits(F.col("l_returnflag") == "R").alias("returned"), hits(F.col("l_linestatus") == "O").alias("open"),
        hits(F.col("l_quantity") >= 45).alias("big"))


@check("agg_ratio_pct", "long: l_suppkey, double: returned_pct",
       f"""SELECT l_suppkey, {exact_ratio("count(*) FILTER (l_returnflag = 'R')", 'count(*)', 2, 100, num_scale=0)}
             AS returned_pct FROM lineitem GROUP BY l_suppkey""")
def agg_ratio_pct(t: Tables) -> DataFrame:
    returned = F.sum(F.when(F.col("l_returnflag") == "R", 1).otherwise(0))
    return t.lineitem.groupBy("l_suppkey").agg(ratio(returned, F.count("*"), 2, 100).alias("returned_pct"))


@check("agg_post_ratio", "long: o_custkey, double: per_order per_urgent",
       f"""SELECT o_custkey, {exact_ratio(f'sum({PRICE})', 'count(*)', 2)} AS per_order,
             {exact_ratio(f'sum({PRICE})', "count(*) FILTER (o_orderpriority = '1-URGENT')", 2)} AS per_urgent
           FROM orders GROUP BY o_custkey""")
def agg_post_ratio(t: Tables) -> DataFrame:
    urgent = F.count_if(F.col("o_orderpriority") == "1-URGENT")
    sums = t.orders.groupBy("o_custkey").agg(F.sum(price()).alias("spent"), F.count("*").alias("n"), urgent.alias("u"))
    return sums.select("o_custkey", ratio("spent", "n", 2).alias("per_order"), ratio("spent", "u", 2).alias("per_urgent"))


@check("agg_global_metric", "double: total nothing",
       f"SELECT sum({PRICE}) AS total, 0 AS nothing FROM orders")
def agg_global_metric(t: Tables) -> DataFrame:
    none = F.sum(F.when(F.col("o_orderstatus") == "?", price()))
    return t.orders.agg(F.coalesce(F.sum(price()), F.lit(0)).alias("total"),
                        F.coalesce(none, F.lit(0)).alias("nothing"))


@check("agg_named_multi", "long: customer_id order_count, double: total_spent avg_order_value largest, text: last_order",
       f"""SELECT customer_id, count(*) AS order_count, sum(total_amount) AS total_spent,
             {exact_avg('total_amount')} AS avg_order_value, max(total_amount) AS largest, max(order_date) AS last_order
           FROM raw_orders GROUP BY customer_id""")
def agg_named_multi(t: Tables) -> DataFrame:
    return raw.orders(t).groupBy("customer_id").agg(
        F.count("id").alias("order_count"), F.sum("total_amount").alias("total_spent"),
        mean("total_amount").alias("avg_order_value"), F.max("total_amount").alias("largest"),
        F.max("order_date").alias("last_order"))


@check("agg_filtered_group", "long: user_id order_count, double: total_spent",
       "SELECT customer_id AS user_id, count(*) AS order_count, sum(total_amount) AS total_spent FROM raw_orders "
       "WHERE status = 'completed' GROUP BY customer_id")
def agg_filtered_group(t: Tables) -> DataFrame:
    return demos.completed_by_user(demo_orders(t))


@check("agg_value_counts", "text: o_orderpriority, long: n",
       "SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY o_orderpriority")
def agg_value_counts(t: Tables) -> DataFrame:
    return t.orders.groupBy("o_orderpriority").agg(F.count("*").alias("n"))


@check("agg_nunique", "long: parts suppliers",
       "SELECT count(DISTINCT l_partkey) AS parts, count(DISTINCT l_suppkey) AS suppliers FROM lineitem")
def agg_nunique(t: Tables) -> DataFrame:
    return t.lineitem.agg(F.count_distinct("l_partkey").alias("parts"), F.count_distinct("l_suppkey").alias("suppliers"))


@check("agg_arg_max", "text: n_name, long: c_custkey, double: spent",
       f"""SELECT n_name, c_custkey, spent FROM (
             SELECT *, row_number() OVER (PARTITION BY n_name ORDER BY spent DESC, c_custkey) AS n FROM (
               SELECT n_name, c_custkey, sum({PRICE}) AS spent FROM orders JOIN customer ON c_custkey = o_custkey
               JOIN nation ON n_nationkey = c_nationkey GROUP BY n_name, c_custkey) s) r WHERE n = 1""")
def agg_arg_max(t: Tables) -> DataFrame:
    """The customer who spent most in each nation; spending is summed before the lookup join."""
    spent = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.sum(price()).alias("spent"))
    placed = spent.join(t.customer, "c_custkey").join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
    return aggregates.row_of_max(placed, ["n_name"], "spent", "c_custkey")


@check("agg_quantile", "text: event_type, double: q quantile",
       "SELECT event_type, q, round(quantile_cont(value, q), 6) AS quantile FROM (SELECT event_type, value, "
       "unnest([0.5, 0.99]) AS q FROM events) e GROUP BY event_type, q".replace(
           "quantile_cont(value, q)", "CASE q WHEN 0.5 THEN quantile_cont(value, 0.5) ELSE quantile_cont(value, 0.99) END"))
def agg_quantile(t: Tables) -> DataFrame:
    found = exact_quantiles(t.events, ["event_type"], "value", [0.5, 0.99])
    return found.withColumn("quantile", F.round("quantile", 6))


@check("agg_median_impute", "long: event_id, double: value",
       "SELECT event_id, round(CASE WHEN event_type = 'view' THEN (SELECT quantile_cont(value, 0.5) FROM events "
       "WHERE event_type <> 'view') ELSE value END, 6) AS value FROM events")
def agg_median_impute(t: Tables) -> DataFrame:
    holes = t.events.select("event_id", F.when(F.col("event_type") != "view", F.col("value")).alias("value"))
    return aggregates.impute_median(holes, "value").withColumn("value", F.round("value", 6))


@check("agg_string_list", "long: user_id chunk, text: types",
       "SELECT user_id, (rn - 1) // 10000 AS chunk, string_agg(event_type, ', ' ORDER BY rn) AS types FROM (SELECT *, row_number() OVER ("
       "PARTITION BY user_id ORDER BY event_type) AS rn FROM (SELECT DISTINCT user_id, event_type FROM events) d) e GROUP BY ALL")
def agg_string_list(t: Tables) -> DataFrame:
    return aggregates.sorted_text(t.events, ["user_id"], "event_type", "types")


@check("agg_bool_or", "long: l_orderkey, bool: any_returned all_closed",
       "SELECT l_orderkey, bool_or(l_returnflag = 'R') AS any_returned, bool_and(l_linestatus = 'F') AS all_closed "
       "FROM lineitem GROUP BY l_orderkey")
def agg_bool_or(t: Tables) -> DataFrame:
    return t.lineitem.groupBy("l_orderkey").agg(
        F.bool_or(F.col("l_returnflag") == "R").alias("any_returned"),
        F.bool_and(F.col("l_linestatus") == "F").alias("all_closed"))


# -- windows -----------------------------------------------------------------------------

_DAILY = "SELECT event_type, CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY ALL"


def _daily(t: Tables) -> DataFrame:
    return t.events.groupBy("event_type", F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))


@check("win_cumulative_count", "text: event_type day, long: n running_total",
       f"SELECT *, sum(n) OVER (PARTITION BY event_type ORDER BY day) AS running_total FROM ({_DAILY}) d")
def win_cumulative_count(t: Tables) -> DataFrame:
    return windows.running_and_rolling(_daily(t), ["event_type"], "day", "n", 7)


@check("win_rolling_avg_7", "text: event_type day, double: rolling_avg",
       f"""SELECT event_type, day, round(avg(n) OVER (PARTITION BY event_type ORDER BY day
             ROWS BETWEEN 6 PRECEDING AND CURRENT ROW), 6) AS rolling_avg FROM ({_DAILY}) d""")
def win_rolling_avg_7(t: Tables) -> DataFrame:
    return windows.running_and_rolling(_daily(t), ["event_type"], "day", "n", 7)


_LINE_TIES = ["l_orderkey", "l_linenumber", "l_suppkey", "l_quantity", "l_extendedprice"]


@check("win_rank_first", "long: l_partkey l_orderkey l_linenumber line_rank, bool: is_first",
       f"""SELECT l_partkey, l_orderkey, l_linenumber, CASE WHEN done THEN n END AS line_rank,
             coalesce(done AND n = 1, false) AS is_first
           FROM (SELECT *, l_linestatus = 'F' AS done, row_number() OVER (PARTITION BY l_partkey, l_linestatus = 'F'
             ORDER BY l_shipdate, {', '.join(_LINE_TIES)}) AS n FROM lineitem) r""")
def win_rank_first(t: Tables) -> DataFrame:
    """Shipping order of a part's lines; lines not yet shipped have no rank."""
    shipped = t.lineitem.withColumn("shipped", F.when(F.col("l_linestatus") == "F", F.col("l_shipdate")))
    ranked = windows.ranked_within(shipped, ["l_partkey"], "shipped", _LINE_TIES, "line_rank")
    return ranked.withColumn("is_first", F.coalesce(F.col("line_rank") == 1, F.lit(False)))


@check("win_row_number", "long: o_orderkey order_number, text: o_orderdate",
       "SELECT o_orderkey, o_orderdate, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS order_number FROM orders")
def win_row_number(t: Tables) -> DataFrame:
    return windows.row_numbers(t.orders.select("o_orderkey", "o_orderdate"), ["o_orderdate", "o_orderkey"], "order_number")


@check("win_latest_per_key", "long: o_custkey o_orderkey, text: o_orderdate o_orderstatus",
       "SELECT o_custkey, o_orderkey, o_orderdate, o_orderstatus FROM orders QUALIFY row_number() OVER "
       "(PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1")
def win_latest_per_key(t: Tables) -> DataFrame:
    return windows.latest_per_key(t.orders.select("o_custkey", "o_orderkey", "o_orderdate", "o_orderstatus"),
                                  ["o_custkey"], ["o_orderdate", "o_orderkey"])


# -- sort, limit, top-k ------------------------------------------------------------------

@check("sort_limit_label", "text: label, double: value",
       f"SELECT CAST(o_orderdate AS DATE) AS label, sum({PRICE}) AS value FROM orders GROUP BY 1 ORDER BY label LIMIT 50")
def sort_limit_label(t: Tables) -> DataFrame:
    days = t.orders.groupBy(F.to_date("o_orderdate").alias("label")).agg(F.sum(price()).alias("value"))
    return days.orderBy(F.asc_nulls_last("label")).limit(50)


@check("limit_sample", "long: o_orderkey, double: o_totalprice",
       "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 1000")
def limit_sample(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", "o_totalprice").orderBy("o_orderkey").limit(1000)


@check("sort_desc_measure", "text: p_type, double: revenue, long: place",
       """SELECT p_type, revenue, row_number() OVER (ORDER BY revenue DESC, p_type) AS place FROM (
            SELECT p_type, sum(CAST(l_extendedprice AS DECIMAL(12,2))) AS revenue FROM lineitem
            JOIN part ON p_partkey = l_partkey GROUP BY p_type) r""")
def sort_desc_measure(t: Tables) -> DataFrame:
    """Part types by revenue, numbered in descending order."""
    by_part = t.lineitem.groupBy("l_partkey").agg(F.sum(price("l_extendedprice")).alias("part_revenue"))
    by_type = by_part.join(t.part, F.col("l_partkey") == F.col("p_partkey")).groupBy("p_type").agg(
        F.sum("part_revenue").alias("revenue"))
    numbered = windows.row_numbers(by_type.withColumn("minus", -F.col("revenue")), ["minus", "p_type"], "place")
    return numbered.orderBy(F.desc("revenue"), "p_type")


@check("topk_rows", "long: l_suppkey, double: revenue",
       "SELECT l_suppkey, sum(CAST(l_extendedprice AS DECIMAL(12,2))) AS revenue FROM lineitem GROUP BY l_suppkey "
       "ORDER BY revenue DESC, l_suppkey LIMIT 10")
def topk_rows(t: Tables) -> DataFrame:
    revenue = t.lineitem.groupBy("l_suppkey").agg(F.sum(price("l_extendedprice")).alias("revenue"))
    return revenue.orderBy(F.desc("revenue"), "l_suppkey").limit(10)


# -- dataflows ---------------------------------------------------------------------------

def demo_orders(t: Tables) -> DataFrame:
    return raw.orders(t).select(F.col("id").alias("order_id"), F.col("customer_id").alias("user_id"),
                                F.col("total_amount").alias("amount"), "status")


VIEWS["user_totals"] = f"""
SELECT u.user_id, upper(u.name) AS name, u.age, u.country,
  CASE WHEN u.age BETWEEN 1 AND 30 THEN 'Young' WHEN u.age BETWEEN 31 AND 40 THEN 'Middle'
    WHEN u.age BETWEEN 41 AND 100 THEN 'Senior' END AS age_group,
  count(o.id) AS order_count, coalesce(sum(o.total_amount), 0) AS total_spent,
  coalesce({exact_ratio('coalesce(sum(o.total_amount), 0)', 'count(o.id)', 6)}, 0) AS avg_order_value
FROM demo_users u LEFT JOIN raw_orders o ON o.customer_id = u.user_id AND o.status = 'completed'
GROUP BY u.user_id, u.name, u.age, u.country
"""


@check("demo_user_summary", "long: user_id age order_count, text: name country age_group, double: total_spent "
       "avg_order_value", "SELECT * FROM user_totals")
def demo_user_summary(t: Tables) -> DataFrame:
    return demos.user_summary(raw.users(t), demo_orders(t))


check("apply_row_axis1", "long: user_id, double: avg_order_value",
      "SELECT user_id, avg_order_value FROM user_totals")(demo_user_summary)


@check("apply_row_udf", "long: product_id, text: price_category",
       "SELECT id AS product_id, CASE WHEN price < 10 THEN 'Budget' WHEN price < 50 THEN 'Mid-Range' "
       "WHEN price < 200 THEN 'Premium' ELSE 'Luxury' END AS price_category FROM raw_products WHERE price > 0")
def apply_row_udf(t: Tables) -> DataFrame:
    from stratamart.checks.registry import orders_mart
    return orders_mart(t).ref("int_products_enriched")


@check("demo_user_insights", "text: insight item, double: value",
       f"""SELECT 'total_users' AS insight, NULL AS item, count(*) AS value FROM user_totals UNION ALL
           SELECT 'total_revenue', NULL, CAST(sum(total_spent) AS DOUBLE) FROM user_totals UNION ALL
           SELECT 'avg_revenue_per_user', NULL, {exact_avg('total_spent')} FROM user_totals UNION ALL
           SELECT 'total_orders', NULL, sum(order_count) FROM user_totals UNION ALL
           (SELECT 'top_spender', name, CAST(total_spent AS DOUBLE) FROM user_totals
            ORDER BY total_spent DESC, user_id LIMIT 1) UNION ALL
           SELECT 'users_by_country', country, count(*) FROM user_totals GROUP BY country UNION ALL
           SELECT 'users_by_age_group', age_group, count(*) FROM user_totals GROUP BY age_group""")
def demo_user_insights(t: Tables) -> DataFrame:
    return demos.user_insights(demos.user_summary(raw.users(t), demo_orders(t)))


@check("demo_event_summary", "text: beacon_type severity first_beacon last_beacon, long: beacon_count unique_users "
       "unique_orgs acknowledged_count",
       """SELECT beacon_type, severity, count(*) AS beacon_count, count(DISTINCT user_id) AS unique_users,
            count(DISTINCT organization_id) AS unique_orgs, count(*) FILTER (acknowledged) AS acknowledged_count,
            min(created_at) AS first_beacon, max(created_at) AS last_beacon FROM demo_beacons GROUP BY ALL""")
def demo_event_summary(t: Tables) -> DataFrame:
    return demos.event_summary(raw.beacons(t))


_TRENDS = """SELECT date, beacon_type, daily_count,
    sum(daily_count) OVER (PARTITION BY beacon_type ORDER BY date) AS cumulative_count,
    round(avg(daily_count) OVER (PARTITION BY beacon_type ORDER BY date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW), 6)
      AS rolling_7day_avg
  FROM (SELECT CAST(created_at AS DATE) AS date, beacon_type, count(*) AS daily_count FROM demo_beacons GROUP BY ALL) d"""


@check("demo_event_trends", "text: date beacon_type, long: daily_count cumulative_count, double: rolling_7day_avg",
       f"{_TRENDS} ORDER BY date DESC, beacon_type LIMIT 50")
def demo_event_trends(t: Tables) -> DataFrame:
    return demos.event_trends(raw.beacons(t)).orderBy(F.desc("date"), "beacon_type").limit(50)


def proposals(t: Tables) -> DataFrame:
    """Lines as proposals. ``line`` makes ``(id, line)`` unique where the source repeats a line number."""
    retail = price("l_extendedprice")
    rows = t.lineitem.join(t.orders.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    same_id = F.struct("l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag")
    return rows.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), same_id.alias("line"),
        F.col("o_custkey").alias("user_id"), F.col("l_suppkey").alias("provider_pg_id"),
        F.col("l_partkey").alias("quoted_ware_pg_id"), F.col("l_returnflag").alias("proposal_type"),
        F.when(F.col("l_linestatus") == "F", F.col("l_shipdate")).alias("confirmed_at"),
        retail.alias("retail_total_price"), (retail * F.lit("0.80").cast("decimal(3,2)")).alias("wholesale_total_price"))


def currencies(t: Tables) -> DataFrame:
    """One rate per proposal id; third lines have none."""
    ids = t.lineitem.where(F.col("l_linenumber") != 3).select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("exchangable_id")).distinct()
    return ids.withColumn("conversion_rate", 1 + F.col("exchangable_id") % 5)


def proposal_parts(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    # suppliers in debt go by another key, so their proposals have no provider
    shown = F.when(F.col("s_acctbal") > 0, F.col("s_suppkey")).otherwise(-F.col("s_suppkey") - 1)
    providers = t.supplier.select(shown.alias("id"), F.col("s_name").alias("name"))
    people = t.customer.select(F.col("c_custkey").alias("id"),
                               F.concat(F.lit("user"), F.col("c_custkey"), F.lit("@example.com")).alias("email"),
                               F.concat(F.lit("Ms "), F.col("c_name")).alias("full_name"))
    return proposals(t), currencies(t), providers, people


_WHOLESALE = "CAST(l_extendedprice AS DECIMAL(12,2)) * 0.80"
VIEWS["proposal_rates"] = """
SELECT DISTINCT l_orderkey * 10 + l_linenumber AS rated_id, 1 + (l_orderkey * 10 + l_linenumber) % 5 AS rate
FROM lineitem WHERE l_linenumber <> 3
"""
VIEWS["proposal_rows"] = f"""
SELECT l_orderkey * 10 + l_linenumber AS id, o_custkey AS user_id, l_suppkey AS provider_pg_id, l_partkey AS ware,
  l_returnflag AS proposal_type, CASE WHEN l_linestatus = 'F' THEN l_shipdate END AS confirmed_at,
  s_name AS provider_name, 'user' || o_custkey || '@example.com' AS user_email, 'Ms ' || c_name AS user_full_name,
  {exact_ratio('CAST(l_extendedprice AS DECIMAL(12,2))', 'rate', 4)} AS retail_usd,
  {exact_ratio(_WHOLESALE, 'rate', 4, num_scale=4)} AS wholesale_usd,
  (l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag) AS line
FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey
  LEFT JOIN proposal_rates ON rated_id = l_orderkey * 10 + l_linenumber
  LEFT JOIN supplier ON CASE WHEN s_acctbal > 0 THEN s_suppkey ELSE -s_suppkey - 1 END = l_suppkey
"""


@check("demo_proposals", "long: id user_id provider_pg_id quoted_ware_pg_id proposal_rank, text: proposal_type "
       "confirmed_at provider_name user_email user_full_name, double: retail_total_price_usd wholesale_total_price_usd, "
       "bool: is_first_proposal",
       """SELECT id, user_id, provider_pg_id, ware AS quoted_ware_pg_id, proposal_type, confirmed_at, provider_name,
            user_email, user_full_name, retail_usd AS retail_total_price_usd,
            wholesale_usd AS wholesale_total_price_usd, CASE WHEN confirmed_at IS NOT NULL THEN n END AS proposal_rank,
            confirmed_at IS NOT NULL AND n = 1 AS is_first_proposal
          FROM (SELECT *, row_number() OVER (PARTITION BY ware, confirmed_at IS NULL ORDER BY confirmed_at, id, line) AS n
            FROM proposal_rows) r""")
def demo_proposals(t: Tables) -> DataFrame:
    return demos.proposals_enriched(*proposal_parts(t))


@check("demo_proposal_summary", "text: provider_name proposal_type, long: proposal_count, double: retail_total_usd "
       "retail_avg_usd retail_max_usd wholesale_total_usd wholesale_avg_usd wholesale_max_usd",
       f"""SELECT provider_name, proposal_type, count(*) AS proposal_count, sum(r) AS retail_total_usd,
             {exact_avg('r', scale=4)} AS retail_avg_usd, max(r) AS retail_max_usd, sum(w) AS wholesale_total_usd,
             {exact_avg('w', scale=4)} AS wholesale_avg_usd, max(w) AS wholesale_max_usd
           FROM (SELECT *, CAST(retail_usd AS DECIMAL(18,4)) AS r, CAST(wholesale_usd AS DECIMAL(18,4)) AS w
             FROM proposal_rows WHERE provider_name IS NOT NULL) p GROUP BY ALL""")
def demo_proposal_summary(t: Tables) -> DataFrame:
    return demos.proposal_summary(demos.proposals_priced(*proposal_parts(t)))


@check("demo_proposal_insights", "text: insight item, double: value",
       f"""WITH p AS (SELECT *, CAST(retail_usd AS DECIMAL(18,4)) AS r FROM proposal_rows)
           SELECT 'total_proposals' AS insight, NULL AS item, count(*) AS value FROM p UNION ALL
           SELECT 'total_providers', NULL, count(DISTINCT provider_name) FROM p UNION ALL
           SELECT 'total_users', NULL, count(DISTINCT user_email) FROM p UNION ALL
           SELECT 'total_value_usd', NULL, CAST(sum(r) AS DOUBLE) FROM p UNION ALL
           SELECT 'avg_proposal_value_usd', NULL, {exact_avg('r', scale=4)} FROM p UNION ALL
           (SELECT 'top_provider', provider_name, CAST(sum(r) AS DOUBLE) AS v FROM p WHERE provider_name IS NOT NULL
            GROUP BY provider_name, proposal_type ORDER BY v DESC, provider_name, proposal_type LIMIT 1) UNION ALL
           SELECT 'proposal_types', proposal_type, count(*) FROM p GROUP BY proposal_type""")
def demo_proposal_insights(t: Tables) -> DataFrame:
    return demos.proposal_insights(demos.proposals_priced(*proposal_parts(t)))
