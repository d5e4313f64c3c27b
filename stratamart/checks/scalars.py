"""Scalar functions, projections and filters, each over a whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratamart.checks.registry import ORDERS_AS_OF, check
from stratamart.functions import (
    age_years, bin_right_closed, clean_output, day_of_week, is_email, ratio, rfm_score, title_case, trim_space,
    whole_days,
)
from stratamart.operators.filters import filter_map, matching_ops, not_true
from stratamart.operators.quantiles import exact_quantiles
from stratamart.plans.silver import banded
from stratamart.sources import Tables
from stratamart.sources.raw import customers as raw_customers
from stratamart.sources.raw import orders as raw_orders
from stratamart.checks.sql import exact_ratio, years_between

AS_OF = "DATE '2001-08-01'"
KEYS = {"orders": ["o_orderkey"], "lineitem": ["l_orderkey", "l_linenumber"], "part": ["p_partkey"],
        "customer": ["c_custkey"], "events": ["event_id"]}


def money(c: str) -> Column:
    return F.col(c).cast("decimal(12,2)")


def dec(value: str, precision: int, scale: int) -> Column:
    return F.lit(value).cast(f"decimal({precision},{scale})")


def odd_or_null() -> Column:
    return F.nullif(F.col("p_size") % 2, F.lit(0))


def scalar(name: str, table: str, kind: str, build: Callable[[], Column | dict[str, Column]],
           sql: str | dict[str, str]) -> None:
    """Check one expression, or several of one kind, for every row of a table.

    ``build`` makes the columns once a session exists.
    """
    keys = KEYS[table]
    wanted = sql if isinstance(sql, dict) else {"result": sql}
    computed = ", ".join(f"{e} AS {n}" for n, e in wanted.items())

    def run(t: Tables) -> DataFrame:
        made = build()
        made = made if isinstance(made, dict) else {"result": made}
        return getattr(t, table).select(*keys, *[c.alias(n) for n, c in made.items()])

    check(name, f"long: {' '.join(keys)}, {kind}: {' '.join(wanted)}",
          f"SELECT {', '.join(keys)}, {computed} FROM {table}")(run)


M = "CAST({} AS DECIMAL(12,2))".format


scalar("scalar_round", "orders", "double", lambda: F.round(money("o_totalprice") * dec("0.0715", 5, 4), 1),
       f"round({M('o_totalprice')} * 0.0715, 1)")
scalar("scalar_nullif", "lineitem", "double", lambda: ratio(money("l_extendedprice"), money("l_discount"), 4),
       exact_ratio(M("l_extendedprice"), M("l_discount"), 4, den_scale=2))
scalar("scalar_abs", "part", "double", lambda: F.abs(money("p_retailprice") - dec("950.05", 5, 2)),
       f"abs({M('p_retailprice')} - 950.05)")
scalar("scalar_arith", "lineitem", "double", lambda:
       money("l_extendedprice") * (1 - F.col("l_discount").cast("decimal(4,2)"))
       * (1 + F.col("l_tax").cast("decimal(4,2)")),
       f"{M('l_extendedprice')} * (1 - CAST(l_discount AS DECIMAL(4,2))) * (1 + CAST(l_tax AS DECIMAL(4,2)))")
scalar("scalar_coalesce", "part", "long", lambda: F.coalesce(F.nullif(F.col("p_size") % 3, F.lit(0)), F.lit(99)),
       "coalesce(nullif(p_size % 3, 0), 99)")
scalar("scalar_case", "lineitem", "text", lambda:
       F.when(F.col("l_returnflag") == "R", "returned").when(F.col("l_linestatus") == "F", "closed")
        .otherwise("open"),
       "CASE WHEN l_returnflag = 'R' THEN 'returned' WHEN l_linestatus = 'F' THEN 'closed' ELSE 'open' END")
scalar("scalar_is_null", "part", "bool", lambda: {"missing": odd_or_null().isNull(), "present": odd_or_null().isNotNull()},
       {"missing": "p_size % 2 = 0", "present": "p_size % 2 <> 0"})
scalar("scalar_cast_ts", "orders", "text", lambda: F.to_date("o_orderdate").cast("timestamp_ntz"),
       "CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP)")
scalar("scalar_cast_decimal", "orders", "double", lambda:
       money("o_totalprice").cast("decimal(38,10)") * dec("0.125", 4, 3), f"{M('o_totalprice')} * 0.125")
scalar("scalar_try_cast", "events", "double", lambda:
       F.when(F.col("event_id") % 7 == 0, "n/a").otherwise((F.col("event_id") % 100).cast("string"))
        .try_cast("double"),
       "CASE WHEN event_id % 7 <> 0 THEN CAST(event_id % 100 AS DOUBLE) END")
scalar("scalar_date", "events", "text", lambda: F.to_date("ts"), "CAST(ts AS DATE)")
scalar("scalar_extract", "orders", "long", lambda:
       {"y": F.year("o_orderdate"), "m": F.month("o_orderdate"), "d": F.dayofmonth("o_orderdate"),
        "q": F.quarter("o_orderdate")},
       {"y": "extract(year FROM o_orderdate)", "m": "extract(month FROM o_orderdate)",
        "d": "extract(day FROM o_orderdate)", "q": "extract(quarter FROM o_orderdate)"})
scalar("scalar_dow", "orders", "long", lambda: day_of_week("o_orderdate"), "extract(dow FROM o_orderdate)")
anchor = "2024-01-12 09:30:00"
scalar("scalar_interval_days", "events", "long", lambda: whole_days("ts", F.lit(anchor).cast("timestamp_ntz")),
       f"trunc(date_diff('microsecond', TIMESTAMP '{anchor}', ts) / 86400000000)")
scalar("scalar_age_years", "orders", "long", lambda: age_years(F.to_date("o_orderdate"), ORDERS_AS_OF),
       years_between(AS_OF, "CAST(o_orderdate AS DATE)"))
scalar("scalar_as_of", "orders", "bool", lambda:
       F.to_date("o_orderdate") < F.date_sub(F.lit(ORDERS_AS_OF), 90),
       f"CAST(o_orderdate AS DATE) < {AS_OF} - 90")
scalar("scalar_ts_compare", "lineitem", "text", lambda:
       F.when(F.when(F.col("l_linestatus") == "F", F.col("l_shipdate"))
              > F.lit("1998-06-15 00:00:00").cast("timestamp_ntz"), "after").otherwise("not after or unknown"),
       "CASE WHEN l_linestatus = 'F' AND l_shipdate > TIMESTAMP '1998-06-15' THEN 'after' "
       "ELSE 'not after or unknown' END")
scalar("scalar_concat", "customer", "text", lambda:
       F.concat(F.col("c_name"), F.lit(" "), F.nullif(F.col("c_mktsegment"), F.lit("BUILDING"))),
       "c_name || ' ' || nullif(c_mktsegment, 'BUILDING')")
scalar("scalar_upper", "part", "text", lambda: F.upper("p_name"), "upper(p_name)")
scalar("scalar_title", "part", "text", lambda:
       title_case(trim_space(F.concat(F.lit(" \t"), F.col("p_name"), F.lit("'s mc-CRAE\n")))),
       "array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ') "
       "|| '''S Mc-Crae'")
scalar("scalar_like", "part", "bool", lambda: F.col("p_name").like("%e_ g%"), "p_name LIKE '%e_ g%'")
scalar("scalar_cut", "part", "text", lambda: bin_right_closed("p_size", (0, 30, 40, 45), ("Young", "Middle", "Senior")),
       "CASE WHEN p_size BETWEEN 1 AND 30 THEN 'Young' WHEN p_size BETWEEN 31 AND 40 THEN 'Middle' "
       "WHEN p_size BETWEEN 41 AND 45 THEN 'Senior' END")
scalar("case_bucket", "orders", "text", lambda:
       banded(money("o_totalprice"), [(400000, "High"), (100000, "Medium")], "Low"),
       "CASE WHEN o_totalprice < 100000 THEN 'Low' WHEN o_totalprice < 400000 THEN 'Medium' ELSE 'High' END")
scalar("derived_arith", "lineitem", "double", lambda:
       {"net": money("l_extendedprice") - money("l_discount"),
        "gross": money("l_quantity") * money("l_tax"),
        "scaled": (money("l_extendedprice") - money("l_tax")) * F.col("l_linenumber")},
       {"net": f"{M('l_extendedprice')} - {M('l_discount')}", "gross": f"{M('l_quantity')} * {M('l_tax')}",
        "scaled": f"({M('l_extendedprice')} - {M('l_tax')}) * l_linenumber"})


@check("scalar_recency", "long: customer_id recency_days",
       f"SELECT o_custkey AS customer_id, date_diff('day', max(CAST(o_orderdate AS DATE)), {AS_OF}) AS recency_days "
       "FROM orders GROUP BY o_custkey")
def scalar_recency(t: Tables) -> DataFrame:
    last = t.orders.groupBy(F.col("o_custkey").alias("customer_id")).agg(F.max("o_orderdate").alias("last"))
    return last.select("customer_id", F.datediff(F.lit(ORDERS_AS_OF), "last").alias("recency_days"))


@check("scalar_fillna", "long: p_partkey, double: size_or_zero",
       "SELECT p_partkey, coalesce(nullif(p_size % 5, 2), 0) AS size_or_zero FROM part")
def scalar_fillna(t: Tables) -> DataFrame:
    holes = t.part.select("p_partkey", F.nullif(F.col("p_size") % 5, F.lit(2)).alias("size_or_zero"))
    return holes.na.fill(0)


@check("scalar_clip", "long: event_id, double: clipped",
       "SELECT event_id, round(least(value, (SELECT quantile_cont(value, 0.99) FROM events)), 6) AS clipped FROM events")
def scalar_clip(t: Tables) -> DataFrame:
    top = exact_quantiles(t.events, [], "value", [0.99]).select("quantile").scalar()
    return t.events.select("event_id", F.round(F.least("value", top), 6).alias("clipped"))


@check("scalar_array_overlap", "long: user_id",
       "SELECT user_id FROM events GROUP BY user_id, CAST(ts AS DATE) HAVING bool_or(event_type IN ('purchase', 'signup'))")
def scalar_array_overlap(t: Tables) -> DataFrame:
    """Users per day whose set of event types overlaps the wanted types."""
    wanted = F.array(F.lit("purchase"), F.lit("signup"))
    seen = t.events.groupBy("user_id", F.to_date("ts").alias("day")).agg(
        F.bool_or(F.arrays_overlap(F.array("event_type"), wanted)).alias("overlaps"))
    return seen.where("overlaps").select("user_id")


@check("scalar_unnest", "long: vec_id pos, double: element",
       "SELECT vec_id, i - 1 AS pos, embedding[i] AS element FROM (SELECT *, unnest(range(1, len(embedding) + 1)) AS i "
       "FROM embeddings) e")
def scalar_unnest(t: Tables) -> DataFrame:
    return t.embeddings.select("vec_id", F.posexplode("embedding").alias("pos", "element"))


@check("scalar_json", "long: event_id k map_k, text: map_key",
       "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, 'k' AS map_key, "
       "CAST(props ->> 'k' AS BIGINT) AS map_k FROM events")
def scalar_json(t: Tables) -> DataFrame:
    parsed = t.events.select(
        "event_id", F.get_json_object("props", "$.k").cast("long").alias("k"),
        F.explode(F.from_json("props", "map<string,bigint>")).alias("map_key", "map_k"))
    return parsed


@check("scalar_output_cleanup", "long: event_id, text: ts day, double: value",
       """SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') || CASE WHEN extract(microsecond FROM ts) % 1000000 = 0
            THEN '' ELSE '.' || strftime(ts, '%f') END AS ts, CAST(CAST(ts AS DATE) AS VARCHAR) AS day,
            CASE WHEN event_id % 5 IN (0, 1, 2) THEN NULL ELSE value END AS value FROM events""")
def scalar_output_cleanup(t: Tables) -> DataFrame:
    """NaN and both infinities become NULL, times become ISO text and dates text."""
    fifth = F.col("event_id") % 5
    odd = (F.when(fifth == 0, F.lit(float("nan"))).when(fifth == 1, F.lit(float("inf")))
           .when(fifth == 2, F.lit(float("-inf"))).otherwise(F.col("value")))
    return clean_output(t.events.select("event_id", "ts", F.to_date("ts").alias("day"), odd.alias("value")))


@check("scalar_validate_score", "long: customer_id, bool: valid broken, double: score",
       f"""SELECT c_custkey AS customer_id, true AS valid, false AS broken,
            round(0.3 * date_diff('day', max(CAST(o_orderdate AS DATE)), {AS_OF}) + 0.3 * count(*)
            + 0.4 * sum(CAST(CAST(o_totalprice AS DECIMAL(12,2)) * 0.004 AS DECIMAL(10,2))), 4) AS score
          FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey""")
def scalar_validate_score(t: Tables) -> DataFrame:
    per_customer = raw_orders(t).groupBy(F.col("customer_id").alias("id")).agg(
        F.datediff(F.lit(ORDERS_AS_OF), F.max("order_date")).alias("recency"), F.count("*").alias("frequency"),
        F.sum("total_amount").cast("double").alias("monetary"))
    score = F.round(rfm_score(F.col("recency"), F.col("frequency"), F.col("monetary")), 4)
    return raw_customers(t).join(per_customer, "id").select(
        F.col("id").alias("customer_id"), is_email("email").alias("valid"),
        is_email(F.replace("email", F.lit("@"), F.lit(" at "))).alias("broken"), score.alias("score"))


# -- projections and filters -------------------------------------------------------------

@check("project_rename", "long: key, text: title brand",
       "SELECT p_partkey AS key, p_name AS title, p_brand AS brand FROM part")
def project_rename(t: Tables) -> DataFrame:
    return t.part.select(F.col("p_partkey").alias("key"), F.col("p_name").alias("title"), F.col("p_brand").alias("brand"))


@check("select_star_plus", "long: o_orderkey o_custkey order_year, text: o_orderstatus o_orderdate o_orderpriority, "
       "double: o_totalprice half",
       "SELECT *, year(o_orderdate) AS order_year, o_totalprice / 2 AS half FROM orders")
def select_star_plus(t: Tables) -> DataFrame:
    return t.orders.withColumns({"order_year": F.year("o_orderdate"), "half": F.col("o_totalprice") / 2})


@check("filter_compare", "long: l_orderkey l_linenumber",
       "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity > 25 AND l_discount > 0")
def filter_compare(t: Tables) -> DataFrame:
    return t.lineitem.where((F.col("l_quantity") > 25) & (F.col("l_discount") > 0)).select("l_orderkey", "l_linenumber")


@check("filter_equality", "long: o_orderkey", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F'")
def filter_equality(t: Tables) -> DataFrame:
    return t.orders.where(F.col("o_orderstatus") == "F").select("o_orderkey")


@check("filter_not_true", "long: o_orderkey",
       "SELECT o_orderkey FROM orders WHERE CASE o_orderstatus WHEN 'F' THEN true WHEN 'O' THEN false END <> true")
def filter_not_true(t: Tables) -> DataFrame:
    """The flag is true for F, false for O and NULL for P; only false ones stay."""
    flag = F.when(F.col("o_orderstatus") == "F", True).when(F.col("o_orderstatus") == "O", False)
    return not_true(t.orders.withColumn("flag", flag), "flag").select("o_orderkey")


@check("filter_map", "long: o_orderkey",
       "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O' AND o_orderpriority = '2-HIGH'")
def filter_map_check(t: Tables) -> DataFrame:
    wanted = {"o_orderstatus": "O", "o_orderpriority": "2-HIGH", "o_custkey": None, "o_orderkey": ""}
    return filter_map(t.orders, wanted).select("o_orderkey")


@check("filter_expression", "long: o_orderkey",
       "SELECT o_orderkey FROM orders WHERE year(o_orderdate) = 1998 AND left(o_orderpriority, 1) = '3'")
def filter_expression(t: Tables) -> DataFrame:
    wanted = {"order_year": 1998, "level": "3"}
    by = {"order_year": "extract(year FROM o_orderdate)", "level": "substring(o_orderpriority, 1, 1)"}
    return filter_map(t.orders, wanted, by).select("o_orderkey")


_OPERATOR_CASES = [
    ("=", "o_orderstatus", "F"), ("!=", "o_orderstatus", "F"), (">", "o_totalprice", 250000.0),
    ("<", "o_totalprice", 250000.0), (">=", "o_custkey", 500), ("<=", "o_custkey", 500), ("LIKE", "o_orderpriority", "%O%"),
]


@check("filter_ops", "text: op, long: o_orderkey",
       " UNION ALL ".join(
           f"SELECT '{op}' AS op, o_orderkey FROM orders WHERE {f} {op} {v if not isinstance(v, str) else repr(v)}"
           for op, f, v in _OPERATOR_CASES))
def filter_ops_check(t: Tables) -> DataFrame:
    """Every operator over the whole table, tagged with its name."""
    return matching_ops(t.orders, [(f, op, v) for op, f, v in _OPERATOR_CASES], "op").select("op", "o_orderkey")


@check("filter_not_null", "long: p_partkey", "SELECT p_partkey FROM part WHERE p_size % 7 <> 3")
def filter_not_null(t: Tables) -> DataFrame:
    return t.part.withColumn("axis", F.nullif(F.col("p_size") % 7, F.lit(3))).where(F.col("axis").isNotNull()).select("p_partkey")


@check("filter_in", "long: o_orderkey, text: o_orderpriority",
       "SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')")
def filter_in(t: Tables) -> DataFrame:
    return t.orders.where(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")).select("o_orderkey", "o_orderpriority")


@check("filter_gt_scalar_subquery", "long: o_orderkey, text: o_orderdate",
       "SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate > (SELECT max(o_orderdate) FROM orders "
       "WHERE o_orderdate < TIMESTAMP '2000-01-01')")
def filter_gt_scalar_subquery(t: Tables) -> DataFrame:
    """Rows newer than the newest row of a first batch."""
    split = F.lit("2000-01-01 00:00:00").cast("timestamp_ntz")
    newest = t.orders.where(F.col("o_orderdate") < split).agg(F.max("o_orderdate")).scalar()
    return t.orders.where(F.col("o_orderdate") > newest).select("o_orderkey", "o_orderdate")


@check("cte_chain", "text: o_orderpriority, long: customers, double: spent",
       "WITH big AS (SELECT o_custkey, o_orderpriority, CAST(o_totalprice AS DECIMAL(12,2)) AS price FROM orders "
       "WHERE o_totalprice > 300000), per AS (SELECT o_custkey, o_orderpriority, sum(price) AS spent FROM big "
       "GROUP BY ALL) SELECT o_orderpriority, count(*) AS customers, sum(spent) AS spent FROM per GROUP BY ALL")
def cte_chain(t: Tables) -> DataFrame:
    return t.spark.sql("""
        WITH big AS (
          SELECT o_custkey, o_orderpriority, CAST(o_totalprice AS DECIMAL(12,2)) AS price
          FROM {orders} WHERE o_totalprice > 300000),
        per_customer AS (
          SELECT o_custkey, o_orderpriority, sum(price) AS spent FROM big GROUP BY o_custkey, o_orderpriority)
        SELECT o_orderpriority, count(*) AS customers, sum(spent) AS spent
        FROM per_customer GROUP BY o_orderpriority""", orders=t.orders)
