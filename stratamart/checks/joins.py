"""Joins, set operations, data checks and run analytics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratamart.checks.registry import check
from stratamart.functions import ratio
from stratamart.operators import history, joins, quality
from stratamart.operators.aggregates import nested_children, nested_distinct, nested_rows
from stratamart.operators.windows import latest_per_key
from stratamart.session import scratch_path
from stratamart.sources import Tables
from stratamart.sources import raw
from stratamart.checks.sql import exact_ratio

PRICE = "CAST(o_totalprice AS DECIMAL(12,2))"


@check("join_inner_2way", "long: o_orderkey c_custkey, text: c_name",
       "SELECT o_orderkey, c_custkey, c_name FROM orders, customer WHERE o_custkey = c_custkey")
def join_inner_2way(t: Tables) -> DataFrame:
    return t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_custkey", "c_name")


@check("join_inner_3way", "long: l_orderkey l_linenumber, text: p_brand s_name",
       "SELECT l_orderkey, l_linenumber, p_brand, s_name FROM lineitem, part, supplier "
       "WHERE l_partkey = p_partkey AND l_suppkey = s_suppkey")
def join_inner_3way(t: Tables) -> DataFrame:
    return (
        t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey"))
        .join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey"))
        .select("l_orderkey", "l_linenumber", "p_brand", "s_name")
    )


@check("join_inner_4way", "text: n_name o_orderpriority, long: lines, double: revenue",
       "SELECT n_name, o_orderpriority, count(*) AS lines, sum(CAST(l_extendedprice AS DECIMAL(12,2))) AS revenue "
       "FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey "
       "JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL")
def join_inner_4way(t: Tables) -> DataFrame:
    """Lines per customer nation and priority; the dimension join comes before the large one."""
    buyers = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_name")
    placed = t.orders.join(buyers, F.col("o_custkey") == F.col("c_custkey"))
    return (
        t.lineitem.join(placed, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("n_name", "o_orderpriority")
        .agg(F.count("*").alias("lines"), F.sum(F.col("l_extendedprice").cast("decimal(12,2)")).alias("revenue"))
    )


_LOOKUP_SQL = f"""SELECT r_name, rate, count(*) AS orders, sum({PRICE}) AS amount,
     sum({PRICE}) * rate AS tax
   FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
     JOIN region ON n_regionkey = r_regionkey
     LEFT JOIN (VALUES ('AFRICA', 0.05), ('AMERICA', 0.07), ('ASIA', 0.10), ('EUROPE', 0.19)) v(r, rate) ON r = r_name
   GROUP BY r_name, rate"""


@check("join_left_lookup", "text: r_name, double: rate amount tax, long: orders", _LOOKUP_SQL)
def join_left_lookup(t: Tables) -> DataFrame:
    """Tax per region from inline rows that lack one region; totals are summed before the lookup."""
    # The lookup rows.
    values = t.spark.sql("SELECT * FROM VALUES ('AFRICA', 0.05BD), ('AMERICA', 0.07BD), ('ASIA', 0.10BD), "
                         "('EUROPE', 0.19BD) AS v(r_name, rate)")
    places = (
        t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).select("c_custkey", "r_name")
    )
    totals = t.orders.join(places, F.col("o_custkey") == F.col("c_custkey")).groupBy("r_name").agg(
        F.count("*").alias("orders"), F.sum(F.col("o_totalprice").cast("decimal(12,2)")).alias("amount"))
    return joins.lookup(totals, values, ["r_name"]).withColumn("tax", F.col("amount") * F.col("rate"))


@check("join_left_fill", "long: user_id order_count, double: total_spent",
       f"""SELECT c_custkey AS user_id, count(o_orderkey) AS order_count, coalesce(sum({PRICE}), 0) AS total_spent
           FROM customer LEFT JOIN (SELECT *, CASE WHEN o_orderkey % 3 <> 0 THEN o_custkey - o_custkey % 2 END AS buyer FROM orders) o
             ON buyer = c_custkey GROUP BY c_custkey""")
def join_left_fill(t: Tables) -> DataFrame:
    """Spending per customer; orders go to the even customer number, some to none, so customers stay without."""
    buyer = F.when(F.col("o_orderkey") % 3 != 0, F.col("o_custkey") - F.col("o_custkey") % 2)
    spent = t.orders.groupBy(buyer.alias("user_id")).agg(
        F.count("*").alias("order_count"), F.sum(F.col("o_totalprice").cast("decimal(12,2)")).alias("total_spent"))
    return joins.lookup(t.customer.select(F.col("c_custkey").alias("user_id")), spent, ["user_id"],
                        {"order_count": 0, "total_spent": 0})


@check("join_left_chain_diff_keys", "long: l_orderkey l_linenumber, text: supplier part_name nation, double: usd",
       f"""SELECT l_orderkey, l_linenumber, s_name AS supplier, p_name AS part_name, n_name AS nation,
             {exact_ratio('CAST(l_extendedprice AS DECIMAL(12,2))', '1 + l_orderkey % 5', 4)} AS usd
           FROM lineitem LEFT JOIN supplier ON s_suppkey = CASE WHEN l_linenumber <> 2 THEN l_suppkey END
             LEFT JOIN part ON p_partkey = CASE WHEN l_returnflag <> 'A' THEN l_partkey END LEFT JOIN nation ON n_nationkey = s_nationkey""")
def join_left_chain_diff_keys(t: Tables) -> DataFrame:
    """Lines with supplier, part and nation; some lines name no supplier or no part."""
    lines = t.lineitem.withColumns({"supplier_key": F.when(F.col("l_linenumber") != 2, F.col("l_suppkey")),
                                    "part_key": F.when(F.col("l_returnflag") != "A", F.col("l_partkey"))})
    joined = (
        lines.join(t.supplier, F.col("supplier_key") == F.col("s_suppkey"), "left")
        .join(t.part, F.col("part_key") == F.col("p_partkey"), "left")
        .join(t.nation, F.col("s_nationkey") == F.col("n_nationkey"), "left")
    )
    usd = ratio(F.col("l_extendedprice").cast("decimal(12,2)"), 1 + F.col("l_orderkey") % 5, 4)
    return joined.select("l_orderkey", "l_linenumber", F.col("s_name").alias("supplier"),
                         F.col("p_name").alias("part_name"), F.col("n_name").alias("nation"), usd.alias("usd"))


@check("join_full_outer_expr", "text: day, long: orders shipped",
       """SELECT coalesce(o.day, s.day) AS day, coalesce(o.n, 0) AS orders, coalesce(s.n, 0) AS shipped
          FROM (SELECT CAST(o_orderdate AS DATE) AS day, count(*) AS n FROM orders GROUP BY 1) o
          FULL JOIN (SELECT CAST(l_shipdate AS DATE) AS day, count(*) AS n FROM lineitem GROUP BY 1) s
            ON s.day = o.day""")
def join_full_outer_expr(t: Tables) -> DataFrame:
    placed = t.orders.groupBy(F.to_date("o_orderdate").alias("o_day")).agg(F.count("*").alias("orders"))
    sent = t.lineitem.groupBy(F.to_date("l_shipdate").alias("s_day")).agg(F.count("*").alias("shipped"))
    both = placed.join(sent, F.col("o_day") == F.col("s_day"), "full")
    return both.select(F.coalesce("o_day", "s_day").alias("day"), F.coalesce("orders", F.lit(0)).alias("orders"),
                       F.coalesce("shipped", F.lit(0)).alias("shipped"))


@check("join_lateral_top1", "long: c_custkey last_order, text: last_date last_status",
       """SELECT c_custkey, o.o_orderkey AS last_order, o.o_orderdate AS last_date, o.o_orderstatus AS last_status
          FROM customer LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY o_custkey
            ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders) o ON o_custkey = c_custkey AND n = 1""")
def join_lateral_top1(t: Tables) -> DataFrame:
    """Every customer with the latest order, if any."""
    placed = t.orders.select(
        F.col("o_custkey").alias("c_custkey"), "o_orderdate", "o_orderkey", "o_orderstatus")
    last = latest_per_key(placed, ["c_custkey"], ["o_orderdate", "o_orderkey"])
    return t.customer.select("c_custkey").join(last, "c_custkey", "left").select(
        "c_custkey", F.col("o_orderkey").alias("last_order"), F.col("o_orderdate").alias("last_date"),
        F.col("o_orderstatus").alias("last_status"))


@check("join_correlated_counts", "long: c_custkey total_orders filled pending",
       """SELECT c_custkey, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS total_orders,
            (SELECT count(*) FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F') AS filled,
            (SELECT count(*) FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P') AS pending
          FROM customer""")
def join_correlated_counts(t: Tables) -> DataFrame:
    status = F.col("o_orderstatus")
    return joins.correlated_counts(
        t.customer.select("c_custkey"), t.orders.withColumnRenamed("o_custkey", "c_custkey"), "c_custkey",
        {"total_orders": F.lit(True), "filled": status == "F", "pending": status == "P"})


@check("join_anti_presence", "long: doc_id, text: source",
       "SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) "
       "AND doc_id NOT IN (SELECT vec_id FROM embeddings WHERE label % 2 = 0)")
def join_anti_presence(t: Tables) -> DataFrame:
    """Documents neither labelled nor among the vectors with an even label."""
    even = t.embeddings.where(F.col("label") % 2 == 0).withColumnRenamed("vec_id", "doc_id")
    return joins.missing_from(t.documents.select("doc_id", "source"), t.labels, even, on=["doc_id"])


@check("join_cross_filtered", "text: region priority, long: orders",
       """SELECT r_name AS region, v.p AS priority, count(o_orderkey) AS orders
          FROM region CROSS JOIN (VALUES ('1-URGENT'), ('2-HIGH'), ('0-NEVER')) v(p)
            LEFT JOIN (SELECT o_orderkey, o_orderpriority, n_regionkey FROM orders JOIN customer ON o_custkey = c_custkey
              JOIN nation ON c_nationkey = n_nationkey) o ON n_regionkey = r_regionkey AND o_orderpriority = v.p
          WHERE r_name <> 'ASIA' GROUP BY r_name, v.p""")
def join_cross_filtered(t: Tables) -> DataFrame:
    """Order counts on a region by priority grid, 0 where none; orders are counted before the join."""
    wanted = ["1-URGENT", "2-HIGH", "0-NEVER"]
    cells = joins.grid(t.region.where(F.col("r_name") != "ASIA"), "o_orderpriority", wanted)
    places = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).select(
        "c_custkey", F.col("n_regionkey").alias("r_regionkey"))
    counted = (
        t.orders.where(F.col("o_orderpriority").isin(wanted)).join(places, F.col("o_custkey") == F.col("c_custkey"))
        .groupBy("r_regionkey", "o_orderpriority").agg(F.count("*").alias("orders"))
    )
    full = joins.lookup(cells, counted, ["r_regionkey", "o_orderpriority"], {"orders": 0})
    return full.select(F.col("r_name").alias("region"), F.col("o_orderpriority").alias("priority"), "orders")


# -- set operations ----------------------------------------------------------------------

@check("union_all", "text: kind name, long: key",
       "SELECT 'customer' AS kind, c_name AS name, c_custkey AS key FROM customer UNION ALL "
       "SELECT 'supplier', s_name, s_suppkey FROM supplier UNION ALL SELECT 'part', p_name, p_partkey FROM part")
def union_all(t: Tables) -> DataFrame:
    def tagged(df: DataFrame, kind: str, name: str, key: str) -> DataFrame:
        return df.select(F.lit(kind).alias("kind"), F.col(name).alias("name"), F.col(key).alias("key"))

    return (
        tagged(t.customer, "customer", "c_name", "c_custkey")
        .unionByName(tagged(t.supplier, "supplier", "s_name", "s_suppkey"))
        .unionByName(tagged(t.part, "part", "p_name", "p_partkey"))
    )


@check("literal_rows", "text: o_orderpriority label, long: orders",
       "SELECT o_orderpriority, label, count(*) AS orders FROM orders JOIN (SELECT '1-URGENT' AS p, 'now' AS label "
       "UNION ALL SELECT '2-HIGH', 'soon' UNION ALL SELECT '5-LOW', 'later') v ON p = o_orderpriority GROUP BY ALL")
def literal_rows(t: Tables) -> DataFrame:
    rows = t.spark.createDataFrame([("1-URGENT", "now"), ("2-HIGH", "soon"), ("5-LOW", "later")],
                                   "o_orderpriority string, label string")
    counted = t.orders.groupBy("o_orderpriority").agg(F.count("*").alias("orders"))
    return counted.join(rows, "o_orderpriority")


@check("set_difference", "long: part_key supplier_key",
       "SELECT l_partkey AS part_key, l_suppkey AS supplier_key FROM lineitem WHERE l_linestatus = 'F' "
       "EXCEPT SELECT l_partkey, l_suppkey FROM lineitem WHERE l_returnflag = 'R'")
def set_difference(t: Tables) -> DataFrame:
    """Part and supplier pairs with a finished line but no return."""
    pair = [F.col("l_partkey").alias("part_key"), F.col("l_suppkey").alias("supplier_key")]
    finished = t.lineitem.where(F.col("l_linestatus") == "F").select(*pair)
    return joins.set_difference(finished, t.lineitem.where(F.col("l_returnflag") == "R").select(*pair))


# -- data checks -------------------------------------------------------------------------

@check("dq_not_null", "text: column, long: rows nulls",
       """WITH x AS (SELECT o_orderkey, nullif(o_orderstatus, 'P') AS status, o_orderdate FROM orders)
          SELECT 'o_orderkey' AS "column", count(*) AS rows, 0 AS nulls FROM x UNION ALL
          SELECT 'status', count(*), count(*) FILTER (status IS NULL) FROM x UNION ALL
          SELECT 'o_orderdate', count(*), 0 FROM x""")
def dq_not_null(t: Tables) -> DataFrame:
    planted = t.orders.select("o_orderkey", F.nullif("o_orderstatus", F.lit("P")).alias("status"), "o_orderdate")
    return quality.null_counts(planted, planted.columns)


@check("dq_unique", "long: id row_count",
       "SELECT id, count(*) AS row_count FROM raw_order_items GROUP BY id HAVING count(*) > 1")
def dq_unique(t: Tables) -> DataFrame:
    return quality.duplicates(raw.order_items(t), ["id"])


@check("dq_relationships", "text: reference, long: missing_values missing_rows",
       """SELECT 'lineitem.order' AS reference, 0 AS missing_values, count(*) AS missing_rows FROM lineitem
            WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders) UNION ALL
          SELECT 'lineitem.small_part', count(DISTINCT l_partkey), count(*) FROM lineitem
            WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size <= 25)""")
def dq_relationships(t: Tables) -> DataFrame:
    def totals(name: str, broken: DataFrame) -> DataFrame:
        return broken.agg(F.count("*").alias("missing_values"),
                          F.coalesce(F.sum("row_count"), F.lit(0)).alias("missing_rows")).withColumn(
            "reference", F.lit(name))

    whole = quality.broken_references(t.lineitem, "l_orderkey", t.orders, "o_orderkey")
    part = quality.broken_references(t.lineitem, "l_partkey", t.part.where(F.col("p_size") <= 25), "p_partkey")
    return totals("lineitem.order", whole).unionByName(totals("lineitem.small_part", part))


@check("dq_orphans", "long: doc_id, text: presence",
       "SELECT coalesce(d.doc_id, l.id) AS doc_id, CASE WHEN l.id IS NULL THEN 'left_only' WHEN d.doc_id IS NULL "
       "THEN 'right_only' ELSE 'both' END AS presence FROM documents d "
       "FULL JOIN (SELECT doc_id + 500 AS id FROM labels) l ON l.id = d.doc_id")
def dq_orphans(t: Tables) -> DataFrame:
    """Documents against label keys moved by 500, so that both sides have unmatched keys."""
    return joins.reconcile(t.documents, t.labels.select((F.col("doc_id") + 500).alias("doc_id")), "doc_id")


@check("dq_orphans_summary", "long: total_keys orphaned_count managed_count unknown_count, text: status",
       """SELECT count(*) AS total_keys, count(*) FILTER (l.doc_id IS NULL) AS orphaned_count,
            count(*) FILTER (l.doc_id IS NOT NULL AND d.doc_id IS NOT NULL) AS managed_count,
            count(*) FILTER (d.doc_id IS NULL) AS unknown_count,
            CASE WHEN count(*) FILTER (l.doc_id IS NULL) = 0 THEN 'clean' ELSE 'needs_attention' END AS status
          FROM documents d FULL JOIN labels l ON l.doc_id = d.doc_id""")
def dq_orphans_summary(t: Tables) -> DataFrame:
    return joins.reconcile_summary(joins.reconcile(t.documents, t.labels, "doc_id"))


@check("dq_declared_tests", "text: table column test, long: failures",
       """SELECT 'orders' AS "table", 'id' AS "column", 'not_null' AS test, 0 AS failures UNION ALL
          SELECT 'orders', 'id', 'unique', count(*) FROM (SELECT 1 FROM orders GROUP BY o_orderkey HAVING count(*) > 1) x
          UNION ALL SELECT 'orders', 'customer_id', 'references', count(*) FROM orders
            WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)
          UNION ALL SELECT 'order_items', 'id', 'unique', count(*) FROM (
            SELECT 1 FROM lineitem GROUP BY l_orderkey * 10 + l_linenumber HAVING count(*) > 1) y""")
def dq_declared_tests(t: Tables) -> DataFrame:
    declared = {
        "orders": {"id": ["not_null", "unique"], "customer_id": [("references", "customers", "id")]},
        "order_items": {"id": ["unique"]},
    }
    return quality.run_checks(raw.raw_source(t), declared)


# -- run analytics -----------------------------------------------------------------------

def event_runs(t: Tables) -> DataFrame:
    """Events as a run log: a day is a run, an event type a model, and errors fail."""
    daily = t.events.groupBy(F.date_format("ts", "yyyyMMdd").alias("day"), F.col("event_type").alias("model")).agg(
        F.sum(F.col("value").cast("decimal(12,2)")).cast("double").alias("execution_time"),
        F.max(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")).alias("timestamp"))
    failed = F.col("model") == "error"
    log = daily.select(F.concat(F.lit("run_"), F.col("day")).alias("run_id"), "model", "execution_time", "timestamp",
                       F.when(failed, "failed").otherwise("success").alias("status"),
                       F.when(failed, "event error").alias("error"))
    return history.records_from_log(log)


def stored_runs(t: Tables) -> DataFrame:
    """The same records after a round trip through JSON files in the shared folder."""
    path = scratch_path(t.spark, "runs")
    history.write_runs(event_runs(t), path)
    return history.read_runs(t.spark, path, multi_line=False)


_RUN_LOG = """SELECT 'run_' || strftime(ts, '%Y%m%d') AS run_id, event_type AS model,
    CASE event_type WHEN 'error' THEN 'failed' ELSE 'success' END AS status,
    CASE event_type WHEN 'error' THEN 'event error' END AS error,
    sum(CAST(value AS DECIMAL(12,2))) AS execution_time, strftime(max(ts), '%Y-%m-%dT%H:%M:%S') AS timestamp
  FROM events GROUP BY ALL"""


@check("run_history_scan", "text: run_id timestamp, long: total_models log_lines",
       f"""SELECT run_id, max(timestamp) AS timestamp, count(*) AS total_models, count(*) AS log_lines
           FROM ({_RUN_LOG}) r GROUP BY run_id ORDER BY run_id DESC LIMIT 50""")
def run_history_scan(t: Tables) -> DataFrame:
    return history.recent_runs(stored_runs(t)).select(
        "run_id", "timestamp", F.col("summary.total_models").alias("total_models"), F.size("logs").alias("log_lines"))


@check("run_summary", "text: run_id, long: total_models successes failures, double: total_execution_time",
       f"""SELECT run_id, count(*) AS total_models, count(*) FILTER (status = 'success') AS successes,
             count(*) FILTER (status = 'failed') AS failures,
             round(CAST(sum(execution_time) AS DOUBLE), 2) AS total_execution_time
           FROM ({_RUN_LOG}) r GROUP BY run_id""")
def run_summary(t: Tables) -> DataFrame:
    return history.run_summary(stored_runs(t)).withColumn(
        "total_execution_time", F.round("total_execution_time", 2))


@check("run_model_history", "text: run_id status error logs, double: execution_time",
       f"""SELECT run_id, status, error, execution_time,
             '[' || timestamp || '] [ERROR] ' || model || ': failed' AS logs
           FROM ({_RUN_LOG}) r WHERE model = 'error' ORDER BY run_id DESC LIMIT 10""")
def run_model_history(t: Tables) -> DataFrame:
    rows = history.model_history(stored_runs(t), "error", limit=10)
    own = F.filter("logs", lambda line: line.contains("] error:"))
    return rows.select("run_id", "status", "error", "execution_time", F.array_join(own, "|").alias("logs"))


@check("schedule_status", "long: user_id total_runs purchases errors item_count last_event_id, text: last_ts items",
       """SELECT u.c_custkey AS user_id, coalesce(c.total_runs, 0) AS total_runs, coalesce(c.purchases, 0) AS purchases,
            coalesce(c.errors, 0) AS errors, coalesce(i.n, 0) AS item_count, c.last_event_id, c.last_ts, i.items
          FROM customer u
          LEFT JOIN (SELECT user_id, count(*) AS total_runs, count(*) FILTER (event_type = 'purchase') AS purchases,
            count(*) FILTER (event_type = 'error') AS errors, arg_max(event_id, (ts, event_id)) AS last_event_id,
            max(ts) AS last_ts FROM events GROUP BY user_id) c ON c.user_id = c_custkey
          LEFT JOIN (SELECT user_id, count(*) AS n, string_agg(event_type, ', ' ORDER BY length(event_type), event_type)
            AS items FROM (SELECT DISTINCT user_id, event_type FROM events) d GROUP BY user_id) i
            ON i.user_id = c_custkey""")
def schedule_status(t: Tables) -> DataFrame:
    """Customers with their last event, event counts and event types ordered by (length, name)."""
    kind = F.col("event_type")
    items = t.events.select("user_id", kind.alias("item"), F.length(kind).alias("position"))
    return history.entity_status(
        t.customer.select(F.col("c_custkey").alias("user_id")), t.events.select("user_id", "ts", "event_id", "event_type"),
        items, "user_id", ["ts", "event_id"],
        {"total_runs": F.lit(True), "purchases": kind == "purchase", "errors": kind == "error"})


# -- nested results ----------------------------------------------------------------------

_LISTED = "CAST(l_partkey AS VARCHAR) || ':' || l_returnflag"


_IN_ORDER = "l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate"
_TIES = ["l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate"]


@check("agg_nested_list", "long: o_orderkey chunk n, text: lines",
       f"""SELECT l_orderkey AS o_orderkey, coalesce((rn - 1) // 10000, 0) AS chunk, count(rn) AS n,
             coalesce(string_agg({_LISTED}, ',' ORDER BY rn) FILTER (rn IS NOT NULL), '') AS lines
           FROM (SELECT *, CASE WHEN l_returnflag = 'R' THEN row_number() OVER (PARTITION BY l_orderkey, l_returnflag = 'R'
             ORDER BY {_IN_ORDER}) END AS rn FROM lineitem) l GROUP BY 1, 2""")
def agg_nested_list(t: Tables) -> DataFrame:
    """Per order the array of its returned lines, in line order; empty where none was returned."""
    rows = t.lineitem.withColumnRenamed("l_orderkey", "o_orderkey")
    nested = nested_rows(rows, "o_orderkey", F.col("l_returnflag") == "R", "l_linenumber", _TIES, ["l_partkey", "l_returnflag"], "children")
    return _flattened(nested, "o_orderkey")


@check("agg_nested_distinct", "long: user_id chunk n, text: types",
       """SELECT user_id, coalesce((rn - 1) // 10000, 0) AS chunk, count(rn) AS n,
            coalesce(string_agg(kind, ',' ORDER BY kind) FILTER (rn IS NOT NULL), '') AS types
          FROM (SELECT *, CASE WHEN kind IS NOT NULL THEN row_number() OVER (PARTITION BY user_id, kind IS NULL ORDER BY kind) END AS rn
            FROM (SELECT DISTINCT user_id, nullif(event_type, 'view') AS kind FROM events) d) e GROUP BY 1, 2""")
def agg_nested_distinct(t: Tables) -> DataFrame:
    """Per user the distinct event types but views, in order; empty for users who only view."""
    rows = t.events.select("user_id", F.nullif("event_type", F.lit("view")).alias("kind"))
    nested = nested_distinct(rows, "user_id", "kind", "children")
    return nested.select("user_id", "chunk", F.size("children").alias("n"), F.array_join(F.transform("children", lambda r: r["kind"]), ",").alias("types"))


@check("agg_nest_children", "long: o_orderkey chunk n, text: lines",
       f"""SELECT o_orderkey, coalesce((rn - 1) // 10000, 0) AS chunk, count(rn) AS n, coalesce(string_agg({_LISTED}, ',' ORDER BY rn), '') AS lines
           FROM orders LEFT JOIN (SELECT *, CASE WHEN l_linenumber > 1 THEN l_orderkey END AS parent, row_number() OVER (
               PARTITION BY l_orderkey, l_linenumber > 1 ORDER BY {_IN_ORDER}) AS rn FROM lineitem) l ON parent = o_orderkey
           GROUP BY 1, 2""")
def agg_nest_children(t: Tables) -> DataFrame:
    """Every order with the array of its lines; first lines belong to no order, so some have none."""
    lines = t.lineitem.withColumn("o_orderkey", F.when(F.col("l_linenumber") > 1, F.col("l_orderkey")))
    nested = nested_children(t.orders.select("o_orderkey"), lines, "o_orderkey", "l_linenumber", _TIES,
                             ["l_partkey", "l_returnflag"], "children")
    return _flattened(nested, "o_orderkey")


def _flattened(nested: DataFrame, key: str) -> DataFrame:
    text = F.transform("children", lambda r: F.concat(r["l_partkey"].cast("string"), F.lit(":"), r["l_returnflag"]))
    return nested.select(key, "chunk", F.size("children").alias("n"), F.array_join(text, ",").alias("lines"))
