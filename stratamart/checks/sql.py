"""SQL views over the star-schema tables, and exact arithmetic for DuckDB.

The views state the raw tables once more, independently of the DataFrame adapters.
"""

from __future__ import annotations

import re

VIEWS: dict[str, str] = {}

VIEWS["raw_customers"] = """
SELECT c_custkey AS id, 'user' || CAST(c_custkey AS STRING) || '@example.com' AS email,
  c_name AS name, TIMESTAMP '1994-01-01 00:00:00' + INTERVAL '1' DAY * (c_custkey % 365) AS created_at,
  n_name AS country, c_mktsegment AS segment
FROM customer JOIN nation ON c_nationkey = n_nationkey
"""

VIEWS["raw_products"] = """
SELECT p_partkey AS id, p_name AS name, p_type AS category,
  CAST((CAST(p_retailprice AS DECIMAL(10,2)) - 900) * 3 AS DECIMAL(10,2)) AS price,
  CAST((CAST(p_retailprice AS DECIMAL(10,2)) - 900) * (40 + p_size) * 0.03 AS DECIMAL(10,2)) AS cost,
  p_brand || '-' || CAST(p_partkey AS STRING) AS sku, CAST(p_size * 0.20 AS DECIMAL(10,2)) AS weight_kg
FROM part
"""

VIEWS["raw_orders"] = """
SELECT o_orderkey AS id, o_custkey AS customer_id, o_orderdate AS order_date,
  CAST(CAST(o_totalprice AS DECIMAL(12,2)) * 0.004 AS DECIMAL(10,2)) AS total_amount,
  CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'pending' ELSE 'processing' END AS status
FROM orders
"""

VIEWS["raw_order_items"] = """
SELECT row_id AS id, order_id, product_id, quantity, price, CAST(price * quantity AS DECIMAL(12,2)) AS total
FROM (SELECT l_orderkey * 10 + l_linenumber AS row_id, l_orderkey AS order_id, l_partkey AS product_id,
        CAST(l_quantity AS INT) - 1 AS quantity,
        CAST((l_partkey % 300) + 1.50 AS DECIMAL(10,2)) AS price FROM lineitem) li
"""

VIEWS["raw_warehouses"] = """
SELECT r_regionkey AS id, r_name || ' Warehouse' AS name, r_name AS location,
  5000 + r_regionkey * 1000 AS capacity, 'mgr' || CAST(r_regionkey AS STRING) AS manager
FROM region
"""

VIEWS["raw_stock_levels"] = """
SELECT p_partkey * 10 + r_regionkey AS id, p_partkey AS product_id, r_regionkey AS warehouse_id,
  CAST((p_partkey * 7 + r_regionkey * 13) % 60 AS INT) AS quantity,
  TIMESTAMP '2001-07-01 00:00:00' + INTERVAL '1' DAY * (p_partkey % 30) AS last_updated
FROM part CROSS JOIN region
"""

VIEWS["raw_suppliers"] = """
SELECT s_suppkey AS id, s_name AS name, s_name || ' contact' AS contact_name,
  'sup' || CAST(s_suppkey AS STRING) || '@example.com' AS email,
  CAST(s_suppkey AS STRING) AS phone, n_name AS country,
  CAST(3 + (s_suppkey % 21) * 0.1 AS DECIMAL(2,1)) AS rating
FROM supplier JOIN nation ON s_nationkey = n_nationkey
"""

VIEWS["raw_purchase_orders"] = """
SELECT l_orderkey * 10 + l_linenumber AS id, l_suppkey AS supplier_id, o_orderdate AS order_date,
  l_shipdate AS expected_delivery,
  CASE l_linestatus WHEN 'F' THEN 'received' ELSE 'pending' END AS status,
  CAST(l_extendedprice AS DECIMAL(12,2)) AS total_amount
FROM lineitem JOIN orders ON l_orderkey = o_orderkey
"""

VIEWS["raw_carriers"] = """
SELECT n_nationkey AS id, n_name || ' Freight' AS name, CAST(n_nationkey AS STRING) AS contact_phone,
  CAST(3.5 + (n_nationkey % 16) * 0.1 AS DECIMAL(2,1)) AS rating
FROM nation
"""

VIEWS["raw_shipments"] = """
SELECT l_orderkey * 10 + l_linenumber AS id, l_orderkey AS order_id, s_nationkey AS carrier_id,
  n_regionkey AS warehouse_id, 'TRK' || CAST(l_orderkey * 10 + l_linenumber AS STRING) AS tracking_number,
  o_orderdate + INTERVAL '1' DAY AS ship_date, o_orderdate + INTERVAL '45' DAY AS estimated_delivery,
  CASE WHEN l_linestatus = 'F' THEN l_shipdate END AS actual_delivery,
  CASE WHEN l_linestatus = 'F' THEN 'delivered' WHEN l_linenumber = 1 THEN 'delayed' ELSE 'in_transit' END AS status
FROM lineitem JOIN orders ON l_orderkey = o_orderkey
  JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
"""

VIEWS["raw_returns"] = """
SELECT l_orderkey * 10 + l_linenumber AS id, l_orderkey AS order_id,
  l_shipdate + INTERVAL '1' DAY * l_linenumber AS return_date,
  CASE l_partkey % 5 WHEN 0 THEN 'Defective' WHEN 1 THEN 'Wrong Item' WHEN 2 THEN 'Not as Described'
    WHEN 3 THEN 'Changed Mind' ELSE 'Size Issue' END AS reason,
  CASE l_suppkey % 4 WHEN 0 THEN 'pending' WHEN 1 THEN 'approved' WHEN 2 THEN 'rejected' ELSE 'completed' END AS status,
  'note' AS notes
FROM lineitem WHERE l_returnflag = 'R'
"""

VIEWS["raw_payment_transactions"] = """
SELECT o_orderkey AS id, o_orderkey AS order_id, o_custkey * 10 AS payment_method_id,
  o_orderdate AS transaction_date,
  CAST(CAST(CAST(o_totalprice AS DECIMAL(12,2)) * 0.004 AS DECIMAL(10,2))
    + CASE o_orderkey % 3 WHEN 0 THEN 0 WHEN 1 THEN -5 ELSE 5 END AS DECIMAL(10,2)) AS amount,
  CASE WHEN o_orderkey % 10 = 0 THEN 'failed' WHEN o_orderkey % 10 = 1 THEN 'pending' ELSE 'success' END AS status,
  'TXN-' || CAST(o_orderkey AS STRING) AS transaction_id
FROM orders
"""

VIEWS["raw_campaigns"] = """
SELECT id, channel || ' wave ' || CAST(id AS STRING) AS name, channel, start_date, end_date, budget,
  CASE id % 3 WHEN 0 THEN 'active' WHEN 1 THEN 'completed' ELSE 'paused' END AS status
FROM (SELECT CAST('0x' || substr(md5(event_type || ':' || strftime(date_trunc('week', ts), '%Y-%m-%d')), 1, 12) AS BIGINT) AS id, event_type AS channel,
        CAST(min(ts) AS DATE) AS start_date, CAST(max(ts) AS DATE) AS end_date,
        CAST(sum(CAST(value AS DECIMAL(12,2))) AS DECIMAL(14,2)) AS budget
      FROM events GROUP BY event_type, date_trunc('week', ts)) g
"""

VIEWS["raw_promotions"] = """
SELECT id, 'P' || CAST(id AS STRING) AS code, event_type AS type,
  CAST(5 + id % 46 AS DECIMAL(10,2)) AS discount_value, day AS start_date,
  day + CAST(7 + id % 84 AS INT) AS end_date,
  CAST(40 + 4 * extract(day FROM day) AS INT) AS usage_limit, CAST(n AS INT) AS times_used
FROM (SELECT CAST('0x' || substr(md5(event_type || ':' || strftime(CAST(ts AS DATE), '%Y-%m-%d')), 1, 12) AS BIGINT) AS id, event_type,
        CAST(ts AS DATE) AS day, count(*) AS n
      FROM events GROUP BY event_type, CAST(ts AS DATE)) g
"""

VIEWS["raw_employees"] = """
SELECT s_suppkey AS id, s_name AS name, 'emp' || CAST(s_suppkey AS STRING) || '@example.com' AS email,
  CASE s_nationkey % 5 WHEN 0 THEN 'Sales' WHEN 1 THEN 'Marketing' WHEN 2 THEN 'Operations'
    WHEN 3 THEN 'Customer Service' ELSE 'IT' END AS department,
  'Role ' || CAST(s_nationkey AS STRING) AS position,
  DATE '1995-01-01' + CAST((s_suppkey * 37) % 2400 AS INT) AS hire_date,
  CAST(40000 + (CAST(s_acctbal AS DECIMAL(12,2)) + 1000) * 8 AS DECIMAL(10,2)) AS salary
FROM supplier
"""

VIEWS["raw_commissions"] = """
SELECT l_orderkey AS id, l_orderkey AS order_id, l_suppkey AS sales_rep_id,
  CAST(l_discount AS DECIMAL(6,4)) AS commission_rate,
  CAST(CAST(l_extendedprice AS DECIMAL(12,2)) * CAST(l_discount AS DECIMAL(6,4)) AS DECIMAL(10,2)) AS commission_amount,
  l_shipdate AS paid_date, CASE l_linestatus WHEN 'F' THEN 'paid' ELSE 'pending' END AS status
FROM lineitem WHERE l_linenumber = 1
"""

VIEWS["demo_users"] = """
SELECT c_custkey AS user_id, c_name AS name, CAST(18 + c_custkey % 60 AS INT) AS age, n_name AS country
FROM customer JOIN nation ON c_nationkey = n_nationkey
"""

VIEWS["demo_beacons"] = """
SELECT event_id AS id, ts AS created_at, user_id, user_id % 20 AS organization_id, event_type AS beacon_type,
  CASE WHEN value >= 100 THEN 'high' WHEN value >= 20 THEN 'medium' ELSE 'low' END AS severity,
  event_id % 3 = 0 AS acknowledged
FROM events
"""



def exact_ratio(num: str, den: str, digits: int, factor: int = 1, num_scale: int = 2, den_scale: int = 0) -> str:
    """``round(num * factor / den, digits)`` half away from zero, in integer arithmetic; NULL for den = 0.

    ``num`` and ``den`` are expressions of at most ``num_scale`` and ``den_scale`` fractional digits.
    """
    a = f"(CAST(({num}) * {10 ** num_scale} AS HUGEINT) * {factor * 10 ** (digits + den_scale)})"
    b = f"(CAST(({den}) * {10 ** den_scale} AS HUGEINT) * {10 ** num_scale})"
    whole = f"((2 * abs({a}) + abs({b})) // (2 * abs({b})))"
    return f"(CASE WHEN ({den}) <> 0 THEN sign({a}) * sign({b}) * {whole} / {float(10 ** digits)} END)"


def exact_avg(value: str, digits: int = 6, scale: int = 2) -> str:
    return exact_ratio(f"sum({value})", f"count({value})", digits, num_scale=scale)


def years_between(later: str, earlier: str) -> str:
    """Completed years from ``earlier`` to ``later``."""
    return (f"(extract(year FROM {later}) - extract(year FROM {earlier}) - "
            f"CASE WHEN strftime({later}, '%m%d') < strftime({earlier}, '%m%d') THEN 1 ELSE 0 END)")


def with_views(query: str) -> str:
    """Prefix the views the query needs, in order of dependence."""
    needed: list[str] = []

    def visit(text: str) -> None:
        for name in dict.fromkeys(re.findall(r"\b\w+\b", text)):
            if name in VIEWS and name not in needed:
                visit(VIEWS[name])
                needed.append(name)

    visit(query)
    if not needed:
        return query
    body = ",\n".join(f"{name} AS ({VIEWS[name]})" for name in needed)
    return f"WITH {body}\n{query}"
