"""The 34 named models and the lookup example.

The SQL works from the raw views directly, without the layers in between.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from stratamart.checks.registry import check, events_mart, orders_mart
from stratamart.checks.sql import VIEWS, exact_avg, exact_ratio, years_between
from stratamart.plans.examples import taxed_orders
from stratamart.sources import Tables

AS_OF = "DATE '2001-08-01'"
EVENTS_DAY = "DATE '2024-01-20'"


def mart(name: str, spec: str, query: str, context=orders_mart) -> None:
    """Check the model ``name`` as built from the raw tables."""
    check(name, spec, query)(lambda t: context(t).ref(name))


# -- bronze ------------------------------------------------------------------------------

mart("stg_campaigns",
     "long: campaign_id campaign_duration_days, text: campaign_name marketing_channel campaign_start campaign_end "
     "campaign_status, double: campaign_budget",
     """SELECT id AS campaign_id, name AS campaign_name, channel AS marketing_channel, start_date AS campaign_start,
          end_date AS campaign_end, budget AS campaign_budget, status AS campaign_status,
          date_diff('day', start_date, end_date) AS campaign_duration_days FROM raw_campaigns""", events_mart)

mart("stg_carriers", "long: carrier_id, text: carrier_name carrier_phone, double: carrier_rating",
     """SELECT id AS carrier_id, name AS carrier_name, contact_phone AS carrier_phone, rating AS carrier_rating
        FROM raw_carriers""")

mart("stg_commissions",
     "long: commission_id order_id sales_rep_id, double: commission_rate commission_amount, "
     "text: paid_date commission_status",
     """SELECT id AS commission_id, order_id, sales_rep_id, commission_rate, commission_amount, paid_date,
          status AS commission_status FROM raw_commissions""")

mart("stg_customers", "long: customer_id, text: email customer_name created_at",
     "SELECT id AS customer_id, email, name AS customer_name, created_at FROM raw_customers")

mart("stg_employees",
     "long: employee_id years_of_service, text: employee_name employee_email department position hire_date, "
     "double: salary",
     f"""SELECT id AS employee_id, name AS employee_name, email AS employee_email, department, position, hire_date,
          salary, {years_between(AS_OF, 'hire_date')} AS years_of_service FROM raw_employees""")

mart("stg_order_items",
     "long: order_item_id order_id product_id quantity, double: unit_price line_total, text: loaded_at",
     f"""SELECT id AS order_item_id, order_id, product_id, quantity, price AS unit_price, total AS line_total,
          CAST({AS_OF} AS TIMESTAMP) AS loaded_at FROM raw_order_items WHERE quantity > 0""")

mart("stg_orders", "long: order_id customer_id, text: order_date status, double: total_amount",
     "SELECT id AS order_id, * EXCLUDE (id) FROM raw_orders")

mart("stg_payment_transactions",
     "long: transaction_id order_id payment_method_id, text: transaction_date payment_status "
     "external_transaction_id, double: transaction_amount",
     """SELECT id AS transaction_id, order_id, payment_method_id, transaction_date, amount AS transaction_amount,
          status AS payment_status, 'TXN-' || id AS external_transaction_id
        FROM raw_payment_transactions WHERE status = 'success'""")

mart("stg_products",
     "long: product_id, text: product_name category sku, double: price cost weight_kg profit_margin margin_percentage",
     f"""SELECT id AS product_id, name AS product_name, category, price, cost, sku, weight_kg,
          price - cost AS profit_margin,
          {exact_ratio('price - cost', 'price', 2, 100, den_scale=2)} AS margin_percentage
        FROM raw_products WHERE price > 0""")

mart("stg_promotions",
     "long: promotion_id usage_limit times_used, text: promo_code promo_type promo_start promo_end, "
     "double: discount_value utilization_percentage",
     f"""SELECT id AS promotion_id, code AS promo_code, type AS promo_type, discount_value, start_date AS promo_start,
          end_date AS promo_end, usage_limit, times_used,
          {exact_ratio('times_used', 'usage_limit', 2, 100, num_scale=0)} AS utilization_percentage
        FROM raw_promotions""", events_mart)

mart("stg_purchase_orders",
     "long: purchase_order_id supplier_id, text: po_date expected_delivery po_status, double: po_total",
     """SELECT id AS purchase_order_id, supplier_id, order_date AS po_date, expected_delivery, status AS po_status,
          total_amount AS po_total FROM raw_purchase_orders""")

mart("stg_returns", "long: return_id order_id, text: return_date return_reason return_status return_notes",
     """SELECT id AS return_id, order_id, return_date, reason AS return_reason, status AS return_status,
          notes AS return_notes FROM raw_returns""")

_PERFORMANCE = """CASE WHEN actual_delivery IS NULL OR estimated_delivery IS NULL THEN 'In Transit'
    WHEN actual_delivery > estimated_delivery THEN 'Delayed' ELSE 'On Time' END"""

mart("stg_shipments",
     "long: shipment_id order_id carrier_id warehouse_id, text: tracking_number ship_date estimated_delivery "
     "actual_delivery shipment_status delivery_performance",
     f"""SELECT id AS shipment_id, order_id, carrier_id, warehouse_id, tracking_number, ship_date, estimated_delivery,
          actual_delivery, status AS shipment_status, {_PERFORMANCE} AS delivery_performance FROM raw_shipments""")

mart("stg_stock_levels", "long: stock_id product_id warehouse_id stock_quantity, text: last_updated",
     """SELECT id AS stock_id, product_id, warehouse_id, quantity AS stock_quantity, last_updated
        FROM raw_stock_levels""")

mart("stg_suppliers",
     "long: supplier_id, text: supplier_name contact_name supplier_email supplier_phone supplier_country, "
     "double: supplier_rating",
     """SELECT id AS supplier_id, name AS supplier_name, contact_name, email AS supplier_email,
          phone AS supplier_phone, country AS supplier_country, rating AS supplier_rating FROM raw_suppliers""")

mart("stg_warehouses", "long: warehouse_id capacity, text: warehouse_name location warehouse_manager",
     """SELECT id AS warehouse_id, name AS warehouse_name, location, capacity, manager AS warehouse_manager
        FROM raw_warehouses""")

# -- silver ------------------------------------------------------------------------------

VIEWS["kept_products"] = "SELECT * FROM raw_products WHERE price > 0"
VIEWS["order_lines"] = """
SELECT i.id AS order_item_id, o.id AS order_id, o.customer_id, o.order_date, o.status AS order_status,
  p.id AS product_id, p.name AS product_name, p.category AS product_category, i.quantity,
  i.price AS unit_price, i.total AS line_total, p.cost AS unit_cost,
  i.quantity * (i.price - p.cost) AS line_profit
FROM raw_order_items i JOIN raw_orders o ON o.id = i.order_id JOIN kept_products p ON p.id = i.product_id
WHERE i.quantity > 0
"""
VIEWS["stock_rows"] = """
SELECT s.id AS stock_id, p.id AS product_id, p.name AS product_name, p.category, w.id AS warehouse_id,
  w.name AS warehouse_name, w.location AS warehouse_location, s.quantity AS stock_quantity,
  p.price AS unit_price, p.price * s.quantity AS inventory_value, s.last_updated
FROM raw_stock_levels s JOIN kept_products p ON p.id = s.product_id JOIN raw_warehouses w ON w.id = s.warehouse_id
"""
VIEWS["return_rows"] = """
SELECT r.id AS return_id, o.id AS order_id, o.customer_id, c.name AS customer_name, r.return_date,
  r.reason AS return_reason, r.status AS return_status, o.order_date,
  date_diff('microsecond', o.order_date, r.return_date) // 86400000000 AS days_to_return
FROM raw_returns r JOIN raw_orders o ON o.id = r.order_id JOIN raw_customers c ON c.id = o.customer_id
"""
VIEWS["parcels"] = f"""
SELECT s.id AS shipment_id, o.id AS order_id, o.customer_id, c.id AS carrier_id, c.name AS carrier_name,
  c.rating AS carrier_rating, w.id AS warehouse_id, w.name AS warehouse_name, s.tracking_number, s.ship_date,
  s.estimated_delivery, s.actual_delivery, s.status AS shipment_status, {_PERFORMANCE} AS delivery_performance,
  trunc(date_diff('microsecond', s.ship_date, s.actual_delivery) / 86400000000) AS actual_delivery_days
FROM raw_shipments s JOIN raw_orders o ON o.id = s.order_id JOIN raw_carriers c ON c.id = s.carrier_id
  JOIN raw_warehouses w ON w.id = s.warehouse_id
"""

_CAMPAIGN_DAYS = "date_diff('day', start_date, end_date)"
mart("int_campaign_performance",
     "long: campaign_id campaign_duration_days, text: campaign_name marketing_channel campaign_start campaign_end "
     "campaign_status completion_status, double: campaign_budget daily_budget",
     f"""SELECT id AS campaign_id, name AS campaign_name, channel AS marketing_channel, start_date AS campaign_start,
          end_date AS campaign_end, budget AS campaign_budget, status AS campaign_status,
          {_CAMPAIGN_DAYS} AS campaign_duration_days,
          coalesce({exact_ratio('budget', f'greatest({_CAMPAIGN_DAYS}, 0)', 2)}, 0) AS daily_budget,
          CASE WHEN status = 'completed' THEN 'Yes' WHEN end_date < {EVENTS_DAY} THEN 'Overdue'
            ELSE 'Active' END AS completion_status
        FROM raw_campaigns""", events_mart)

mart("int_customer_orders",
     "long: order_id customer_id, text: customer_name customer_email order_date status, double: total_amount",
     """SELECT o.id AS order_id, c.id AS customer_id, c.name AS customer_name, c.email AS customer_email,
          o.order_date, o.total_amount, o.status FROM raw_customers c JOIN raw_orders o ON o.customer_id = c.id""")

mart("int_employee_performance",
     "long: employee_id years_of_service, text: employee_name employee_email department position hire_date "
     "seniority_level salary_band, double: salary",
     f"""SELECT id AS employee_id, name AS employee_name, email AS employee_email, department, position, hire_date,
          salary, years AS years_of_service,
          CASE WHEN years >= 5 THEN 'Senior' WHEN years >= 2 THEN 'Mid-Level' ELSE 'Junior' END AS seniority_level,
          CASE WHEN salary >= 100000 THEN 'High' WHEN salary >= 60000 THEN 'Medium' ELSE 'Entry' END AS salary_band
        FROM (SELECT *, {years_between(AS_OF, 'hire_date')} AS years FROM raw_employees) e""")

mart("int_inventory_summary",
     "long: stock_id product_id warehouse_id stock_quantity, text: product_name category warehouse_name "
     "warehouse_location last_updated, double: unit_price inventory_value",
     "SELECT * FROM stock_rows")

mart("int_order_details",
     "long: order_item_id order_id customer_id product_id quantity, text: order_date order_status product_name "
     "product_category, double: unit_price line_total unit_cost line_profit",
     "SELECT * FROM order_lines")

mart("int_payment_reconciliation",
     "long: transaction_id order_id customer_id, text: customer_name transaction_date reconciliation_status, "
     "double: transaction_amount order_amount amount_difference",
     """SELECT t.id AS transaction_id, o.id AS order_id, c.id AS customer_id, c.name AS customer_name,
          t.transaction_date, t.amount AS transaction_amount, o.total_amount AS order_amount,
          t.amount - o.total_amount AS amount_difference,
          CASE WHEN abs(t.amount - o.total_amount) < 0.01 THEN 'Matched' WHEN t.amount < o.total_amount THEN 'Underpaid' ELSE 'Overpaid' END
            AS reconciliation_status
        FROM raw_payment_transactions t JOIN raw_orders o ON o.id = t.order_id
          JOIN raw_customers c ON c.id = o.customer_id WHERE t.status = 'success'""")

mart("int_promo_utilization",
     "long: promotion_id usage_limit times_used remaining_uses promo_duration_days, text: promo_code promo_type "
     "promo_start promo_end utilization_status, double: discount_value utilization_percentage",
     f"""SELECT promotion_id, code AS promo_code, type AS promo_type, discount_value, start_date AS promo_start,
          end_date AS promo_end, usage_limit, times_used, used AS utilization_percentage,
          usage_limit - times_used AS remaining_uses, end_date - start_date AS promo_duration_days,
          CASE WHEN usage_limit - times_used <= 0 THEN 'Exhausted' WHEN used >= 80 THEN 'High' WHEN used >= 50 THEN 'Medium'
            ELSE 'Low' END AS utilization_status
        FROM (SELECT id AS promotion_id, *,
          {exact_ratio('times_used', 'usage_limit', 2, 100, num_scale=0)} AS used FROM raw_promotions) p""",
     events_mart)

mart("int_return_analysis",
     "long: return_id order_id customer_id days_to_return, text: customer_name return_date return_reason "
     "return_status order_date",
     """SELECT * REPLACE (trunc(date_diff('microsecond', order_date, return_date) / 86400000000) AS days_to_return)
        FROM return_rows""")

mart("int_sales_commissions",
     "long: commission_id order_id customer_id sales_rep_id days_to_pay_commission, text: order_date sales_rep_name "
     "department paid_date commission_status, double: order_amount commission_rate commission_amount",
     """SELECT m.id AS commission_id, o.id AS order_id, o.customer_id, o.order_date, o.total_amount AS order_amount,
          e.id AS sales_rep_id, e.name AS sales_rep_name, e.department, m.commission_rate, m.commission_amount,
          m.paid_date, m.status AS commission_status,
          trunc(date_diff('microsecond', o.order_date, m.paid_date) / 86400000000) AS days_to_pay_commission
        FROM raw_orders o JOIN raw_commissions m ON m.order_id = o.id JOIN raw_employees e ON e.id = m.sales_rep_id""")

mart("int_shipment_tracking",
     "long: shipment_id order_id customer_id carrier_id warehouse_id actual_delivery_days, text: carrier_name "
     "warehouse_name tracking_number ship_date estimated_delivery actual_delivery shipment_status "
     "delivery_performance, double: carrier_rating",
     "SELECT * FROM parcels")

mart("int_supplier_orders",
     "long: purchase_order_id supplier_id lead_time_days, text: supplier_name supplier_country po_date "
     "expected_delivery po_status, double: supplier_rating po_total",
     """SELECT p.id AS purchase_order_id, s.id AS supplier_id, s.name AS supplier_name,
          s.country AS supplier_country, s.rating AS supplier_rating, p.order_date AS po_date, p.expected_delivery,
          p.status AS po_status, p.total_amount AS po_total,
          trunc(date_diff('microsecond', p.order_date, p.expected_delivery) / 86400000000) AS lead_time_days
        FROM raw_suppliers s JOIN raw_purchase_orders p ON p.supplier_id = s.id""")

_MARGIN = exact_ratio("price - cost", "price", 2, 100, den_scale=2)
mart("int_products_enriched",
     "long: product_id, text: product_name category sku price_category product_name_clean, "
     "double: price cost weight_kg profit_margin margin_percentage",
     f"""SELECT id AS product_id, name AS product_name, category, price, cost, sku, weight_kg,
          {_MARGIN} AS profit_margin, {_MARGIN} AS margin_percentage,
          CASE WHEN price >= 200 THEN 'Luxury' WHEN price >= 50 THEN 'Premium' WHEN price >= 10 THEN 'Mid-Range'
            ELSE 'Budget' END AS price_category,
          array_to_string(list_transform(string_split(trim(name), ' '),
            lambda w: upper(w[1]) || lower(w[2:])), ' ') AS product_name_clean
        FROM kept_products""")

# -- gold --------------------------------------------------------------------------------

mart("fct_orders",
     "long: order_id customer_id order_year order_month order_day, text: customer_name customer_email order_date "
     "status order_value_tier, double: total_amount",
     """SELECT o.id AS order_id, customer_id, name AS customer_name, email AS customer_email, order_date,
          total_amount, status, year(order_date) AS order_year, month(order_date) AS order_month,
          day(order_date) AS order_day,
          CASE WHEN total_amount >= 1000 THEN 'High Value' WHEN total_amount >= 100 THEN 'Medium Value' 
            ELSE 'Low Value' END AS order_value_tier
        FROM raw_orders o JOIN raw_customers c ON c.id = customer_id""")

mart("fct_sales_performance",
     "text: sale_date product_category, long: sale_year sale_month sale_quarter day_of_week order_count units_sold "
     "unique_customers, double: revenue profit avg_unit_price profit_margin_pct avg_order_value "
     "revenue_per_customer",
     f"""SELECT *, {exact_ratio('profit', 'revenue', 2, 100, den_scale=2)} AS profit_margin_pct,
          {exact_ratio('revenue', 'order_count', 2)} AS avg_order_value,
          {exact_ratio('revenue', 'unique_customers', 2)} AS revenue_per_customer
        FROM (
          SELECT CAST(order_date AS DATE) AS sale_date, year(order_date) AS sale_year,
            month(order_date) AS sale_month, quarter(order_date) AS sale_quarter,
            extract(dow FROM order_date) AS day_of_week, product_category,
            count(DISTINCT order_id) AS order_count, sum(line_total) AS revenue, sum(line_profit) AS profit,
            sum(quantity) AS units_sold, {exact_avg('unit_price')} AS avg_unit_price,
            count(DISTINCT customer_id) AS unique_customers
          FROM order_lines WHERE order_status = 'completed' GROUP BY ALL) d""")

mart("fct_inventory_metrics",
     "long: warehouse_id product_count total_units min_stock max_stock out_of_stock_count low_stock_count, "
     "text: warehouse_name warehouse_location product_category, double: total_inventory_value avg_unit_price avg_stock",
     f"""SELECT warehouse_id, warehouse_name, warehouse_location, category AS product_category,
          count(DISTINCT product_id) AS product_count, sum(stock_quantity) AS total_units,
          sum(inventory_value) AS total_inventory_value, {exact_avg('unit_price')} AS avg_unit_price,
          min(stock_quantity) AS min_stock, max(stock_quantity) AS max_stock,
          {exact_avg('stock_quantity', scale=0)} AS avg_stock,
          count(*) FILTER (stock_quantity = 0) AS out_of_stock_count,
          count(*) FILTER (stock_quantity < 10) AS low_stock_count
        FROM stock_rows GROUP BY ALL""")

mart("fct_customer_returns",
     "text: return_date return_reason return_status, long: return_year return_month return_count affected_orders "
     "affected_customers min_days_to_return max_days_to_return, double: avg_days_to_return",
     f"""SELECT CAST(return_date AS DATE) AS return_date, year(return_date) AS return_year,
          month(return_date) AS return_month, return_reason, return_status, count(DISTINCT return_id) AS return_count,
          count(DISTINCT order_id) AS affected_orders, count(DISTINCT customer_id) AS affected_customers,
          {exact_avg('days', scale=0)} AS avg_days_to_return, min(days) AS min_days_to_return,
          max(days) AS max_days_to_return
        FROM (SELECT *, CAST(trunc(date_diff('microsecond', order_date, return_date) / 86400000000) AS BIGINT) AS days
          FROM return_rows) r GROUP BY ALL""")

mart("fct_marketing_roi",
     "text: activity_date marketing_channel, long: activity_year activity_month campaign_count promo_count "
     "total_promo_uses, double: total_campaign_budget total_discounts_given avg_promo_utilization",
     f"""SELECT coalesce(c.start_date, p.day) AS activity_date, year(coalesce(c.start_date, p.day)) AS activity_year,
          month(coalesce(c.start_date, p.day)) AS activity_month, c.channel AS marketing_channel,
          count(DISTINCT c.id) AS campaign_count, sum(c.budget) AS total_campaign_budget,
          sum(p.n) AS promo_count, sum(p.uses) AS total_promo_uses, sum(p.discounts) AS total_discounts_given,
          round(avg(p.used), 6) AS avg_promo_utilization
        FROM raw_campaigns c FULL JOIN (
          SELECT start_date AS day, type, count(DISTINCT id) AS n, sum(times_used) AS uses,
            sum(discount_value * times_used) AS discounts,
            avg({exact_ratio('times_used', 'usage_limit', 2, 100, num_scale=0)}) AS used
          FROM raw_promotions GROUP BY start_date, type) p ON p.day = c.start_date
        GROUP BY ALL""", events_mart)

mart("fct_shipping_logistics",
     "long: carrier_id warehouse_id ship_year ship_month shipment_count order_count on_time_deliveries "
     "delayed_deliveries, text: carrier_name warehouse_name ship_date, double: avg_delivery_days on_time_percentage",
     f"""SELECT carrier_id, carrier_name, warehouse_id, warehouse_name, CAST(ship_date AS DATE) AS ship_date,
          year(ship_date) AS ship_year, month(ship_date) AS ship_month, count(DISTINCT shipment_id) AS shipment_count,
          count(DISTINCT order_id) AS order_count,
          count(*) FILTER (delivery_performance = 'On Time') AS on_time_deliveries,
          count(*) FILTER (delivery_performance = 'Delayed') AS delayed_deliveries,
          {exact_avg('CAST(actual_delivery_days AS BIGINT)', scale=0)} AS avg_delivery_days,
          {exact_ratio("count(*) FILTER (delivery_performance = 'On Time')", 'count(*)', 2, 100, num_scale=0)}
            AS on_time_percentage
        FROM parcels WHERE shipment_status = 'delivered' GROUP BY ALL""")


# -- example -----------------------------------------------------------------------------

@check("example_asset_usage",
       "long: order_id, text: region_code region_name currency, double: amount tax_rate tax_amount total_with_tax",
       """SELECT o.o_orderkey AS order_id, CAST(n.n_regionkey AS VARCHAR) AS region_code, a.region_name, a.currency,
            CAST(o.o_totalprice AS DECIMAL(12,2)) AS amount, a.tax_rate,
            round(CAST(o.o_totalprice AS DECIMAL(12,2)) * a.tax_rate, 2) AS tax_amount,
            round(CAST(o.o_totalprice AS DECIMAL(12,2)) * (1 + a.tax_rate), 2) AS total_with_tax
          FROM orders o JOIN customer c ON c.c_custkey = o.o_custkey JOIN nation n ON n.n_nationkey = c.c_nationkey
          LEFT JOIN (VALUES (0, 'AFRICA', 'ZAR', 0.1500), (1, 'AMERICA', 'USD', 0.0825), (2, 'ASIA', 'JPY', 0.1000),
            (3, 'EUROPE', 'EUR', 0.1900)) a(region_key, region_name, currency, tax_rate)
            ON a.region_key = n.n_regionkey""")
def example_asset_usage(t: Tables):
    """Order amounts taxed by the customer's region; the last region is left out of the lookup on purpose."""
    # The lookup rows.
    rates = [("0", "AFRICA", "ZAR", "0.1500"), ("1", "AMERICA", "USD", "0.0825"), ("2", "ASIA", "JPY", "0.1000"),
             ("3", "EUROPE", "EUR", "0.1900")]
    table = t.spark.createDataFrame(rates, "region_code string, region_name string, currency string, rate string")
    table = table.select("region_code", "region_name", "currency", F.col("rate").cast("decimal(5,4)").alias("tax_rate"))
    orders = (
        t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
        .join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .select(F.col("o_orderkey").alias("order_id"), F.col("n_regionkey").cast("string").alias("region_code"),
                F.col("o_totalprice").cast("decimal(12,2)").alias("amount"))
    )
    return taxed_orders(orders, table)
