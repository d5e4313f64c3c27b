"""Silver: staged tables joined and enriched, loaded by watermark.

Joins carry no hints. Dimensions below the broadcast threshold are broadcast by Catalyst
or AQE from their measured size; larger ones take a shuffle join that AQE splits on skew.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratamart.functions import ratio, title_case, trim_space, whole_days
from stratamart.plans.context import MartContext, model


def incremental(watermark: str, **config):
    return model("silver", "incremental", watermark=watermark, **config)


def banded(value: Column, bands: list[tuple[float, str]], below: str) -> Column:
    """Label of the first band whose lower bound the value reaches; ``below`` otherwise."""
    out = F.when(value >= bands[0][0], bands[0][1])
    for bound, label in bands[1:]:
        out = out.when(value >= bound, label)
    return out.otherwise(below)


@incremental("campaign_start")
def int_campaign_performance(ctx: MartContext) -> DataFrame:
    days = F.col("campaign_duration_days")
    per_day = F.when(days > 0, ratio("campaign_budget", days, 2)).otherwise(F.lit(0))
    state = (
        F.when(F.col("campaign_status") == "completed", "Yes")
        .when(F.col("campaign_end") < F.lit(ctx.as_of), "Overdue")
        .otherwise("Active")
    )
    return ctx.ref("stg_campaigns").withColumns({"daily_budget": per_day, "completion_status": state})


@incremental("order_date", unique_key="order_id")
def int_customer_orders(ctx: MartContext) -> DataFrame:
    return ctx.ref("stg_orders").join(ctx.ref("stg_customers"), "customer_id").select(
        "order_id", "customer_id", "customer_name", F.col("email").alias("customer_email"), "order_date",
        "total_amount", "status")


@incremental("hire_date")
def int_employee_performance(ctx: MartContext) -> DataFrame:
    # Seniority in years, salary band bounds.
    seniority = [(5, "Senior"), (2, "Mid-Level")]
    salary = [(100000, "High"), (60000, "Medium")]
    return ctx.ref("stg_employees").withColumns({
        "seniority_level": banded(F.col("years_of_service"), seniority, "Junior"),
        "salary_band": banded(F.col("salary"), salary, "Entry"),
    })


@incremental("last_updated")
def int_inventory_summary(ctx: MartContext) -> DataFrame:
    product = ctx.ref("stg_products").select("product_id", "product_name", "category",
                                             F.col("price").alias("unit_price"))
    warehouse = ctx.ref("stg_warehouses").select("warehouse_id", "warehouse_name",
                                                 F.col("location").alias("warehouse_location"))
    stock = ctx.ref("stg_stock_levels").join(warehouse, "warehouse_id").join(product, "product_id")
    return stock.select(
        "stock_id", "product_id", "product_name", "category", "warehouse_id", "warehouse_name",
        "warehouse_location", "stock_quantity", "unit_price",
        (F.col("stock_quantity") * F.col("unit_price")).alias("inventory_value"), "last_updated")


@incremental("order_date", priority=5)
def int_order_details(ctx: MartContext) -> DataFrame:
    product = ctx.ref("stg_products").select("product_id", "product_name",
                                             F.col("category").alias("product_category"),
                                             F.col("cost").alias("unit_cost"))
    order = ctx.ref("stg_orders").select("order_id", "customer_id", "order_date",
                                         F.col("status").alias("order_status"))
    # what products add is wide: they are joined last, so that no shuffle carries it
    lines = ctx.ref("stg_order_items").join(order, "order_id").join(product, "product_id")
    return lines.select(
        "order_item_id", "order_id", "customer_id", "order_date", "order_status", "product_id", "product_name",
        "product_category", "quantity", "unit_price", "line_total", "unit_cost",
        ((F.col("unit_price") - F.col("unit_cost")) * F.col("quantity")).alias("line_profit"))


@incremental("transaction_date")
def int_payment_reconciliation(ctx: MartContext) -> DataFrame:
    order = ctx.ref("stg_orders").select("order_id", "customer_id", F.col("total_amount").alias("order_amount"))
    customer = ctx.ref("stg_customers").select("customer_id", "customer_name")
    gap = F.col("transaction_amount") - F.col("order_amount")
    cent = F.lit("0.01").cast("decimal(3,2)")
    return (
        ctx.ref("stg_payment_transactions").join(order, "order_id").join(customer, "customer_id")
        .select("transaction_id", "order_id", "customer_id", "customer_name", "transaction_date",
                "transaction_amount", "order_amount", gap.alias("amount_difference"),
                F.when(F.abs(gap) < cent, "Matched").when(gap < 0, "Underpaid").otherwise("Overpaid")
                .alias("reconciliation_status"))
    )


@incremental("promo_start")
def int_promo_utilization(ctx: MartContext) -> DataFrame:
    left = F.col("usage_limit") - F.col("times_used")
    # Utilization band bounds in percent.
    bands = [(80, "High"), (50, "Medium")]
    status = F.when(left <= 0, "Exhausted").otherwise(banded(F.col("utilization_percentage"), bands, "Low"))
    return ctx.ref("stg_promotions").withColumns({
        "remaining_uses": left,
        "utilization_status": status,
        "promo_duration_days": F.datediff("promo_end", "promo_start"),
    })


@incremental("return_date", priority=2)
def int_return_analysis(ctx: MartContext) -> DataFrame:
    order = ctx.ref("stg_orders").select("order_id", "customer_id", "order_date")
    customer = ctx.ref("stg_customers").select("customer_id", "customer_name")
    return ctx.ref("stg_returns").join(order, "order_id").join(customer, "customer_id").select(
        "return_id", "order_id", "customer_id", "customer_name", "return_date", "return_reason", "return_status",
        "order_date", whole_days("return_date", "order_date").alias("days_to_return"))


@incremental("paid_date")
def int_sales_commissions(ctx: MartContext) -> DataFrame:
    order = ctx.ref("stg_orders").select("order_id", "customer_id", "order_date",
                                         F.col("total_amount").alias("order_amount"))
    rep = ctx.ref("stg_employees").select(F.col("employee_id").alias("sales_rep_id"),
                                          F.col("employee_name").alias("sales_rep_name"), "department")
    return ctx.ref("stg_commissions").join(rep, "sales_rep_id").join(order, "order_id").select(
        "commission_id", "order_id", "customer_id", "order_date", "order_amount", "sales_rep_id", "sales_rep_name",
        "department", "commission_rate", "commission_amount", "paid_date", "commission_status",
        whole_days("paid_date", "order_date").alias("days_to_pay_commission"))


@incremental("ship_date", priority=3)
def int_shipment_tracking(ctx: MartContext) -> DataFrame:
    order = ctx.ref("stg_orders").select("order_id", "customer_id")
    carrier = ctx.ref("stg_carriers").select("carrier_id", "carrier_name", "carrier_rating")
    warehouse = ctx.ref("stg_warehouses").select("warehouse_id", "warehouse_name")
    # parcels made from order lines come dealt by order, so the join with the orders goes first
    parcels = ctx.ref("stg_shipments").join(order, "order_id")
    return parcels.join(carrier, "carrier_id").join(warehouse, "warehouse_id").select(
        "shipment_id", "order_id", "customer_id", "carrier_id", "carrier_name", "carrier_rating", "warehouse_id",
        "warehouse_name", "tracking_number", "ship_date", "estimated_delivery", "actual_delivery",
        "shipment_status", "delivery_performance",
        whole_days("actual_delivery", "ship_date").alias("actual_delivery_days"))


@incremental("po_date", priority=4)
def int_supplier_orders(ctx: MartContext) -> DataFrame:
    supplier = ctx.ref("stg_suppliers").select("supplier_id", "supplier_name", "supplier_country",
                                               "supplier_rating")
    return ctx.ref("stg_purchase_orders").join(supplier, "supplier_id").select(
        "purchase_order_id", "supplier_id", "supplier_name", "supplier_country", "supplier_rating", "po_date",
        "expected_delivery", "po_status", "po_total",
        whole_days("expected_delivery", "po_date").alias("lead_time_days"))


def enrich_products(products: DataFrame) -> DataFrame:
    """``profit_margin`` becomes a percentage here; steps whose input column is absent are skipped."""
    price = F.col("price")
    # Price category bounds.
    categories = [(200, "Luxury"), (50, "Premium"), (10, "Mid-Range")]
    category = F.when(price.isNull() | (price == 0), "Unknown").otherwise(banded(price, categories, "Budget"))
    added = {"price_category": category}
    if "cost" in products.columns:
        added["profit_margin"] = ratio(price - F.col("cost"), price, 2, 100)
    if "product_name" in products.columns:
        added["product_name_clean"] = title_case(trim_space("product_name"))
    if "discontinued" in products.columns:
        added["is_active"] = ~F.coalesce(F.col("discontinued"), F.lit(False))
    return products.withColumns(added)


@model("silver", "table")
def int_products_enriched(ctx: MartContext) -> DataFrame:
    return enrich_products(ctx.ref("stg_products"))
