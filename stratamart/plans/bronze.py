"""Bronze: one staging view per raw table, mostly renames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratamart.functions import age_years, ratio
from stratamart.plans.context import MartContext, model

bronze = model("bronze")


def renamed(df: DataFrame, **columns: str) -> DataFrame:
    """Select ``new=old`` pairs in the given order."""
    return df.select(*[F.col(old).alias(new) for new, old in columns.items()])


@bronze
def stg_campaigns(ctx: MartContext) -> DataFrame:
    staged = renamed(ctx.source("campaigns"), campaign_id="id", campaign_name="name", marketing_channel="channel",
                     campaign_start="start_date", campaign_end="end_date", campaign_budget="budget",
                     campaign_status="status")
    return staged.withColumn("campaign_duration_days", F.datediff("campaign_end", "campaign_start"))


@bronze
def stg_carriers(ctx: MartContext) -> DataFrame:
    return renamed(ctx.source("carriers"), carrier_id="id", carrier_name="name", carrier_phone="contact_phone",
                   carrier_rating="rating")


@bronze
def stg_commissions(ctx: MartContext) -> DataFrame:
    return renamed(ctx.source("commissions"), commission_id="id", order_id="order_id", sales_rep_id="sales_rep_id",
                   commission_rate="commission_rate", commission_amount="commission_amount", paid_date="paid_date",
                   commission_status="status")


@bronze
def stg_customers(ctx: MartContext) -> DataFrame:
    return renamed(ctx.source("customers"), customer_id="id", email="email", customer_name="name",
                   created_at="created_at")


@bronze
def stg_employees(ctx: MartContext) -> DataFrame:
    staged = renamed(ctx.source("employees"), employee_id="id", employee_name="name", employee_email="email",
                     department="department", position="position", hire_date="hire_date", salary="salary")
    return staged.withColumn("years_of_service", age_years("hire_date", ctx.as_of))


@bronze
def stg_order_items(ctx: MartContext) -> DataFrame:
    kept = ctx.source("order_items").where(F.col("quantity") > 0)
    staged = renamed(kept, order_item_id="id", order_id="order_id", product_id="product_id", quantity="quantity",
                     unit_price="price", line_total="total")
    return staged.withColumn("loaded_at", F.lit(ctx.as_of).cast("timestamp_ntz"))


@bronze
def stg_orders(ctx: MartContext) -> DataFrame:
    return renamed(ctx.source("orders"), order_id="id", customer_id="customer_id", order_date="order_date",
                   total_amount="total_amount", status="status")


@bronze
def stg_payment_transactions(ctx: MartContext) -> DataFrame:
    return renamed(ctx.source("payment_transactions").where(F.col("status") == "success"), transaction_id="id",
                   order_id="order_id", payment_method_id="payment_method_id", transaction_date="transaction_date",
                   transaction_amount="amount", payment_status="status", external_transaction_id="transaction_id")


@bronze
def stg_products(ctx: MartContext) -> DataFrame:
    staged = renamed(ctx.source("products").where(F.col("price") > 0), product_id="id", product_name="name",
                     category="category", price="price", cost="cost", sku="sku", weight_kg="weight_kg")
    profit = F.col("price") - F.col("cost")
    return staged.withColumns({"profit_margin": profit, "margin_percentage": ratio(profit, "price", 2, 100)})


@bronze
def stg_promotions(ctx: MartContext) -> DataFrame:
    staged = renamed(ctx.source("promotions"), promotion_id="id", promo_code="code", promo_type="type",
                     discount_value="discount_value", promo_start="start_date", promo_end="end_date",
                     usage_limit="usage_limit", times_used="times_used")
    return staged.withColumn("utilization_percentage", ratio("times_used", "usage_limit", 2, 100))


@bronze
def stg_purchase_orders(ctx: MartContext) -> DataFrame:
    return renamed(ctx.source("purchase_orders"), purchase_order_id="id", supplier_id="supplier_id",
                   po_date="order_date", expected_delivery="expected_delivery", po_status="status",
                   po_total="total_amount")


@bronze
def stg_returns(ctx: MartContext) -> DataFrame:
    return renamed(ctx.source("returns"), return_id="id", order_id="order_id", return_date="return_date",
                   return_reason="reason", return_status="status", return_notes="notes")


@bronze
def stg_shipments(ctx: MartContext) -> DataFrame:
    staged = renamed(ctx.source("shipments"), shipment_id="id", order_id="order_id", carrier_id="carrier_id",
                     warehouse_id="warehouse_id", tracking_number="tracking_number", ship_date="ship_date",
                     estimated_delivery="estimated_delivery", actual_delivery="actual_delivery",
                     shipment_status="status")
    late = F.col("actual_delivery") > F.col("estimated_delivery")
    # late is NULL while either time is missing, which leaves the parcel in transit
    return staged.withColumn("delivery_performance", F.when(late, "Delayed").when(~late, "On Time")
                             .otherwise("In Transit"))


@bronze
def stg_stock_levels(ctx: MartContext) -> DataFrame:
    return renamed(ctx.source("stock_levels"), stock_id="id", product_id="product_id", warehouse_id="warehouse_id",
                   stock_quantity="quantity", last_updated="last_updated")


@bronze
def stg_suppliers(ctx: MartContext) -> DataFrame:
    return renamed(ctx.source("suppliers"), supplier_id="id", supplier_name="name", contact_name="contact_name",
                   supplier_email="email", supplier_phone="phone", supplier_country="country",
                   supplier_rating="rating")


@bronze
def stg_warehouses(ctx: MartContext) -> DataFrame:
    return renamed(ctx.source("warehouses"), warehouse_id="id", warehouse_name="name", location="location",
                   capacity="capacity", warehouse_manager="manager")
