"""Gold: fact tables.

Distinct counts are added up along what determines what (a return its order, an order its
customer), so no fact row is multiplied for them; all measures are combined on the map side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratamart.functions import day_of_week, mean, ratio
from stratamart.operators.aggregates import counted_up
from stratamart.plans.context import MartContext, model
from stratamart.plans.silver import banded


def fact(*layout: str, **config):
    return model("gold", "table", layout=layout, **config)


def calendar(ts: str, prefix: str, *parts: str) -> list[Column]:
    """Calendar columns of a timestamp, e.g. ``order_year`` and ``order_month``."""
    read = {"year": F.year, "month": F.month, "day": F.dayofmonth, "quarter": F.quarter}
    return [read[p](ts).alias(f"{prefix}_{p}") for p in parts]


def count_where(condition: Column) -> Column:
    return F.sum(F.when(condition, 1).otherwise(0))


@fact("order_year")
def fct_orders(ctx: MartContext) -> DataFrame:
    # Order value tier bounds.
    tiers = [(1000, "High Value"), (100, "Medium Value")]
    return ctx.ref("int_customer_orders").select(
        "order_id", "customer_id", "customer_name", "customer_email", "order_date", "total_amount", "status",
        *calendar("order_date", "order", "year", "month", "day"),
        banded(F.col("total_amount"), tiers, "Low Value").alias("order_value_tier"))


@fact("sale_year", priority=1)
def fct_sales_performance(ctx: MartContext) -> DataFrame:
    sold = ctx.ref("int_order_details").where(F.col("order_status") == "completed")
    daily = counted_up(
        sold, [F.to_date("order_date").alias("sale_date"), "product_category"],
        {"order_count": "order_id", "unique_customers": "customer_id"},
        {"revenue": ("sum", "line_total"), "profit": ("sum", "line_profit"), "units_sold": ("sum", "quantity"),
         "prices": ("sum", "unit_price"), "priced": ("count", "unit_price")},
    ).withColumn("avg_unit_price", ratio("prices", "priced", 6))
    # the calendar parts follow from the day, so they need not be grouping keys
    return daily.select(
        "sale_date", *calendar("sale_date", "sale", "year", "month", "quarter"),
        day_of_week("sale_date").alias("day_of_week"), "product_category", "order_count", "revenue", "profit",
        "units_sold", "avg_unit_price", "unique_customers",
        ratio("profit", "revenue", 2, 100).alias("profit_margin_pct"),
        ratio("revenue", "order_count", 2).alias("avg_order_value"),
        ratio("revenue", "unique_customers", 2).alias("revenue_per_customer"))


@fact("warehouse_id")
def fct_inventory_metrics(ctx: MartContext) -> DataFrame:
    units = F.col("stock_quantity")
    return ctx.ref("int_inventory_summary").groupBy(
        "warehouse_id", "warehouse_name", "warehouse_location", F.col("category").alias("product_category")
    ).agg(
        F.count_distinct("product_id").alias("product_count"),
        F.sum(units).alias("total_units"),
        F.sum("inventory_value").alias("total_inventory_value"),
        mean("unit_price").alias("avg_unit_price"),
        F.min(units).alias("min_stock"),
        F.max(units).alias("max_stock"),
        mean(units).alias("avg_stock"),
        count_where(units == 0).alias("out_of_stock_count"),
        count_where(units < 10).alias("low_stock_count"),
    )


@fact("return_year", priority=2)
def fct_customer_returns(ctx: MartContext) -> DataFrame:
    days = "days_to_return"
    grouped = counted_up(
        ctx.ref("int_return_analysis"), [F.to_date("return_date").alias("return_date"), "return_reason", "return_status"],
        {"return_count": "return_id", "affected_orders": "order_id", "affected_customers": "customer_id"},
        {"total_days": ("sum", days), "dated": ("count", days), "min_days_to_return": ("min", days), "max_days_to_return": ("max", days)},
    ).withColumn("avg_days_to_return", ratio("total_days", "dated", 6)).select(
        "return_date", "return_reason", "return_status", "return_count", "affected_orders", "affected_customers",
        "avg_days_to_return", "min_days_to_return", "max_days_to_return")
    return grouped.withColumns({"return_year": F.year("return_date"), "return_month": F.month("return_date")})


@fact("activity_year")
def fct_marketing_roi(ctx: MartContext) -> DataFrame:
    """Campaigns matched with the promotions of their start day, by day and channel.

    By definition every campaign of a day meets every promotion type of that day, and sums
    count each such pair. Both sides are reduced to one row per day (and channel) before
    the join and the pair counts are multiplied back in, so no pair is ever produced.
    """
    campaigns = ctx.ref("int_campaign_performance").groupBy(
        F.to_date("campaign_start").alias("campaign_day"), "marketing_channel"
    ).agg(
        F.count_distinct("campaign_id").alias("campaign_count"),
        F.count("*").alias("campaign_rows"),
        F.sum("campaign_budget").alias("budget"),
    )
    by_type = ctx.ref("int_promo_utilization").groupBy(F.to_date("promo_start").alias("promo_day"), "promo_type").agg(
        F.count_distinct("promotion_id").alias("promo_count"),
        F.sum("times_used").alias("uses"),
        mean("utilization_percentage", 8).alias("utilization"),
        F.sum(F.col("discount_value") * F.col("times_used")).alias("discounts"),
    )
    promos = by_type.groupBy("promo_day").agg(
        F.count("*").alias("promo_rows"),
        F.sum("promo_count").alias("promo_count"),
        F.sum("uses").alias("uses"),
        F.sum("discounts").alias("discounts"),
        mean("utilization").alias("utilization"),
    )
    paired = campaigns.join(promos, F.col("campaign_day") == F.col("promo_day"), "full")
    per_campaign = F.coalesce(F.col("campaign_rows"), F.lit(1))
    day = F.coalesce("campaign_day", "promo_day")
    return paired.select(
        day.alias("activity_date"),
        F.year(day).alias("activity_year"),
        F.month(day).alias("activity_month"),
        "marketing_channel",
        F.coalesce("campaign_count", F.lit(0)).alias("campaign_count"),
        (F.col("budget") * F.coalesce("promo_rows", F.lit(1))).alias("total_campaign_budget"),
        (F.col("promo_count") * per_campaign).alias("promo_count"),
        (F.col("uses") * per_campaign).alias("total_promo_uses"),
        (F.col("discounts") * per_campaign).alias("total_discounts_given"),
        F.col("utilization").alias("avg_promo_utilization"),
    )


@fact("ship_year", priority=2)
def fct_shipping_logistics(ctx: MartContext) -> DataFrame:
    delivered = ctx.ref("int_shipment_tracking").where(F.col("shipment_status") == "delivered")
    took = "actual_delivery_days"
    daily = counted_up(
        delivered, ["carrier_id", "carrier_name", "warehouse_id", "warehouse_name", F.to_date("ship_date").alias("ship_date")],
        {"shipment_count": "shipment_id", "order_count": "order_id"},
        {"on_time_deliveries": ("sum", F.when(F.col("delivery_performance") == "On Time", 1).otherwise(0)),
         "delayed_deliveries": ("sum", F.when(F.col("delivery_performance") == "Delayed", 1).otherwise(0)),
         "total_days": ("sum", took), "dated": ("count", took), "deliveries": ("count", F.lit(1))},
    ).withColumns({"avg_delivery_days": ratio("total_days", "dated", 6),
                   "on_time_percentage": ratio("on_time_deliveries", "deliveries", 2, 100)}).drop("total_days", "dated", "deliveries")
    return daily.withColumns({"ship_year": F.year("ship_date"), "ship_month": F.month("ship_date")})
