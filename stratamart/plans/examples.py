"""A model that joins an uploaded lookup file to order amounts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def taxed_orders(orders: DataFrame, rates: DataFrame) -> DataFrame:
    """Orders ``(order_id, region_code, amount)`` with their region's rate; unknown regions keep NULLs."""
    rate = F.col("tax_rate")
    return orders.join(rates, "region_code", "left").select(
        "order_id", "region_code", "region_name", "currency", "amount", "tax_rate",
        F.round(F.col("amount") * rate, 2).alias("tax_amount"),
        F.round(F.col("amount") * (1 + rate), 2).alias("total_with_tax"))
