"""Customer features from orders."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratamart.functions import mean
from stratamart.operators.quantiles import exact_quantiles

# Days without an order that make a churned customer; the score limit of the label rule.
CHURN_DAYS, CHURN_SCORE = 90, 0.2


def rfm_features(orders: DataFrame, as_of: date) -> DataFrame:
    """Recency, frequency and money per customer of ``(customer_id, order_id, total_amount, order_date)``."""
    return orders.groupBy("customer_id").agg(
        F.count("order_id").alias("order_count"),
        F.sum("total_amount").alias("total_spent"),
        mean("total_amount").alias("avg_order_value"),
        F.max("order_date").alias("last_order_date"),
    ).withColumn("recency_days", F.datediff(F.lit(as_of), "last_order_date"))


def churn_base_table(orders: DataFrame, customers: DataFrame, as_of: date) -> DataFrame:
    """One row per customer with orders; ``customers`` gives ``(customer_id, created_at)``."""
    today = F.lit(as_of)
    rfm = rfm_features(orders, as_of).join(customers.select("customer_id", "created_at"), "customer_id")
    lapsed = F.to_date("last_order_date") < F.date_sub(today, CHURN_DAYS)
    return rfm.select(
        "customer_id",
        F.col("recency_days").alias("recency"),
        F.col("order_count").alias("frequency"),
        F.col("total_spent").alias("monetary"),
        "avg_order_value",
        F.datediff(today, "created_at").alias("days_since_signup"),
        F.when(lapsed, 1).otherwise(0).alias("churned"),
    )


def churn_features(base: DataFrame, quantile: float = 0.99) -> DataFrame:
    """Add spend per order and engagement, then cap the three base features at their quantile."""
    capped = ["monetary", "frequency", "recency"]
    filled = base.na.fill(0)
    value = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value"))
                                for c in capped])).alias("_f")
    caps = exact_quantiles(filled.select(value).select("_f.*"), ["feature"], "value", [quantile])
    limit = {r["feature"]: r["quantile"] for r in caps.collect()}  # three numbers
    ratios = filled.withColumns({
        "avg_spend_per_order": F.col("monetary").cast("double") / (F.col("frequency") + 1),
        "engagement_score": F.col("frequency").cast("double") / (F.col("recency") + 1),
    })
    return ratios.withColumns({c: F.least(F.col(c).cast("double"), F.lit(limit.get(c))) for c in capped})


def churn_labels(base: DataFrame) -> DataFrame:
    """Label by rule: recency and frequency relative to their greatest values."""
    most = base.agg(F.struct(F.max("recency").alias("r"), F.max("frequency").alias("f"))).scalar()
    score = (F.col("recency").cast("double") / most.getField("r")
             - F.col("frequency").cast("double") / most.getField("f"))
    return base.withColumns({"churn_score": score, "churned": F.when(score > CHURN_SCORE, 1).otherwise(0)})
