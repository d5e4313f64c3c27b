"""End-to-end dataflows: user summaries, event trends and proposals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratamart.functions import bin_right_closed, mean, ratio
from stratamart.operators.windows import RANGE_ROWS, ranked_within


def completed_by_user(orders: DataFrame) -> DataFrame:
    done = orders.where(F.col("status") == "completed")
    return done.groupBy("user_id").agg(F.count("order_id").alias("order_count"), F.sum("amount").alias("total_spent"))


def user_summary(users: DataFrame, orders: DataFrame) -> DataFrame:
    """Every user with completed order totals (0 without any) and the average order value."""
    # The age bins.
    group = bin_right_closed("age", (0, 30, 40, 100), ("Young", "Middle", "Senior"))
    cleaned = users.withColumns({"name": F.upper("name"), "age_group": group})
    joined = cleaned.join(completed_by_user(orders), "user_id", "left").na.fill(0, ["order_count", "total_spent"])
    average = F.coalesce(ratio("total_spent", "order_count", 6), F.lit(0))
    return joined.withColumn("avg_order_value", average)


def _insights(figures: dict[str, tuple[Column, Column]]) -> Column:
    """An array of ``(insight, item, value)`` structs, one per named ``(item, value)`` pair."""
    return F.array(*[
        F.struct(F.lit(name).alias("insight"), item.cast("string").alias("item"), value.cast("double").alias("value"))
        for name, (item, value) in figures.items()
    ])


def user_insights(summary: DataFrame) -> DataFrame:
    """Key figures in long form ``(insight, item, value)``.

    The summary is read once: all figures come from its aggregate by country and age group.
    Equal top spenders are settled by the smaller user id.
    """
    cells = summary.groupBy("country", "age_group").agg(
        F.count("*").alias("users"), F.sum("total_spent").alias("spent"), F.sum("order_count").alias("orders"),
        F.max(F.struct("total_spent", (-F.col("user_id")).alias("tie"), "name")).alias("top"))
    sets = cells.groupingSets([[], ["country"], ["age_group"]], "country", "age_group").agg(
        F.sum("users").alias("users"), F.sum("spent").alias("spent"), F.sum("orders").alias("orders"),
        F.max("top").alias("top"), F.grouping_id().alias("level"))
    none = F.lit(None)
    overall = _insights({
        "total_users": (none, F.col("users")),
        "total_revenue": (none, F.col("spent")),
        "avg_revenue_per_user": (none, ratio("spent", "users", 6)),
        "total_orders": (none, F.col("orders")),
        "top_spender": (F.col("top.name"), F.col("top.total_spent")),
    })
    # grouping_id bits: country, age_group; a set bit means the column is rolled up
    rows = (
        F.when(F.col("level") == 3, overall)
        .when(F.col("level") == 1, _insights({"users_by_country": (F.col("country"), F.col("users"))}))
        .otherwise(_insights({"users_by_age_group": (F.col("age_group"), F.col("users"))}))
    )
    return sets.select(F.inline(rows)).where(~F.col("insight").startswith("users_by") | F.col("item").isNotNull())


def event_summary(events: DataFrame) -> DataFrame:
    return events.groupBy("beacon_type", "severity").agg(
        F.count("*").alias("beacon_count"),
        F.count_distinct("user_id").alias("unique_users"),
        F.count_distinct("organization_id").alias("unique_orgs"),
        F.sum(F.when(F.col("acknowledged"), 1).otherwise(0)).alias("acknowledged_count"),
        F.min("created_at").alias("first_beacon"),
        F.max("created_at").alias("last_beacon"),
    ).orderBy(F.desc("beacon_count"), "beacon_type", "severity")


def event_trends(events: DataFrame) -> DataFrame:
    """Daily counts per type with running total and 7-row rolling average.

    The windows run over the daily aggregate: at most one row per type and day.
    """
    daily = events.groupBy(F.to_date("created_at").alias("date"), "beacon_type").agg(F.count("*").alias("daily_count"))
    by_day = Window.partitionBy("beacon_type").orderBy("date")
    week = by_day.rowsBetween(-6, 0)
    return daily.select(
        "date", "beacon_type", "daily_count",
        F.sum("daily_count").over(by_day).alias("cumulative_count"),
        F.round(F.sum("daily_count").over(week).cast("decimal(20,0)")
                / F.count("daily_count").over(week).cast("decimal(4,0)"), 6).alias("rolling_7day_avg"))


def proposals_priced(proposals: DataFrame, currencies: DataFrame, providers: DataFrame, users: DataFrame) -> DataFrame:
    """Proposals with provider, user and converted prices."""
    rate = currencies.select(F.col("exchangable_id").alias("id"), "conversion_rate")
    provider = providers.select(F.col("id").alias("provider_pg_id"), F.col("name").alias("provider_name"))
    user = users.select(F.col("id").alias("user_id"), F.col("email").alias("user_email"),
                        F.col("full_name").alias("user_full_name"))
    merged = proposals.join(rate, "id", "left").join(provider, "provider_pg_id", "left").join(user, "user_id", "left")
    return merged.withColumns({
        "retail_total_price_usd": ratio("retail_total_price", "conversion_rate", 4),
        "wholesale_total_price_usd": ratio("wholesale_total_price", "conversion_rate", 4),
    })


def proposals_enriched(proposals: DataFrame, currencies: DataFrame, providers: DataFrame, users: DataFrame,
                       range_rows: int = RANGE_ROWS) -> DataFrame:
    """Priced proposals and their order within each ware.

    ``proposals`` needs a unique ``(id, line)`` pair; it breaks ties of the confirmation time.
    """
    priced = proposals_priced(proposals, currencies, providers, users)
    ranked = ranked_within(priced, ["quoted_ware_pg_id"], "confirmed_at", ["id", "line"], "proposal_rank", range_rows,
                           sizes_of=proposals)
    # a missing rank is not the first one
    return ranked.withColumn("is_first_proposal", F.coalesce(F.col("proposal_rank") == 1, F.lit(False)))


def proposal_summary(priced: DataFrame) -> DataFrame:
    """Totals by provider and type; as in a frame group-by, rows with a missing key are left out."""
    measures = [F.count("id").alias("proposal_count")]
    for side in ("retail", "wholesale"):
        price = f"{side}_total_price_usd"
        measures += [F.sum(price).alias(f"{side}_total_usd"), mean(price).alias(f"{side}_avg_usd"),
                     F.max(price).alias(f"{side}_max_usd")]
    return (
        priced.where(F.col("provider_name").isNotNull() & F.col("proposal_type").isNotNull())
        .groupBy("provider_name", "proposal_type").agg(*measures)
        .orderBy(F.desc("retail_total_usd"), "provider_name", "proposal_type")
    )


def proposal_insights(priced: DataFrame) -> DataFrame:
    """Key figures in long form ``(insight, item, value)``; the top provider is the first summary row.

    One aggregate by provider and type feeds every figure but the number of users.
    """
    price = "retail_total_price_usd"
    cells = priced.groupBy("provider_name", "proposal_type").agg(
        F.count("*").alias("proposals"), F.count(price).alias("priced"), F.sum(price).alias("total"))
    grouped = F.col("provider_name").isNotNull() & F.col("proposal_type").isNotNull()
    first = F.when(grouped, F.struct((-F.col("total")).alias("minus"), "provider_name", "proposal_type"))
    sets = cells.withColumn("first", first).groupingSets([[], ["proposal_type"]], "proposal_type").agg(
        F.sum("proposals").alias("proposals"), F.sum("priced").alias("priced"), F.sum("total").alias("total"),
        F.count_distinct("provider_name").alias("providers"), F.min("first").alias("first"),
        F.grouping_id().alias("level"))
    none = F.lit(None)
    overall = _insights({
        "total_proposals": (none, F.col("proposals")),
        "total_providers": (none, F.col("providers")),
        "total_value_usd": (none, F.col("total")),
        "avg_proposal_value_usd": (none, ratio("total", "priced", 6)),
        "top_provider": (F.col("first.provider_name"), -F.col("first.minus")),
    })
    kind = _insights({"proposal_types": (F.col("proposal_type"), F.col("proposals"))})
    figures = sets.select(F.inline(F.when(F.col("level") == 1, overall).otherwise(kind)))
    people = priced.agg(F.count_distinct("user_email").alias("n")).select(
        F.inline(_insights({"total_users": (none, F.col("n"))})))
    shown = figures.where((F.col("insight") != "proposal_types") | F.col("item").isNotNull())
    return shown.unionByName(people)
