"""Raw business tables (orders, products, shipments, ...) derived from the star schema.

Every adapter is a narrow projection, at most joined to the parent order or a dimension.
Keys are arithmetic on the source keys and money is decimal, so results do not depend on
row order or on the number of partitions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratamart.sources.tables import Tables

MONEY = "decimal(10,2)"
# Fixed value: the star schema always has the region keys 0 to 4.
REGION_KEYS = (0, 4)


def _dec(value: str, of: str = MONEY) -> Column:
    return F.lit(value).cast(of)


def _text(c: str) -> Column:
    return F.col(c).cast("string")


def _days(n: Column) -> Column:
    return F.make_dt_interval(days=n.cast("int"))


def _nth(key: Column, *names: str) -> Column:
    """``names[key % len(names)]``"""
    return F.element_at(F.array(*[F.lit(n) for n in names]), (key % len(names)).cast("int") + 1)


def _line_id() -> Column:
    return F.col("l_orderkey") * 10 + F.col("l_linenumber")


def _order_amount() -> Column:
    return (F.col("o_totalprice").cast("decimal(12,2)") * _dec("0.004", "decimal(4,3)")).cast(MONEY)


def customers(t: Tables) -> DataFrame:
    return t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.col("c_custkey").alias("id"),
        F.concat(F.lit("user"), _text("c_custkey"), F.lit("@example.com")).alias("email"),
        F.col("c_name").alias("name"),
        (F.lit("1994-01-01 00:00:00").cast("timestamp_ntz") + _days(F.col("c_custkey") % 365)).alias("created_at"),
        F.col("n_name").alias("country"),
        F.col("c_mktsegment").alias("segment"),
    )


def products(t: Tables) -> DataFrame:
    markup = F.col("p_retailprice").cast(MONEY) - _dec("900", "decimal(3,0)")
    size = F.col("p_size").cast("decimal(10,0)")
    return t.part.select(
        F.col("p_partkey").alias("id"),
        F.col("p_name").alias("name"),
        F.col("p_type").alias("category"),
        (markup * _dec("3", "decimal(1,0)")).cast(MONEY).alias("price"),
        (markup * (_dec("40", "decimal(2,0)") + size) * _dec("0.03", "decimal(3,2)")).cast(MONEY).alias("cost"),
        F.concat(F.col("p_brand"), F.lit("-"), _text("p_partkey")).alias("sku"),
        (size * _dec("0.20", "decimal(3,2)")).cast(MONEY).alias("weight_kg"),
    )


def orders(t: Tables) -> DataFrame:
    return t.orders.select(
        F.col("o_orderkey").alias("id"),
        F.col("o_custkey").alias("customer_id"),
        F.col("o_orderdate").alias("order_date"),
        _order_amount().alias("total_amount"),
        F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "O", "pending")
         .otherwise("processing").alias("status"),
    )


def order_items(t: Tables) -> DataFrame:
    quantity = F.col("l_quantity").cast("int") - 1
    price = ((F.col("l_partkey") % 300).cast("decimal(5,0)") + _dec("1.50", "decimal(3,2)")).cast(MONEY)
    return t.lineitem.select(
        _line_id().alias("id"),
        F.col("l_orderkey").alias("order_id"),
        F.col("l_partkey").alias("product_id"),
        quantity.alias("quantity"),
        price.alias("price"),
        (price * quantity.cast("decimal(10,0)")).cast("decimal(12,2)").alias("total"),
    )


def warehouses(t: Tables) -> DataFrame:
    return t.region.select(
        F.col("r_regionkey").alias("id"),
        F.concat(F.col("r_name"), F.lit(" Warehouse")).alias("name"),
        F.col("r_name").alias("location"),
        (F.lit(5000) + F.col("r_regionkey") * 1000).alias("capacity"),
        F.concat(F.lit("mgr"), _text("r_regionkey")).alias("manager"),
    )


def stock_levels(t: Tables) -> DataFrame:
    """One row per part and region: each part row is expanded in place, without a join."""
    region = F.explode(F.sequence(F.lit(REGION_KEYS[0]), F.lit(REGION_KEYS[1])))
    part, r = F.col("p_partkey"), F.col("warehouse_id")
    return t.part.select(part, region.alias("warehouse_id")).select(
        (part * 10 + r).alias("id"),
        part.alias("product_id"),
        r,
        ((part * 7 + r * 13) % 60).cast("int").alias("quantity"),
        (F.lit("2001-07-01 00:00:00").cast("timestamp_ntz") + _days(part % 30)).alias("last_updated"),
    )


def suppliers(t: Tables) -> DataFrame:
    return t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey")).select(
        F.col("s_suppkey").alias("id"),
        F.col("s_name").alias("name"),
        F.concat(F.col("s_name"), F.lit(" contact")).alias("contact_name"),
        F.concat(F.lit("sup"), _text("s_suppkey"), F.lit("@example.com")).alias("email"),
        _text("s_suppkey").alias("phone"),
        F.col("n_name").alias("country"),
        (_dec("3", "decimal(1,0)") + (F.col("s_suppkey") % 21).cast("decimal(3,0)") * _dec("0.1", "decimal(2,1)"))
        .cast("decimal(2,1)").alias("rating"),
    )


def purchase_orders(t: Tables) -> DataFrame:
    return t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        _line_id().alias("id"),
        F.col("l_suppkey").alias("supplier_id"),
        F.col("o_orderdate").alias("order_date"),
        F.col("l_shipdate").alias("expected_delivery"),
        F.when(F.col("l_linestatus") == "F", "received").otherwise("pending").alias("status"),
        F.col("l_extendedprice").cast("decimal(12,2)").alias("total_amount"),
    )


def carriers(t: Tables) -> DataFrame:
    return t.nation.select(
        F.col("n_nationkey").alias("id"),
        F.concat(F.col("n_name"), F.lit(" Freight")).alias("name"),
        _text("n_nationkey").alias("contact_phone"),
        (_dec("3.5", "decimal(2,1)") + (F.col("n_nationkey") % 16).cast("decimal(3,0)") * _dec("0.1", "decimal(2,1)"))
        .cast("decimal(2,1)").alias("rating"),
    )


def shipments(t: Tables) -> DataFrame:
    arrived = F.col("l_linestatus") == "F"
    origin = t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey")).select(
        "s_suppkey", "s_nationkey", "n_regionkey")
    return (
        t.lineitem.join(origin, F.col("l_suppkey") == F.col("s_suppkey"))
        .join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .select(
            _line_id().alias("id"),
            F.col("l_orderkey").alias("order_id"),
            F.col("s_nationkey").alias("carrier_id"),
            F.col("n_regionkey").alias("warehouse_id"),
            F.concat(F.lit("TRK"), _line_id().cast("string")).alias("tracking_number"),
            (F.col("o_orderdate") + _days(F.lit(1))).alias("ship_date"),
            (F.col("o_orderdate") + _days(F.lit(45))).alias("estimated_delivery"),
            F.when(arrived, F.col("l_shipdate")).alias("actual_delivery"),
            F.when(arrived, "delivered").when(F.col("l_linenumber") == 1, "delayed")
             .otherwise("in_transit").alias("status"),
        )
    )


def returns(t: Tables) -> DataFrame:
    return t.lineitem.where(F.col("l_returnflag") == "R").select(
        _line_id().alias("id"),
        F.col("l_orderkey").alias("order_id"),
        (F.col("l_shipdate") + _days(F.col("l_linenumber"))).alias("return_date"),
        _nth(F.col("l_partkey"), "Defective", "Wrong Item", "Not as Described", "Changed Mind", "Size Issue")
        .alias("reason"),
        _nth(F.col("l_suppkey"), "pending", "approved", "rejected", "completed").alias("status"),
        F.lit("note").alias("notes"),
    )


def payment_transactions(t: Tables) -> DataFrame:
    third, tenth = F.col("o_orderkey") % 3, F.col("o_orderkey") % 10
    drift = F.when(third == 0, 0).when(third == 1, -5).otherwise(5).cast("decimal(10,0)")
    return t.orders.select(
        F.col("o_orderkey").alias("id"),
        F.col("o_orderkey").alias("order_id"),
        (F.col("o_custkey") * 10).alias("payment_method_id"),
        F.col("o_orderdate").alias("transaction_date"),
        (_order_amount() + drift).cast(MONEY).alias("amount"),
        F.when(tenth == 0, "failed").when(tenth == 1, "pending").otherwise("success").alias("status"),
        F.concat(F.lit("TXN-"), _text("o_orderkey")).alias("transaction_id"),
    )


def _hashed_id(day) -> Column:
    """48 bits of a hash of event type and day: an id that needs no numbering."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", "event_type", day)), 1, 12), 16, 10).cast("bigint")


def campaigns(t: Tables) -> DataFrame:
    """Weekly spend per event type; the id is a hash of type and week."""
    weekly = t.events.groupBy("event_type", F.date_trunc("week", "ts").alias("week")).agg(
        F.min("ts").cast("date").alias("start_date"),
        F.max("ts").cast("date").alias("end_date"),
        F.sum(F.col("value").cast("decimal(12,2)")).cast("decimal(14,2)").alias("budget"),
    )
    numbered = weekly.withColumn("id", _hashed_id(F.date_format("week", "yyyy-MM-dd")))
    return numbered.select(
        "id",
        F.concat(F.col("event_type"), F.lit(" wave "), _text("id")).alias("name"),
        F.col("event_type").alias("channel"),
        "start_date",
        "end_date",
        "budget",
        _nth(F.col("id"), "active", "completed", "paused").alias("status"),
    )


def promotions(t: Tables) -> DataFrame:
    """Daily uses per event type; the id is a hash of type and day."""
    daily = (
        t.events.groupBy("event_type", F.to_date("ts").alias("day"))
        .agg(F.count("*").alias("n"))
        .withColumn("id", _hashed_id(F.date_format("day", "yyyy-MM-dd")))
    )
    return daily.select(
        "id",
        F.concat(F.lit("P"), _text("id")).alias("code"),
        F.col("event_type").alias("type"),
        (F.lit(5) + F.col("id") % 46).cast(MONEY).alias("discount_value"),
        F.col("day").alias("start_date"),
        F.date_add("day", (F.lit(7) + F.col("id") % 84).cast("int")).alias("end_date"),
        (F.lit(40) + F.dayofmonth("day") * 4).alias("usage_limit"),
        F.col("n").cast("int").alias("times_used"),
    )


def employees(t: Tables) -> DataFrame:
    return t.supplier.select(
        F.col("s_suppkey").alias("id"),
        F.col("s_name").alias("name"),
        F.concat(F.lit("emp"), _text("s_suppkey"), F.lit("@example.com")).alias("email"),
        _nth(F.col("s_nationkey"), "Sales", "Marketing", "Operations", "Customer Service", "IT").alias("department"),
        F.concat(F.lit("Role "), _text("s_nationkey")).alias("position"),
        F.date_add(F.lit("1995-01-01").cast("date"), ((F.col("s_suppkey") * 37) % 2400).cast("int")).alias("hire_date"),
        (_dec("40000", "decimal(5,0)") + (F.col("s_acctbal").cast("decimal(12,2)") + _dec("1000", "decimal(4,0)"))
         * _dec("8", "decimal(1,0)")).cast(MONEY).alias("salary"),
    )


def commissions(t: Tables) -> DataFrame:
    rate = F.col("l_discount").cast("decimal(6,4)")
    return t.lineitem.where(F.col("l_linenumber") == 1).select(
        F.col("l_orderkey").alias("id"),
        F.col("l_orderkey").alias("order_id"),
        F.col("l_suppkey").alias("sales_rep_id"),
        rate.alias("commission_rate"),
        (F.col("l_extendedprice").cast("decimal(12,2)") * rate).cast(MONEY).alias("commission_amount"),
        F.col("l_shipdate").alias("paid_date"),
        F.when(F.col("l_linestatus") == "F", "paid").otherwise("pending").alias("status"),
    )


def users(t: Tables) -> DataFrame:
    return t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.col("c_custkey").alias("user_id"),
        F.col("c_name").alias("name"),
        (F.lit(18) + F.col("c_custkey") % 60).cast("int").alias("age"),
        F.col("n_name").alias("country"),
    )


def beacons(t: Tables) -> DataFrame:
    return t.events.select(
        F.col("event_id").alias("id"),
        F.col("ts").alias("created_at"),
        "user_id",
        (F.col("user_id") % 20).alias("organization_id"),
        F.col("event_type").alias("beacon_type"),
        F.when(F.col("value") >= 100, "high").when(F.col("value") >= 20, "medium").otherwise("low").alias("severity"),
        (F.col("event_id") % 3 == 0).alias("acknowledged"),
    )


RAW_TABLES: dict[str, Callable[[Tables], DataFrame]] = {
    f.__name__: f
    for f in (customers, products, orders, order_items, warehouses, stock_levels, suppliers, purchase_orders,
              carriers, shipments, returns, payment_transactions, campaigns, promotions, employees, commissions,
              users, beacons)
}


def raw_source(t: Tables) -> Callable[[str], DataFrame]:
    """A ``source(name)`` function over the star schema, for ``MartContext``."""
    return lambda name: RAW_TABLES[name](t)


def catalog_source(spark, schema: str = "raw") -> Callable[[str], DataFrame]:
    """A ``source(name)`` function over catalog tables ``schema.name``."""
    return lambda name: spark.table(f"{schema}.{name}")
