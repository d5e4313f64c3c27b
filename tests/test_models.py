"""Model rules on hand-made raw rows, and the stored pipeline."""

from datetime import date, datetime
from decimal import Decimal
from glob import glob

import pytest
from table_rows import rows

from stratamart.operators.history import read_runs
from stratamart.operators.materialize import Warehouse
from stratamart.plans import MODELS, MartContext, build
from stratamart.plans.build import build_models
from stratamart.plans.examples import taxed_orders
from stratamart.session import FREE_SHUFFLES
from stratamart.sources import RAW_TABLES, Tables, raw_source

D = Decimal


def context(spark, day=date(2024, 1, 20), **tables):
    made = {name: spark.createDataFrame(data, kind) for name, (data, kind) in tables.items()}
    return MartContext(made.__getitem__, day)


def test_layers_and_kinds():
    count = lambda **want: sum(all(getattr(m, k) == v for k, v in want.items()) for m in MODELS.values())
    assert count(layer="bronze", materialized="view") == 16
    assert count(layer="silver", materialized="incremental") == 11
    assert count(layer="silver", materialized="table") == 1
    assert count(layer="gold", materialized="table") == 6


def test_price_boundaries(spark):
    kind = "id int, name string, category string, price decimal(10,2), cost decimal(10,2), sku string, weight_kg decimal(10,2)"
    prices = ["0.01", "9.99", "10.00", "49.99", "50.00", "199.99", "200.00", "0.00", "-1.00"]
    data = [(i, " it's a  TEST ", "c", D(p), D("0.00"), "s", D(1)) for i, p in enumerate(prices)]
    got = context(spark, products=(data, kind)).ref("int_products_enriched").orderBy("product_id").collect()
    assert [r.price_category for r in got] == [
        "Budget", "Budget", "Mid-Range", "Mid-Range", "Premium", "Premium", "Luxury"]
    assert {r.product_name_clean for r in got} == {"It'S A  Test"}
    assert {r.profit_margin for r in got} == {D("100.00")}


def test_optional_columns(spark):
    ctx = MartContext(lambda name: None, date(2024, 1, 1))
    ctx.bind("stg_products", spark.createDataFrame([(1, 5.0, True), (2, 5.0, None)], "product_id int, price double, discontinued boolean"))
    got = ctx.ref("int_products_enriched").orderBy("product_id")
    assert "profit_margin" not in got.columns and [r.is_active for r in got.collect()] == [False, True]


def test_campaign_and_promotion_rules(spark):
    c_kind = "id int, name string, channel string, start_date date, end_date date, budget decimal(10,2), status string"
    campaigns = [(1, "a", "tv", date(2024, 1, 1), date(2024, 1, 1), D("70.00"), "active"),
                 (2, "b", "tv", date(2024, 1, 1), date(2024, 1, 4), D("100.00"), "completed"),
                 (3, "c", "web", date(2024, 1, 10), date(2024, 1, 20), D("10.00"), "paused")]
    p_kind = ("id int, code string, type string, discount_value decimal(10,2), start_date date, end_date date, "
              "usage_limit int, times_used int")
    promos = [(1, "A", "x", D(2), date(2024, 1, 1), date(2024, 1, 8), 10, 10), (2, "B", "y", D(3), date(2024, 1, 1), date(2024, 1, 9), 100, 80),
              (3, "C", "y", D(1), date(2024, 1, 1), date(2024, 1, 9), 3, 1), (4, "D", "x", D(5), date(2024, 1, 2), date(2024, 1, 3), 0, 0),
              (5, "E", "x", D(5), date(2024, 1, 2), date(2024, 1, 3), None, 2)]
    ctx = context(spark, campaigns=(campaigns, c_kind), promotions=(promos, p_kind))
    perf = {r.campaign_id: r for r in ctx.ref("int_campaign_performance").collect()}
    assert [perf[i].daily_budget for i in (1, 2, 3)] == [D("0.00"), D("33.33"), D("1.00")]
    assert [perf[i].completion_status for i in (1, 2, 3)] == ["Overdue", "Yes", "Active"]
    used = {r.promotion_id: (r.utilization_percentage, r.utilization_status) for r in ctx.ref("int_promo_utilization").collect()}
    assert used == {1: (D("100.00"), "Exhausted"), 2: (D("80.00"), "High"), 3: (D("33.33"), "Low"),
                    4: (None, "Exhausted"), 5: (None, "Low")}
    roi = {(r.activity_date, r.marketing_channel): r for r in ctx.ref("fct_marketing_roi").collect()}
    tv = roi[date(2024, 1, 1), "tv"]  # two campaigns meet two promotion types
    assert (tv.campaign_count, tv.total_campaign_budget, tv.promo_count, tv.total_promo_uses) == (2, D("340.00"), 6, 182)
    assert tv.total_discounts_given == 2 * (20 + 241)
    web, none = roi[date(2024, 1, 10), "web"], roi[date(2024, 1, 2), None]
    assert (web.total_campaign_budget, web.promo_count, none.campaign_count, none.promo_count) == (D("10.00"), None, 0, 2)


def test_payment_and_shipment_rules(spark):
    ctx = context(
        spark,
        orders=([(1, 1, datetime(2024, 1, 1), D("10.00"), "completed")],
                "id int, customer_id int, order_date timestamp_ntz, total_amount decimal(10,2), status string"),
        customers=([(1, "e", "n", datetime(2024, 1, 1))], "id int, email string, name string, created_at timestamp_ntz"),
        payment_transactions=([(i, 1, 1, datetime(2024, 1, 1), D(a), s, "x") for i, (a, s) in enumerate(
            [("10.00", "success"), ("9.99", "success"), ("10.01", "success"), ("10.00", "failed")])],
            "id int, order_id int, payment_method_id int, transaction_date timestamp_ntz, amount decimal(10,2), "
            "status string, transaction_id string"),
        shipments=([(i, 1, 1, 1, "t", datetime(2024, 1, 1), datetime(2024, 1, 5), a, "delivered") for i, a in enumerate(
            [datetime(2024, 1, 5), datetime(2024, 1, 5, 1), None])],
            "id int, order_id int, carrier_id int, warehouse_id int, tracking_number string, ship_date timestamp_ntz, "
            "estimated_delivery timestamp_ntz, actual_delivery timestamp_ntz, status string"))
    assert [r.reconciliation_status for r in ctx.ref("int_payment_reconciliation").orderBy("transaction_id").collect()] == [
        "Matched", "Underpaid", "Overpaid"]
    assert [r.delivery_performance for r in ctx.ref("stg_shipments").orderBy("shipment_id").collect()] == [
        "On Time", "Delayed", "In Transit"]


def test_lookup_example(spark):
    orders = spark.createDataFrame([(1, "US-CA", D("100.00")), (2, "XX", D("10.00"))], "order_id int, region_code string, amount decimal(10,2)")
    rates = spark.createDataFrame([("US-CA", "California", "USD", D("0.0725"))], "region_code string, region_name string, currency string, tax_rate decimal(5,4)")
    assert rows(taxed_orders(orders, rates)) == [
        (1, "US-CA", "California", "USD", D("100.00"), D("0.0725"), D("7.25"), D("107.25")),
        (2, "XX", None, None, D("10.00"), None, None, None)]


def test_unknown_model(spark, small):
    with pytest.raises(KeyError):
        MartContext(raw_source(Tables(spark, small)), date(2001, 8, 1)).ref("stg_nothing")


def test_build_stores_a_model_with_what_it_needs(spark, small, tmp_path):
    w = Warehouse(spark, "t_build_one", str(tmp_path / "w"))
    record = build_models(raw_source(Tables(spark, small)), date(2001, 8, 1), w, ["fct_orders"], str(tmp_path / "runs")).first()
    assert set(record.summary.models) == {"stg_orders", "stg_customers", "int_customer_orders", "fct_orders"}
    assert w.read("fct_orders").count() == Tables(spark, small).orders.count()
    again = build_models(raw_source(Tables(spark, small)), date(2001, 8, 1), w, ["fct_orders"], str(tmp_path / "runs")).first()
    assert again.summary.failures == 0 and w.read("int_customer_orders").count() == w.read("fct_orders").count()
    assert read_runs(spark, str(tmp_path / "runs"), multi_line=False).count() == 2


def test_first_failure_ends_the_run_and_is_recorded(spark, small, tmp_path):
    def source(name):
        if name == "customers":
            raise RuntimeError("source is gone")
        return RAW_TABLES[name](Tables(spark, small))

    w = Warehouse(spark, "t_build_fail", str(tmp_path / "w"))
    with pytest.raises(RuntimeError, match="gone"):
        build_models(source, date(2001, 8, 1), w, ["fct_orders"], str(tmp_path / "runs"))
    record = read_runs(spark, str(tmp_path / "runs"), multi_line=False).first()
    assert record.summary.models["stg_customers"].error == "source is gone" and not w.exists("fct_orders")


def test_models_in_a_circle_are_named(spark, monkeypatch):
    from stratamart.plans.context import Model

    for name, other in (("first", "second"), ("second", "first")):
        monkeypatch.setitem(MODELS, name, Model(name, lambda ctx, other=other: ctx.ref(other), "silver"))
    with pytest.raises(ValueError, match="first -> second -> first"):
        MartContext(lambda _: None, date(2024, 1, 1)).ref("first")


def shuffle_files(spark):
    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    return {path for folder in disk.localDirsString() for path in glob(f"{folder}/*/shuffle_*.data")}


def test_a_run_leaves_no_shuffle_files(spark, small, tmp_path):
    before, setting = shuffle_files(spark), spark.conf.get(FREE_SHUFFLES)
    w = Warehouse(spark, "t_build_freed", str(tmp_path / "w"))
    build_models(raw_source(Tables(spark, small)), date(2001, 8, 1), w, ["fct_orders", "int_supplier_orders"])
    assert not shuffle_files(spark) - before
    assert spark.conf.get(FREE_SHUFFLES) == setting


def test_large_models_are_stored_one_at_a_time(spark, small, tmp_path, monkeypatch):
    monkeypatch.setattr(build, "AT_ONCE_BYTES", 0)
    stored, running, most = [], set(), 0

    class Watched(Warehouse):
        def write(self, table, *args, **kwargs):
            nonlocal most
            running.add(table)
            most = max(most, len(running))
            shown = super().write(table, *args, **kwargs)
            running.remove(table)
            stored.append(table)
            return shown

    w = Watched(spark, "t_build_turns", str(tmp_path / "w"))
    record = build_models(raw_source(Tables(spark, small)), date(2001, 8, 1), w).first()
    assert most == 1 and record.summary.successes == len(MODELS)
    assert stored == [n for n in build.one_by_one() if MODELS[n].layer != "bronze"]


def test_models_come_after_what_they_read(spark, small):
    class Noting(MartContext):
        reads = []

        def ref(self, name):
            self.reads.append(name)
            return super().ref(name)

    order = build.one_by_one()
    assert sorted(order) == sorted(MODELS)
    for name, model in MODELS.items():
        ctx = Noting(raw_source(Tables(spark, small)), date(2001, 8, 1))
        ctx.reads = []
        model.build(ctx)
        assert all(order.index(r) < order.index(name) for r in ctx.reads)
