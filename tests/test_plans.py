"""Properties of the physical plans: no cross products, pruned scans, pushed filters."""

import re

import pytest

from stratamart.checks import CHECKS
from stratamart.operators.aggregates import counted_up


def plan(spark, name, folder):
    return CHECKS[name].run(spark, folder)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", [n for n in CHECKS if not n.startswith(("ml_", "train_c", "model_", "incremental_s"))])
def test_no_cross_products_or_single_task_windows(spark, small, name):
    text = plan(spark, name, small)
    assert "CartesianProduct" not in text
    assert "BroadcastNestedLoopJoin" not in text
    assert "BatchEvalPython" not in text
    for line in text.splitlines():
        if "Exchange SinglePartition" in line:
            # only whole-table aggregates and limits may end in one task
            assert re.search(r"Aggregate\(keys=\[\]|TakeOrdered|GlobalLimit|CollectLimit", text), text


def test_scans_read_only_needed_columns(spark, small):
    text = plan(spark, "fct_sales_performance", small)
    read = re.findall(r"ReadSchema: struct<([^>]*)>", text)
    assert not any("l_discount" in r or "l_tax" in r or "o_orderpriority" in r for r in read)


def test_filters_reach_the_scan(spark, small):
    assert "EqualTo(o_orderstatus,F)" in plan(spark, "filter_equality", small)
    assert "EqualTo(l_returnflag,R)" in plan(spark, "int_return_analysis", small)
    assert "GreaterThan(l_quantity,25.0)" in plan(spark, "filter_compare", small)


def test_joins_fall_back_to_a_shuffle_beyond_the_threshold(spark, small):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
    try:
        for name in ("int_order_details", "int_shipment_tracking", "fct_marketing_roi", "join_left_chain_diff_keys"):
            text = plan(spark, name, small)
            assert "SortMergeJoin" in text and "BroadcastHashJoin" not in text, name
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("name", ["fct_sales_performance", "fct_customer_returns", "fct_shipping_logistics"])
def test_distinct_counts_multiply_no_row(spark, small, name):
    assert "Expand" not in plan(spark, name, small)


def test_summaries_rank_nothing(spark, small):
    for name in ("demo_proposal_summary", "demo_proposal_insights"):
        assert "row_number" not in plan(spark, name, small)


def test_facts_are_shuffled_once_for_their_distinct_counts(spark, tmp_path):
    kind = "day date, kind string, item bigint, parent bigint, top bigint, v decimal(10,2)"
    spark.createDataFrame([], kind).write.parquet(str(tmp_path / "rows"))
    rows = spark.read.schema(kind).parquet(str(tmp_path / "rows"))
    counted = counted_up(rows, ["day", "kind"], {"items": "item", "parents": "parent", "tops": "top"}, {"sum": ("sum", "v")})
    text = counted._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"Exchange \w+", text)) == 2  # all rows, and one row per group and task


def test_parcels_are_dealt_by_order_once(spark, small):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "3k")  # more than carriers and warehouses have, less than suppliers
    try:
        text = plan(spark, "int_shipment_tracking", small)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    dealt = re.findall(r"Exchange hashpartitioning\((\w+)#", text)
    assert sorted(dealt) == ["l_orderkey", "l_suppkey", "o_orderkey", "order_id", "s_suppkey"], text
