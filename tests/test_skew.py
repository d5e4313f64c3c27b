"""Queries on tables where a third or more of the rows share one key."""

import duckdb
import pytest
from compare import compare, duckdb_tables

QUERIES = [
    "int_order_details", "int_shipment_tracking", "fct_sales_performance", "fct_customer_returns", "fct_marketing_roi",
    "fct_shipping_logistics", "join_lateral_top1", "join_correlated_counts", "agg_multi_distinct", "agg_quantile",
    "agg_string_list", "agg_nest_children", "agg_arg_max", "win_rank_first", "win_row_number", "win_latest_per_key",
    "demo_proposals", "demo_event_trends", "schedule_status", "mat_incremental_upsert", "rfm_features", "churn_features",
]


@pytest.fixture(scope="module")
def skewed(small, tmp_path_factory):
    folder = tmp_path_factory.mktemp("skewed")
    hot = {
        "lineitem": "CASE WHEN r % 3 = 0 THEN 1 ELSE l_orderkey END AS l_orderkey, "
                    "CASE WHEN r % 3 = 1 THEN l_partkey ELSE 7 END AS l_partkey, "
                    "CASE WHEN r % 3 = 2 THEN 3 ELSE l_suppkey END AS l_suppkey",
        "orders": "CASE WHEN r % 3 = 0 THEN 5 ELSE o_custkey END AS o_custkey, "
                  "CASE WHEN r % 3 = 1 THEN TIMESTAMP '1999-05-05' ELSE o_orderdate END AS o_orderdate",
        "events": "CASE WHEN r % 3 = 0 THEN 5 ELSE user_id END AS user_id, "
                  "CASE WHEN r % 2 = 0 THEN 'error' ELSE event_type END AS event_type",
    }
    con = duckdb.connect()
    for name in ("region", "nation", "customer", "supplier", "part", *hot):
        replace = f"REPLACE ({hot[name]})" if name in hot else ""
        con.execute(f"COPY (SELECT * EXCLUDE (r) {replace} FROM (SELECT *, row_number() OVER () AS r "
                    f"FROM read_parquet('{small}/{name}.parquet')) x) TO '{folder}/{name}.parquet' (FORMAT parquet)")
    return str(folder)


@pytest.mark.parametrize("name", QUERIES)
def test_skewed(spark, skewed, name):
    assert compare(spark, duckdb_tables(skewed), name, skewed) is None
