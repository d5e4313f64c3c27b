"""Charts, filters, data checks, run records and files."""

import json
from dataclasses import replace

import pytest
from table_rows import rows

from stratamart.operators import charts, filters, history, joins, quality
from stratamart.operators.aggregates import profile, row_of_max
from stratamart.operators.charts import Chart
from stratamart.sources import files


@pytest.fixture(scope="module")
def sales(spark):
    data = [("a", "x", 1), ("a", "y", 2), ("b", "x", None), (None, "x", 9), ("c", None, 4), ("a", "x", 3)]
    return spark.createDataFrame(data, "k string, c string, v int")


def test_xy_leaves_out_null_labels(sales):
    assert [tuple(r) for r in charts.chart_data(sales, Chart("bar", "k", "v")).collect()] == [
        ("a", 6), ("b", None), ("c", 4)]


def test_metric_of_nothing_is_zero(sales):
    assert charts.chart_data(sales, Chart("metric", y_axis="v", filters={"k": "none"})).first().value == 0.0
    assert charts.chart_data(sales, Chart("metric", y_axis="v", aggregation="stddev", filters={"v": 9})).first().value == 0.0


def test_two_aggregates_of_one_field(sales):
    got = charts.chart_data(sales, Chart(x_axis="k", metrics=[("v", "sum"), ("v", "max")]))
    assert got.columns == ["label", "sum_v", "max_v"] and got.first() == ("a", 6, 3)


def test_stacked_fills_empty_cells(sales):
    chart = Chart("bar-stacked", "k", "v", category="c")
    got = charts.chart_data(sales, chart)
    assert got.columns == ["label", "None", "x", "y"]  # rows without a category are a series
    assert [tuple(r) for r in got.collect()] == [("a", 0, 4, 2), ("b", 0, 0, 0), ("c", 4, 0, 0)]
    limited = charts.chart_data(sales, replace(chart, limit=1))  # whole labels: no cell is cut
    assert [tuple(r) for r in limited.collect()] == [("a", 4, 2)]


def test_limits_are_in_the_request(spark, tmp_path):
    many = spark.range(15_000).selectExpr("id", "CAST(id AS STRING) AS k", "1 AS v", "id AS order_status")
    assert charts.chart_data(many, Chart("bar", "k", "v")).count() == 15_000
    assert charts.chart_data(many, Chart("bar", "k", "v", limit=7)).count() == 7
    assert charts.chart_data(many, Chart("table", columns=["k"], limit=5)).count() == 5
    charts.export_chart(many, Chart("table", columns=["k"], limit=5), str(tmp_path / "out"))
    assert spark.read.csv(str(tmp_path / "out"), header=True).count() == 15_000
    assert filters.filter_options(many).count() == filters.distinct_values(many, "k").count() == 15_000
    assert filters.filter_options(many, limit=3).count() == 3


@pytest.mark.parametrize("chart", [
    Chart("bar", "k", "v", "median"), Chart("bar", "nope", "v"), Chart("bar", "k"), Chart("table"),
    Chart("metric", y_axis="nope"), Chart("bar", "k", "v", filters={"nope": 1}),
    Chart("bar", "k", "v", conditions=[("v", "~", 1)]), Chart(x_axis="k", metrics=[("v", "mode")])])
def test_bad_charts_are_refused(sales, chart):
    with pytest.raises(ValueError):
        charts.chart_data(sales, chart)


def test_zero_and_false_are_filter_values(spark):
    df = spark.createDataFrame([(0, False), (1, True)], "n int, f boolean")
    assert filters.filter_map(df, {"n": 0}).count() == 1
    assert filters.filter_map(df, {"f": False}).count() == 1
    assert filters.filter_map(df, {"n": None, "f": ""}).count() == 2


def test_not_true_drops_null(spark):
    df = spark.createDataFrame([(1, True), (2, False), (3, None)], "i int, f boolean")
    assert [r.i for r in filters.not_true(df, "f").collect()] == [2]


def test_distinct_values_take_field_or_expression(sales):
    assert [r.value for r in filters.distinct_values(sales, "k", limit=2).collect()] == ["a", "b"]
    assert [r.value for r in filters.distinct_values(sales, expression="v % 2").collect()] == [0, 1]
    with pytest.raises(ValueError):
        filters.distinct_values(sales)


def test_exports(sales, tmp_path, spark):
    charts.export_chart(sales, Chart("bar", "k", "v"), str(tmp_path / "one"))
    assert spark.read.csv(str(tmp_path / "one"), header=True).count() == 3
    listed = [(sales, Chart("bar", "k", "v", title="A")), (sales, Chart("metric", y_axis="v", title="B")),
              (sales, Chart("bar", "k", title="C"))]
    charts.export_dashboard(listed, str(tmp_path / "all"))
    assert {r.chart for r in spark.read.csv(str(tmp_path / "all"), header=True).collect()} == {"A"}


def test_argmax_settles_ties_by_the_smaller_key(spark):
    df = spark.createDataFrame([("a", 3, 5), ("a", 2, 5), ("a", 1, 4)], "g string, id int, m int")
    assert rows(row_of_max(df, ["g"], "m", "id")) == [("a", 2, 5)]


def test_profile_counts_nulls_and_distinct(sales):
    assert rows(profile(sales)) == [("c", "string", 6, 1, 2), ("k", "string", 6, 1, 3), ("v", "int", 6, 1, 5)]


def test_quality(spark):
    child = spark.createDataFrame([(1, 1), (1, 2), (2, 9), (None, 9), (3, None)], "id int, ref int")
    parent = spark.createDataFrame([(1,), (2,)], "id int")
    assert rows(quality.null_counts(child, ["id", "ref"])) == [("id", 5, 1), ("ref", 5, 1)]
    assert rows(quality.duplicates(child, ["id"])) == [(1, 2)]
    assert rows(quality.broken_references(child, "ref", parent, "id")) == [(9, 2)]
    tables = {"child": child, "parent": parent}
    declared = {"child": {"id": ["not_null", "unique"], "ref": [("references", "parent", "id")]}}
    assert rows(quality.run_checks(tables.get, declared)) == [
        ("child", "id", "not_null", 1), ("child", "id", "unique", 1), ("child", "ref", "references", 2)]


def test_a_chart_of_too_many_categories_is_refused(spark):
    df = spark.range(charts.MOST_CATEGORIES + 1).selectExpr("1 AS x", "id AS y", "CAST(id AS STRING) AS c")
    chart = Chart("bar-stacked", "x", "y", category="c")
    with pytest.raises(ValueError, match="categories"):
        charts.stacked_chart(df, chart)
    assert charts.stacked_chart(df, chart, ["5", "7"]).collect()[0][1:] == (5, 7)


def test_declared_tests_of_a_table_read_it_once(spark, tmp_path):
    path = str(tmp_path / "child")
    spark.createDataFrame([(1, 1, 5), (1, 2, None), (2, 9, 5), (None, 9, 1), (3, None, 1)], "id int, ref int, other int").write.parquet(path)
    tables = {"child": spark.read.parquet(path), "p": spark.createDataFrame([(1,), (2,)], "id bigint"),
              "q": spark.createDataFrame([("5",)], "code string"), "none": spark.createDataFrame([], "id int")}
    declared = {"child": {"id": ["not_null", "unique"], "ref": [("references", "p", "id"), ("references", "none", "id")],
                          "other": [("references", "q", "code"), "not_null"]}, "none": {"id": ["unique", "not_null"]}}
    found = quality.run_checks(tables.get, declared)
    assert rows(found) == [("child", "id", "not_null", 1), ("child", "id", "unique", 1), ("child", "other", "not_null", 1),
                           ("child", "other", "references", 2), ("child", "ref", "references", 2), ("child", "ref", "references", 4),
                           ("none", "id", "not_null", 0), ("none", "id", "unique", 0)]
    assert found._jdf.queryExecution().optimizedPlan().toString().count("parquet") == 1
    with pytest.raises(ValueError, match="no test"):
        quality.run_checks(tables.get, {})


def test_reconcile(spark):
    a, b = spark.createDataFrame([(1,), (2,), (2,)], "k int"), spark.createDataFrame([(2,), (3,)], "k int")
    found = joins.reconcile(a, b, "k")
    assert rows(found) == [(1, "left_only"), (2, "both"), (3, "right_only")]
    assert rows(joins.reconcile_summary(found)) == [(3, 1, 1, 1, "needs_attention")]
    assert joins.reconcile_summary(joins.reconcile(b, b, "k")).first().status == "clean"


def test_pretty_printed_run_files_are_read(spark, tmp_path):
    for n, status in ((1, "success"), (2, "failed")):
        info = {"execution_time": 0.5, "timestamp": "2024-01-01T00:00:00", "status": status}
        if status == "failed":
            info["error"] = "boom"
        record = {"run_id": f"run_{n}", "timestamp": f"2024-01-0{n}T00:00:00", "summary": {
            "total_models": 2, "successes": 1, "failures": 1, "total_execution_time": 1.0,
            "models": {"stg_a": info, "stg_b": {**info, "status": "success", "error": None}}, "logs": ["ignored"]},
            "logs": ["ran stg_a", "ran stg_b"]}
        (tmp_path / f"run_{n}.json").write_text(json.dumps(record, indent=2))
    runs = history.read_runs(spark, str(tmp_path))
    assert rows(history.run_summary(runs)) == [("run_1", 2, 2, 0, 1.0), ("run_2", 2, 1, 1, 1.0)]
    assert history.model_history(runs, "stg_a").count() == 2
    newest = history.model_history(runs, "stg_a", limit=1).first()
    assert (newest.run_id, newest.status, newest.error, newest.logs) == ("run_2", "failed", "boom", ["ran stg_a"])


def test_csv_types_and_names(spark, tmp_path):
    (tmp_path / "x.csv").write_text("id,amount,ok,name\n1,1.5,true,a\n2,,false,\n")
    df = files.read_csv(spark, str(tmp_path / "x.csv"))
    assert [t for _, t in df.dtypes] == ["int", "double", "boolean", "string"]
    found = files.csv_preview(df)
    assert found["row_count"] == 2 and found["data"][1] == {"id": 2, "amount": None, "ok": False, "name": None}
    assert files.csv_table_name("My data-1.csv") == "csv_my_data_1"
    with pytest.raises(ValueError):
        files.dataset_preview(df, 0)


def test_date_spine(spark):
    span = spark.sql("SELECT DATE '2024-02-27' AS first, DATE '2024-03-02' AS last")
    assert files.date_spine(span).count() == 5
