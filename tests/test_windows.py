import random

import numpy as np
import pytest
from table_rows import rows
from pyspark.sql import functions as F

from stratamart.operators.aggregates import nested_children, nested_rows, sorted_text
from stratamart.operators.quantiles import exact_quantiles
from stratamart.operators.windows import latest_per_key, ranked_within, row_numbers


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of the rows share one key, and half of those one value."""
    rng = random.Random(7)
    made = []
    for i in range(3000):
        key = "hot" if i % 3 == 0 else (None if i % 50 == 1 else f"k{rng.randrange(40)}")
        value = None if i % 11 == 0 else (5 if i % 6 == 0 else rng.randrange(100))
        made.append((i, key, value))
    return spark.createDataFrame(made, "id int, key string, value int").repartition(6).cache()


def expected_ranks(df):
    ranks, groups = {}, {}
    for r in df.collect():
        groups.setdefault(r.key, []).append(r)
    for members in groups.values():
        known = sorted((m for m in members if m.value is not None), key=lambda m: (m.value, m.id))
        ranks |= {m.id: i for i, m in enumerate(known, 1)} | {m.id: None for m in members if m.value is None}
    return ranks


@pytest.mark.parametrize("range_rows", [10_000, 500, 20, 1])
def test_rank_is_the_same_for_any_range(skewed, range_rows):
    ranked = ranked_within(skewed, ["key"], "value", ["id"], "rank", range_rows)
    got = ranked.collect()
    assert len(got) == 3000
    assert {r.id: r["rank"] for r in got} == expected_ranks(skewed)


def test_rank_of_an_empty_table(spark):
    empty = spark.createDataFrame([], "id int, key string, value int")
    assert ranked_within(empty, ["key"], "value", ["id"], "rank").count() == 0


def test_row_numbers_cover_the_whole_table_in_order(skewed):
    got = row_numbers(skewed, ["value", "id"], "n").collect()
    order = sorted(got, key=lambda r: (r.value is None, r.value, r.id) if r.value is not None else (True, 0, r.id))
    assert [r.n for r in order] == list(range(1, 3001))


def test_row_numbers_of_an_empty_table(spark):
    assert row_numbers(spark.createDataFrame([], "a int"), ["a"], "n").count() == 0


@pytest.mark.parametrize("range_rows", [10_000, 7])
def test_row_numbers_by_any_type(spark, range_rows):
    """Texts that share their first bytes, NULLs, dates and values that are not finite keep their order."""
    rng = random.Random(3)
    words = ["", "a", "abcdefg", "abcdefh", "abcdef", "é", "zz", None]
    made = [(i, rng.choice(words), rng.choice([None, float("nan"), float("inf"), float("-inf"), 1.5, -2.0]), rng.choice([None, "2020-01-01", "1950-05-05"]))
            for i in range(400)]
    df = spark.createDataFrame(made, "id int, s string, d double, day string").selectExpr(
        "id", "s", "d", "CAST(day AS DATE) AS day", "CAST(day AS TIMESTAMP) AS ts", "CAST(day AS TIMESTAMP_NTZ) AS tn", "id % 2 = 0 AS even", "struct(id) AS box")
    for order in (["s", "id"], ["d", "id"], ["day", "s", "id"], ["ts", "id"], ["tn", "id"], ["even", "box"], ["box"]):
        got = row_numbers(df, order, "n", range_rows).orderBy("n").select("id", "n").collect()
        want = df.orderBy(*[F.col(c).asc_nulls_last() for c in order]).select("id").collect()
        assert [r.n for r in got] == list(range(1, 401)) and [r.id for r in got] == [r.id for r in want], order


def test_ranks_need_no_job_and_split_a_hot_value(spark):
    """Half of the rows share key and value; still no range has many more rows than asked for."""
    df = spark.range(20_000).selectExpr("id", "CAST(id % 2 AS STRING) AS key", "CAST(IF(id % 4 = 0, 7, id % 90) AS INT) AS value")
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("ranks", "planning")
    ranked = ranked_within(df, ["key"], "value", ["id"], "n", 1000)
    assert not tracker.getJobIdsForGroup("ranks")
    spark.sparkContext.setJobGroup("", "")
    from stratamart.operators import windows
    places = [(windows._place(df, name), F.col(name)) for name in ("value", "id")]
    laid, group = df, ["key"]
    for level in range(windows.LEVELS):
        laid = windows._with(laid, windows._spans(laid, group, places, 1000), group).withColumn(f"r{level}", windows._range(F.col("_span"), places)).drop("_span")
        group = [*group, f"r{level}"]
    assert laid.groupBy(*group).count().agg(F.max("count")).first()[0] < 2000
    assert ranked.groupBy("key").agg(F.max("n"), F.count_distinct("n")).collect()[0][1:] == (10_000, 10_000)


def test_latest_per_key(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 1, None)], "k string, t int, v string")
    assert rows(latest_per_key(df, ["k"], ["t"])) == [("a", 2, "y"), ("b", 1, None)]


@pytest.mark.parametrize("task_values", [10_000, 5])
def test_quantiles_match_numpy(skewed, task_values):
    got = {(r.key, r.q): r.quantile for r in
           exact_quantiles(skewed, ["key"], "value", [0.0, 0.25, 0.5, 0.99, 1.0], task_values, 8).collect()}
    groups = {}
    for r in skewed.collect():
        if r.value is not None:
            groups.setdefault(r.key, []).append(r.value)
    assert set(got) == {(k, q) for k in groups for q in (0.0, 0.25, 0.5, 0.99, 1.0)}
    for (key, q), value in got.items():
        assert value == pytest.approx(np.quantile(groups[key], q), abs=1e-9), (key, q)


@pytest.mark.parametrize("task_values", [10_000, 5])
def test_global_quantile_with_an_outlier(spark, task_values):
    values = [float(i) for i in range(200)] + [1e18]
    df = spark.createDataFrame([(v,) for v in values], "v double").repartition(3)
    (row,) = exact_quantiles(df, [], "v", [0.99], task_values, 4).collect()
    assert row.quantile == pytest.approx(np.quantile(values, 0.99))


def test_quantiles_of_many_distinct_values_in_rounds(spark):
    df = spark.range(1_000_000).selectExpr("IF(id % 3 = 0, 'hot', CAST(id % 7 AS STRING)) AS k", "pow(id % 1000003, 3) * IF(id % 2 = 0, 1, -1) AS v")
    got = {(r.k, r.q): r.quantile for r in exact_quantiles(df, ["k"], "v", [0.0, 0.5, 0.99], task_values=100).collect()}
    plain = df.groupBy("k").agg(F.percentile("v", [0.0, 0.5, 0.99]).alias("p")).collect()
    for r in plain:
        for q, p in zip((0.0, 0.5, 0.99), r.p):
            assert got[r.k, q] == pytest.approx(p, rel=1e-12), (r.k, q)
    assert len(got) == 3 * len(plain)


def test_nested_children_split_large_parents(spark):
    parents = spark.createDataFrame([("a",), ("b",), ("c",)], "p string")
    children = spark.createDataFrame([("a", i, f"v{i}") for i in range(25)] + [("b", 1, "x")], "p string, n int, v string")
    for hot in (1_000, 3):
        nested = nested_children(parents, children, "p", "n", ["v"], ["n", "v"], "items", chunk_rows=10, range_rows=hot)
        got = {(r.p, r.chunk): [tuple(x) for x in r["items"]] for r in nested.collect()}
        assert [len(got["a", c]) for c in range(3)] == [10, 10, 5]
        assert sum((got["a", c] for c in range(3)), []) == [(i, f"v{i}") for i in range(25)]
        assert got["b", 0] == [(1, "x")] and got["c", 0] == []


def test_sorted_text_drops_duplicates(spark):
    df = spark.createDataFrame([("a", "y"), ("a", "x"), ("a", "y")], "k string, v string")
    assert rows(sorted_text(df, ["k"], "v", "t")) == [("a", 0, "x, y")]


def test_sorted_text_splits_long_lists(spark):
    df = spark.createDataFrame([("a", f"{i:02d}") for i in range(25)] * 2 + [("b", "z"), ("b", None)], "k string, v string")
    for hot in (1_000, 3):
        got = {(r.k, r.chunk): r.t for r in sorted_text(df, ["k"], "v", "t", ",", 10, hot).collect()}
        assert ",".join(got["a", c] for c in range(3)) == ",".join(f"{i:02d}" for i in range(25))
        assert got["b", 0] == "z" and len(got) == 4


def test_rows_without_a_value_stay_out_of_the_window(spark):
    df = spark.createDataFrame([("k", i if i < 5 else None, i) for i in range(1000)], "k string, v int, t int")
    ranked = ranked_within(df, ["k"], "v", ["t"], "n")
    assert sorted(r.n for r in ranked.where("n IS NOT NULL").collect()) == [1, 2, 3, 4, 5] and ranked.count() == 1000
    plan = ranked._jdf.queryExecution().optimizedPlan().toString()
    assert "isnotnull(v" in plan.split("Window", 1)[1]


def test_nested_rows_in_chunks(spark):
    df = spark.createDataFrame([(1, i, i % 2 == 0) for i in range(7)] + [(2, 0, False)], "k int, v int, keep boolean")
    got = {(r.k, r.chunk): [x.v for x in r.out] for r in nested_rows(df, "k", F.col("keep"), "v", [], ["v"], "out", chunk_rows=3).collect()}
    assert got == {(1, 0): [0, 2, 4], (1, 1): [6], (2, 0): []}
