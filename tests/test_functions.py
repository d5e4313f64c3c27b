from datetime import date, datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from stratamart import functions as fn


def column(spark, values, kind):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")


def result(df, c):
    return [r[1] for r in sorted(df.select("i", c.alias("r")).collect())]


def test_title_case(spark):
    texts = ["o'neil mc-donald", "ALL CAPS", "3rd place", "", None]
    assert result(column(spark, texts, "string"), fn.title_case("v")) == [
        "O'Neil Mc-Donald", "All Caps", "3Rd Place", "", None]


def test_trim_space_strips_tabs_and_newlines(spark):
    assert result(column(spark, ["\t a b \n", None], "string"), fn.trim_space("v")) == ["a b", None]


def test_ratio_guards_zero_and_rounds_half_up(spark):
    df = spark.createDataFrame([(0, Decimal("1.00"), 8), (1, Decimal("-1.00"), 8), (2, Decimal("1.00"), 0),
                                (3, None, 1)], "i int, v decimal(10,2), d int")
    assert result(df, fn.ratio("v", "d", 2).cast("string")) == ["0.13", "-0.13", None, None]
    assert result(df, fn.ratio("v", "d", 1, 100).cast("string")) == ["12.5", "-12.5", None, None]


def test_mean_is_exact_and_null_without_values(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("a", None), ("b", None)], "k string, v int")
    got = {r.k: r.m for r in df.groupBy("k").agg(fn.mean("v").alias("m")).collect()}
    assert got == {"a": Decimal("1.500000"), "b": None}


@pytest.mark.parametrize("day, years", [
    (date(2001, 8, 1), 0), (date(2000, 8, 1), 1), (date(2000, 8, 2), 0), (date(1996, 2, 29), 5),
    (date(2001, 12, 1), 0), (date(2003, 8, 1), -2), (None, None)])
def test_age_years(spark, day, years):
    assert result(column(spark, [day], "date"), fn.age_years("v", date(2001, 8, 1))) == [years]


def test_age_years_leap_day_is_reached_the_day_after(spark):
    leap = column(spark, [date(1996, 2, 29)], "date")
    assert result(leap, fn.age_years("v", date(2001, 2, 28))) == [4]
    assert result(leap, fn.age_years("v", date(2001, 3, 1))) == [5]


def test_whole_days_truncate_towards_zero(spark):
    noon = datetime(2024, 1, 10, 12)
    df = column(spark, [datetime(2024, 1, 12, 11), datetime(2024, 1, 12, 12), datetime(2024, 1, 8, 13), None],
                "timestamp_ntz")
    assert result(df, fn.whole_days("v", F.lit(noon).cast("timestamp_ntz"))) == [1, 2, -1, None]


def test_day_of_week_starts_on_sunday(spark):
    df = column(spark, [date(2024, 1, 7), date(2024, 1, 8), date(2024, 1, 13)], "date")
    assert result(df, fn.day_of_week("v")) == [0, 1, 6]


def test_bins_are_closed_on_the_right(spark):
    df = column(spark, [0, 1, 30, 31, 40, 41, 100, 101, None], "int")
    bins = fn.bin_right_closed("v", (0, 30, 40, 100), ("Young", "Middle", "Senior"))
    assert result(df, bins) == [None, "Young", "Young", "Middle", "Middle", "Senior", "Senior", None, None]


def test_email_pattern(spark):
    df = column(spark, ["a.b+c@x-y.org", "a@b", "a b@c.de", "@c.de", None], "string")
    assert result(df, fn.is_email("v")) == [True, False, False, False, None]


def test_clean_output(spark):
    df = spark.createDataFrame(
        [(float("nan"), float("inf"), datetime(2024, 1, 2, 3, 4, 5, 60000), Decimal("1.50"), date(2024, 1, 2), ["a"]),
         (1.5, -1.0, datetime(2024, 1, 2, 3, 4, 5), None, None, None)],
        "a double, b double, t timestamp_ntz, d decimal(5,2), e date, l array<string>")
    got = [tuple(r) for r in fn.clean_output(df).collect()]
    assert got == [(None, None, "2024-01-02T03:04:05.060000", 1.5, "2024-01-02", ["a"]),
                   (1.5, -1.0, "2024-01-02T03:04:05", None, None, None)]
