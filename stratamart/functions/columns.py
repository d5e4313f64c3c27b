"""Column helpers: each returns a Column built from JVM-side functions."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed value: the address pattern of the documented validator.
EMAIL_PATTERN = r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$"


def as_column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ratio(num: Column | str, den: Column | str, digits: int, factor: int = 1) -> Column:
    """``round(num * factor / den, digits)`` in decimals, NULL when ``den`` is 0.

    The casts leave twelve or more fractional digits in the quotient, so the rounding is
    half-up on the true value and free of binary floating point error.
    """
    top = as_column(num).cast("decimal(26,8)") * F.lit(factor).cast("decimal(4,0)")
    bottom = as_column(den).cast("decimal(20,2)")
    return F.round(top / F.nullif(bottom, F.lit(0).cast("decimal(20,2)")), digits)


def mean(value: Column | str, digits: int = 6) -> Column:
    """Average of an exact numeric, independent of row order; NULL for no values."""
    c = as_column(value)
    return ratio(F.sum(c), F.count(c), digits)


def day_of_week(ts: Column | str) -> Column:
    """Day of week with Sunday as 0."""
    return F.dayofweek(as_column(ts)) - 1


def whole_days(end: Column | str, start: Column | str) -> Column:
    """Complete 24-hour days between two timestamps, truncated towards zero."""
    return F.extract(F.lit("DAY"), as_column(end) - as_column(start)).cast("int")


def age_years(day: Column | str, as_of: date) -> Column:
    """Completed calendar years from ``day`` to ``as_of``; negative after ``as_of``."""
    now, then = F.lit(as_of), as_column(day)

    def completed(late: Column, early: Column) -> Column:
        month_day = lambda c: F.month(c) * 100 + F.dayofmonth(c)
        missed = F.when(month_day(late) < month_day(early), 1).otherwise(0)
        return F.year(late) - F.year(early) - missed

    return F.when(then > now, -completed(then, now)).otherwise(completed(now, then))


def trim_space(text: Column | str) -> Column:
    """Strip every kind of white space from both ends, not only blanks."""
    return F.regexp_replace(as_column(text), r"^\s+|\s+$", "")


def title_case(text: Column | str) -> Column:
    """Upper-case each letter that follows a non-letter, lower-case all others."""
    runs = F.regexp_extract_all(as_column(text), F.lit(r"(\p{L}+|[^\p{L}]+)"), F.lit(1))
    return F.array_join(F.transform(runs, lambda run: F.initcap(run)), "")


def bin_right_closed(value: Column | str, edges: Sequence[float], labels: Sequence[str]) -> Column:
    """Label of the interval ``(edge, next edge]`` that holds the value; NULL outside."""
    if len(edges) != len(labels) + 1:
        raise ValueError("need one more edge than labels")
    c = as_column(value)
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for low, high, label in zip(edges, edges[1:], labels):
        out = out.when((c > low) & (c <= high), label)
    return out


def is_email(text: Column | str) -> Column:
    return as_column(text).rlike(EMAIL_PATTERN)


def rfm_score(recency: Column, frequency: Column, monetary: Column) -> Column:
    # The weights of the documented score.
    w = {"recency": 0.3, "frequency": 0.3, "monetary": 0.4}
    return recency * w["recency"] + frequency * w["frequency"] + monetary * w["monetary"]


def clean_output(df: DataFrame) -> DataFrame:
    """Rows ready for JSON: NaN and infinities as NULL, times as ISO text, others as text."""
    plain = (T.StringType, T.BooleanType, T.ByteType, T.ShortType, T.IntegerType, T.LongType,
             T.ArrayType, T.MapType, T.StructType)
    iso = "yyyy-MM-dd'T'HH:mm:ss"
    out = []
    for field in df.schema.fields:
        c = F.col(f"`{field.name}`")
        if isinstance(field.dataType, (T.FloatType, T.DoubleType)):
            bad = F.isnan(c) | (F.abs(c) == F.lit(float("inf")))
            c = F.when(~bad, c)
        elif isinstance(field.dataType, T.DecimalType):
            c = c.cast("double")
        elif isinstance(field.dataType, (T.TimestampType, T.TimestampNTZType)):
            fraction = F.date_format(c, "SSSSSS")
            c = F.when(fraction == "000000", F.date_format(c, iso)).otherwise(
                F.date_format(c, iso + ".SSSSSS"))
        elif not isinstance(field.dataType, plain):
            c = c.cast("string")
        out.append(c.alias(field.name))
    return df.select(*out)
