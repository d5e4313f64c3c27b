"""Row numbers and ranks that hold when one group has most of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

RANGE_ROWS, LEVELS, STEPS = 1_000_000, 3, 16


def _place(df: DataFrame, name: str) -> Column | None:
    """A number that never falls as the column rises, to lay ranges by; None for a type without one."""
    kind, col = df.schema[name].dataType, F.col(name)
    if isinstance(kind, T.StringType):  # the first six bytes
        return F.conv(F.rpad(F.hex(F.substring(col.cast("binary"), 1, 6)), 12, "0"), 16, 10).cast("double")
    if isinstance(kind, T.DateType):
        return F.unix_date(col).cast("double")
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return col.cast("timestamp").cast("double")
    if isinstance(kind, T.BooleanType):
        return col.cast("int").cast("double")
    return col.cast("double") if isinstance(kind, T.NumericType) else None


Places = Sequence[tuple[Column, Column]]  # a place, and the column it is laid by


def _range(span: Column, places: Places) -> Column:
    """The range of a row by even steps over the first place that differs in its group. Where the values of
    a column differ but not their places, no later column may decide."""
    def share(i: int, place: Column) -> Column:
        low, high = span[f"low{i}"], span[f"high{i}"]
        return F.when(high > low, F.nanvl((place - low) / (high - low), F.lit(1.0))).when(~span[f"same{i}"], 0.0)

    position = F.coalesce(*[share(i, place) for i, (place, _) in enumerate(places)], F.lit(0.0))
    return F.coalesce(F.least(F.floor(position * span["ranges"]), span["ranges"] - 1), F.lit(0).cast("long"))


def _spans(counted: DataFrame, group: Sequence[str], places: Places, range_rows: int) -> DataFrame:
    """``(group..., _span)`` of the groups with more than ``range_rows`` rows: how many ranges they get, the
    least and greatest places, and whether a column has one value only."""
    sums = counted.groupBy(*group).agg(
        F.when(F.count("*") > range_rows, F.ceil(F.count("*") / range_rows) * STEPS).otherwise(F.lit(1).cast("long")).alias("ranges"),
        *[f(p).alias(f"{n}{i}") for i, (p, _) in enumerate(places) for f, n in ((F.min, "low"), (F.max, "high"))],
        *[F.coalesce(F.min(c) == F.max(c), F.lit(True)).alias(f"same{i}") for i, (_, c) in enumerate(places)])
    return sums.where("ranges > 1").select(*group, F.struct(*[c for c in sums.columns if c not in group]).alias("_span"))


def _with(rows: DataFrame, few: DataFrame, group: Sequence[str], how: str = "left") -> DataFrame:
    """``rows`` with what ``few`` has for their group. It has at most ``2 * STEPS * LEVELS`` rows for every
    ``range_rows`` rows that are numbered, a share that bounds what is broadcast here."""
    named = few.select(*[F.col(k).alias(f"_key{i}") for i, k in enumerate(group)], *[c for c in few.columns if c not in group])
    same = [F.col(k).eqNullSafe(F.col(f"_key{i}")) for i, k in enumerate(group)]
    return rows.join(F.broadcast(named), same, how).drop(*[f"_key{i}" for i in range(len(group))])


def _numbered(rows: DataFrame, counted: DataFrame, keys: Sequence[str], order: Sequence[str], out: str, range_rows: int) -> DataFrame:
    """Number ``rows`` within ``keys`` in ``order`` (NULLs last), which must be unique; ``counted`` has the same
    rows with at least the keys and the columns to lay ranges by.

    Ranges follow from the counts and the least and greatest values of a group, so they are the same
    in every run and part of one lazy plan. A group of more than ``range_rows`` rows gets
    ``STEPS`` ranges for each so many, and a range that still has more is parted again, ``LEVELS`` times in all: a value that most of a group
    shares comes to stand alone and is parted by the next column. A row's number is the sum of the counts of the ranges before its own, and its place in that range.
    """
    places = []
    for c in order:
        if (place := _place(counted, c) if c in counted.columns else None) is None:
            break  # what follows only settles ties of this column
        missing = F.col(c).isNull().cast("double")
        places += [(missing, missing), (place, F.col(c))]
    group, columns = list(keys), rows.columns
    counted = counted.select(*dict.fromkeys([*keys, *[c for c in order if c in counted.columns]]))
    for level in range(LEVELS if places else 0):
        spans, laid = _spans(counted, group, places, range_rows), f"_range{level}"
        if group:
            # after the first level only groups that have ranges are counted on
            rows, counted = _with(rows, spans, group), _with(counted, spans, group, "left" if level else "inner")
        else:
            rows, counted = (df.withColumn("_span", spans.scalar()) for df in (rows, counted))
        rows, counted = (df.withColumn(laid, _range(F.col("_span"), places)).drop("_span") for df in (rows, counted))
        group.append(laid)
    window = Window.partitionBy(*group).orderBy(*[F.col(c).asc_nulls_last() for c in order])
    place = F.row_number().over(window).cast("long")
    if group == list(keys):
        return rows.withColumn(out, place)
    upto = Window.partitionBy(*keys).orderBy(*group[len(keys):]).rowsBetween(Window.unboundedPreceding, -1)
    starts = counted.groupBy(*group).agg(F.count("*").alias("_count")).select(*group, F.sum("_count").over(upto).alias("_start"))
    placed = _with(rows, starts, group)
    return placed.select(*[F.col(f"`{c}`") for c in columns], (place + F.coalesce("_start", F.lit(0))).alias(out))


def row_numbers(df: DataFrame, order_by: Sequence[str], out: str, range_rows: int = RANGE_ROWS) -> DataFrame:
    """``row_number() over (order by ...)`` for a whole table; ``order_by`` must be unique, NULLs last."""
    return _numbered(df, df, [], order_by, out, range_rows)


def ranked_within(df: DataFrame, keys: Sequence[str], value: str, ties: Sequence[str], out: str,
                  range_rows: int = RANGE_ROWS, sizes_of: DataFrame | None = None) -> DataFrame:
    """Rank of ``value`` within ``keys``, equal values ordered by ``ties``; NULL values get no rank.

    A task sorts a range of about ``range_rows`` rows, never a whole hot group. Ranges are counted in
    ``sizes_of``, by default ``df`` itself: a narrower table that ``df`` was joined from saves running
    the joins for it.
    """
    known = F.col(value).isNotNull()  # rows without a value may be most of a key
    counted = (sizes_of if sizes_of is not None else df).where(known)
    ranked = _numbered(df.where(known), counted, keys, [value, *ties], out, range_rows)
    return ranked.unionByName(df.where(~known).withColumn(out, F.lit(None).cast("long")))


def latest_per_key(df: DataFrame, keys: Sequence[str], newest_by: Sequence[str]) -> DataFrame:
    """The row with the greatest ``newest_by`` of each key.

    A maximum over structs is combined on the map side, so a hot key sends one row per task.
    """
    rest = [c for c in df.columns if c not in (*keys, *newest_by)]
    latest = df.groupBy(*keys).agg(F.max(F.struct(*newest_by, *rest)).alias("_latest"))
    return latest.select(*keys, "_latest.*").select(*df.columns)


def running_and_rolling(daily: DataFrame, keys: Sequence[str], day: str, value: str, rows: int) -> DataFrame:
    """Running total and average of the last ``rows`` rows per key, over a pre-aggregated table."""
    ordered = Window.partitionBy(*keys).orderBy(day)
    recent = ordered.rowsBetween(1 - rows, 0)
    total = F.sum(value).over(recent).cast("decimal(20,4)")
    return daily.withColumns({
        "running_total": F.sum(value).over(ordered.rowsBetween(Window.unboundedPreceding, 0)),
        "rolling_avg": F.round(total / F.count(value).over(recent).cast("decimal(10,0)"), 6),
    })
