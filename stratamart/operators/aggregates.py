"""Aggregations beyond plain ``groupBy``: measure lists, nesting, lists, argmax, imputation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratamart.functions import mean
from stratamart.operators.quantiles import exact_quantiles
from stratamart.operators.windows import RANGE_ROWS, ranked_within


# The aggregates a request may name. Deviation and variance are of the sample.
AGGREGATIONS = {
    "SUM": F.sum, "AVG": F.avg, "COUNT": F.count, "MIN": F.min, "MAX": F.max,
    "STDDEV": F.stddev, "VARIANCE": F.variance,
}


def aggregation(df: DataFrame, name: str, field: str) -> Column:
    """The named aggregate of a field; averages of exact numbers stay exact."""
    if name.upper() not in AGGREGATIONS:
        raise ValueError(f"unknown aggregation {name!r}")
    kind = df.schema[field].dataType
    if name.upper() == "AVG" and isinstance(kind, (T.DecimalType, T.IntegralType)):
        return mean(F.col(field))
    return AGGREGATIONS[name.upper()](F.col(field))


def row_of_max(df: DataFrame, keys: Sequence[str], measure: str, tie: str) -> DataFrame:
    """Per key the ``tie`` column and measure of the greatest measure, equal ones by smallest ``tie``.

    ``tie`` must be numeric: the maximum is taken over ``(measure, -tie)`` on the map side.
    """
    top = df.groupBy(*keys).agg(F.max(F.struct(measure, (-F.col(tie)).alias("_tie"))).alias("_top"))
    return top.select(*keys, (-F.col("_top._tie")).alias(tie), F.col(f"_top.{measure}").alias(measure))


# How partial results of a measure are put together.
_COMBINED = {"sum": (F.sum, F.sum), "count": (F.count, F.sum), "min": (F.min, F.min), "max": (F.max, F.max)}


def counted_up(df: DataFrame, keys: Sequence[Column | str], chain: dict[str, str],
               measures: dict[str, tuple[str, Column | str]]) -> DataFrame:
    """Per group the distinct non-NULL values of the columns of ``chain``, and ``measures``
    (``name: (sum, count, min or max, column)``).

    Each column of the chain must determine the next one (a return its order, an order its
    customer). Rows are grouped by the whole chain first and then by ever less of it, so every step
    adds up what the one before counted: no row is multiplied for a distinct count. All rows are
    shuffled once, as plain values: dealt by group and last chain column, which spreads a hot group,
    they lie right for every step but the last, and that one is combined on the map side.
    """
    columns, names = list(chain.values()), list(chain)
    groups = [F.col(k) if isinstance(k, str) else k for k in keys]
    inputs = {c if isinstance(c, str) else n: F.col(c) if isinstance(c, str) else c for n, (_, c) in measures.items()}
    rows = df.select(*groups, *[F.col(c).alias(f"_of_{c}") for c in columns], *[c.alias(f"_in_{n}") for n, c in inputs.items()])
    groups, columns = rows.columns[:len(keys)], [f"_of_{c}" for c in columns]
    found = rows.repartition(*groups, columns[-1]).groupBy(*groups, *columns).agg(*[
        _COMBINED[kind][0](f"_in_{c if isinstance(c, str) else n}").alias(n) for n, (kind, c) in measures.items()])
    types = {f.name: f.dataType for f in found.schema.fields}
    for i, column in enumerate(columns):
        counts = [F.sum(n).alias(n) for n in names[:i]] + [F.count(column).alias(names[i])]
        sums = [_COMBINED[kind][1](n).cast(types[n]).alias(n) for n, (kind, _) in measures.items()]
        found = found.groupBy(*groups, *columns[i + 1:]).agg(*counts, *sums)
    return found


def sorted_text(df: DataFrame, keys: Sequence[str], item: str, out: str, separator: str = ", ",
                chunk_items: int = 10_000, range_rows: int = RANGE_ROWS) -> DataFrame:
    """The distinct items of each key in order, as one text.

    Duplicates go before the gather, spread over (key, item). A key with more than
    ``chunk_items`` distinct items gets several texts, numbered by ``chunk``, since a text
    must fit in one row.
    """
    distinct = df.select(*keys, item).where(F.col(item).isNotNull()).distinct()
    placed = ranked_within(distinct, keys, item, [], "_n", range_rows)
    chunk = F.floor((F.col("_n") - 1) / chunk_items).cast("int").alias("chunk")
    rows = placed.groupBy(*keys, chunk).agg(F.sort_array(F.collect_list(F.struct("_n", item))).alias("_items"))
    return rows.select(*keys, "chunk", F.array_join(F.transform("_items", lambda r: r[item]), separator).alias(out))


def nested_rows(rows: DataFrame, key: str, keep: Column, order_by: str, ties: Sequence[str], fields: Sequence[str],
                out: str, chunk_rows: int = 10_000, range_rows: int = RANGE_ROWS) -> DataFrame:
    """Per key the ordered array of its rows that meet ``keep``, empty where none does.

    Keys come from all rows, so no second pass or join is needed for them. Chunks are as in
    ``nested_children``.
    """
    marked = rows.withColumn("_at", F.when(keep, F.col(order_by)))
    placed = ranked_within(marked, [key], "_at", ties, "_n", range_rows)
    chunk = F.coalesce(F.floor((F.col("_n") - 1) / chunk_rows), F.lit(0)).cast("int").alias("chunk")
    item = F.when(F.col("_n").isNotNull(), F.struct("_n", *fields))
    gathered = placed.groupBy(key, chunk).agg(F.sort_array(F.collect_list(item)).alias("_rows"))
    return gathered.select(key, "chunk", F.transform("_rows", lambda r: F.struct(*[r[f].alias(f) for f in fields])).alias(out))


def nested_distinct(rows: DataFrame, key: str, item: str, out: str, chunk_rows: int = 10_000, range_rows: int = RANGE_ROWS) -> DataFrame:
    """Per key the ordered array of its distinct non-NULL items, empty where there is none."""
    distinct = rows.select(key, item).distinct()
    return nested_rows(distinct, key, F.col(item).isNotNull(), item, [], [item], out, chunk_rows, range_rows)


def nested_children(parents: DataFrame, children: DataFrame, key: str, order_by: str, ties: Sequence[str],
                    fields: Sequence[str], out: str, chunk_rows: int = 10_000,
                    range_rows: int = RANGE_ROWS) -> DataFrame:
    """Parents with an ordered array of child structs, empty without children.

    An array must fit in one row, so a parent with more than ``chunk_rows`` children gets
    several rows, numbered by ``chunk``; together they hold every child in order.
    ``order_by`` with ``ties`` must be unique within a parent.
    """
    placed = ranked_within(children, [key], order_by, ties, "_n", range_rows)
    chunked = placed.groupBy(key, F.floor((F.col("_n") - 1) / chunk_rows).cast("int").alias("chunk")).agg(
        F.sort_array(F.collect_list(F.struct("_n", *fields))).alias("_rows"))
    plain = F.transform("_rows", lambda r: F.struct(*[r[f].alias(f) for f in fields]))
    kept = chunked.select(key, "chunk", plain.alias(out))
    empty = F.filter(F.array(F.struct(*[F.lit(None).cast(children.schema[f].dataType).alias(f) for f in fields])),
                     lambda _: F.lit(False))
    joined = parents.join(kept, key, "left")
    return joined.withColumns({"chunk": F.coalesce("chunk", F.lit(0)), out: F.coalesce(out, empty)})


def impute_median(df: DataFrame, column: str) -> DataFrame:
    """Fill NULLs of a column with its exact median."""
    median = exact_quantiles(df, [], column, [0.5]).select("quantile")
    return df.withColumn(column, F.coalesce(F.col(column).cast("double"), median.scalar()))


def profile(df: DataFrame) -> DataFrame:
    """Per column its type, rows, NULLs and distinct values.

    Values are unpivoted to (column, value) and counted per pair, so every column's distinct
    count spreads over all tasks and one scan serves all columns.
    """
    names = df.columns
    pairs = F.array(*[F.struct(F.lit(i).alias("_i"), F.col(f"`{c}`").cast("string").alias("_v"))
                      for i, c in enumerate(names)])
    counted = df.select(F.inline(pairs)).groupBy("_i", "_v").agg(F.count("*").alias("_n"))
    known = F.create_map(*[x for i, f in enumerate(df.schema.fields)
                           for x in (F.lit(i), F.struct(F.lit(f.name).alias("column"),
                                                        F.lit(f.dataType.simpleString()).alias("type")))])
    return counted.groupBy("_i").agg(
        F.sum("_n").alias("rows"),
        F.coalesce(F.sum(F.when(F.col("_v").isNull(), F.col("_n"))), F.lit(0)).alias("nulls"),
        F.count("_v").alias("distinct_values"),
    ).select(known[F.col("_i")].getField("column").alias("column"),
             known[F.col("_i")].getField("type").alias("type"), "rows", "nulls", "distinct_values")
