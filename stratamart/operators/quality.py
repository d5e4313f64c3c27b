"""Data checks declared per table: not NULL, unique, and references between tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def null_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``(column, rows, nulls)`` for all columns in one scan."""
    counted = df.agg(F.count("*").alias("_rows"), *[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    rows = [F.struct(F.lit(c).alias("column"), F.col("_rows").alias("rows"), F.col(c).alias("nulls"))
            for c in columns]
    return counted.select(F.inline(F.array(*rows)))


def duplicates(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """Keys that occur more than once, with their number of rows; NULL keys are not compared."""
    known = df
    for c in key:
        known = known.where(F.col(c).isNotNull())
    return known.groupBy(*key).agg(F.count("*").alias("row_count")).where(F.col("row_count") > 1)


def broken_references(child: DataFrame, column: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """Values of a foreign key that the parent lacks, with their number of rows.

    The key is counted before the join, so a value shared by most rows travels once per task.
    """
    used = child.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("row_count"))
    return used.join(parent.select(F.col(parent_key).alias(column)), column, "left_anti")


def run_checks(sources, declared: dict) -> DataFrame:
    """``(table, column, test, failures)`` for declared tests, all in one lazy plan.

    ``declared`` maps a table to ``{column: [tests]}``; a test is ``not_null``, ``unique`` or
    ``("references", table, column)``. ``sources`` turns a table name into a DataFrame.

    A table is read once for all its tests: its tested columns are unpivoted and counted per
    (column, value), which spreads a hot value over all tasks, and every test is a sum over those counts.
    """
    out = None
    for table, columns in declared.items():
        tests = [(c, test) for c, named in columns.items() for test in named]
        if not tests:
            continue
        found = _table_checks(sources, sources(table), tests).select(
            F.lit(table).alias("table"), "column", "test", "failures")
        out = found if out is None else out.unionByName(found)
    if out is None:
        raise ValueError("no test declared")
    return out


def _table_checks(sources, df: DataFrame, tests: list[tuple]) -> DataFrame:
    names = list(dict.fromkeys(c for c, _ in tests))
    only_null = {c for c in names if all(test == "not_null" for name, test in tests if name == c)}
    references = [(names.index(c), test[1], test[2]) for c, test in tests if not isinstance(test, str)]

    def text(frame: DataFrame, c: str, i: int) -> Column:
        """The value as text, of a type that it shares with every key it refers to."""
        kinds = {r[0]: sources(r[1]).schema[r[2]].dataType for r in references}
        return (F.col(c).cast(kinds[i]) if i in kinds else F.col(c)).cast("string")

    cells = F.array(*[F.struct(F.lit(i).alias("i"), (F.when(F.col(c).isNotNull(), "") if c in only_null else text(df, c, i)).alias("v"))
                      for i, c in enumerate(names)])
    counted = df.select(F.inline(cells)).groupBy("i", "v").agg(F.count("*").alias("n"))
    for k, (i, parent, key) in enumerate(references):
        known = sources(parent).select(F.lit(i).alias("i"), F.col(key).cast("string").alias("v")).where("v IS NOT NULL").distinct()
        counted = counted.join(known.withColumn(f"known{k}", F.lit(True)), ["i", "v"], "left")
    value, n = F.col("v").isNotNull(), F.col("n")
    sums = {"not_null": F.when(~value, n), "unique": F.when(value & (n > 1), 1)}
    sums |= {f"known{k}": F.when(value & F.col(f"known{k}").isNull(), n) for k in range(len(references))}
    totals = counted.groupBy("i").agg(*[F.sum(c).alias(name) for name, c in sums.items()])
    at = {(i, parent, key): k for k, (i, parent, key) in enumerate(references)}
    named = [test if isinstance(test, str) else test[0] for _, test in tests]
    sources_of = [test if isinstance(test, str) else f"known{at[names.index(c), test[1], test[2]]}" for c, test in tests]
    rows = [F.struct(F.lit(t).alias("t"), F.lit(names.index(c)).alias("at"), F.coalesce(F.col(sum_of), F.lit(0)).cast("long").alias("failures"))
            for t, ((c, _), sum_of) in enumerate(zip(tests, sources_of, strict=True))]
    failed = totals.select("i", F.inline(F.array(*rows))).where("i = at").select("t", "failures")
    # a table without rows has no totals; its tests have no failures
    every = df.sparkSession.createDataFrame([(t, c, name) for t, ((c, _), name) in enumerate(zip(tests, named, strict=True))], "t int, column string, test string")
    return every.join(failed, "t", "left").select("column", "test", F.coalesce("failures", F.lit(0)).alias("failures"))
