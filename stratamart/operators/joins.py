"""Join shapes: lookups, fills, correlated counts, presence checks and grids."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def lookup(fact: DataFrame, table: DataFrame, on: Sequence[str], fill: Mapping[str, object] | None = None) -> DataFrame:
    """Left join that keeps every fact row, with optional defaults for what was not found."""
    joined = fact.join(table, list(on), "left")
    return joined.na.fill(dict(fill)) if fill else joined


def correlated_counts(parent: DataFrame, child: DataFrame, key: str, counts: Mapping[str, Column]) -> DataFrame:
    """Count a parent's child rows per condition; 0 without children. Counted before the join."""
    per_key = child.groupBy(key).agg(*[F.count_if(cond).alias(name) for name, cond in counts.items()])
    return lookup(parent, per_key, [key], {name: 0 for name in counts})


def missing_from(left: DataFrame, *others: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows of ``left`` whose key is in none of the other tables."""
    for other in others:
        left = left.join(other.select(*on), list(on), "left_anti")
    return left


def set_difference(required: DataFrame, present: DataFrame) -> DataFrame:
    """Distinct rows of ``required`` that ``present`` does not have."""
    return required.subtract(present)


def grid(base: DataFrame, name: str, values: Sequence[object]) -> DataFrame:
    """Every base row paired with each value of a fixed list, expanded in place without a join."""
    return base.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))


def reconcile(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """One row per key of either side with where it occurs: both, left_only or right_only."""
    a = left.select(key).distinct().withColumn("_l", F.lit(True))
    b = right.select(key).distinct().withColumn("_r", F.lit(True))
    where = F.when(F.col("_l").isNull(), "right_only").when(F.col("_r").isNull(), "left_only").otherwise("both")
    return a.join(b, key, "full").select(key, where.alias("presence"))


def reconcile_summary(reconciled: DataFrame) -> DataFrame:
    """Totals of a reconciliation; ``clean`` when nothing is orphaned on the left."""
    orphaned = F.count_if(F.col("presence") == "left_only")
    return reconciled.agg(
        F.count("*").alias("total_keys"),
        orphaned.alias("orphaned_count"),
        F.count_if(F.col("presence") == "both").alias("managed_count"),
        F.count_if(F.col("presence") == "right_only").alias("unknown_count"),
        F.when(orphaned == 0, "clean").otherwise("needs_attention").alias("status"),
    )
