"""Exact quantiles with linear interpolation, for groups of any size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratamart.session import stable


def _same(left: str, right: str, keys: Sequence[str]) -> Column:
    """Equal keys, NULLs included."""
    found = F.lit(True)
    for k in keys:
        found = found & F.col(f"{left}.{k}").eqNullSafe(F.col(f"{right}.{k}"))
    return found


def exact_quantiles(df: DataFrame, keys: Sequence[str], value: str, qs: Sequence[float],
                    task_values: int = 1_000_000, ranges: int = 64) -> DataFrame:
    """``(keys..., q, quantile)`` of the non-NULL values as doubles, by selection in rounds.

    Values are counted per (group, value) first, which spreads a hot group over all tasks. A wanted
    rank lies in a range of its group's values, at first all of them. While some range has more than
    ``task_values`` distinct values, every range is cut into up to ``ranges`` parts, the rows of each
    part are counted, and only the parts that hold a wanted rank go on; each round leaves about one
    part in ``ranges``. What is left is ordered range by range, so no task has more than that.
    """
    if not keys:
        whole = exact_quantiles(df.select(F.lit(0).alias("_all"), value), ["_all"], value, qs, task_values, ranges)
        return whole.drop("_all")
    keys = list(keys)
    left = stable(df.select(*keys, F.lit(0).cast("long").alias("_r"), F.col(value).cast("double").alias("_v"))
                  .where(F.col("_v").isNotNull()).groupBy(*keys, "_r", "_v").agg(F.count("*").alias("_n")))
    position = (F.col("_total") - 1) * F.col("q")
    wanted = left.groupBy(*keys, "_r").agg(F.sum("_n").alias("_total")).withColumn(
        "q", F.explode(F.array(*[F.lit(float(q)) for q in qs]))).select(
        *keys, "_r", "q", (position - F.floor(position)).alias("_part"),
        F.explode(F.array(F.struct(F.lit(True).alias("low"), F.floor(position).alias("rank")),
                          F.struct(F.lit(False).alias("low"), F.ceil(position).alias("rank")))).alias("_at")) \
        .select(*keys, "_r", "q", "_part", "_at.low", "_at.rank")
    while (left.groupBy(*keys, "_r").count().agg(F.max("count")).first()[0] or 0) > task_values:
        left, wanted = _narrowed(left, wanted, keys, ranges)
    before = F.sum("_n").over(Window.partitionBy(*keys, "_r").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")
    placed = left.withColumn("_from", before)
    found = wanted.alias("w").join(placed.alias("p"), _same("w", "p", [*keys, "_r"]) & (F.col("w.rank") >= F.col("p._from"))
                                   & (F.col("w.rank") < F.col("p._from") + F.col("p._n"))).select("w.*", "p._v")
    ends = found.groupBy(*keys, "q", "_part").agg(F.max(F.when(F.col("low"), F.col("_v"))).alias("_l"),
                                                  F.max(F.when(~F.col("low"), F.col("_v"))).alias("_h"))
    return ends.select(*keys, "q", (F.col("_l") + (F.col("_h") - F.col("_l")) * F.col("_part")).alias("quantile"))


def _narrowed(left: DataFrame, wanted: DataFrame, keys: list[str], ranges: int) -> tuple[DataFrame, DataFrame]:
    """One round: the parts of the ranges that hold a wanted rank, and the ranks within them.

    Where a range is cut is approximate, which decides how even its parts are, never the result.
    """
    own = [*keys, "_r"]
    cuts = F.array_distinct(F.percentile_approx("_v", [i / ranges for i in range(1, ranges)], 10_000))
    splits = stable(left.groupBy(*own).agg(cuts.alias("_cuts")))  # written: all below see the same cuts
    placed = left.alias("l").join(splits.alias("s"), _same("l", "s", own)).select(
        "l.*", F.size(F.filter("s._cuts", lambda cut: cut < F.col("l._v"))).alias("_b"))
    upto = F.sum("_rows").over(Window.partitionBy(*own).orderBy("_b").rowsBetween(Window.unboundedPreceding, 0))
    parts = placed.groupBy(*own, "_b").agg(F.sum("_n").alias("_rows")).withColumn("_from", upto - F.col("_rows"))
    part = (F.col("_r") * ranges + F.col("_b")).alias("_r")
    hits = stable(wanted.alias("w").join(parts.alias("p"), _same("w", "p", own) & (F.col("w.rank") >= F.col("p._from"))
                                         & (F.col("w.rank") < F.col("p._from") + F.col("p._rows")))
                  .select(*[F.col(f"w.{k}") for k in own], "p._b", "q", "_part", "low", (F.col("rank") - F.col("p._from")).alias("rank")))
    needed = hits.select(*own, "_b").distinct()
    kept = placed.alias("l").join(needed.alias("n"), _same("l", "n", [*own, "_b"]), "left_semi")
    return stable(kept.select(*keys, part, "_v", "_n")), hits.select(*keys, part, "q", "_part", "low", "rank")
