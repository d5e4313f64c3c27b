"""Connected components of links between ids."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratamart.session import stable


def components(links: DataFrame) -> DataFrame:
    """``(id, component)`` for every id in ``links(a, b)``; component is its smallest reachable id.

    Each round gives every id the smallest label among itself and its neighbours and then the
    label of that label, so chains shorten by half and more. Labels are summed up on the map
    side, so a centre with very many links is no hot key. Every round is written to the shared
    folder, which cuts the lineage; ids that can no longer change still take part, the links are
    only those given.
    """
    both = stable(links.select("a", "b").union(links.select(F.col("b"), F.col("a"))).where("a <> b").distinct())
    labels = stable(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.first("a")).alias("component")))
    while True:
        near = both.join(labels, both["b"] == labels["id"]).select(F.col("a").alias("id"), "component")
        low = near.union(labels).groupBy("id").agg(F.min("component").alias("component"))
        up = labels.select(F.col("id").alias("via"), F.col("component").alias("root"))
        jumped = low.join(up, low["component"] == up["via"], "left").select(
            "id", F.least("component", F.coalesce("root", "component")).alias("component"))
        after = stable(jumped)
        before = labels.select("id", F.col("component").alias("old"))
        if after.join(before, "id").where("component <> old").isEmpty():
            return after
        labels = after
