"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from steadyrun.sources.scratch import stored


def _large_star(links: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the smallest of the node and its neighbours."""
    both = links.union(links.select("b", "a")).toDF("node", "other")
    least = both.groupBy("node").agg(F.least(F.col("node"), F.min("other")).alias("least"))
    return both.join(least, "node").where("other > node").select(F.col("other").alias("a"), F.col("least").alias("b"))


def _small_star(links: DataFrame) -> DataFrame:
    """Every smaller neighbour of a node, and the node, are linked to the smallest of them."""
    down = links.select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("other"))
    least = down.groupBy("node").agg(F.min("other").alias("least"))
    others = down.join(least, "node").where("other <> least").select(F.col("other").alias("a"), F.col("least").alias("b"))
    return others.union(least.select(F.col("node").alias("a"), F.col("least").alias("b")))


def components(links: DataFrame, label: str = "components") -> DataFrame:
    """(node, component): the smallest node reachable, for every node of ``links`` (columns a, b, both long).

    Alternates the large-star and small-star steps until no link changes. Each round is written to the shared
    folder, so lineage stays short and a lost executor costs one round; links never pass the driver. A link
    of a node to itself and repeated links are allowed, nulls are not links.
    """
    now = stored(links.where("a <> b").select("a", "b").distinct(), label)
    seen = None
    while True:
        stars = _small_star(_large_star(now).distinct()).where("a <> b").distinct()
        now = stored(stars, label)
        count = now.agg(F.count(F.lit(1)), F.sum(F.hash("a", "b").cast("long")), F.sum(F.xxhash64("a", "b") % 1000003))
        mark = tuple(count.first())
        if mark == seen or not mark[0]:
            break
        seen = mark
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots)
