"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortry.llm.common import stored


def components(links: DataFrame, folder: str) -> DataFrame:
    """``(node, root)`` of every node that has a link, root being the smallest node of its component.

    ``links`` has two long columns a and b. Large and small stars alternate: every node passes its larger neighbours,
    then its smaller ones, to the smallest neighbour it knows. Each round is written to ``folder``; the number of
    rounds grows with the logarithm of the nodes. Minima are aggregated before they are shuffled and the stars are
    plain joins, so a node with very many links is split like any skewed join key.
    """
    edges = stored(
        links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(),
        f"{folder}/links-0",
    )
    seen = None
    for turn in range(1, 200):
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lowest, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = stored(small.union(lowest).distinct(), f"{folder}/links-{turn}")
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen or state[0] == 0:
            break
        seen = state
    roots = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.union(edges.select(F.col("v"), F.col("v")).distinct())
