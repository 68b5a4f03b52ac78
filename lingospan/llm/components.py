"""Connected components of a graph given as a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lingospan.llm.tables import store


def connected_components(links: DataFrame) -> DataFrame:
    """``node, component`` for every node of ``links`` (a long, b long).

    Alternating large and small stars: every step hangs each node on the smallest node it
    sees, until the links are stars around the smallest node of their component. Minima are
    summed up in the tasks first, so a node with very many links is no hot key. A step never has
    more rows than the one before; each is a written table.
    """
    links = store(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")), "links")
    state = None
    while True:
        both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        lowest = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(lowest, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        large = store(large, "large-star")
        lowest = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(lowest, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"), F.lit(1).alias("moved"))
        links = store(small.unionByName(lowest.select("a", F.col("m").alias("b"), F.lit(0).alias("moved"))), "small-star")
        # Stars have one row a node; they are final when a step moves none of them.
        new = links.agg(F.count("*"), F.sum("moved"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if not new[0] or (not new[1] and new == state):
            break
        state = new
    roots = links.groupBy("b").agg(F.lit(0).alias("_")).select(F.col("b").alias("node"), F.col("b").alias("component"))
    return links.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
