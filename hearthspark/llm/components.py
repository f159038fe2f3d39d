"""Connected components of a graph kept in tables, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearthspark.llm.common import written


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of an edge; root is the smallest node that can be reached.

    ``edges`` has columns a and b of one orderable type. Each round first links every neighbour above a node
    to the node's smallest neighbour, then a node and its lower neighbours to the smallest of them, and
    writes the edges; the rounds end when the edges stay as they are, which is when each component is a
    star. Rounds grow with the logarithm of the number of nodes. Minima are summed up before the shuffle and
    met by an equality join that Spark may split, so a hub of any degree is no single task.
    """
    links = written(
        edges.filter("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links"
    )
    mark = None
    while True:
        both = links.unionAll(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lowest = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(lowest, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.filter("u != v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(
            F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v"))))
        )
        links = written(small.select("col.*").filter("u != v").distinct(), "links")
        now = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == mark:
            break
        mark = now
    return links.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(
        links.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )
