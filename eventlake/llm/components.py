"""Connected components of a table of links, as Spark jobs.

Alternating large-star and small-star steps (Kiveris et al., 2014): each step
hooks a node's neighbours to its smallest one.  Minima combine on the map side;
every step is written to the shared checkpoint folder, which cuts the lineage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventlake.llm.common import written


def _star(links: DataFrame, large: bool) -> DataFrame:
    """links (u, v) with u > v; returns the rewired links, again u > v."""
    both = links.select("u", "v").unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else links
    least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("n"), F.least("u", "m").alias("m"))
    joined = both.join(least, F.col("u") == F.col("n"))
    if large:       # hook the larger neighbours of every node to the least node around
        out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:           # hook a node and its smaller neighbours to the least of them
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select(F.col("n").alias("u"), F.col("m").alias("v")))
    return out.where("u > v").distinct()


def _sum(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root): the least node of each linked node's component.

    Links are undirected; repeated links and self-links do no harm.  Nodes
    without a link are not listed.
    """
    edges = written(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u > v").distinct(), "links")
    state = _sum(edges)
    while state[0]:
        edges = written(_star(_star(edges, True), False), "links")
        now = _sum(edges)
        if now == state:
            break
        state = now
    roots = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
