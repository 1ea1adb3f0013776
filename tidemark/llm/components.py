"""Connected components of a link table, by alternating large-star and small-star steps.

Each step is a join and an aggregation with map-side combine. The centre of a large
star is a hot key of the join and is broadcast: no group of links is ever gathered in
one task, and nothing but two numbers a round reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import join_counted, written


def _large_star(links: DataFrame, total: int) -> DataFrame:
    """Connect every larger neighbour of a node to the least node around it (links hold a > b)."""
    up = links.select(F.col("b").alias("a"), F.col("a").alias("b"))
    least = links.unionByName(up).groupBy("a").agg(F.min("b").alias("least"), F.count_if(F.col("b") > F.col("a")).alias("n"))
    least = written(least.select("a", F.least("a", "least").alias("least"), "n"))
    return join_counted(up, least, "a", total).select(F.col("b").alias("a"), F.col("least").alias("b"))


def _small_star(links: DataFrame, total: int) -> DataFrame:
    """Connect a node and its smaller neighbours to the least of them (links hold a > b)."""
    least = written(links.groupBy("a").agg(F.min("b").alias("least"), F.count(F.lit(1)).alias("n")))
    down = join_counted(links, least, "a", total).select(F.col("b").alias("a"), F.col("least").alias("b"))
    return down.unionByName(least.select("a", F.col("least").alias("b"))).filter("a > b").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b): root is the least node reachable.

    Links may repeat and may lead from a node to itself; null ends are left out. The
    number of rounds grows with the logarithm of the longest path.
    """
    # Read twice below, and dear to find.
    links = written(links.select("a", "b"))
    ordered = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"), F.isnull("a") | F.isnull("b"))
    nodes_alone = links.filter("a = b").select(F.col("a").alias("node")).distinct()
    links = written(ordered.toDF("a", "b", "lost").filter("NOT lost AND a > b").select("a", "b").distinct())

    def state(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    now = state(links)
    while True:
        links = written(_small_star(written(_large_star(links, now[0])), now[0]))
        was, now = now, state(links)
        if now == was:
            break
    roots = links.select(F.col("a").alias("node"), F.col("b").alias("root"))
    tops = links.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("root"))
    joined = roots.unionByName(tops)
    alone = nodes_alone.join(joined, "node", "left_anti").select("node", F.col("node").alias("root"))
    return joined.unionByName(alone)
