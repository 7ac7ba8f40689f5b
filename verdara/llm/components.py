"""Connected components of a graph given as a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdara.sources.scratch import stored


def _both(links: DataFrame) -> DataFrame:
    return links.select("a", "b").unionByName(links.select(F.col("b").alias("a"),
                                                           F.col("a").alias("b")))


def _with_least(links: DataFrame) -> DataFrame:
    """Links with the least of a and its neighbours.

    The minima are written, so Spark knows their size: it broadcasts a short list, and else joins
    two plain shuffles, whose hot nodes (the centres of large stars) it splits at run time.
    """
    least = stored(links.groupBy("a").agg(F.min("b").alias("m")))
    return links.join(least, "a").withColumn("m", F.least("a", "m"))


def _large_star(links: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the node's least neighbour."""
    return (_with_least(_both(links)).where("b > a")
            .select(F.col("b").alias("a"), F.col("m").alias("b")))


def _small_star(links: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are linked to the least of them."""
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    found = _with_least(down)
    return (found.select(F.col("b").alias("a"), F.col("m").alias("b"))
            .unionByName(found.select("a", F.col("m").alias("b"))))


def components(links: DataFrame) -> DataFrame:
    """(node, component): least node reachable, for every node of a link.

    ``links`` has a and b of one orderable type.  Alternating large-star and small-star rounds
    end in one star per component after a number of rounds that grows with the logarithm of the
    longest chain; each round is written, so the plan stays short and lost executors cost one
    round at most.
    """
    now = stored(links.where("a <> b").select("a", "b").distinct())
    state = None
    while True:
        after = stored(_small_star(_large_star(now)).where("a <> b").distinct())
        found = tuple(after.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")))
                      .first())
        if found == state:
            break
        now, state = after, found
    roots = after.select(F.col("b").alias("node")).distinct()
    return (after.select(F.col("a").alias("node"), F.col("b").alias("component"))
            .unionByName(roots.select("node", F.col("node").alias("component"))))
