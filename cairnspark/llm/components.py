"""Connected components of links, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnspark.session import cut

#: Rounds grow with the logarithm of the longest chain; this many would cover chains far beyond any corpus.
MOST_ROUNDS = 60


def _large(links: DataFrame) -> DataFrame:
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = cut(both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("m", "a")))
    return both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small(links: DataFrame) -> DataFrame:
    least = cut(links.groupBy("a").agg(F.min("b").alias("m")))
    return links.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))


def _oriented(links: DataFrame) -> DataFrame:
    return links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct()


def _mark(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(links: DataFrame) -> DataFrame:
    """Links (a, b) to rows (a, b): every node that is not the least of its component, with that least node.

    Both steps are joins on a node against one row per node. That side is written first, so that the join reads two plain
    shuffles and adaptive execution can divide a hot node's rows among tasks; each round is written to the checkpoint folder,
    so a lost executor costs one round at most.
    """
    now = cut(_oriented(links))
    mark = _mark(now)
    for _ in range(MOST_ROUNDS):
        after = cut(_oriented(_small(_oriented(_large(now)))))
        new = _mark(after)
        if new == mark:
            return after
        now, mark = after, new
    raise RuntimeError(f"components did not settle in {MOST_ROUNDS} rounds")
