"""Connected components of an edge table by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duskveil.plans.scratch import stash


def connected_components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``edges`` (``a, b`` of one orderable type).

    ``root`` is the smallest node that can be reached. Each round links the
    larger neighbours of a node to its smallest one and then does the same with
    the smaller neighbours; the number of rounds grows with the logarithm of
    the longest path. The state of a round is a written table, never more edges
    than the first one.
    """
    links = stash(
        edges.where("a <> b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct()
    )
    mark = _mark(links)
    while True:
        links = stash(_small_star(_large_star(links)))
        after = _mark(links)
        if after == mark:
            break
        mark = after
    return links.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        links.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )


def _mark(links: DataFrame) -> tuple:
    summed = F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))
    return tuple(links.agg(F.count("*"), summed).first())


def _large_star(links: DataFrame) -> DataFrame:
    """Every neighbour above a node now hangs on the node's smallest neighbour."""
    # links run from the larger node a to the smaller node b
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy(F.col("a").alias("n")).agg(
        F.least(F.min("b"), F.col("n")).alias("least")
    )
    # the neighbours of b above it are the a of its links
    moved = links.join(least, F.col("b") == F.col("n")).select("a", F.col("least").alias("b"))
    return moved.where("a <> b").distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """A node and its smaller neighbours now hang on the smallest of them."""
    least = links.groupBy(F.col("a").alias("n")).agg(F.min("b").alias("least"))
    moved = links.join(least, F.col("a") == F.col("n")).select(
        F.col("b").alias("a"), F.col("least").alias("b")
    )
    own = least.select(F.col("n").alias("a"), F.col("least").alias("b"))
    return moved.where("a <> b").unionByName(own).distinct()
