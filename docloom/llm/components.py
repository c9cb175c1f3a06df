"""Connected components of a table of links, by alternating large and small stars.

Each round is two aggregations and two joins over the links; the links shrink to
a star around the smallest node of each component. Every step ends in a table
in the shared folder, so a lost executor costs one step at most, and nothing
but a row count and a checksum reaches the driver.

The centre of a large component is one key of most links. Its smallest neighbour
is a partial aggregate, and it is written before it is joined: with a shuffle on
either side of the join, adaptive execution splits the centre's partition.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, discard

MOST_ROUNDS = 100


def _star(links: DataFrame, large: bool) -> DataFrame:
    """Hang the neighbours of each node that are larger (or not) on the smallest node next to it; a table."""
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else links
    lowest = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    lowest = cut(lowest, "lowest")
    if large:
        hung = both.filter(F.col("b") > F.col("a")).join(lowest, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        hung = both.join(lowest, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(
            lowest.select("a", F.col("m").alias("b"))
        )
    # from here on a link leads from the larger node to the smaller one
    found = cut(hung.filter(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "star")
    discard(lowest)
    return found


def components(links: DataFrame) -> DataFrame:
    """Links (a, b) of longs -> (node, root), root being the smallest node of the component.

    Nodes without links do not occur. Self-links and repeats are ignored.
    """
    now = cut(
        links.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"))
        .filter(F.col("a") != F.col("b"))
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct(),
        "links",
    )
    state = None
    for _ in range(MOST_ROUNDS):
        hung = _star(now, large=True)
        after = _star(hung, large=False)
        discard(hung)
        found = after.agg(
            F.count(F.lit(1)).alias("n"),
            F.sum((F.xxhash64("a", "b") / F.lit(4096)).cast("decimal(38,0)")).alias("check"),
        ).first()
        discard(now)
        now = after
        if state == (found.n, found.check):
            break
        state = (found.n, found.check)
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )
