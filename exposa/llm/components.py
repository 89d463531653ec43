"""Connected components of a table of links, by alternating large and small stars.

A round is a fixed number of joins and groupings of the links, written to the shared folder, so
nothing gathers in a task or on the driver; a node of many links is one row per map task after partial
aggregation, and the joins' large sides can be split by adaptive execution. Stars double their reach
each round, so the number of rounds follows the logarithm of the longest path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from exposa.llm.common import materialize


def _large_star(links: DataFrame) -> DataFrame:
    both = links.union(links.select("b", "a"))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("least"))
    return (both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("least").alias("b"))
            .where("a != b").distinct())


def _small_star(links: DataFrame) -> DataFrame:
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("least"))
    moved = down.join(least, "a").where("b != least").select(F.col("b").alias("a"), F.col("least").alias("b"))
    return moved.union(least).distinct()


def _state(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node that has a link; root is the component's least node. ``links`` has
    two bigint columns, in any order and with repeats."""
    links = links.toDF("a", "b").where("a != b")
    links = materialize(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    state = _state(links)
    while state[0]:
        links = materialize(_small_star(_large_star(links)))
        before, state = state, _state(links)
        if state == before:
            break
    return links.toDF("node", "root")
