"""Connected components of a distributed edge list (alternating large and small stars)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tally.llm.common import join_salted, written


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every linked node that is not its component's least.

    ``links`` has long columns a and b, in any order and number.  Each round points a
    node's larger neighbours, then its smaller ones, at its least neighbour (Kiveris et
    al., 2014); edges end as stars around the least node of each component.  Edges are
    written to the checkpoint folder after each round; only their count and checksum
    reach the driver.
    """
    edges = written(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
                    .distinct())
    state = _state(edges)
    while state[0]:
        both = edges.select(F.col("u").alias("x"), F.col("v").alias("y")).unionByName(
            edges.select(F.col("v").alias("x"), F.col("u").alias("y")))
        least = both.groupBy("x").agg(F.least(F.min("y"), F.col("x")).alias("lo"))
        # a hub of very many neighbours spreads over tasks
        large = join_salted(both, least, "x", F.col("y")).where("y > x").select(F.col("y").alias("u"), F.col("lo").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("lo"))
        small = (large.join(least, "u").where("v <> lo").select(F.col("v").alias("u"), F.col("lo").alias("v"))
                 .unionByName(least.select("u", F.col("lo").alias("v"))).distinct())
        edges = written(small)
        before, state = state, _state(edges)
        if state == before:
            break
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())
