"""Connected components of a graph given by its edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomline.llm.common import cut


def _stars(edges: DataFrame, small: bool) -> DataFrame:
    """One step of alternating stars on edges u > v: every node tells its neighbours its least one.

    The large star tells the larger neighbours, the small star the smaller ones and the node itself.
    Both keep components as they are; the least neighbour is found by a grouping with partial
    aggregates, so a node of any degree is spread over many tasks.
    """
    both = edges if small else edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
    told = both.join(least, "u")
    if small:
        found = told.where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    else:
        # Repeats are left for the small star to remove.
        return told.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return found.distinct()


def _digest(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0))).first()
    return tuple(row)


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node that has an edge to another; root is the least node it reaches.

    ``edges`` has two columns of one ordered type; direction, loops and repeats do not matter, and
    edges with a null end are left out.  Steps alternate until nothing changes; each is cut to
    the shared checkpoint folder, and only a count and a checksum come to the driver.
    """
    a, b = edges.columns
    now = cut(edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())
    before, after = None, _digest(now)
    while before != after:
        now = cut(_stars(_stars(now, small=False), small=True))
        before, after = after, _digest(now)
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()
