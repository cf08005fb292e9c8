"""Connected components of link tables, for operators on pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmesh.session import written


def components(links: DataFrame) -> DataFrame:
    """(u, root): the least node each linked node can reach, for links (u, v) of long ids; a root has no row of its own.

    Large-star and small-star rounds. A round's minima are written before they are
    joined: both sides of each join then are plain exchanges, whose hot keys adaptive
    execution splits, so the neighbours of a hub are never in one task.
    """
    current = written(_ordered(links))
    mark = None
    while True:
        found = current.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if found == mark:
            return current.select("u", F.col("v").alias("root"))
        mark = found
        current = _small_star(_large_star(current))


def _ordered(links: DataFrame) -> DataFrame:
    """Each link once, from its greater end to its lesser one."""
    return links.where(F.col("u") != F.col("v")).select(
        F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def _large_star(current: DataFrame) -> DataFrame:
    """Every neighbour above a node is linked to the least of the node and its neighbours."""
    ends = F.array(F.struct(F.col("u").alias("u"), F.col("v").alias("v")), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))
    sides = current.select(F.explode(ends).alias("e")).select("e.u", "e.v")
    least = written(sides.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
    moved = sides.where(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return written(moved.distinct())


def _small_star(large: DataFrame) -> DataFrame:
    """A node and its lesser neighbours are linked to the least of them."""
    least = written(large.groupBy("u").agg(F.min("v").alias("m")))
    moved = large.join(least, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return written(_ordered(moved.unionByName(least.select("u", F.col("m").alias("v")))))
