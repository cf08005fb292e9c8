"""Graph queries over edge tables (src, dst[, kind]).

Degrees and neighbourhoods are aggregates and joins. Traversals run a fixed or
converging number of rounds; each round is written to the shared folder, so the
plan stays short and a lost executor does not restart the walk.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmesh.functions import lexicon as L
from lexmesh.session import written


def in_degree(edges: DataFrame, kinds: list[str] | None = None) -> DataFrame:
    kept = edges.where(F.col("kind").isin(kinds)) if kinds else edges
    return kept.groupBy("dst").agg(F.count(F.lit(1)).alias("grado"))


def multiply_defined(edges: DataFrame) -> DataFrame:
    """(dst, n_defs, src): every definer of a node that has more than one, in long form.

    Long form, so that a node with millions of definers is not one giant array.
    """
    pairs = edges.select("src", "dst").distinct()
    counts = pairs.groupBy("dst").agg(F.count(F.lit(1)).alias("n_defs")).where(F.col("n_defs") > 1)
    return pairs.join(counts, "dst")


def orphans(nodes: DataFrame, edges: DataFrame, key: str = "id_norma") -> DataFrame:
    """Nodes that are neither source nor target of any edge."""
    touched = edges.select(F.explode(F.array("src", "dst")).alias(key)).distinct()
    return nodes.join(touched, key, "left_anti")


def last_layer(edges: DataFrame) -> DataFrame:
    """A directed graph keeps one edge per pair: the highest layer wins."""
    return edges.groupBy("src", "dst").agg(F.max_by("kind", "layer").alias("kind"))


def reach(edges: DataFrame, start: DataFrame, depth: int) -> DataFrame:
    """(node, level) within ``depth`` steps of the start set, which itself is left out."""
    links = edges.select("src", "dst").distinct()
    seen = written(start.select(F.col(start.columns[0]).alias("node"), F.lit(0).alias("level")))
    frontier = seen
    for level in range(1, depth + 1):
        fresh = (
            links.join(frontier.select(F.col("node").alias("src")), "src")
            .select(F.col("dst").alias("node")).distinct()
            .join(seen, "node", "left_anti")
            .withColumn("level", F.lit(level))
        )
        frontier = written(fresh)
        seen = seen.unionByName(frontier)
    return seen.where(F.col("level") > 0)


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, component): weakly connected components named by their least node.

    Alternating large-star and small-star steps: every step is a mergeable
    minimum per node plus one join, so hubs are never gathered, and the number
    of rounds grows with the logarithm of the longest chain.
    """
    current = written(edges.where(F.col("src") != F.col("dst")).select(
        F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct())
    mark = None
    while True:
        # Equal marks before and after a round mean the stars no longer change.
        found = current.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if found == mark:
            break
        mark = found
        current = written(_star_round(current))
    roots = current.groupBy("u").agg(F.min("v").alias("component"))
    key = nodes.columns[0]
    return nodes.select(F.col(key).alias("node")).join(roots.withColumnRenamed("u", "node"), "node", "left").select(
        "node", F.coalesce("component", "node").alias("component"))


def _star_round(current: DataFrame) -> DataFrame:
    """One large-star and one small-star step over (u > v) links."""
    # Large star: each neighbour above a node points to the least of its neighbourhood.
    ends = F.array(F.struct(F.col("u").alias("a"), F.col("v").alias("b")), F.struct(F.col("v").alias("a"), F.col("u").alias("b")))
    sides = current.select(F.explode(ends).alias("e")).select(F.col("e.a").alias("u"), F.col("e.b").alias("v"))
    least = sides.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    large = sides.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    # Small star: each node and its smaller neighbours point to the least of them.
    floor = large.groupBy("u").agg(F.min("v").alias("m"))
    moved = large.join(floor, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(floor.select("u", F.col("m").alias("v"))).where(F.col("u") != F.col("v")).distinct()


def density(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    n = nodes.agg(F.count(F.lit(1)).alias("nodos"))
    m = edges.select("src", "dst").distinct().agg(F.count(F.lit(1)).alias("aristas"))
    both = n.withColumn("aristas", m.scalar())
    return both.withColumn("densidad", F.round(F.when(F.col("nodos") > 1, F.col("aristas") / (F.col("nodos") * (F.col("nodos") - 1))).otherwise(0.0), 9))


def status_after(relations: DataFrame, norms: DataFrame) -> DataFrame:
    """Repeal dominates; a modification only shows on norms of unknown status."""
    marks = relations.where(F.col("destino").isNotNull()).groupBy(F.col("destino").alias("id_norma")).agg(
        F.bool_or(F.col("relacion") == "DEROGA").alias("derogada"),
        F.bool_or(F.col("relacion") == "MODIFICA").alias("modificada"))
    status = (
        F.when(F.coalesce("derogada", F.lit(False)), "DEROGADA")
        .when(F.coalesce("modificada", F.lit(False)) & (F.col("estado") == "DESCONOCIDO"), "MODIFICADA")
        .otherwise(F.col("estado"))
    )
    return norms.join(marks, "id_norma", "left").select("id_norma", status.alias("estado"))


def context_boosts(questions: DataFrame, defines: DataFrame, references: DataFrame) -> DataFrame:
    """(query_id, norm, boost): 2.0 for definers of a mentioned concept, 1.3 for norms referring to them.

    ``questions`` (query_id, concept), ``defines`` (norm, concept), ``references`` (src, dst).
    """
    definers = questions.join(defines, "concept").select("query_id", "norm").distinct()
    referrers = definers.join(references.select("src", F.col("dst").alias("norm")).distinct(), "norm").select(
        "query_id", F.col("src").alias("norm"))
    graded = definers.withColumn("boost", F.lit(L.DEFINER_BOOST)).unionByName(
        referrers.withColumn("boost", F.lit(L.REFERRER_BOOST)))
    return graded.groupBy("query_id", "norm").agg(F.max("boost").alias("boost"))
