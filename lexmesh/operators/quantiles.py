"""Exact quantiles per group without gathering a group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ACCURACY = 10000


def exact_quantiles(df: DataFrame, keys: list[str], value: str, probabilities: Sequence[float]) -> DataFrame:
    """(keys..., q0, q1, ...): linearly interpolated quantiles, one row per group.

    A mergeable sketch brackets every wanted rank narrowly; exact counts of the
    brackets then say which bracket really holds it, and only its values are
    ordered. A wrong sketch costs time, never exactness. Equal values are
    collapsed to one counted row first.
    """
    if not keys:
        return exact_quantiles(df.withColumn("_all", F.lit(1)), ["_all"], value, probabilities).drop("_all")
    data = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("v"))
    margin = 2.0 / ACCURACY
    edges = sorted({min(max(p + s, 0.0), 1.0) for p in probabilities for s in (-margin, margin)})
    bounds = data.groupBy(*keys).agg(
        F.array_distinct(F.percentile_approx("v", [float(e) for e in edges], ACCURACY)).alias("bounds"),
        F.count(F.lit(1)).alias("total"))
    counted = data.groupBy(*keys, "v").agg(F.count(F.lit(1)).alias("n"))
    placed = counted.join(bounds, keys).select(
        *keys, "v", "n", "total", F.size(F.filter("bounds", lambda b: b <= F.col("v"))).alias("bracket"))
    sizes = placed.groupBy(*keys, "bracket", "total").agg(F.sum("n").alias("held"))
    order = Window.partitionBy(*keys).orderBy("bracket")  # a handful of brackets per group
    offsets = sizes.withColumn("start", F.sum("held").over(order) - F.col("held"))
    targets = F.array(*[F.struct(
        F.lit(i).alias("i"), F.floor((F.col("total") - 1) * p).alias("lo"), F.ceil((F.col("total") - 1) * p).alias("hi"),
        ((F.col("total") - 1) * p - F.floor((F.col("total") - 1) * p)).alias("part")) for i, p in enumerate(probabilities)])
    inside = lambda r: (r >= F.col("start")) & (r < F.col("start") + F.col("held"))
    wanted = offsets.withColumn("targets", F.filter(targets, lambda t: inside(t["lo"]) | inside(t["hi"]))).where(
        F.size("targets") > 0).select(*keys, "bracket", "start", "targets")
    running = Window.partitionBy(*keys, "bracket").orderBy("v")
    ranks = placed.join(wanted, [*keys, "bracket"]).withColumn(
        "first", F.col("start") + F.sum("n").over(running) - F.col("n"))
    hits = ranks.select(*keys, "v", "first", "n", F.explode("targets").alias("t"))
    at = lambda r: (r >= F.col("first")) & (r < F.col("first") + F.col("n"))
    found = hits.where(at(F.col("t.lo")) | at(F.col("t.hi"))).groupBy(*keys, "t.i").agg(
        F.max(F.when(at(F.col("t.lo")), F.col("v"))).alias("lo"), F.max(F.when(at(F.col("t.hi")), F.col("v"))).alias("hi"),
        F.max("t.part").alias("part"))
    value_of = F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("part")
    return found.groupBy(*keys).agg(*[
        F.max(F.when(F.col("i") == i, value_of)).alias(f"q{i}") for i in range(len(probabilities))])
