"""Rank assignment, fusion and re-ranking of candidate lists.

Candidate lists hold (query_id, <id>, score). Ties are always broken by id so
that results do not depend on how rows are spread.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmesh.functions import lexicon as L


def ranked(candidates: DataFrame, key: str, score: str = "score", name: str = "rank") -> DataFrame:
    """Add a rank from 1 within each question."""
    order = Window.partitionBy("query_id").orderBy(F.desc(score), F.asc(key))
    return candidates.withColumn(name, F.row_number().over(order))


def top_k(candidates: DataFrame, k: int, key: str, score: str = "score") -> DataFrame:
    """Best ``k`` per question; the rank filter is cut per task before the shuffle."""
    return ranked(candidates, key, score).where(F.col("rank") <= k)


def above_then_top(candidates: DataFrame, threshold: float, k: int, key: str) -> DataFrame:
    """Threshold first, then truncation."""
    return top_k(candidates.where(F.col("score") > threshold), k, key)


def rrf(rankings: Sequence[DataFrame], key: str, weights: Sequence[Column | float] | None = None,
        k: int = L.RRF_K) -> DataFrame:
    """Reciprocal rank fusion of (query_id, key, rank) lists.

    Score ties keep first-seen order: earlier list first, then better rank.
    A weight may be a number or a column of its list.
    """
    weights = weights or [1.0] * len(rankings)
    parts = None
    for place, (ranking, weight) in enumerate(zip(rankings, weights)):
        weight = weight if isinstance(weight, Column) else F.lit(float(weight))
        part = ranking.select(
            "query_id", key, (weight / (k + F.col("rank"))).alias("part"),
            F.lit(place).alias("place"), F.col("rank").alias("place_rank"))
        parts = part if parts is None else parts.unionByName(part)
    fused = parts.groupBy("query_id", key).agg(
        F.round(F.sum("part"), 9).alias("score"),
        F.min(F.struct("place", "place_rank")).alias("seen"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("seen"), F.asc(key))
    return fused.withColumn("rank", F.row_number().over(order)).drop("seen")


def min_max(candidates: DataFrame, score: str) -> DataFrame:
    """Scale a score to [0, 1] per question; a constant list becomes all zeros.

    The bounds come from a mergeable aggregate joined back, not from a window
    that would gather a whole question's candidates in one task.
    """
    bounds = candidates.groupBy("query_id").agg(F.min(score).alias("lo"), F.max(score).alias("hi"))
    span = F.col("hi") - F.col("lo")
    scaled = F.when(span == 0, 0.0).otherwise((F.col(score) - F.col("lo")) / span)
    return candidates.join(bounds, "query_id").withColumn(score, scaled).drop("lo", "hi")


def linear_fusion(pairs: DataFrame, alpha: float = 0.3) -> DataFrame:
    """alpha * keyword + (1 - alpha) * dense after min-max on (query_id, id, kw, emb)."""
    bounds = pairs.groupBy("query_id").agg(
        F.min("kw").alias("kw_lo"), F.max("kw").alias("kw_hi"), F.min("emb").alias("emb_lo"), F.max("emb").alias("emb_hi"))

    def scaled(name: str) -> Column:
        span = F.col(f"{name}_hi") - F.col(f"{name}_lo")
        return F.when(span == 0, 0.0).otherwise((F.col(name) - F.col(f"{name}_lo")) / span)

    score = F.round(alpha * scaled("kw") + (1 - alpha) * scaled("emb"), 6)
    return pairs.join(bounds, "query_id").withColumn("score", score).drop("kw_lo", "kw_hi", "emb_lo", "emb_hi")


def identity_rerank(ranking: DataFrame, k: int) -> DataFrame:
    """Keep the order; the score becomes one over the rank."""
    return ranking.where(F.col("rank") <= k).withColumn("score", 1.0 / F.col("rank"))


def overlap_rerank(candidates: DataFrame, question: Column, title: Column) -> DataFrame:
    """Blend 0.6 of the old score with 0.4 of the share of question tokens in the title."""
    asked = F.array_distinct(F.split(F.trim(F.lower(question)), r"\s+"))
    held = F.array_distinct(F.split(F.trim(F.lower(title)), r"\s+"))
    share = F.size(F.array_intersect(asked, held)) / F.greatest(F.size(asked), F.lit(1))
    return candidates.withColumn("score", F.round(0.6 * F.col("score") + 0.4 * share, 6))


def expert_score(score: Column, critical: Column, company_match: Column, frequency: Column, rare: Column) -> Column:
    """Expert rules in order: factors for critical or matching norms, usage bonus, penalty."""
    lifted = score * F.when(critical, 1.3).otherwise(1.0) * F.when(company_match, 1.3).otherwise(1.0)
    used = lifted + F.when(frequency > 100, F.least(frequency / 500, F.lit(0.2))).otherwise(0.0)
    return used * F.when(rare, 0.7).otherwise(1.0)


def keyword_score(words: Column, title: Column, theme_text: Column) -> Column:
    """1 per keyword in the title, 0.5 per keyword in the themes, over the number of keywords."""
    title, theme_text = F.lower(title), F.lower(theme_text)
    total = F.aggregate(
        words, F.lit(0.0),
        lambda acc, w: acc + F.when(F.contains(title, w), 1.0).otherwise(0.0)
        + F.when(F.contains(theme_text, w), 0.5).otherwise(0.0))
    return F.when(F.size(words) > 0, total / F.size(words)).otherwise(0.0)
