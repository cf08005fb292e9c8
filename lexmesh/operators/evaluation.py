"""Evaluation of retrieval and answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmesh.functions import lexicon as L
from lexmesh.functions.text import content_tokens, degree_retrieval, degree_scoring
from lexmesh.operators.quantiles import exact_quantiles


def share(part: Column, whole: Column) -> Column:
    """Guarded ratio: an empty denominator gives 0."""
    return F.round(F.when(whole > 0, part / whole).otherwise(0.0), 6)


def retrieval_hits(expected: DataFrame, pool: DataFrame) -> DataFrame:
    """(query_id, hit, norm_hit): an expected article of null asks for the norm only; no expected norm never hits."""
    met = expected.join(
        pool.select("query_id", F.col("id_norma").alias("expected_norma"), degree_retrieval(F.col("numero")).alias("n")),
        ["query_id", "expected_norma"])
    wanted = F.col("expected_articulo")
    seen = met.groupBy("query_id").agg(
        F.lit(True).alias("norm_hit"), F.bool_or(wanted.isNull() | (degree_retrieval(wanted) == F.col("n"))).alias("hit"))
    return expected.select("query_id").join(seen, "query_id", "left").select(
        "query_id", F.coalesce("hit", F.lit(False)).alias("hit"), F.coalesce("norm_hit", F.lit(False)).alias("norm_hit"))


def definition_recall(answer: Column, definition: Column) -> Column:
    """Share of the definition's content words present in the answer; no words, no recall."""
    wanted = content_tokens(definition)
    held = F.size(F.array_intersect(wanted, content_tokens(answer)))
    return F.when(F.size(wanted) > 0, held / F.size(wanted)).otherwise(0.0)


def cites_expected(citations: Column, norm: Column, article: Column) -> Column:
    """Exact pair among the citations."""
    target = degree_scoring(article)
    return norm.isNotNull() & F.exists(citations, lambda c: (c["norma"] == norm) & (degree_scoring(c["articulo"]) == target))


def rollup(rows: DataFrame) -> DataFrame:
    """One row of rates with guarded denominators.

    rows: expected_norma, hit, norm_hit, generated, grounded, refused. All
    negatives count in their denominator, even those without an answer.
    """
    count = lambda c: F.sum(F.coalesce(c, F.lit(False)).cast("bigint"))
    positive, negative = F.col("expected_norma").isNotNull(), F.col("expected_norma").isNull()
    done = F.col("generated")
    totals = rows.agg(
        F.count(F.lit(1)).alias("n_queries"), count(positive).alias("n_positive"), count(negative).alias("n_negative"),
        count(done).alias("n_with_generation"), count(positive & F.col("hit")).alias("full"), count(positive & F.col("norm_hit")).alias("norm"),
        count(done & F.col("grounded")).alias("grounded"), count(done & ~F.col("refused")).alias("answered"),
        count(done & negative & F.col("refused")).alias("negative_ok"))
    c = F.col
    return totals.select(
        "n_queries", "n_positive", "n_negative", "n_with_generation",
        share(c("full"), c("n_positive")).alias("recall_at_k"), share(c("norm"), c("n_positive")).alias("recall_norma"),
        share(c("grounded"), c("n_with_generation")).alias("grounding_pass"), share(c("answered"), c("n_with_generation")).alias("answered"),
        share(c("negative_ok"), c("n_negative")).alias("negative_correct"))


def latency_percentiles(rows: DataFrame, value: str) -> DataFrame:
    """p50, p95, p99 cut to whole milliseconds; no rows give zeros."""
    found = exact_quantiles(rows, [], value, [0.5, 0.95, 0.99])
    return found.agg(*[F.coalesce(F.floor(F.max(f"q{i}")), F.lit(0)).alias(f"p{p}") for i, p in enumerate((50, 95, 99))])


def definition_report(rows: DataFrame) -> DataFrame:
    """Mean, median and threshold shares of definition recall, and strict correctness. rows: recall, cited."""
    median = exact_quantiles(rows, [], "recall", [0.5])
    means = rows.agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("recall"), 3).alias("recall_mean"),
        F.round(100 * F.avg((F.col("recall") >= L.STRICT_RECALL).cast("int")), 1).alias("recall_ge_strict"),
        F.round(100 * F.avg((F.col("recall") >= 0.8).cast("int")), 1).alias("recall_ge_80"),
        F.round(100 * F.avg((F.col("cited") & (F.col("recall") >= L.STRICT_RECALL)).cast("int")), 1).alias("strict_correct"))
    return means.withColumn("recall_median", median.select(F.round("q0", 3)).scalar())


def budget(docs: DataFrame, limit: int = L.PROMPT_BUDGET) -> DataFrame:
    """Ranked documents whose joined prompt fits; the first always stays.

    Lengths are never negative, so stopping at the first overflow is the same
    as keeping every row whose running total fits.
    """
    order = Window.partitionBy("query_id").orderBy("rank")
    # Every piece has at least its 12 fixed characters, so no piece past this place can fit, whatever gaps the ranks have.
    placed = docs.withColumn("lugar", F.row_number().over(order)).where(F.col("lugar") <= limit // 12 + 1)
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    piece = F.length(F.concat(F.lit("[Art. "), blank("numero"), F.lit(" de "), blank("id_norma"), F.lit("]\n"), blank("texto")))
    priced = placed.withColumn("costo", piece + F.when(F.col("lugar") > 1, L.PROMPT_SEPARATOR).otherwise(0))
    total = F.sum("costo").over(Window.partitionBy("query_id").orderBy("lugar").rowsBetween(Window.unboundedPreceding, 0))
    return priced.withColumn("total", total).where((F.col("total") <= limit) | (F.col("lugar") == 1)).drop("costo", "lugar")


def compare_runs(base: DataFrame, treatment: DataFrame) -> DataFrame:
    """A/B over common questions. Both: query, category, cited, recall, refused; a repeated query keeps its last row."""
    keep = lambda df, p: df.groupBy("query").agg(F.max_by(
        F.struct("category", "cited", "recall", "refused"), "pos").alias(p))
    both = keep(base, "b").join(keep(treatment, "t"), "query")
    inside = F.col("t.category") == "in_domain"
    outside = F.col("t.category") == "off_corpus"
    count = lambda c: F.sum(F.coalesce(c, F.lit(False)).cast("bigint"))
    return both.agg(
        count(inside).alias("in_domain"), count(inside & F.col("b.cited")).alias("cited_base"), count(inside & F.col("t.cited")).alias("cited_treatment"),
        count(inside & F.col("t.cited") & ~F.col("b.cited")).alias("recovered"), count(inside & F.col("b.cited") & ~F.col("t.cited")).alias("regressed"),
        F.round(F.avg(F.when(inside, F.col("b.recall"))), 6).alias("recall_base"), F.round(F.avg(F.when(inside, F.col("t.recall"))), 6).alias("recall_treatment"),
        count(outside & F.col("b.refused")).alias("refusal_base"), count(outside & F.col("t.refused")).alias("refusal_treatment"))
