"""Whole retrieval plans composed of the operators; every plan answers a batch of questions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexmesh.functions import classify, lexicon as L
from lexmesh.operators import boosting, dense, fusion, lexical
from lexmesh.session import written


# Reasons for a norm to be in a report, in their order, by the class of the norm that defines; then what refers to it.
REASONS = {"reglamento_base": ("define concepto", 0), "fija_valores": ("aplica concepto", 1), "modifica": ("modifica definición", 3)}
MENTIONS, REFERS = ("menciona concepto", 2), ("referencia a definitoria", 4)
INJECTED = 5  # articles of a missing norm


def injected(pool: DataFrame, boosts: DataFrame, articles: DataFrame, threshold: float, most: int = INJECTED) -> DataFrame:
    """(query_id, id_norma, numero, score): the first articles, in corpus order, of norms that define what is asked and have none in the pool.

    ``articles`` (id_norma, numero, place, score) carries what the re-ranker gives each; the threshold holds for them too.
    """
    defining = boosts.where(F.col("boost") >= L.DEFINER_BOOST).select("query_id", F.col("norm").alias("id_norma"))
    missing = defining.join(pool.select("query_id", "id_norma").distinct(), ["query_id", "id_norma"], "left_anti")
    order = Window.partitionBy("id_norma").orderBy("place", "numero")
    first = articles.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= most)
    return missing.join(first, "id_norma").where(F.col("score") > threshold).select("query_id", "id_norma", "numero", "score")


def compliance(scored: DataFrame, boosts: DataFrame, articles: DataFrame, classes: DataFrame, pool: int, threshold: float = L.COMPLIANCE_THRESHOLD) -> DataFrame:
    """Report per question: norms by reason and best score, their articles in order, and totals.

    scored (query_id, id_norma, numero, score), boosts (query_id, norm, boost), articles as for ``injected``, classes (id_norma, clase).
    When any norm of a question is boosted, only boosted norms stay.
    """
    kept = fusion.above_then_top(
        scored.withColumn("clave", F.struct("id_norma", "numero")), threshold, pool, "clave").drop("clave", "rank")
    whole = kept.select("query_id", "id_norma", "numero", "score").unionByName(injected(kept, boosts, articles, threshold))
    lifted = whole.join(boosts.withColumnRenamed("norm", "id_norma"), ["query_id", "id_norma"], "left").withColumn(
        "boost", F.coalesce("boost", F.lit(1.0))).withColumn("alzado", F.round(F.col("score") * F.col("boost"), 3))
    # A norm has at most the pool and the injected articles.
    listed = F.array_sort(F.collect_list(F.struct((-F.col("alzado")).alias("s"), F.col("numero").alias("n"))))
    per_norm = lifted.groupBy("query_id", "id_norma").agg(
        F.max("alzado").alias("mejor"), F.count(F.lit(1)).alias("articulos"), F.max("boost").alias("boost"), F.transform(listed, lambda x: x["n"]).alias("lista")
    ).join(classes.select("id_norma", "clase"), "id_norma", "left")
    per_query = Window.partitionBy("query_id")  # bounded by the pool
    pick = lambda i: F.when(F.col("boost") <= 1, F.lit(("", 5)[i])).when(F.col("boost") < L.DEFINER_BOOST, F.lit(REFERS[i]))
    reason, priority = pick(0), pick(1)
    for name, (said, place) in REASONS.items():
        reason, priority = reason.when(F.col("clase") == name, said), priority.when(F.col("clase") == name, place)
    reason, priority = reason.otherwise(MENTIONS[0]), priority.otherwise(MENTIONS[1])
    shown = per_norm.withColumn("top", F.max("boost").over(per_query)).where((F.col("top") <= 1) | (F.col("boost") > 1))
    order = per_query.orderBy(priority, F.desc("mejor"), F.asc("id_norma"))
    return shown.select("query_id", "id_norma", "mejor", "articulos", F.round("boost", 1).alias("boost"), reason.alias("razon"), "lista",
                        F.row_number().over(order).cast("bigint").alias("orden"), F.sum("articulos").over(per_query).alias("total_articulos"),
                        F.count(F.lit(1)).over(per_query).alias("total_normas"))


def ranked_variants(documents: DataFrame, vectors: DataFrame, variants: DataFrame, weighted: bool) -> DataFrame:
    """Lexical and dense pools fused per question variant.

    documents (doc_id, text), vectors (id, vec), variants (query_id, tokens, vec, text).
    """
    left = lexical.bm25_topk(documents, variants.select("query_id", "tokens"), L.LEXICAL_POOL)
    right = dense.dense_topk(vectors, variants.select("query_id", "vec"), L.DENSE_POOL).withColumnRenamed("id", "doc_id")
    if not weighted:
        return fusion.rrf([left, right], "doc_id").where(F.col("rank") <= L.LEXICAL_POOL)
    wl, wd = classify.length_weights(F.col("text"))
    weights = variants.select("query_id", wl.alias("wl"), wd.alias("wd"))
    return fusion.rrf(
        [left.join(weights, "query_id"), right.join(weights, "query_id")], "doc_id", [F.col("wl"), F.col("wd")]
    ).where(F.col("rank") <= L.LEXICAL_POOL)


def finish(ranking: DataFrame, fragments: DataFrame, links: DataFrame, asked: DataFrame, articles: DataFrame,
           rerank: int, k: int, reranker: Callable[[DataFrame, int], DataFrame] = fusion.identity_rerank) -> DataFrame:
    """Re-rank, boost by the graph, expand to articles and cut.

    ranking (query_id, doc_id, rank); fragments (doc_id, articulo_id).
    """
    pool = reranker(ranking, rerank).join(fragments, "doc_id").select("query_id", "articulo_id", "doc_id", "score", "rank")
    by_article = pool.groupBy("query_id", "articulo_id").agg(
        F.max_by(F.struct("doc_id", "score", "rank"), F.struct(F.col("score"), -F.col("rank"))).alias("b")).select(
        "query_id", "articulo_id", "b.*")
    lifted = boosting.graph_boost(by_article.select("query_id", "articulo_id", "score"), links, asked)
    named = lifted.join(by_article.drop("score"), ["query_id", "articulo_id"])
    full = boosting.expand_to_articles(named.withColumnRenamed("doc_id", "fragmento_id"), articles)
    return fusion.top_k(full, k, "articulo_id")


def simple(documents, vectors, questions, fragments, links, asked, articles, k: int = L.SIMPLE_TOP_K) -> DataFrame:
    """Weighted fusion of one lexical and one dense pool, then the common finish."""
    ranking = ranked_variants(documents, vectors, questions, weighted=True)
    return finish(ranking, fragments, links, asked, articles, L.SIMPLE_RERANK, k)


def complex_(documents, vectors, variants, fragments, links, asked, articles, k: int = L.COMPLEX_TOP_K) -> DataFrame:
    """Every variant of a question is ranked on its own, then the variant rankings are fused.

    variants carry (query_id, variant, tokens, vec, text); the expansions come
    from a pluggable generator and are plain input columns here.
    """
    keyed = variants.withColumn("parent", F.col("query_id")).withColumn("query_id", F.col("query_id") * 10 + F.col("variant"))
    per_variant = ranked_variants(documents, vectors, keyed, weighted=False)
    parents = keyed.select("query_id", "parent", "variant")
    listed = per_variant.join(parents, "query_id")
    fused = listed.groupBy(F.col("parent").alias("query_id"), "doc_id").agg(
        F.round(F.sum(1.0 / (L.RRF_K + F.col("rank"))), 9).alias("score"), F.min(F.struct("variant", "rank")).alias("seen"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("seen"), F.asc("doc_id"))
    ranking = fused.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= L.LEXICAL_POOL).drop("seen")
    return finish(ranking, fragments, links, asked, articles, L.COMPLEX_RERANK, k)


def sequential(keyword_scores: DataFrame, vectors: DataFrame, questions: DataFrame, k: int, threshold: float = 0.1) -> DataFrame:
    """Keyword prefilter, then order by cosine; a question without candidates searches all vectors.

    keyword_scores (query_id, doc_id, score), vectors (doc_id, vec), questions (query_id, qvec).
    """
    kept = keyword_scores.where(F.col("score") > threshold).select("query_id", "doc_id")
    near = kept.join(vectors, "doc_id").join(questions, "query_id").select(
        "query_id", "doc_id", F.round(dense.cosine(F.col("vec"), F.col("qvec")), 6).alias("score"))
    empty = questions.join(kept.select("query_id").distinct(), "query_id", "left_anti").withColumnRenamed("qvec", "vec")
    full = dense.dense_topk(vectors.withColumnRenamed("doc_id", "id"), empty, k)
    return fusion.top_k(near, k, "doc_id").unionByName(full.withColumnRenamed("id", "doc_id"))


def by_strategy(routed: DataFrame, keyword_scores: DataFrame, vectors: DataFrame, k: int, alpha: float = 0.3) -> DataFrame:
    """Each question takes its own route: keywords only, vectors only, or both blended.

    routed (query_id, qvec, route). The blend is taken over the documents that
    hold a keyword, with vector scores for those documents only.
    """
    pick = lambda name: routed.where(F.col("route") == name)
    words = fusion.top_k(keyword_scores.join(pick("keywords").select("query_id"), "query_id", "left_semi"), k, "doc_id")
    near = dense.dense_topk(vectors.withColumnRenamed("doc_id", "id"), pick("embeddings").withColumnRenamed("qvec", "vec"), k)
    # Lengths are worked out once for each vector, not for each pair; pairs are written, since bounds and blend read them.
    sized = lambda df, vec: df.withColumn(f"{vec}_length", F.sqrt(dense.dot(F.col(vec), F.col(vec))))
    pairs = keyword_scores.join(sized(pick("hybrid").select("query_id", "qvec"), "qvec"), "query_id").join(sized(vectors, "vec"), "doc_id")
    length = F.col("vec_length") * F.col("qvec_length")
    cosine = F.when(length == 0, 0.0).otherwise(dense.dot(F.col("vec"), F.col("qvec")) / length)
    both = written(pairs.select("query_id", "doc_id", F.col("score").alias("kw"), F.round(cosine, 6).alias("emb")))
    blended = fusion.top_k(fusion.linear_fusion(both, alpha).select("query_id", "doc_id", "score"), k, "doc_id")
    out = words.withColumn("route", F.lit("keywords")).unionByName(
        near.withColumnRenamed("id", "doc_id").withColumn("route", F.lit("embeddings")))
    return out.unionByName(blended.withColumn("route", F.lit("hybrid")))
