"""Lexical ranking for a batch of questions over postings.

All questions are answered in one plan. Texts are read once, to build the postings or not at all if an
index is given. Postings of the questions' terms are spread by document, so adding up scores and
the first cut to ``k`` per question happen inside one task without moving
(question, document) pairs; a frequent word never becomes a shuffle key of the scoring step.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmesh.operators.fusion import top_k
from lexmesh.operators.postings import TASK_PAIRS, Index
from lexmesh.operators.spans import occurrences
from lexmesh.session import dealt, written

# Parameters of the Okapi formula.
K1, B, EPSILON = 1.5, 0.75, 0.25


def question_terms(questions: DataFrame) -> DataFrame:
    """(query_id, term, qtf) from (query_id, tokens)."""
    return (
        questions.select("query_id", F.explode("tokens").alias("term"))
        .groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("qtf"))
    )


def weighted_terms(index: Index, questions: DataFrame) -> DataFrame:
    """(query_id, term, weight, average_length), written once so that its size is known to the planner.

    A negative idf (a term in more than half of the documents) is replaced by a
    quarter of the mean idf of the vocabulary.
    """
    stats = written(index.frequencies())
    size, total = index.totals()
    terms = stats.select("term", (F.log(size - F.col("n") + 0.5) - F.log(F.col("n") + 0.5)).alias("raw"))
    mean = terms.agg(F.avg("raw")).scalar()
    idf = F.when(F.col("raw") < 0, EPSILON * mean).otherwise(F.col("raw"))
    weighted = question_terms(questions).join(terms, "term").select(
        "query_id", "term", (F.col("qtf") * idf).alias("weight"), (F.lit(total) / F.greatest(F.lit(size), F.lit(1))).alias("average_length"))
    return written(weighted)


def bm25_scores(documents: DataFrame | Index, questions: DataFrame, match_all: bool = False) -> DataFrame:
    """(query_id, doc_id, score) for every document that holds a question term.

    documents (doc_id, text) or their index, questions (query_id, tokens). ``match_all`` keeps
    only documents that hold every distinct term of the question.
    """
    index = Index.of(documents)
    weights = weighted_terms(index, questions)
    found = index.holding(weights, "tf")
    tf, dl = F.col("tf"), F.col("dl")
    part = F.col("weight") * tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / F.col("average_length")))
    scored = (
        found.join(weights, "term")
        .select("query_id", "doc_id", part.alias("part"))
        .groupBy("doc_id", "query_id")
        .agg(F.round(F.sum("part"), 6).alias("score"), F.count(F.lit(1)).alias("matched"))
    )
    if not match_all:
        return scored.select("query_id", "doc_id", "score")
    # A term that no document holds makes the question unanswerable, so it counts too.
    needed = question_terms(questions).groupBy("query_id").agg(F.count(F.lit(1)).alias("needed"))
    return (
        scored.join(needed, "query_id").where(F.col("matched") == F.col("needed"))
        .select("query_id", "doc_id", "score")
    )


def bm25_topk(documents: DataFrame | Index, questions: DataFrame, k: int, match_all: bool = False) -> DataFrame:
    """(query_id, doc_id, score, rank): best ``k`` first, cut before the positive-score filter."""
    best = top_k(bm25_scores(documents, questions, match_all), k, "doc_id")
    return best.where(F.col("score") > 0)


def substring_hits(documents: DataFrame, questions: DataFrame, text: str = "text") -> DataFrame:
    """(query_id, token, doc_id, tf) where a question token occurs inside the text, words or not; both in lower case.

    ``questions`` holds (query_id, tokens), one row per question. Every text is walked once for all
    tokens; hits alone are joined to their questions, and occurrences that overlap an earlier one don't count.
    Hits are dealt by document first, over tasks that follow the pairs there may be, so that scores add up where they are.
    """
    pairs = written(questions.select("query_id", F.explode("tokens").alias("token")))
    hits = occurrences(documents, pairs.select(F.col("token").alias("form")), ["doc_id"], text, borders=None, margin=None)
    found = hits.select("doc_id", F.col("form").alias("token"), F.col("n").alias("tf"))
    return dealt(found, "doc_id", documents.count() * pairs.select("query_id").distinct().count(), TASK_PAIRS).join(pairs, "token")


def saturated_scores(hits: DataFrame) -> DataFrame:
    """Saturating term frequency, no idf and no length norm."""
    tf = F.col("tf")
    return hits.groupBy("doc_id", "query_id").agg(F.round(F.sum(tf * 2.2 / (tf + 1.2)), 6).alias("score"))


def sparse_scores(hits: DataFrame) -> DataFrame:
    """Longer tokens weigh more: a tenth of their length per hit."""
    return hits.groupBy("doc_id", "query_id").agg(F.round(F.sum(F.length("token") / 10), 6).alias("score"))


def cover_density(documents: DataFrame | Index, questions: DataFrame, k: int) -> DataFrame:
    """Cover-density ranking of documents that hold all terms of a question.

    A cover is a shortest window holding every term; each adds the inverse of
    its number of excess positions plus one. For each occurrence the window that ends
    there reaches back to the least of the latest positions of the terms; it
    is a cover when no later start gives a window with the same end, that is,
    when the start differs from the one of the previous occurrence. All of it
    is window arithmetic inside one (question, document) group, whose size is
    bounded by the length of one document.
    """
    terms = question_terms(questions).select("query_id", "term")
    needed = terms.groupBy("query_id").agg(F.count(F.lit(1)).alias("needed"))
    spread = Index.of(documents).holding(terms, "positions")
    # Which documents hold all terms is counted first; positions are gathered for those alone.
    complete = (
        spread.select("doc_id", "term").join(terms, "term").groupBy("doc_id", "query_id").agg(F.count(F.lit(1)).alias("held"))
        .join(needed, "query_id").where(F.col("held") == F.col("needed")).select("doc_id", "query_id", "needed")
    )
    held = (
        spread.join(complete, "doc_id").join(terms, ["query_id", "term"])
        .select("doc_id", "query_id", "needed", "term", F.explode("positions").alias("pos"))
        .groupBy("doc_id", "query_id", "needed").agg(F.sort_array(F.collect_list(F.struct("pos", "term"))).alias("hits"))
    )
    # Fold: keep the latest position per term; after each hit the window start is the least of them.
    empty = F.expr("named_struct('latest', cast(map() as map<string,int>), 'start', -1, 'total', cast(0 as double))")

    def step(state: Column, hit: Column) -> Column:
        latest = F.map_concat(F.map_filter(state["latest"], lambda t, _p: t != hit["term"]),
                              F.create_map(hit["term"], hit["pos"]))
        start = F.array_min(F.map_values(latest))
        complete = (F.size(latest) == F.col("needed")) & (start > state["start"])
        excess = hit["pos"] - start - (F.col("needed") - 1)
        return F.struct(
            latest.alias("latest"),
            F.when(complete, start).otherwise(state["start"]).alias("start"),
            (state["total"] + F.when(complete, 1.0 / (F.greatest(excess, F.lit(0)) + 1)).otherwise(0.0)).alias("total"),
        )

    scored = held.select(
        "query_id", "doc_id", F.round(F.aggregate("hits", empty, step)["total"], 6).alias("score"))
    return top_k(scored, k, "doc_id")
