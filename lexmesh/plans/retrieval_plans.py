"""Queries that run whole retrieval plans over passages and documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexmesh.functions import text as T
from lexmesh.operators import dense, fusion, lexical, router, terms
from lexmesh.plans import retrieval
from lexmesh.plans.extract_plans import CONCEPT_REFS_SQL, _BENCH_TERMS, passage_terms
from lexmesh.plans.rank_plans import (HYBRID_SQL, _COS, _CUT, _LETTERS_SQL, dense_documents, documents, rrf_sql)
from lexmesh.plans.register import query
from lexmesh.plans.text_plans import normalize_sql, tokens_sql
from lexmesh.sources.tables import table, texts as rows


def questions(spark, d):
    """Passages with everything a ranking needs."""
    return table(spark, d, "benchmark", "item_id", "text").select(
        F.col("item_id").alias("query_id"), T.lexical_tokens(F.col("text")).alias("tokens"), dense.letter_vector(F.col("text")).alias("vec"), "text")


def fragments(spark, d):
    return rows(spark, d, "documents", "doc_id").select("doc_id", F.col("doc_id").alias("articulo_id"))


def articles(spark, d):
    return rows(spark, d, "documents", "doc_id", "source").select(F.col("doc_id").alias("articulo_id"), F.col("source").alias("id_norma"))


def document_links(spark, d):
    """Document -> concept links: a name in the text defines, an alias cites."""
    docs = rows(spark, d, "documents", "doc_id", "text", "lang")
    refs = terms.concepts_in(docs, passage_terms(spark, d), ["doc_id", "lang"])
    return refs.select(
        F.col("doc_id").alias("articulo_id"), "concepto_id", F.when(F.col("by_alias"), "cita").otherwise("define_termino").alias("kind"),
        (F.col("doc_id") % 30 + 1990).alias("anio"), (F.col("lang") == "es").alias("base"))


def asked_concepts(spark, d):
    """Concepts of each passage; every second passage counts as an alias question."""
    q = table(spark, d, "benchmark", F.col("item_id").alias("query_id"), "text")
    hits = terms.concepts_in(q, passage_terms(spark, d), ["query_id"])
    return hits.select("query_id", "concepto_id", (F.col("by_alias") | (F.col("query_id") % 2 == 0)).alias("by_alias"))


_QHAY = f"trim(regexp_replace({normalize_sql('text')}, '[^\\p{{L}}\\p{{N}}_]+', ' ', 'g'))"
_FINISH_SQL = f"""{CONCEPT_REFS_SQL}, qhay as (select item_id as query_id, {normalize_sql('text')} as form, ' ' || {_QHAY} || ' ' as h from benchmark),
 qasks as (select query_id, concepto_id, not (contains(h, ' ' || nf || ' ') and regexp_matches(form, '(^|[^\\p{{L}}\\p{{N}}_])' || nf || '($|[^\\p{{L}}\\p{{N}}_])')) or query_id % 2 = 0 as by_alias from qhay, bt where (contains(h, ' ' || nf || ' ') and regexp_matches(form, '(^|[^\\p{{L}}\\p{{N}}_])' || nf || '($|[^\\p{{L}}\\p{{N}}_])')) or (contains(h, ' ' || af || ' ') and regexp_matches(form, '(^|[^\\p{{L}}\\p{{N}}_])' || af || '($|[^\\p{{L}}\\p{{N}}_])'))),
 lk as (select c.doc_id, concepto_id, case when by_alias then 'cita' else 'define_termino' end as kind, c.doc_id % 30 + 1990 as anio, lang = 'es' as base from crefs c join documents using (doc_id)),
 facts as (select p.query_id, p.doc_id, bool_or(kind = 'define_termino' and a.by_alias) as via, max(case when kind = 'define_termino' and a.by_alias then anio end) as anio, bool_or(kind = 'define_termino' and a.by_alias and base) as base, max(case when kind = 'cita' then 1.3 end) as fo
   from reranked p join lk using (doc_id) join qasks a on a.query_id = p.query_id and a.concepto_id = lk.concepto_id group by all),
 final as (select p.query_id, p.doc_id, round(cast(case when f.via is null then score when f.via then score + 10 + coalesce(least(greatest((anio - 1935) / 90.0, 0), 1) * 0.9, 0) + case when base then 0.3 else 0 end else score * coalesce(fo, 1) end as double), 6) as score from reranked p left join facts f on f.query_id = p.query_id and f.doc_id = p.doc_id)
 select query_id, doc_id as articulo_id, source as id_norma, score, row_number() over (partition by query_id order by score desc, doc_id) as rank from final join documents using (doc_id) qualify rank <= {{k}}"""


def _shown(df):
    return df.select("query_id", "articulo_id", "id_norma", "score", F.col("rank").cast("bigint").alias("rank"))


@query("simple_retrieval", f"with {HYBRID_SQL}, reranked as (select query_id, doc_id, cast(1.0 as double) / rank as score from fused where rank <= 10), {_FINISH_SQL.replace('{k}', '5')}")
def _(spark, d):
    """Q21, Q18, Q19: the simple branch end to end"""
    return _shown(retrieval.simple(
        documents(spark, d), dense_documents(spark, d), questions(spark, d), fragments(spark, d), document_links(spark, d),
        asked_concepts(spark, d), articles(spark, d)))


_VARIANT_SQL = "vtext as (select item_id * 10 as query_id, item_id as parent, 0 as variant, text from benchmark union all select item_id * 10 + 1, item_id, 1, split_part(text, '.', 1) from benchmark union all select item_id * 10 + 2, item_id, 2, split_part(text, ' ', 1) || ' ' || split_part(text, ' ', 2) from benchmark)"


def _bm25_variants() -> str:
    from lexmesh.plans.rank_plans import bm25_sql
    return bm25_sql("all_tokens").replace(f"select item_id as query_id, {tokens_sql('text')} as all_tokens from benchmark", f"select query_id, {tokens_sql('text')} as all_tokens from vtext")


_COMPLEX_SQL = (f"{_VARIANT_SQL}, {_bm25_variants()}, dvec as (select doc_id, {_LETTERS_SQL('text')} as v from documents), qvec as (select query_id, {_LETTERS_SQL('text')} as q from vtext), "
                f"dense as (select query_id, doc_id, {_COS.format(a='v', b='q')} as score from dvec, qvec), {_CUT.format(n='scored', k=50)}, {_CUT.format(n='dense', k=50)}, lex as (select * from scored_r where score > 0), "
                f"per as ({rrf_sql(['lex', 'dense_r'])}), fusedv as (select v.parent as query_id, p.doc_id, round(sum(1.0 / (60 + rank)), 9) as score, min(v.variant * 1000000 + rank) as seen from per p join vtext v using (query_id) where rank <= 50 group by all), "
                "fused as (select query_id, doc_id, row_number() over (partition by query_id order by score desc, seen, doc_id) as rank from fusedv)")


def variants(spark, d):
    """Each passage with two reformulations: its first sentence and its first two words."""
    forms = F.array(
        F.struct(F.lit(0).alias("variant"), F.col("text").alias("form")),
        F.struct(F.lit(1).alias("variant"), F.split_part("text", F.lit("."), F.lit(1)).alias("form")),
        F.struct(F.lit(2).alias("variant"), F.concat_ws(" ", F.split_part("text", F.lit(" "), F.lit(1)), F.split_part("text", F.lit(" "), F.lit(2))).alias("form")))
    listed = table(spark, d, "benchmark", "item_id", "text").select(F.col("item_id").alias("query_id"), F.explode(forms).alias("f")).select("query_id", "f.*")
    return listed.select("query_id", "variant", T.lexical_tokens(F.col("form")).alias("tokens"), dense.letter_vector(F.col("form")).alias("vec"), F.col("form").alias("text"))


@query("complex_retrieval", f"with {_COMPLEX_SQL}, reranked as (select query_id, doc_id, cast(1.0 as double) / rank as score from fused where rank <= 15), {_FINISH_SQL.replace('{k}', '10')}")
def _(spark, d):
    """Q22: every variant ranked, rankings fused, then boost and expansion"""
    return _shown(retrieval.complex_(
        documents(spark, d), dense_documents(spark, d), variants(spark, d), fragments(spark, d), document_links(spark, d),
        asked_concepts(spark, d), articles(spark, d)))


@query("routed_questions")
def _(spark, d):
    """Q23: user turns routed by the default classifier"""
    q = table(spark, d, "conversations").where(F.col("role") == "user").select((F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"), "text")
    return router.route(q, router.default_router(spark)).groupBy("branch").agg(F.count(F.lit(1)).alias("n"))
