"""Queries over lexical, dense and fused rankings."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from lexmesh.functions import classify, text as T
from lexmesh.operators import dense, fusion, ivf, lexical, rerank
from lexmesh.plans.register import query
from lexmesh.plans.text_plans import THEMES_SQL, keywords_sql, tokens_sql
from lexmesh.plans.views import norms, norms_sql
from lexmesh.session import written
from lexmesh.sources.tables import table, texts


def documents(spark, d):
    return texts(spark, d, "documents", "doc_id", "text")


def passages(spark, d):
    """Benchmark passages as questions."""
    return table(spark, d, "benchmark", "item_id", "text").select(
        F.col("item_id").alias("query_id"), T.lexical_tokens(F.col("text")).alias("tokens"))


def bm25_sql(tokens: str = "q_tokens", match_all: bool = False) -> str:
    """CTEs ending in `scored(query_id, doc_id, score)`."""
    need = "having count(*) = any_value(needed)" if match_all else ""
    return f"""docs as (select doc_id, {tokens_sql('text')} as tokens from documents),
 questions as (select item_id as query_id, {tokens_sql('text')} as all_tokens from benchmark),
 asked as (select query_id, term, count(*) as qtf from (select query_id, unnest({tokens}) as term from questions) group by all),
 wanted as (select query_id, count(*) as needed from asked group by query_id),
 words as (select doc_id, len(tokens) as dl, unnest(tokens) as term from docs),
 tfs as (select doc_id, dl, term, count(*) as tf from words group by all),
 raws as (select term, ln((select count(*) from docs) - count(*) + 0.5) - ln(count(*) + 0.5) as raw from tfs group by term),
 idfs as (select term, case when raw < 0 then 0.25 * (select avg(raw) from raws) else raw end as idf from raws),
 scored as (select a.query_id, t.doc_id, round(sum(a.qtf * i.idf * t.tf * 2.5 / (t.tf + 1.5 * (0.25 + 0.75 * t.dl / (select avg(len(tokens)) from docs)))), 6) as score
   from asked a join idfs i using (term) join tfs t using (term) join wanted w using (query_id) group by a.query_id, t.doc_id {need})"""


_TOP = "select query_id, doc_id, score, rank from (select *, row_number() over (partition by query_id order by score desc, doc_id) as rank from scored) where rank <= {k} and score > 0"


def _out(df, key="doc_id"):
    return df.select("query_id", key, "score", F.col("rank").cast("bigint").alias("rank"))


@query("bm25_topk", f"with {bm25_sql('all_tokens')} {_TOP.format(k=10)}")
def _(spark, d):
    """Q2, K2: whole passages against whole documents"""
    return _out(lexical.bm25_topk(documents(spark, d), passages(spark, d), 10))


@query("bm25_match_all", f"with {bm25_sql('all_tokens', True)} {_TOP.format(k=10)}")
def _(spark, d):
    """Q1: documents that hold all terms of a passage"""
    return _out(lexical.bm25_topk(documents(spark, d), passages(spark, d), 10, match_all=True))


@query("cover_density_topk")
def _(spark, d):
    """Q1: cover-density rank of documents that hold all terms"""
    return _out(lexical.cover_density(documents(spark, d), passages(spark, d), 10))


# Short questions about norms: what each priority announces, per year of its orders.
_ASK = ("case o_orderpriority when '1-URGENT' then 'modifica decreto ' when '2-HIGH' then 'aprueba reglamento ley ' "
        "when '3-MEDIUM' then 'fija tarifas y potencia ' when '4-NOT SPECIFIED' then 'deroga ley ' else 'complementa decreto ' end || cast(year(o_orderdate) as string)")
_ASK_ID = "cast(year(o_orderdate) * 10 + cast(substr(o_orderpriority, 1, 1) as int) as bigint)"
_QUESTIONS_SQL = f"(select distinct {_ASK_ID} as query_id, {_ASK} as pregunta from orders)"
_TITLES_SQL = ("(select cast(id as bigint) as doc_id, lower(titulo) as titulo, lower(array_to_string(temas, ' ')) as temas from "
               "(select n.id, n.titulo, t.temas from (" + norms_sql("id_norma", "titulo").replace(" as id_norma", " as id") + ") n join ("
               + THEMES_SQL.format(src=norms_sql("id_norma", text=True).replace(" as id_norma", " as id")) + ") t using (id)))")


def norm_questions(spark, d):
    return table(spark, d, "orders", "o_orderdate", "o_orderpriority").select(
        F.expr(_ASK_ID).alias("query_id"), F.expr(_ASK).alias("pregunta")).distinct()


def titles(spark, d):
    return norms(spark, d, "id_norma", "titulo", text=True).select(
        F.col("id_norma").cast("bigint").alias("doc_id"), F.lower("titulo").alias("titulo"),
        F.lower(F.array_join(T.themes(F.col("texto")), " ")).alias("temas"))


def _asked_tokens(spark, d):
    return norm_questions(spark, d).select("query_id", F.array_distinct(F.split("pregunta", " ")).alias("tokens"))


_HITS_SQL = (f"select query_id, doc_id, token, (length(body) - length(replace(body, token, ''))) // length(token) as tf from "
             f"(select query_id, unnest(list_distinct(string_split(pregunta, ' '))) as token from {_QUESTIONS_SQL}) q, "
             f"(select doc_id, {{body}} as body from {_TITLES_SQL}) t where contains(body, token)")
_LITE_SQL = f"lite as (select query_id, doc_id, round(sum(tf * 2.2 / (tf + 1.2)), 6) as score from ({_HITS_SQL.format(body=chr(116) + 'itulo || chr(32) || temas')}) group by all)"
_SPARSE_SQL = f"sparse as (select query_id, doc_id, round(sum(length(token) / 10), 6) as score from ({_HITS_SQL.format(body='titulo')}) group by all)"
_CUT = "{n}_r as (select *, row_number() over (partition by query_id order by score desc, doc_id) as rank from {n} qualify rank <= {k})"


def _lite(spark, d):
    t = titles(spark, d).select("doc_id", F.concat_ws(" ", "titulo", "temas").alias("text"))
    return lexical.saturated_scores(lexical.substring_hits(t, _asked_tokens(spark, d)))


def _sparse(spark, d):
    t = titles(spark, d).select("doc_id", F.col("titulo").alias("text"))
    return lexical.sparse_scores(lexical.substring_hits(t, _asked_tokens(spark, d)))


@query("title_saturation_topk", f"with {_LITE_SQL}, {_CUT.format(n='lite', k=100)} select query_id, doc_id, score, rank from lite_r")
def _(spark, d):
    """Q3, M3"""
    return _out(fusion.top_k(_lite(spark, d), 100, "doc_id"))


_RRF = ("select query_id, doc_id, round(sum(part), 9) as score, min(place * 1000000 + rank) as seen from ({parts}) group by query_id, doc_id")


def rrf_sql(names: list[str], weights: list[str] | None = None, key: str = "doc_id") -> str:
    weights = weights or ["1.0"] * len(names)
    parts = " union all ".join(
        f"select query_id, {key} as doc_id, {w} / (60 + rank) as part, {i} as place, rank from {n}" for i, (n, w) in enumerate(zip(names, weights)))
    return ("select query_id, doc_id, score, row_number() over (partition by query_id order by score desc, seen, doc_id) as rank from ("
            + _RRF.format(parts=parts) + ")")


@query("two_list_rrf_titles",
       f"with {_LITE_SQL}, {_SPARSE_SQL}, {_CUT.format(n='lite', k=100)}, {_CUT.format(n='sparse', k=100)}, fused as ({rrf_sql(['lite_r', 'sparse_r'])}) select * from fused where rank <= 10")
def _(spark, d):
    """Reciprocal rank fusion of lexical and sparse title rankings"""
    lists = [fusion.top_k(_lite(spark, d), 100, "doc_id"), fusion.top_k(_sparse(spark, d), 100, "doc_id")]
    return _out(fusion.rrf(lists, "doc_id").where(F.col("rank") <= 10))


_LETTERS_SQL = lambda e: "[" + ", ".join(f"cast(length(lower({e})) - length(replace(lower({e}), '{c}', '')) as double)" for c in dense.LETTERS) + "]"
_COS = ("round(case when sqrt(list_dot_product({a}, {a})) * sqrt(list_dot_product({b}, {b})) = 0 then 0 else "
        "list_dot_product({a}, {b}) / (sqrt(list_dot_product({a}, {a})) * sqrt(list_dot_product({b}, {b}))) end, 6)")
_DENSE_SQL = (f"dvec as (select doc_id, {_LETTERS_SQL('text')} as v from documents), qvec as (select item_id as query_id, {_LETTERS_SQL('text')} as q from benchmark), "
              f"dense as (select query_id, doc_id, {_COS.format(a='v', b='q')} as score from dvec, qvec)")


def dense_documents(spark, d):
    return texts(spark, d, "documents", "doc_id", "text").select(F.col("doc_id").alias("id"), dense.letter_vector(F.col("text")).alias("vec"))


def dense_passages(spark, d):
    return table(spark, d, "benchmark", "item_id", "text").select(F.col("item_id").alias("query_id"), dense.letter_vector(F.col("text")).alias("vec"))


@query("text_vector_topk", f"with {_DENSE_SQL}, {_CUT.format(n='dense', k=10)} select query_id, doc_id, score, rank from dense_r")
def _(spark, d):
    """Q4, Q6 with the default embedder"""
    best = dense.dense_topk(dense_documents(spark, d), dense_passages(spark, d), 10)
    return _out(best.withColumnRenamed("id", "doc_id"))


_WEIGHT = "(case when nw <= 3 then 0.65 when nw >= 7 then 0.35 else 0.5 end)"
_NW = "len(list_filter(regexp_split_to_array(trim(text), '[ \\n\\t\\r\\f\\v]+'), lambda w: length(w) > 3))"
HYBRID_SQL = (f"{bm25_sql('all_tokens')}, {_DENSE_SQL}, {_CUT.format(n='scored', k=50)}, {_CUT.format(n='dense', k=50)}, "
              f"nws as (select item_id as query_id, {_NW} as nw from benchmark), "
              "lex_w as (select query_id, doc_id, rank, case when nw <= 3 then 0.65 when nw >= 7 then 0.35 else 0.5 end as w from scored_r join nws using (query_id) where score > 0), "
              "den_w as (select query_id, doc_id, rank, case when nw <= 3 then 0.35 when nw >= 7 then 0.65 else 0.5 end as w from dense_r join nws using (query_id)), "
              f"fused as ({rrf_sql(['lex_w', 'den_w'], ['cast(w as double)', 'cast(w as double)'])})")


def hybrid(spark, d, k: int = 50):
    """Weighted fusion of 50 lexical and 50 dense candidates per passage."""
    lexical_w, dense_w = classify.length_weights(F.col("text"))
    weights = table(spark, d, "benchmark", "item_id", "text").select(
        F.col("item_id").alias("query_id"), lexical_w.alias("wl"), dense_w.alias("wd"))
    left = lexical.bm25_topk(documents(spark, d), passages(spark, d), 50).join(weights, "query_id")
    right = dense.dense_topk(dense_documents(spark, d), dense_passages(spark, d), 50).withColumnRenamed("id", "doc_id").join(weights, "query_id")
    return fusion.rrf([left, right], "doc_id", [F.col("wl"), F.col("wd")]).where(F.col("rank") <= k)


@query("bm25_fused_topk", f"with {HYBRID_SQL} select query_id, doc_id, score, rank from fused where rank <= 10")
def _(spark, d):
    """Q7, Q8, Q21: the flagship, lexical and dense candidates fused with length weights"""
    return _out(hybrid(spark, d, 10))


@query("identity_rerank", f"with {HYBRID_SQL} select query_id, doc_id, round(1.0 / rank, 6) as score, rank from fused where rank <= 10")
def _(spark, d):
    """Q16, K5"""
    kept = fusion.identity_rerank(hybrid(spark, d, 50), 10)
    return _out(kept.withColumn("score", F.round("score", 6)))


_PROTO = ("proto as (select label, list(m order by dim) as q from (select label, dim, avg(x) as m from (select label, cast(unnest(embedding) as double) as x, generate_subscripts(embedding, 1) as dim from embeddings) group by all) group by label), "
          f"near as (select label as query_id, vec_id, {_COS.format(a='v', b='q')} as score from proto, (select vec_id, cast(embedding as double[]) as v from embeddings))")


def vectors(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"), "label")


def prototypes(spark, d):
    return dense.centroids(vectors(spark, d), "label").select(F.col("label").cast("bigint").alias("query_id"), "vec")


@query("vector_topk", f"with {_PROTO} select query_id, vec_id, score, rank from (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from near) where rank <= 10")
def _(spark, d):
    """M1, Q4, Q5: nearest vectors of every label prototype, exact"""
    best = dense.dense_topk(vectors(spark, d), prototypes(spark, d), 10)
    return _out(best.withColumnRenamed("id", "vec_id"), "vec_id")


@query("vector_threshold_topk", f"with {_PROTO} select query_id, vec_id, score, rank from (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from near where score > 0.2) where rank <= 15")
def _(spark, d):
    """K6: threshold before truncation; the threshold only drops rows below the cut, so it may follow it"""
    best = dense.dense_topk(vectors(spark, d), prototypes(spark, d), 15).where(F.col("score") > 0.2)
    return _out(best.withColumnRenamed("id", "vec_id"), "vec_id")


@query("own_label_cosine", f"with {_PROTO} select vec_id, score from near join embeddings using (vec_id) where query_id = label")
def _(spark, d):
    """M1, Q32: every vector against the probe of its own group"""
    probe = dense.centroids(vectors(spark, d), "label").withColumnRenamed("vec", "probe")
    joined = vectors(spark, d).join(probe, "label")
    return joined.select(F.col("id").alias("vec_id"), F.round(dense.cosine(F.col("vec"), F.col("probe")), 6).alias("score"))


_KW_SQL = (f"kws as (select query_id, pregunta, {keywords_sql('pregunta')} as kw from {_QUESTIONS_SQL}), "
           f"kwscored as (select query_id, doc_id, titulo, pregunta, round(list_sum(list_transform(kw, lambda w: (case when contains(titulo, w) then 1.0 else 0.0 end) + (case when contains(temas, w) then 0.5 else 0.0 end))) / len(kw), 6) as score from kws, {_TITLES_SQL})")


def keyword_ranking(spark, d):
    """(query_id, doc_id, score) with score > 0, through substring hits instead of all pairs."""
    asked = norm_questions(spark, d).select("query_id", T.keywords(F.col("pregunta")).alias("tokens"))
    both = titles(spark, d)
    in_title = lexical.substring_hits(both.select("doc_id", F.col("titulo").alias("text")), asked).select("query_id", "doc_id", F.lit(1.0).alias("part"))
    in_theme = lexical.substring_hits(both.select("doc_id", F.col("temas").alias("text")), asked).select("query_id", "doc_id", F.lit(0.5).alias("part"))
    sizes = asked.select("query_id", F.size("tokens").alias("n"))
    total = in_title.unionByName(in_theme).groupBy("query_id", "doc_id").agg(F.sum("part").alias("total"))
    return total.join(sizes, "query_id").select("query_id", "doc_id", F.round(F.col("total") / F.col("n"), 6).alias("score"))


@query("keyword_topk", f"with {_KW_SQL}, {_CUT.format(n='kwscored', k=10)} select query_id, doc_id, score, rank from kwscored_r where score > 0")
def _(spark, d):
    """Q11, Q34"""
    return _out(fusion.top_k(keyword_ranking(spark, d), 10, "doc_id"))


@query("keyword_overlap_rerank",
       f"with {_KW_SQL}, {_CUT.format(n='kwscored', k=50)}, late as (select query_id, doc_id, round(0.6 * score + 0.4 * len(list_intersect(list_distinct(regexp_split_to_array(trim(pregunta), ' +')), list_distinct(regexp_split_to_array(trim(titulo), ' +')))) / greatest(len(list_distinct(regexp_split_to_array(trim(pregunta), ' +'))), 1), 6) as score from kwscored_r where score > 0) "
       "select query_id, doc_id, score, row_number() over (partition by query_id order by score desc, doc_id) as rank from late qualify rank <= 10")
def _(spark, d):
    """Q15, Q17: token-overlap re-rank of keyword candidates"""
    pool = fusion.top_k(keyword_ranking(spark, d), 50, "doc_id").drop("rank")
    named = pool.join(titles(spark, d).select("doc_id", "titulo"), "doc_id").join(norm_questions(spark, d), "query_id")
    late = fusion.overlap_rerank(named, F.col("pregunta"), F.col("titulo")).select("query_id", "doc_id", "score")
    return _out(fusion.top_k(late, 10, "doc_id"))


@query("expert_rerank",
       f"""with {_KW_SQL}, {_CUT.format(n='kwscored', k=50)}, usage as (select cast(o_orderkey as bigint) as doc_id, o_orderstatus, floor(o_totalprice / 1000) as freq from orders),
 lifted as (select query_id, doc_id, round(((score * (case when o_orderstatus = 'F' then 1.3 else 1.0 end)) + (case when freq > 100 then least(freq / 500, 0.2) else 0.0 end)) * (case when o_orderstatus = 'P' then 0.7 else 1.0 end), 6) as score from kwscored_r join usage using (doc_id) where score > 0)
 select query_id, doc_id, score, row_number() over (partition by query_id order by score desc, doc_id) as rank from lifted qualify rank <= 10""")
def _(spark, d):
    """Q13"""
    pool = fusion.top_k(keyword_ranking(spark, d), 50, "doc_id").drop("rank")
    usage = table(spark, d, "orders").select(
        F.col("o_orderkey").alias("doc_id"), "o_orderstatus", F.floor(F.col("o_totalprice") / 1000).alias("freq"))
    score = fusion.expert_score(F.col("score"), F.col("o_orderstatus") == "F", F.lit(False), F.col("freq"), F.col("o_orderstatus") == "P")
    lifted = pool.join(usage, "doc_id").select("query_id", "doc_id", F.round(score, 6).alias("score"))
    return _out(fusion.top_k(lifted, 10, "doc_id"))


@query("linear_fusion_topk",
       f"""with {bm25_sql('all_tokens')}, {_DENSE_SQL}, both_ as (select s.query_id, s.doc_id, s.score as kw, e.score as emb from scored s join dense e using (query_id, doc_id)),
 sp as (select *, max(kw) over (partition by query_id) - min(kw) over (partition by query_id) as kws, min(kw) over (partition by query_id) as kwl, max(emb) over (partition by query_id) - min(emb) over (partition by query_id) as es, min(emb) over (partition by query_id) as el from both_),
 lin as (select query_id, doc_id, round(0.3 * (case when kws = 0 then 0 else (kw - kwl) / kws end) + 0.7 * (case when es = 0 then 0 else (emb - el) / es end), 6) as score from sp)
 select query_id, doc_id, score, row_number() over (partition by query_id order by score desc, doc_id) as rank from lin qualify rank <= 10""")
def _(spark, d):
    """Q9, Q10, M2: lexical candidates, dense score of those candidates only, min-max and blend"""
    pool = lexical.bm25_scores(documents(spark, d), passages(spark, d)).withColumnRenamed("score", "kw")
    dv = dense_documents(spark, d).withColumnRenamed("id", "doc_id")
    qv = dense_passages(spark, d).withColumnRenamed("vec", "qvec")
    pairs = pool.join(dv, "doc_id").join(qv, "query_id")
    scored = pairs.select("query_id", "doc_id", "kw", F.round(dense.cosine(F.col("vec"), F.col("qvec")), 6).alias("emb"))
    return _out(fusion.top_k(fusion.linear_fusion(scored, 0.3), 10, "doc_id"))


# Questions whose wording sends them down different routes.
_ROUTED_SQL = ("(select query_id, case when query_id % 10 = 1 then pregunta || ' decreto 5' when query_id % 10 = 2 then 'potencia del coordinador y reglamento ley' || substr(pregunta, 1, 12) "
               f"else 'zzz ' || substr(pregunta, 1, 4) end as pregunta from {_QUESTIONS_SQL})")


def routed_questions(spark, d):
    q, n = F.col("pregunta"), F.col("query_id") % 10
    text = (F.when(n == 1, F.concat(q, F.lit(" decreto 5")))
            .when(n == 2, F.concat(F.lit("potencia del coordinador y reglamento ley"), F.substring(q, 1, 12)))
            .otherwise(F.concat(F.lit("zzz "), F.substring(q, 1, 4))))
    return norm_questions(spark, d).select("query_id", text.alias("pregunta"))


def title_vectors(spark, d, both=None):
    both = titles(spark, d) if both is None else both
    return both.select("doc_id", dense.letter_vector(F.col("titulo")).alias("vec"))


def _routed_keywords(spark, d, questions=None, both=None):
    """``questions`` (query_id, pregunta) and titles ``both`` may come written, if others read them too."""
    asked = (routed_questions(spark, d) if questions is None else questions).select("query_id", T.keywords(F.col("pregunta")).alias("tokens"))
    both = titles(spark, d) if both is None else both
    part = lambda c, w: lexical.substring_hits(both.select("doc_id", F.col(c).alias("text")), asked).select("query_id", "doc_id", F.lit(w).alias("part"))
    total = part("titulo", 1.0).unionByName(part("temas", 0.5)).groupBy("query_id", "doc_id").agg(F.sum("part").alias("total"))
    return total.join(asked.select("query_id", F.size("tokens").alias("n")), "query_id").select(
        "query_id", "doc_id", F.round(F.col("total") / F.col("n"), 6).alias("score"))


_RK_SQL = (f"rq as (select query_id, pregunta, {keywords_sql('pregunta')} as kw, {_LETTERS_SQL('pregunta')} as qv from {_ROUTED_SQL}), tt as (select doc_id, titulo, temas, {_LETTERS_SQL('titulo')} as tv from {_TITLES_SQL}), "
           f"rk as (select query_id, doc_id, round(list_sum(list_transform(kw, lambda w: (case when contains(titulo, w) then 1.0 else 0.0 end) + (case when contains(temas, w) then 0.5 else 0.0 end))) / len(kw), 6) as kwscore, {_COS.format(a='tv', b='qv')} as cosine from rq, tt)")


@query("sequential_search",
       f"with {_RK_SQL}, cand as (select query_id, count(*) filter (where kwscore > 0.1) as n from rk group by query_id) select query_id, doc_id, cosine as score, row_number() over (partition by query_id order by cosine desc, doc_id) as rank from rk join cand using (query_id) where n = 0 or kwscore > 0.1 qualify rank <= 10")
def _(spark, d):
    """Q10"""
    from lexmesh.plans.retrieval import sequential
    q = routed_questions(spark, d).select("query_id", dense.letter_vector(F.col("pregunta")).alias("qvec"))
    return _out(sequential(_routed_keywords(spark, d), title_vectors(spark, d), q, 10))


_STRAT = " + ".join(f"(case when contains(pregunta, '{t}') then 1 else 0 end)" for t in classify.L.TECHNICAL_TERMS)


@query("search_by_strategy",
       f"""with {_RK_SQL}, rt as (select query_id, case when regexp_matches(pregunta, '(decreto|ley|resolución|d\\.)[ ]*[0-9]+') then 'keywords' when ({_STRAT}) <= 2 then 'embeddings' else 'hybrid' end as route from rq),
 hy as (select r.*, max(kwscore) over w - min(kwscore) over w as ks, min(kwscore) over w as kl, max(cosine) over w - min(cosine) over w as es, min(cosine) over w as el from rk r join rt using (query_id) where route = 'hybrid' and kwscore > 0 window w as (partition by query_id)),
 sc as (select query_id, doc_id, route, case when route = 'keywords' then kwscore else cosine end as score from rk join rt using (query_id) where (route = 'keywords' and kwscore > 0) or route = 'embeddings'
  union all select query_id, doc_id, 'hybrid', round(0.3 * (case when ks = 0 then 0 else (kwscore - kl) / ks end) + 0.7 * (case when es = 0 then 0 else (cosine - el) / es end), 6) from hy)
 select query_id, doc_id, score, route, row_number() over (partition by query_id order by score desc, doc_id) as rank from sc qualify rank <= 10""")
def _(spark, d):
    """Q12, Q34"""
    from lexmesh.plans.retrieval import by_strategy
    # Titles and themes are read out of the texts once; keywords of questions that go by vectors alone are not looked for.
    both, asked = written(titles(spark, d)), written(routed_questions(spark, d))
    routed = asked.select("query_id", dense.letter_vector(F.col("pregunta")).alias("qvec"), classify.search_strategy(F.col("pregunta")).alias("route"))
    worded = asked.where(classify.search_strategy(F.col("pregunta")) != "embeddings")
    out = by_strategy(routed, _routed_keywords(spark, d, worded, both), title_vectors(spark, d, both), 10)
    return out.select("query_id", "doc_id", "score", "route", F.col("rank").cast("bigint").alias("rank"))


@query("model_rerank",
       f"""with {bm25_sql('all_tokens')}, {_CUT.format(n='scored', k=50)}, held as (select query_id, doc_id, list_distinct(all_tokens) as q, list_distinct(tokens) as t from scored_r join questions using (query_id) join docs using (doc_id) where score > 0),
 late as (select query_id, doc_id, round(cast(len(list_intersect(q, t)) as double) / greatest(len(q), 1), 6) as score from held)
 select query_id, doc_id, score, row_number() over (partition by query_id order by score desc, doc_id) as rank from late where score > 0.2 qualify rank <= 10""")
def _(spark, d):
    """Lexical candidates scored by a model that workers load, threshold first, then the best ten"""
    pool = lexical.bm25_topk(documents(spark, d), passages(spark, d), 50).select("query_id", "doc_id")
    pairs = pool.join(table(spark, d, "documents", "doc_id", "text"), "doc_id").join(
        table(spark, d, "benchmark", F.col("item_id").alias("query_id"), F.col("text").alias("question")), "query_id")
    return _out(rerank.rerank(pairs, rerank.word_overlap, "doc_id", 10, 0.2))


@query("inverted_list_topk")
def _(spark, d):
    """Q5: nearest vectors of every hundredth vector through inverted lists, as many as give nine tenths; ``hallado`` tells which of the exact ten they give"""
    corpus = vectors(spark, d).select("id", "vec")
    asked = corpus.where(F.col("id") % 100 == 0).select(F.col("id").alias("query_id"), "vec")
    index = ivf.InvertedLists.build(corpus, ivf.folder_of(spark, uuid.uuid4().hex))
    found = ivf.with_recall(index, corpus, asked, 10, ivf.probes_for(index, corpus, asked, 10))
    return found.select("query_id", F.col("id").alias("vec_id"), "score", F.col("rank").cast("bigint").alias("rank"), "hallado")


_TITLE_DENSE_SQL = (f"tvec as (select doc_id, {_LETTERS_SQL('titulo')} as v from {_TITLES_SQL}), pvec as (select query_id, {_LETTERS_SQL('pregunta')} as q from {_QUESTIONS_SQL}), "
                    f"tdense as (select query_id, doc_id, {_COS.format(a='v', b='q')} as score from tvec, pvec)")


@query("three_list_rrf_titles",
       f"with {_LITE_SQL}, {_SPARSE_SQL}, {_TITLE_DENSE_SQL}, {_CUT.format(n='lite', k=100)}, {_CUT.format(n='sparse', k=100)}, {_CUT.format(n='tdense', k=100)}, "
       f"fused as ({rrf_sql(['lite_r', 'sparse_r', 'tdense_r'])}) select * from fused where rank <= 10")
def _(spark, d):
    """Q14: lexical, sparse and dense title rankings fused"""
    q = norm_questions(spark, d).select("query_id", dense.letter_vector(F.col("pregunta")).alias("vec"))
    near = dense.dense_topk(title_vectors(spark, d).withColumnRenamed("doc_id", "id"), q, 100).withColumnRenamed("id", "doc_id")
    lists = [fusion.top_k(_lite(spark, d), 100, "doc_id"), fusion.top_k(_sparse(spark, d), 100, "doc_id"), near]
    return _out(fusion.rrf(lists, "doc_id").where(F.col("rank") <= 10))


_SAID = lambda prefix: f"('{prefix}' || text)"


@query("prefixed_vector_topk",
       f"with dvec as (select doc_id, {_LETTERS_SQL(_SAID('passage: '))} as v from documents), qvec as (select item_id as query_id, {_LETTERS_SQL(_SAID('query: '))} as q from benchmark), "
       f"dense as (select query_id, doc_id, {_COS.format(a='v', b='q')} as score from dvec, qvec), {_CUT.format(n='dense', k=10)} select query_id, doc_id, score, rank from dense_r")
def _(spark, d):
    """Q6: question and passage prefixes before the embedder"""
    docs = documents(spark, d).select(F.col("doc_id").alias("id"), dense.letter_vector(F.col("text"), dense.PASSAGE_PREFIX).alias("vec"))
    asked = table(spark, d, "benchmark", "item_id", "text").select(F.col("item_id").alias("query_id"), dense.letter_vector(F.col("text"), dense.QUESTION_PREFIX).alias("vec"))
    return _out(dense.dense_topk(docs, asked, 10).withColumnRenamed("id", "doc_id"))


@query("expert_rerank_by_company",
       f"""with {_KW_SQL}, usage as (select cast(o_orderkey as bigint) as doc_id, o_orderstatus, floor(o_totalprice / 1000) as freq, o_custkey % 3 = 0 as generador from orders where o_orderstatus = 'F' or floor(o_totalprice / 1000) >= 50),
 cand as (select query_id, doc_id, score, o_orderstatus, freq, generador, row_number() over (partition by query_id order by score desc, doc_id) as r from kwscored join usage using (doc_id) where score > 0 qualify r <= 50),
 lifted as (select query_id, doc_id, round(((score * (case when o_orderstatus = 'F' then 1.3 else 1.0 end) * (case when query_id % 2 = 0 and generador then 1.3 else 1.0 end)) + (case when freq > 100 then least(freq / 500, 0.2) else 0.0 end)) * (case when o_orderstatus = 'P' then 0.7 else 1.0 end), 6) as score from cand)
 select query_id, doc_id, score, row_number() over (partition by query_id order by score desc, doc_id) as rank from lifted qualify rank <= 10""")
def _(spark, d):
    """Q13: critical or much used norms only; those that apply to the asking company are lifted, here every second question comes from a generator"""
    usage = table(spark, d, "orders").select(
        F.col("o_orderkey").alias("doc_id"), "o_orderstatus", F.floor(F.col("o_totalprice") / 1000).alias("freq"), (F.col("o_custkey") % 3 == 0).alias("generador"))
    known = keyword_ranking(spark, d).where("score > 0").join(usage.where("o_orderstatus = 'F' or freq >= 50"), "doc_id")
    pool = fusion.top_k(known, 50, "doc_id").drop("rank")
    match = (F.col("query_id") % 2 == 0) & F.col("generador")
    score = fusion.expert_score(F.col("score"), F.col("o_orderstatus") == "F", match, F.col("freq"), F.col("o_orderstatus") == "P")
    return _out(fusion.top_k(pool.select("query_id", "doc_id", F.round(score, 6).alias("score")), 10, "doc_id"))
