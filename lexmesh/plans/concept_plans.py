"""Queries over concepts: detection, boosting, injection, quality and authority."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexmesh.functions import citations as C, lexicon as L, text as T
from lexmesh.operators import boosting, definitions as D, fusion, terms
from lexmesh.plans.register import query
from lexmesh.plans.text_plans import CLASSES_SQL, _FOLD, _LIST, normalize_sql
from lexmesh.plans.views import (CANDIDATES_SQL, CONCEPTS_SQL, EDGES_SQL, QUESTIONS_SQL, candidates, concepts, edges,
                                 norms, norms_sql, part_questions)
from lexmesh.session import unsent, written
from lexmesh.sources.tables import table


def glossary(spark, d):
    """Parts as glossary entries with one alias each."""
    return concepts(spark, d).withColumn("aliases", F.array("alias"))


_PAD = lambda e: f"' ' || trim(regexp_replace({e}, '[^\\p{{L}}\\p{{N}}_]+', ' ', 'g')) || ' '"
ASKED_SQL = f"""qs as (select query_id, {normalize_sql('text')} as q from ({QUESTIONS_SQL})),
 gl as (select concepto_id, nombre, definicion, alias, dominio, {normalize_sql('nombre')} as nf, {normalize_sql('alias')} as af from ({CONCEPTS_SQL})),
 asked as (select query_id, concepto_id, nombre, not by_name as by_alias, case when by_name then nombre else alias end as term, case when by_name then nf else af end as form
  from (select *, contains({_PAD('q')}, {_PAD('nf')}) as by_name, contains({_PAD('q')}, {_PAD('af')}) as by_al from qs, gl) where by_name or by_al)"""


def asked(spark, d):
    return terms.concepts_in(part_questions(spark, d), glossary(spark, d), ["query_id"])


@query("question_concepts", f"with {ASKED_SQL} select query_id, concepto_id, term, by_alias from asked where true")
def _(spark, d):
    """Concepts named in each question, by name or else by alias"""
    return asked(spark, d).select("query_id", "concepto_id", "term", "by_alias")


@query("question_concepts_in_domain", f"with {ASKED_SQL} select a.query_id, a.concepto_id from asked a join gl using (concepto_id) where dominio = 'electricidad' or dominio is null")
def _(spark, d):
    """the domain filter keeps unclassified concepts"""
    kept = glossary(spark, d).where((F.col("dominio") == "electricidad") | F.col("dominio").isNull())
    return terms.concepts_in(part_questions(spark, d), kept, ["query_id"]).select("query_id", "concepto_id")


SUBJECT_SQL = f"""{ASKED_SQL}, longest as (select query_id, arg_max(struct_pack(concepto_id, nombre, term, form, by_alias), length(term) * 1000000000 - concepto_id) as s from asked group by query_id),
 subject as (select query_id, s.concepto_id as concepto_id, s.nombre as nombre, s.term as term, s.form as form, s.by_alias as by_alias from longest l where not exists (select 1 from asked a where a.query_id = l.query_id and not contains(l.s.form, a.form)))"""


@query("subject_concepts", f"with {SUBJECT_SQL} select query_id, concepto_id, term, by_alias from subject")
def _(spark, d):
    """Q25"""
    return terms.subject_concept(asked(spark, d)).select("query_id", "concepto_id", "term", "by_alias")


@query("definitional_openers",
       f"select query_id, trim(regexp_extract(text, '(?i)^[ ]*(?:qu[eé] +es|definici[oó]n +de|qu[eé] +significa|c[oó]mo +se +define) +(.+?) *[?¿]* *$', 1)) as termino from ({QUESTIONS_SQL}) "
       "where regexp_matches(text, '(?i)^[ ]*(?:qu[eé] +es|definici[oó]n +de|qu[eé] +significa|c[oó]mo +se +define) +(.+?) *[?¿]* *$')")
def _(spark, d):
    """Q24"""
    # Openers of a definition question.
    pattern = r"(?iu)^\s*(?:qu[eé]\s+es|definici[oó]n\s+de|qu[eé]\s+significa|c[oó]mo\s+se\s+define)\s+(.+?)\s*[?¿]*\s*$"
    q = part_questions(spark, d)
    return q.where(F.col("text").rlike(pattern)).select("query_id", F.trim(F.regexp_extract("text", pattern, 1)).alias("termino"))


# Concept index: defining edges with the date of their norm.
_DEFINED_SQL = (f"defined as (select e.concepto_id, g.nombre, g.nf, g.af, n.fecha, e.id_norma, e.numero from ({EDGES_SQL}) e join gl g using (concepto_id) join ({norms_sql('id_norma', 'fecha')}) n using (id_norma) where e.kind = 'define_termino'), "
                "idx as (select form, first(concepto_id order by a, b, fecha desc nulls last, id_norma, numero) as concepto_id, first(id_norma order by a, b, fecha desc nulls last, id_norma, numero) as id_norma, first(numero order by a, b, fecha desc nulls last, id_norma, numero) as numero "
                "from (select nf as form, 0 as a, '' as b, * from defined union all select af, 1, nombre, * from defined) group by form)")


def index(spark, d):
    named = terms.name_and_alias_terms(glossary(spark, d)).withColumn("form", T.normalize_for_match(F.col("term")))
    e = edges(spark, d).where(F.col("kind") == "define_termino").select("concepto_id", "id_norma", "numero")
    dated = e.join(unsent(norms(spark, d, "id_norma", "fecha")), "id_norma")
    return boosting.concept_index(dated.join(unsent(named), "concepto_id"))


@query("concept_index", f"with {ASKED_SQL}, {_DEFINED_SQL} select form, concepto_id, id_norma, numero from idx")
def _(spark, d):
    """Most recent definition per name or alias"""
    return index(spark, d).select("form", "concepto_id", "id_norma", "numero")


# Candidate articles: the lines each supplier ships, scored by quantity.
_POOL_SQL = ("pool as (select l_suppkey as query_id, l_orderkey * 10 + l_linenumber as articulo_id, round(max(l_quantity) / 50, 6) as score from lineitem group by all), "
             "ranked as (select *, row_number() over (partition by query_id order by score desc, articulo_id) as rank from pool qualify rank <= 50)")
_ASKED_SUPP_SQL = "asks as (select l_suppkey as query_id, l_partkey as concepto_id, bool_or(l_tax > 0.04) as by_alias from lineitem where l_discount >= 0.09 group by all)"
_LINKS_SQL = (f"lk as (select e.articulo_id, e.concepto_id, e.kind, year(n.fecha) as anio, coalesce(n.clase = 'reglamento_base', false) as base from ({EDGES_SQL}) e join "
              f"({CLASSES_SQL.format(src=norms_sql('id_norma', 'titulo', 'fecha'))}) n using (id_norma))")


def supplier_pool(spark, d):
    lines = table(spark, d, "lineitem", "l_suppkey", "l_orderkey", "l_linenumber", "l_quantity")
    pool = lines.groupBy(F.col("l_suppkey").alias("query_id"), F.expr("l_orderkey * 10 + l_linenumber").alias("articulo_id")).agg(
        F.round(F.max("l_quantity") / 50, 6).alias("score"))
    return fusion.top_k(pool, 50, "articulo_id")


def supplier_questions(spark, d):
    lines = table(spark, d, "lineitem", "l_suppkey", "l_partkey", "l_tax", "l_discount").where(F.col("l_discount") >= 0.09)
    return lines.groupBy(F.col("l_suppkey").alias("query_id"), F.col("l_partkey").alias("concepto_id")).agg(
        F.bool_or(F.col("l_tax") > 0.04).alias("by_alias"))


def dated_links(spark, d):
    from lexmesh.functions.classify import norm_class
    n = norms(spark, d, "id_norma", "titulo", "fecha").select(
        "id_norma", F.year("fecha").alias("anio"), F.coalesce(norm_class(F.col("titulo")) == "reglamento_base", F.lit(False)).alias("base"))
    return edges(spark, d).join(n, "id_norma").select("articulo_id", "concepto_id", "kind", "anio", "base")


_FACTOR = "case kind " + " ".join(f"when '{k}' then {v}" for k, v in L.EDGE_BOOST.items()) + " else 1.0 end"
_BOOST_SQL = f"""{_POOL_SQL}, {_ASKED_SUPP_SQL}, {_LINKS_SQL},
 facts as (select r.query_id, r.articulo_id, bool_or(kind = 'define_termino' and by_alias) as via, max(case when kind = 'define_termino' and by_alias then anio end) as anio,
   bool_or(kind = 'define_termino' and by_alias and base) as base, max(case when kind <> 'define_termino' then {_FACTOR} end) as fo, max({_FACTOR}) as ft
   from ranked r join lk using (articulo_id) join asks a on a.query_id = r.query_id and a.concepto_id = lk.concepto_id group by all),
 boosted as (select r.query_id, r.articulo_id, round(cast(case when f.via is null then score when f.via then score + 10 + coalesce(least(greatest((f.anio - 1935) / 90.0, 0), 1) * 0.9, 0) + case when f.base then 0.3 else 0 end else score * coalesce(fo, 1) end as double), 6) as score
   from ranked r left join facts f on f.query_id = r.query_id and f.articulo_id = r.articulo_id)"""


def boosted(spark, d, alias_aware=True):
    return boosting.graph_boost(supplier_pool(spark, d).drop("rank"), dated_links(spark, d), supplier_questions(spark, d), alias_aware)


@query("graph_boost", f"with {_BOOST_SQL} select * from boosted")
def _(spark, d):
    """Q18: additive bonus for definitions reached by alias, factors for the rest"""
    return boosted(spark, d)


@query("graph_boost_by_factor", f"with {_BOOST_SQL} select r.query_id, r.articulo_id, round(cast(score * coalesce(ft, 1) as double), 6) as score from ranked r left join facts f on f.query_id = r.query_id and f.articulo_id = r.articulo_id")
def _(spark, d):
    """Q18: callers without alias information"""
    return boosted(spark, d, alias_aware=False)


@query("boost_lift",
       f"""with {_BOOST_SQL}, a as (select query_id, articulo_id, row_number() over (partition by query_id order by score desc, articulo_id) as rank from ranked qualify rank <= 5),
 b as (select query_id, articulo_id, row_number() over (partition by query_id order by score desc, articulo_id) as rank from boosted qualify rank <= 5)
 select query_id, max(case when a.rank = 1 then articulo_id end) <> max(case when b.rank = 1 then articulo_id end) as top1_changed, count(a.rank) < count(*) as set_changed,
 count(*) - count(a.rank) as new_in_b, count(*) - count(b.rank) as only_in_a from a full join b using (query_id, articulo_id) group by query_id""")
def _(spark, d):
    """What boosting changes among the best five"""
    plain = fusion.top_k(supplier_pool(spark, d).drop("rank"), 5, "articulo_id").select("query_id", "articulo_id", F.col("rank").alias("ra"))
    lifted = fusion.top_k(boosted(spark, d), 5, "articulo_id").select("query_id", "articulo_id", F.col("rank").alias("rb"))
    both = plain.join(lifted, ["query_id", "articulo_id"], "full").groupBy("query_id")
    article = F.col("articulo_id")
    return both.agg(
        (F.max(F.when(F.col("ra") == 1, article)) != F.max(F.when(F.col("rb") == 1, article))).alias("top1_changed"),
        (F.count("ra") < F.count(F.lit(1))).alias("set_changed"),
        (F.count(F.lit(1)) - F.count("ra")).alias("new_in_b"), (F.count(F.lit(1)) - F.count("rb")).alias("only_in_a"))


@query("expand_to_articles",
       f"""with frag as (select l_suppkey as query_id, l_orderkey as articulo_id, l_linenumber as fragmento_id, round(max(l_quantity) / 50, 6) as score from lineitem group by all),
 rk as (select *, row_number() over (partition by query_id order by score desc, articulo_id * 10 + fragmento_id) as rank from frag qualify rank <= 50)
 select query_id, articulo_id, fragmento_id, score, numero, titulo from (select *, row_number() over (partition by query_id, articulo_id order by score desc, rank) as p from rk qualify p = 1) join (select cast(id_norma as bigint) as articulo_id, numero, titulo from ({norms_sql('id_norma', 'numero', 'titulo')})) using (articulo_id)""")
def _(spark, d):
    """Line items as fragments of their order"""
    lines = table(spark, d, "lineitem", "l_suppkey", "l_orderkey", "l_linenumber", "l_quantity")
    frag = lines.groupBy(F.col("l_suppkey").alias("query_id"), F.col("l_orderkey").alias("articulo_id"), F.col("l_linenumber").alias("fragmento_id")).agg(
        F.round(F.max("l_quantity") / 50, 6).alias("score"))
    keyed = frag.withColumn("orden", F.col("articulo_id") * 10 + F.col("fragmento_id"))
    pool = fusion.top_k(keyed, 50, "orden")
    arts = norms(spark, d, "id_norma", "numero", "titulo").select(F.col("id_norma").cast("bigint").alias("articulo_id"), "numero", "titulo")
    return boosting.expand_to_articles(pool, arts).select("query_id", "articulo_id", "fragmento_id", "score", "numero", "titulo")


# Pools for injection: lines of the part in question, best five by price.
_INJECT_POOL = ("ipool as (select l_partkey as query_id, cast(l_orderkey as string) as id_norma, cast(l_linenumber as string) as numero, max(l_extendedprice) as score from lineitem group by all), "
                "ir as (select *, row_number() over (partition by query_id order by score desc, id_norma, numero) as rank from ipool qualify rank <= 5)")
_INJECT_SQL = f"""{SUBJECT_SQL}, {_DEFINED_SQL}, {_INJECT_POOL}, cur as (select s.query_id, i.id_norma, i.numero, g.definicion, s.by_alias from subject s join gl g using (concepto_id) join idx i on i.form = g.nf),
 wanted as (select c.*, case when trim(definicion) <> '' and by_alias then 'alias' else 'articulo' end as forma from cur c),
 front as (select w.query_id, w.id_norma, w.numero, w.forma, case when w.forma = 'articulo' and p.score is not null then p.score else 9999.0 end as score, 0 as rank from wanted w left join ir p on p.query_id = w.query_id and p.id_norma = w.id_norma and p.numero = w.numero),
 merged as (select query_id, id_norma, numero, forma, score, rank from front union all select query_id, id_norma, numero, 'recuperado', score, rank from ir p where not exists (select 1 from front f where f.query_id = p.query_id and f.id_norma = p.id_norma and f.numero = p.numero))"""


@query("inject_definitions", f"with {_INJECT_SQL} select query_id, id_norma, numero, forma, score, row_number() over (partition by query_id order by rank, id_norma, numero) as rank from merged qualify row_number() over (partition by query_id order by rank, id_norma, numero) <= 5")
def _(spark, d):
    """Q26"""
    lines = table(spark, d, "lineitem", "l_partkey", "l_orderkey", "l_linenumber", "l_extendedprice")
    priced = lines.groupBy(F.col("l_partkey").alias("query_id"), F.col("l_orderkey").cast("string").alias("id_norma"), F.col("l_linenumber").cast("string").alias("numero")).agg(
        F.max("l_extendedprice").alias("score")).withColumn("llave", F.struct("id_norma", "numero"))
    pool = fusion.top_k(priced, 5, "llave").drop("llave")
    subject = terms.subject_concept(asked(spark, d))
    idx = index(spark, d).select(F.col("form").alias("nf"), "id_norma", "numero")
    g = concepts(spark, d).select("concepto_id", "definicion", T.normalize_for_match(F.col("nombre")).alias("nf"))
    curated = written(subject.select("query_id", "concepto_id", "by_alias").join(unsent(g), "concepto_id").join(unsent(idx), "nf"))
    known = table(spark, d, "lineitem").select(F.col("l_orderkey").cast("string").alias("id_norma"), F.col("l_linenumber").cast("string").alias("numero"))
    out = boosting.inject(pool, curated.select("query_id", "id_norma", "numero", "definicion", "by_alias"), known, 5)
    return out.withColumn("rank", F.col("rank").cast("bigint"))


@query("source_pointers",
       """select o_orderkey, case when o_orderstatus = 'F' and o_orderpriority <> '1-URGENT' then 'def-' || o_custkey when o_orderpriority <> '5-LOW' then 'aut-' || o_custkey end as id_norma,
 case when o_orderstatus = 'F' and o_orderpriority <> '1-URGENT' then '1' when o_orderpriority <> '5-LOW' then '2' end as articulo from orders""")
def _(spark, d):
    """Q27: sources under review are skipped, then the authoritative pointer applies"""
    key = F.col("o_custkey").cast("string")
    source = F.when(F.col("o_orderstatus") == "F", F.struct(
        F.concat(F.lit("def-"), key).alias("id_norma"), F.lit("1").alias("articulo"), (F.col("o_orderpriority") == "1-URGENT").alias("needs_review")))
    authoritative = F.when(F.col("o_orderpriority") != "5-LOW", F.struct(F.concat(F.lit("aut-"), key).alias("id_norma"), F.lit("2").alias("articulo")))
    rows = table(spark, d, "orders").select("o_orderkey", source.alias("s"), authoritative.alias("a"))
    return rows.select("o_orderkey", boosting.source_pointer(F.col("s"), F.col("a")).alias("p")).select("o_orderkey", "p.id_norma", "p.articulo")


_DW = lambda e: f"list_filter(regexp_extract_all({_FOLD.format(f'lower({e})')}, '[a-záéíóúñ]{{2,}}'), lambda w: not list_contains({_LIST(L.DEFINITION_STOPWORDS)}, w))"
_LABEL = lambda n, x: f"len(list_filter({_DW(x)}, lambda w: not list_contains({_DW(n)}, w))) < 4"
_SUSPECT = lambda n, x: (f"case when trim({x}) = '' then 'empty' else array_to_string(list_filter([case when contains(lower({x}), 'se refiere') then 'remission' end, case when {_LABEL(n, x)} then 'label' end], lambda r: r is not null), ',') end")


@query("definition_suspicions", f"select concepto_id, {_SUSPECT('nombre', 'definicion')} as razones from ({CONCEPTS_SQL})")
def _(spark, d):
    """E22"""
    return concepts(spark, d).select("concepto_id", D.suspicion(F.col("nombre"), F.col("definicion")).alias("razones"))


@query("naming_actions",
       f"""select concepto_id, case when definicion like nombre || ' con%' then nombre || ' con capacidad nominal declarada ante el registro' end as canonico,
 case when definicion like nombre || ' con%' then 'rename' when definicion like nombre || ' %' then 'review' else 'skip' end as accion,
 case when definicion like nombre || ' con%' then 'high' when definicion like nombre || ' %' then 'low_confidence: no_boundary' else 'no-fire' end as motivo from ({CONCEPTS_SQL})""")
def _(spark, d):
    """E21"""
    return D.naming_actions(concepts(spark, d))


AUTH_SQL = """w as (select *, max(rank) over (partition by concepto_id) as br, count(*) over (partition by concepto_id) as n from {src}),
 t as (select *, max(fecha) over (partition by concepto_id) as mf from w where rank = br),
 tops as (select concepto_id, any_value(n) as n, count(*) as nt, count(distinct id_norma) as dn, count(*) filter (where fecha is not distinct from mf) as ties,
   first(id_norma order by fecha desc nulls last, pos) as wn, first(articulo order by fecha desc nulls last, pos) as wa from t group by concepto_id),
 recent as (select concepto_id, first(id_norma order by fecha desc nulls last, pos) as rn from w group by concepto_id),
 auth as (select concepto_id, n as n_candidatos, nt as n_rango_mayor, wn, wa, case when n = 1 then 'unico' when ties > 1 then 'empate' when dn > 1 then 'varias_normas' when wn = rn then 'rango_y_fecha' else 'rango_contra_fecha' end as motivo from tops join recent using (concepto_id))"""
_AUTH_OUT = "select concepto_id, case when motivo in ('unico', 'rango_y_fecha') then 'resolved' else 'conflict' end as estado, motivo, case when motivo in ('unico', 'rango_y_fecha') then wn end as id_norma, case when motivo in ('unico', 'rango_y_fecha') then wa end as articulo, n_rango_mayor, n_candidatos from auth"
_FIRST_SQL = f"firsts as (select concepto_id, id_norma, first(articulo order by articulo, pos) as articulo, first(rank order by articulo, pos) as rank, first(fecha order by articulo, pos) as fecha, first(pos order by articulo, pos) as pos from ({CANDIDATES_SQL}) where origin = 'curated' group by all)"


@query("candidates_per_norm", f"with {_FIRST_SQL} select concepto_id, id_norma, articulo, rank, pos from firsts")
def _(spark, d):
    """E24, J2"""
    c = candidates(spark, d).where(F.col("origin") == "curated")
    return D.first_per_norm(c).select("concepto_id", "id_norma", "articulo", "rank", "pos")


@query("authority", f"with {_FIRST_SQL}, {AUTH_SQL.format(src='firsts')} {_AUTH_OUT}")
def _(spark, d):
    """E23"""
    c = candidates(spark, d).where(F.col("origin") == "curated").select("concepto_id", "id_norma", "articulo", "rank", "fecha", "pos")
    return D.authority(D.first_per_norm(c))


_SOURCE_SQL = f"""cand as ({CANDIDATES_SQL}), sound as (select * from cand where origin = 'curated' and not ({_LABEL('nombre', 'definicion')})), {AUTH_SQL.format(src='sound')},
 source as (select c.concepto_id, case when motivo in ('unico', 'rango_y_fecha') then 'resolved' else 'unresolved' end as estado, case when motivo in ('unico', 'rango_y_fecha') then wn end as id_norma, case when motivo in ('unico', 'rango_y_fecha') then wa end as articulo,
  case when motivo is null then 'no-substantive-candidate' when motivo not in ('unico', 'rango_y_fecha') then 'rank-recency-conflict' when n_candidatos = 1 then 'sustancia' when n_rango_mayor = 1 then 'jerarquia' else 'fecha' end as criterio
  from (select distinct concepto_id from cand) c left join auth using (concepto_id))"""


@query("definition_sources", f"with {_SOURCE_SQL} select * from source")
def _(spark, d):
    """E25"""
    return D.definition_source(candidates(spark, d))


@query("gathered_candidates",
       f"select concepto_id, id_norma, articulo, min(origin) as origin from ({CANDIDATES_SQL}) group by concepto_id, id_norma, articulo")
def _(spark, d):
    """Curated wins over retrieved"""
    c = candidates(spark, d)
    curated, retrieved = (c.where(F.col("origin") == o).drop("origin") for o in ("curated", "retrieved"))
    return D.gather(curated, retrieved).select("concepto_id", "id_norma", "articulo", "origin")


@query("edges_define_before_cite",
       f"select id_norma, concepto_id, first(kind order by case when kind = 'define_termino' then 0 else 1 end, kind, articulo_id) as kind, first(articulo_id order by case when kind = 'define_termino' then 0 else 1 end, kind, articulo_id) as articulo_id from ({EDGES_SQL}) group by all")
def _(spark, d):
    """One edge per (norm, concept), definitions first"""
    order = F.struct((F.col("kind") != "define_termino").cast("int").alias("a"), "kind", "articulo_id")
    return edges(spark, d).groupBy("id_norma", "concepto_id").agg(F.min_by(F.struct("kind", "articulo_id"), order).alias("x")).select(
        "id_norma", "concepto_id", "x.kind", "x.articulo_id")


@query("source_decisions",
       f"""with {_SOURCE_SQL}, cs as (select concepto_id, {_SUSPECT('nombre', 'definicion')} as sospecha from ({CONCEPTS_SQL}) where concepto_id in (select concepto_id from cand)),
 conf as (select p_partkey as concepto_id, 'N' || p_partkey as id_norma, '1' as articulo from part where p_retailprice > 1000 and p_size = 1),
 prop as (select concepto_id, first(id_norma order by id_norma, articulo) as id_norma, first(articulo order by id_norma, articulo) as articulo from cand where origin = 'retrieved' group by concepto_id)
 select concepto_id, case when conf.id_norma is not null then conf.id_norma when s.estado = 'resolved' then s.id_norma else prop.id_norma end as id_norma,
 case when conf.id_norma is not null then conf.articulo when s.estado = 'resolved' then s.articulo else prop.articulo end as articulo,
 case when conf.id_norma is not null then 'confirmado_humano' when s.estado = 'resolved' then s.criterio when prop.id_norma is not null then 'primera_cita' else 'ninguno' end as criterio,
 case when conf.id_norma is not null or s.estado = 'resolved' then 'alta' else 'baja' end as confianza, not (conf.id_norma is not null or s.estado = 'resolved') as needs_review,
 case when conf.id_norma is not null then 'confirmado' else sospecha end as razones
 from cs left join conf using (concepto_id) left join source s using (concepto_id) left join prop using (concepto_id) where conf.id_norma is not null or sospecha <> ''""")
def _(spark, d):
    """Staged decisions; the proposer here takes the first citing norm"""
    c = candidates(spark, d)
    confirmed = table(spark, d, "part").where((F.col("p_retailprice") > 1000) & (F.col("p_size") == 1)).select(
        F.col("p_partkey").alias("concepto_id"), F.concat(F.lit("N"), F.col("p_partkey").cast("string")).alias("id_norma"), F.lit("1").alias("articulo"))
    first = c.where(F.col("origin") == "retrieved").groupBy("concepto_id").agg(F.min(F.struct("id_norma", "articulo")).alias("x"))
    proposals = first.select("concepto_id", "x.id_norma", "x.articulo", F.lit("primera_cita").alias("criterio"))
    return D.decisions(concepts(spark, d).select("concepto_id", "nombre", "definicion"), c, confirmed, proposals)


_REASONING = "case when o_orderpriority = '5-LOW' then 'Es la más específica' when o_orderkey % 3 = 0 then 'Conforme a la ley N° 20.' || lpad(cast(o_custkey % 1000 as string), 3, '0') else 'Según la norma ' || cast(o_custkey as string) || ' y otras' end"
_NUMS = lambda e: f"list_distinct(list_transform(regexp_extract_all({e}, '[0-9]{{1,3}}(?:\\.[0-9]{{3}})+\\b|\\b[0-9]{{3,}}\\b'), lambda n: replace(n, '.', '')))"


@query("number_checks",
       f"""select id_norma, len(a) = 0 or list_has_any(a, list_append(b, numero)) as coherente from (select id_norma, numero, {_NUMS('f')} as a, {_NUMS('titulo')} as b
 from (select cast(o_orderkey as string) as id_norma, {_REASONING} as f from orders) join ({norms_sql('id_norma', 'titulo', 'numero')}) using (id_norma))""")
def _(spark, d):
    """A justification that names numbers must name the norm it picked; others are marked for review"""
    said = table(spark, d, "orders", "o_orderkey", "o_orderpriority", "o_custkey").select(F.col("o_orderkey").cast("string").alias("id_norma"), F.expr(_REASONING).alias("fundamento"))
    n = norms(spark, d, "id_norma", "titulo", "numero")
    return said.join(n, "id_norma").select("id_norma", C.cites_its_norm(F.col("fundamento"), F.col("titulo"), F.col("numero")).alias("coherente"))


@query("injected_bodies",
       f"""with {_INJECT_SQL}, done as (select *, row_number() over (partition by query_id order by rank, id_norma, numero) as orden from merged qualify orden <= 5),
 about as (select s.query_id, s.term, s.nombre, g.definicion from subject s join gl g using (concepto_id))
 select query_id, id_norma, numero, forma, orden as rank, case when forma = 'alias' then '«' || term || '» se refiere a «' || nombre || '». ' || trim(definicion) else 'Artículo ' || numero || ' de la norma ' || id_norma end as cuerpo from done left join about using (query_id)""")
def _(spark, d):
    """Q26: the texts that injection puts before a question's pool; an alias question gets the link from alias to name and the definition"""
    lines = table(spark, d, "lineitem", "l_partkey", "l_orderkey", "l_linenumber", "l_extendedprice")
    key = (F.col("l_orderkey").cast("string").alias("id_norma"), F.col("l_linenumber").cast("string").alias("numero"))
    priced = lines.groupBy(F.col("l_partkey").alias("query_id"), *key).agg(F.max("l_extendedprice").alias("score")).withColumn("llave", F.struct("id_norma", "numero"))
    pool = fusion.top_k(priced, 5, "llave").drop("llave")
    idx = index(spark, d).select(F.col("form").alias("nf"), "id_norma", "numero")
    g = concepts(spark, d).select("concepto_id", "definicion", T.normalize_for_match(F.col("nombre")).alias("nf"))
    curated = written(terms.subject_concept(asked(spark, d)).select("query_id", "concepto_id", "by_alias", "term", "nombre").join(unsent(g), "concepto_id").join(unsent(idx), "nf"))
    articles = lines.select(*key).distinct().withColumn("texto", F.concat(F.lit("Artículo "), "numero", F.lit(" de la norma "), "id_norma"))
    out = boosting.inject(pool, curated.select("query_id", "id_norma", "numero", "definicion", "by_alias"), articles, 5)
    return boosting.bodies(out, curated, articles).select("query_id", "id_norma", "numero", "forma", F.col("rank").cast("bigint").alias("rank"), "cuerpo")
