"""Queries over the norm catalog: themes, coverage, profiles, dashboards, finders."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexmesh.functions import classify, lexicon as L
from lexmesh.operators import catalog, graph
from lexmesh.plans.graph_plans import LINK_SQL, links
from lexmesh.plans.register import query
from lexmesh.plans.text_plans import CLASSES_SQL, _LIST
from lexmesh.plans.views import CONCEPTS_SQL, concepts, norms, norms_sql
from lexmesh.session import written
from lexmesh.sources.tables import table

_TAGS = [t for t, _ in L.THEME_STEMS]
# Themes of a norm: one tag per part on its lines.
THEMED_SQL = (f"themed as (select id_norma, tipo, numero, fecha, coalesce(temas, []) as temas from ({norms_sql('id_norma', 'tipo', 'numero', 'fecha')}) left join "
              f"(select cast(l_orderkey as string) as id_norma, list_sort(list(distinct {_LIST(_TAGS)}[cast(l_partkey % 11 as int) + 1])) as temas from lineitem group by l_orderkey) using (id_norma))")


def themed(spark, d):
    lines = table(spark, d, "lineitem", "l_orderkey", "l_partkey").select(
        F.col("l_orderkey").cast("string").alias("id_norma"), "l_partkey")
    per_norm = catalog.theme_sets(lines, "id_norma", F.col("l_partkey") % 11, _TAGS)
    n = norms(spark, d, "id_norma", "tipo", "numero", "fecha")
    return n.join(per_norm, "id_norma", "left").withColumn("temas", F.coalesce("temas", F.array().cast("array<string>")))


_PAIRS_SQL = f"{THEMED_SQL}, pairs as (select a.t as tema1, b.t as tema2, count(*) as n from (select id_norma, unnest(temas) as t from themed) a join (select id_norma, unnest(temas) as t from themed) b on a.id_norma = b.id_norma and a.t < b.t group by all)"


@query("theme_cooccurrence", f"with {_PAIRS_SQL} select * from pairs")
def _(spark, d):
    """A8"""
    return catalog.theme_pairs(themed(spark, d))


@query("low_coverage_pairs", f"with {THEMED_SQL}, f as (select *, strftime(fecha, '%Y-%m') as mes from themed), pairs as (select a.tipo, a.mes, a.t as tema1, b.t as tema2, count(*) as n from (select id_norma, tipo, mes, unnest(temas) as t from f) a join (select id_norma, unnest(temas) as t from f) b on a.id_norma = b.id_norma and a.t < b.t group by all) select tipo, mes, tema1, tema2, n, case when n < 5 then 'CRITICO' else 'MODERADO' end as nivel from pairs where n < 10")
def _(spark, d):
    """Per norm type and month"""
    n = themed(spark, d).withColumn("mes", F.date_format("fecha", "yyyy-MM"))
    return catalog.low_coverage(catalog.theme_pairs(n, by=["tipo", "mes"]))


_CLUSTER_SQL = " union all ".join(f"select id_norma, '{name}' as cluster from themed where len(list_intersect(temas, {_LIST(ts)})) >= 2" for name, ts in L.THEME_CLUSTERS.items())


@query("theme_clusters", f"with {THEMED_SQL}, c as ({_CLUSTER_SQL}) select * from c")
def _(spark, d):
    """A9, R1"""
    return catalog.clusters(themed(spark, d), ["id_norma"])


@query("cluster_leaders", f"with {LINK_SQL}, {THEMED_SQL}, c as ({_CLUSTER_SQL}), deg as (select dst, count(*) as refs from links group by dst) select cluster, id_norma, coalesce(refs, 0) as refs from c left join deg on dst = id_norma qualify row_number() over (partition by cluster order by coalesce(refs, 0) desc, id_norma) <= 5")
def _(spark, d):
    """The five most referenced norms of each cluster"""
    degree = graph.in_degree(links(spark, d)).select(F.col("dst").alias("id_norma"), F.col("grado").alias("refs"))
    c = catalog.clusters(themed(spark, d), ["id_norma"]).join(degree, "id_norma", "left").withColumn("refs", F.coalesce("refs", F.lit(0)))
    return catalog.first_per_group(c, "cluster", [F.desc("refs"), F.asc("id_norma")], 5).select("cluster", "id_norma", "refs")


@query("kind_share_by_theme", f"with {THEMED_SQL}, c as (select t as tema, tipo, count(*) as n from (select tipo, unnest(temas) as t from themed) group by all) select tema, tipo, n, round(n * 100 / sum(n) over (partition by tema), 6) as porcentaje, n > 0.6 * sum(n) over (partition by tema) as dominante from c")
def _(spark, d):
    """A10, W9"""
    return catalog.kind_share(themed(spark, d))


@query("integrating_norms", f"with {THEMED_SQL} select id_norma, len(temas) as n_temas from themed where len(temas) >= 5")
def _(spark, d):
    """A12"""
    return themed(spark, d).where(F.size("temas") >= 5).select("id_norma", F.size("temas").cast("bigint").alias("n_temas"))


@query("catalog_profile", f"with {LINK_SQL}, {THEMED_SQL}, e as (select t.id_norma, len(temas) as nt, coalesce(l.n, 0) as ne from themed t left join (select src, count(*) as n from links group by src) l on l.src = t.id_norma) select count(*) as normas, round(avg(ne), 6) as enlaces_promedio, max(ne) as enlaces_max, count(*) filter (where ne > 0) as con_enlaces, count(*) filter (where nt > 0) as con_temas from e")
def _(spark, d):
    """A13"""
    out = links(spark, d).groupBy(F.col("src").alias("id_norma")).agg(F.collect_list("dst").alias("enlaces"))  # at most one per title pattern
    n = themed(spark, d).join(out, "id_norma", "left").withColumn("enlaces", F.coalesce("enlaces", F.array().cast("array<string>")))
    return catalog.profile(n, "enlaces", "temas")


@query("theme_count_histogram", f"with {THEMED_SQL} select len(temas) as n_temas, count(*) as normas from themed group by 1")
def _(spark, d):
    """A13"""
    return themed(spark, d).groupBy(F.size("temas").cast("bigint").alias("n_temas")).agg(F.count(F.lit(1)).alias("normas"))


@query("subject_dashboard", f"with {THEMED_SQL} select t as materia, tipo, year(fecha) as anio, count(*) as n from (select tipo, fecha, unnest(temas) as t from themed) group by all")
def _(spark, d):
    """Themes travel as a JSON list, as catalogs store them"""
    stored = themed(spark, d).select("tipo", "fecha", F.to_json("temas").alias("materias"))
    rows = stored.select("tipo", "fecha", F.explode(F.from_json("materias", "array<string>")).alias("materia"))
    return rows.groupBy("materia", "tipo", F.year("fecha").cast("bigint").alias("anio")).agg(F.count(F.lit(1)).alias("n"))


@query("year_kind_crosstab", f"select year(fecha) as anio, count(*) filter (where tipo = 'LEY') as ley, count(*) filter (where tipo = 'DECRETO') as decreto, count(*) filter (where tipo = 'RESOLUCION') as resolucion from ({norms_sql('tipo', 'fecha')}) group by 1")
def _(spark, d):
    """A31"""
    n = norms(spark, d, "tipo", "fecha").groupBy(F.year("fecha").cast("bigint").alias("anio")).pivot("tipo", ["LEY", "DECRETO", "RESOLUCION"]).count()
    return n.select("anio", *[F.coalesce(k, F.lit(0)).alias(k.lower()) for k in ("LEY", "DECRETO", "RESOLUCION")])


@query("first_norms_per_kind", f"select tipo, numero, id_norma, orden from (select *, row_number() over (partition by tipo order by numero, id_norma) as orden from ({norms_sql('tipo', 'numero', 'id_norma')})) where orden <= 10")
def _(spark, d):
    """A32"""
    n = norms(spark, d, "tipo", "numero", "id_norma")
    out = catalog.first_per_group(n, "tipo", [F.asc("numero"), F.asc("id_norma")], 10)
    return out.withColumn("orden", F.col("orden").cast("bigint"))


@query("norms_per_theme", f"with {THEMED_SQL} select t as tema, count(*) as normas from (select unnest(temas) as t from themed) group by t")
def _(spark, d):
    """A32, A5"""
    return themed(spark, d).select(F.explode("temas").alias("tema")).groupBy("tema").agg(F.count(F.lit(1)).alias("normas"))


@query("counts_with_zeros", f"select tipo, coalesce(n, 0) as n from (select unnest({_LIST(L.NORM_TYPES)}) as tipo) left join (select tipo, count(*) as n from ({norms_sql('tipo')}) group by tipo) using (tipo)")
def _(spark, d):
    """A4"""
    return catalog.counts_with_zeros(norms(spark, d, "tipo"), "tipo", L.NORM_TYPES)


TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations").split()


@query("table_counts", " union all ".join(f"select '{t}' as tabla, count(*) as filas from {t}" for t in TABLES))
def _(spark, d):
    """A1: every table"""
    out = None
    for name in TABLES:
        one = table(spark, d, name).agg(F.count(F.lit(1)).alias("filas")).select(F.lit(name).alias("tabla"), "filas")
        out = one if out is None else out.unionByName(one)
    return out


@query("incomplete_fields", f"with n as ({norms_sql('tipo', 'fecha', 'organismo')}), c as (select tipo, count(*) as total, count(fecha) as fecha, count(organismo) as organismo from n group by tipo) select * from (select tipo, total, unnest(['fecha', 'organismo']) as campo, unnest([fecha, organismo]) as presentes from c) where presentes < total")
def _(spark, d):
    """F11"""
    return catalog.incomplete_fields(norms(spark, d, "tipo", "fecha", "organismo"), "tipo", ["fecha", "organismo"])


@query("repository_finder", f"select id_norma, organismo from ({norms_sql('id_norma', 'tipo', 'organismo', 'fecha')}) where tipo = 'LEY' and year(fecha) = 1997 and contains(lower(organismo), 'energía')")
def _(spark, d):
    """F9"""
    n = norms(spark, d, "id_norma", "tipo", "organismo", "fecha")
    return n.where((F.col("tipo") == "LEY") & (F.year("fecha") == 1997) & F.contains(F.lower("organismo"), F.lit("energía"))).select("id_norma", "organismo")


_REF_TEXT = "case o_orderpriority when '1-URGENT' then 'decreto ' when '2-HIGH' then 'Ley N° ' when '3-MEDIUM' then 'Resolución ' when '4-NOT SPECIFIED' then 'dfl ' else 'norma ' end || cast(cast(floor(o_orderkey / 10) as bigint) as string)"


@query("find_by_text_reference",
       f"""with n as (select cast(id_norma as bigint) as id, tipo, numero, year(fecha) as anio from ({norms_sql('id_norma', 'tipo', 'numero', 'fecha')})),
 r as (select o_orderkey as ref_id, cast(cast(floor(o_orderkey / 10) as bigint) as string) as numero, case when o_orderstatus = 'F' then year(o_orderdate) end as anio, case o_orderpriority when '1-URGENT' then 'DECRETO' when '2-HIGH' then 'LEY' when '3-MEDIUM' then 'RESOLUCION' when '4-NOT SPECIFIED' then 'DFL' end as tipo from orders)
 select ref_id, min(n.id) as id from r join n on n.numero = r.numero and (r.tipo is null or n.tipo = r.tipo) and (r.anio is null or n.anio = r.anio) where not (r.tipo is null and r.anio is not null) group by ref_id""")
def _(spark, d):
    """F10"""
    n = norms(spark, d, "id_norma", "tipo", "numero", "fecha").select(F.col("id_norma").cast("bigint").alias("id"), "tipo", "numero", F.year("fecha").alias("anio"))
    refs = table(spark, d, "orders").select(
        F.col("o_orderkey").alias("ref_id"), F.expr(_REF_TEXT).alias("texto"), F.expr("cast(cast(floor(o_orderkey / 10) as bigint) as string)").alias("numero"),
        F.when(F.col("o_orderstatus") == "F", F.year("o_orderdate")).alias("anio"))
    return catalog.by_text_reference(refs, n)


@query("off_domain_concepts", f"select concepto_id, nombre from ({CONCEPTS_SQL}) where coalesce(dominio, '') = 'regulatorio_otros' and concepto_id in (select p_partkey from part where p_size <= 25) and not nombre like 'red%'")
def _(spark, d):
    """F12, F4"""
    sizes = table(spark, d, "part", F.col("p_partkey").alias("concepto_id"), "p_size")
    c = concepts(spark, d).join(sizes, "concepto_id").withColumn("secundario", F.when(F.col("p_size") <= 25, "no_aplica").otherwise("otro"))
    # The white list is a column test here because names are derived.
    rule = catalog.off_domain(F.col("dominio"), F.col("secundario"), F.col("nombre"), ["no_aplica"], [])
    return c.where(rule & ~F.startswith("nombre", F.lit("red"))).select("concepto_id", "nombre")


@query("merged_aliases", "select p_name as nombre, array_to_string(list_sort(list(distinct a)), '|') as aliases from (select p_name, p_brand as a from part union all select p_name, p_type from part) group by p_name")
def _(spark, d):
    """A16"""
    c = table(spark, d, "part", "p_name", "p_brand", "p_type").select(F.col("p_name").alias("nombre"), F.array("p_brand", "p_type").alias("aliases"))
    return catalog.merged_aliases(c, "nombre", "aliases").select("nombre", F.array_join("aliases", "|").alias("aliases"))


@query("subjects_in_order", f"with f as (select l_orderkey, {_LIST(_TAGS)}[cast(l_partkey % 11 as int) + 1] as tema, min(cast(l_linenumber as bigint) * 1000000000 + l_partkey) as o from lineitem group by all) select l_orderkey, array_to_string(list(tema order by o), ',') as temas from f group by l_orderkey")
def _(spark, d):
    """A17"""
    tags = F.array(*[F.lit(t) for t in _TAGS])
    rows = table(spark, d, "lineitem", "l_orderkey", "l_partkey", "l_linenumber").select(
        "l_orderkey", F.element_at(tags, (F.col("l_partkey") % 11 + 1).cast("int")).alias("tema"),
        (F.col("l_linenumber") * F.lit(1000000000).cast("bigint") + F.col("l_partkey")).alias("o"))
    return catalog.themes_in_order(rows, "l_orderkey", "tema", "o").select("l_orderkey", F.array_join("temas", ",").alias("temas"))


_WANT_SQL = "wants as (select cast(p as string) as destino from (select o_custkey * 13 as p from orders union all select o_orderkey + 7 from orders))"


@query("link_coverage", f"with {_WANT_SQL}, w as (select distinct destino as id from wants where length(destino) > 3) select count(*) as enlazadas, count(o.id) as existentes, round(count(o.id) / count(*), 6) as cobertura from w left join (select cast(o_orderkey as string) as id from orders) o using (id)")
def _(spark, d):
    """A30"""
    o = table(spark, d, "orders", "o_custkey", "o_orderkey")
    wants = o.select(F.explode(F.array((F.col("o_custkey") * 13).cast("string"), (F.col("o_orderkey") + 7).cast("string"))).alias("destino"))
    return catalog.link_coverage(wants, o.select(F.col("o_orderkey").cast("string").alias("id")))


@query("pending_links", f"with {_WANT_SQL} select distinct destino from wants where length(destino) > 3 and destino not in (select cast(o_orderkey as string) from orders)")
def _(spark, d):
    """A30"""
    o = table(spark, d, "orders", "o_custkey", "o_orderkey")
    wants = o.select(F.explode(F.array((F.col("o_custkey") * 13).cast("string"), (F.col("o_orderkey") + 7).cast("string"))).alias("destino")).where(F.length("destino") > 3).distinct()
    return wants.join(o.select(F.col("o_orderkey").cast("string").alias("destino")), "destino", "left_anti")


@query("case_advisor", f"""with {LINK_SQL}, {THEMED_SQL}, deg as (select dst, count(*) as citas from links group by dst), cases as (select conv_id * 100 + turn as case_id, case when contains(lower(text), 'tarif') then ['TARIFAS'] when contains(lower(text), 'the') then ['PEAJES', 'SSCC'] else ['POTENCIA', 'TRANSFERENCIAS'] end as pedido from conversations where role = 'user'),
 sets as (select distinct pedido from cases), best as (select pedido, id_norma, coalesce(citas, 0) as citas, row_number() over (partition by pedido order by coalesce(citas, 0) desc, cast(id_norma as bigint)) as orden from sets join themed on len(list_intersect(temas, pedido)) > 0 left join deg on dst = id_norma qualify orden <= 10)
 select case_id, id_norma, citas, orden from cases join best using (pedido)""")
def _(spark, d):
    """Q33: cases ask for themes; norms with any of them by citations, ten per case"""
    text = F.lower("text")
    asked = (F.when(F.contains(text, F.lit("tarif")), F.array(F.lit("TARIFAS")))
             .when(F.contains(text, F.lit("the")), F.array(F.lit("PEAJES"), F.lit("SSCC"))).otherwise(F.array(F.lit("POTENCIA"), F.lit("TRANSFERENCIAS"))))
    cases = table(spark, d, "conversations").where(F.col("role") == "user").select(
        (F.col("conv_id") * 100 + F.col("turn")).alias("case_id"), asked.alias("pedido")).withColumn("clave", F.array_join("pedido", ","))
    # Cases with the same themes share one answer, so norms are ranked once per theme set.
    sets = cases.select("clave", F.explode("pedido").alias("tema")).distinct()
    degree = graph.in_degree(links(spark, d)).select(F.col("dst").alias("id_norma"), F.col("grado").alias("citas"))
    n = themed(spark, d).select("id_norma", F.explode("temas").alias("tema")).join(sets, "tema").select("clave", "id_norma").distinct()
    n = n.join(degree, "id_norma", "left").withColumn("citas", F.coalesce("citas", F.lit(0)))
    best = catalog.first_per_group(n, "clave", [F.desc("citas"), F.col("id_norma").cast("bigint")], 10)
    return cases.select("case_id", "clave").join(best, "clave").select("case_id", "id_norma", "citas", F.col("orden").cast("bigint").alias("orden"))


_REASON = "case when boost <= 1 then {none} when boost < 2 then {ref} when clase = 'reglamento_base' then {a} when clase = 'fija_valores' then {b} when clase = 'modifica' then {c} else {d} end"


@query("compliance_report",
       f"""with {LINK_SQL}, art as (select cast(l_orderkey as string) as id_norma, l_linenumber as numero, round(max(l_extendedprice) / 10000 - 4, 3) as score from lineitem group by all),
 sc as (select l_suppkey as query_id, cast(l_orderkey as string) as id_norma, l_linenumber as numero, round(max(l_extendedprice) / 10000 - 4, 3) as score from lineitem group by all having round(max(l_extendedprice) / 10000 - 4, 3) > -3.0),
 top as (select *, row_number() over (partition by query_id order by score desc, id_norma, numero) as r from sc qualify r <= 50),
 b as (select l_suppkey as query_id, cast(l_orderkey as string) as id_norma, cast(2.0 as double) as boost from lineitem where l_discount >= 0.1 and l_linenumber = 1 union select l_suppkey, src, 1.3 from lineitem join links on dst = cast(l_orderkey as string) where l_discount >= 0.1 and l_linenumber = 1),
 bb as (select query_id, id_norma, max(boost) as boost from b group by all),
 inj as (select m.query_id, id_norma, numero, score from (select query_id, id_norma from bb where boost >= 2 except select query_id, id_norma from top) m join (select * from art qualify row_number() over (partition by id_norma order by numero) <= 5) using (id_norma) where score > -3.0),
 lift as (select query_id, id_norma, numero, coalesce(boost, 1.0) as boost, round(cast(score * coalesce(boost, 1.0) as double), 3) as alzado from (select query_id, id_norma, numero, score from top union all select * from inj) left join bb using (query_id, id_norma)),
 cl as (select id_norma, clase from ({CLASSES_SQL.format(src=norms_sql('id_norma', 'titulo'))})),
 g as (select query_id, id_norma, max(alzado) as mejor, count(*) as articulos, any_value(boost) as boost, list(numero order by alzado desc, numero) as lista from lift group by all),
 f as (select *, max(boost) over (partition by query_id) as mb from g left join cl using (id_norma))
 select query_id, id_norma, mejor, articulos, round(cast(boost as double), 1) as boost, lista, {_REASON.format(none="''", ref="'referencia a definitoria'", a="'define concepto'", b="'aplica concepto'", c="'modifica definición'", d="'menciona concepto'")} as razon,
 row_number() over (partition by query_id order by {_REASON.format(none=5, ref=4, a=0, b=1, c=3, d=2)}, mejor desc, id_norma) as orden,
 cast(sum(articulos) over (partition by query_id) as bigint) as total_articulos, count(*) over (partition by query_id) as total_normas from f where mb <= 1 or boost > 1""")
def _(spark, d):
    """Threshold, injected articles of missing norms, boost, norms by reason and score with their articles in order, totals; boosted norms alone when there are any"""
    from lexmesh.plans.retrieval import compliance
    lines = table(spark, d, "lineitem", "l_suppkey", "l_orderkey", "l_linenumber", "l_extendedprice", "l_discount")
    price = F.round(F.max("l_extendedprice") / 10000 - 4, 3).alias("score")
    article = (F.col("l_orderkey").cast("string").alias("id_norma"), F.col("l_linenumber").alias("numero"))
    scored = lines.groupBy(F.col("l_suppkey").alias("query_id"), *article).agg(price)
    articles = lines.groupBy(*article).agg(price).withColumn("place", F.col("numero"))
    defines = lines.where((F.col("l_discount") >= 0.1) & (F.col("l_linenumber") == 1)).select(
        F.col("l_suppkey").alias("query_id"), F.col("l_suppkey").alias("concept"), F.col("l_orderkey").cast("string").alias("norm"))
    boosts = written(graph.context_boosts(defines.select("query_id", "concept").distinct(), defines.select("norm", "concept"), links(spark, d)))
    classes = norms(spark, d, "id_norma", "titulo").select("id_norma", classify.norm_class(F.col("titulo")).alias("clase"))
    return compliance(scored, boosts, articles, classes, 50)
