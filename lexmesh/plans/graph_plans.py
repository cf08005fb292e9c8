"""Queries over edges: title relations between norms, and article -> concept links."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexmesh.functions import text as T
from lexmesh.operators import graph, references
from lexmesh.plans.register import query
from lexmesh.plans.text_plans import CLASSES_SQL
from lexmesh.plans.views import CONCEPTS_SQL, EDGES_SQL, concepts, edges, norms, norms_sql
from lexmesh.sources.tables import table

# What the title patterns find in the derived titles, read off the order row.
REL_SQL = f"""rel as (select id_norma,
 case prioridad when '1-URGENT' then 'MODIFICA' when '2-HIGH' then 'REGLAMENTA' when '3-MEDIUM' then 'SUSTITUYE' when '4-NOT SPECIFIED' then 'DEROGA' else 'COMPLEMENTA' end as relacion,
 case prioridad when '2-HIGH' then 'LEY' when '3-MEDIUM' then 'RESOLUCION' when '4-NOT SPECIFIED' then 'LEY' else 'DECRETO' end as tipo_destino, ref as numero_destino,
 case when prioridad in ('1-URGENT', '3-MEDIUM') then cast(regexp_extract(titulo, 'DE ([0-9]{{4}})$', 1) as int) end as anio_destino, '' as descripcion
 from ({norms_sql('id_norma', 'titulo', 'prioridad', 'ref')}))"""
CAT_SQL = f"""cat as (select tipo as tipo_destino, numero as numero_destino, arg_max(id_norma, coalesce(year(fecha), 0) * 1000000000 - cast(id_norma as bigint)) as destino from ({norms_sql('id_norma', 'tipo', 'numero', 'fecha')}) group by all)"""
LINK_SQL = f"{REL_SQL}, {CAT_SQL}, links as (select id_norma as src, destino as dst, relacion as kind from rel join cat using (tipo_destino, numero_destino))"


def title_relations(spark, d):
    return references.title_relations(norms(spark, d, "id_norma", "titulo"), ["id_norma"])


def links(spark, d):
    resolved = references.resolve(title_relations(spark, d), norms(spark, d, "id_norma", "tipo", "numero", "fecha"))
    return resolved.where(F.col("destino").isNotNull()).select(
        F.col("id_norma").alias("src"), F.col("destino").alias("dst"), F.col("relacion").alias("kind"))


@query("title_relations", f"with {REL_SQL} select * from rel")
def _(spark, d):
    """E17"""
    return title_relations(spark, d)


@query("relation_batch_stats", f"with {REL_SQL} select relacion, count(*) as n, count(anio_destino) as con_anio from rel group by relacion")
def _(spark, d):
    """A27"""
    return title_relations(spark, d).groupBy("relacion").agg(F.count(F.lit(1)).alias("n"), F.count("anio_destino").alias("con_anio"))


@query("resolve_by_number", f"with {REL_SQL}, {CAT_SQL} select id_norma, tipo_destino || '_' || numero_destino as llave, destino from rel left join cat using (tipo_destino, numero_destino)")
def _(spark, d):
    """J10"""
    r = references.resolve(title_relations(spark, d), norms(spark, d, "id_norma", "tipo", "numero", "fecha"))
    return r.select("id_norma", F.concat_ws("_", "tipo_destino", "numero_destino").alias("llave"), "destino")


@query("resolve_by_number_and_year",
       f"""with {REL_SQL}, cands as (select tipo as tipo_destino, numero as numero_destino, year(fecha) as anio, cast(id_norma as bigint) as cid from ({norms_sql('id_norma', 'tipo', 'numero', 'fecha')}))
 select r.id_norma, r.relacion, coalesce(min(case when c.anio = r.anio_destino then c.cid end), min(c.cid)) as destino from rel r left join cands c using (tipo_destino, numero_destino) group by r.id_norma, r.relacion""")
def _(spark, d):
    """J11"""
    r = references.resolve_with_year(title_relations(spark, d), norms(spark, d, "id_norma", "tipo", "numero", "fecha"))
    return r.select("id_norma", "relacion", "destino")


@query("resolve_across_types",
       f"""with {REL_SQL}, {CAT_SQL}, tries as (select id_norma, tipo_destino as pedido, numero_destino, unnest([{{'p': 0, 't': tipo_destino}}, {{'p': 1, 't': 'DECRETO'}}, {{'p': 2, 't': 'LEY'}}, {{'p': 3, 't': 'DFL'}}, {{'p': 4, 't': 'RESOLUCION'}}]) as x from rel)
 select t.id_norma, t.pedido as tipo_destino, t.numero_destino, arg_min(c.destino, t.x.p) as destino from tries t join cat c on c.tipo_destino = t.x.t and c.numero_destino = t.numero_destino group by 1, 2, 3""")
def _(spark, d):
    """J9"""
    return references.resolve_across_types(
        title_relations(spark, d), norms(spark, d, "id_norma", "tipo", "numero", "fecha"), ["DECRETO", "LEY", "DFL", "RESOLUCION"])


@query("relations_both_ways", f"with {LINK_SQL} select src as id_norma, dst as otra, kind || ':sale' as sentido from links union all select dst, src, kind || ':entra' from links")
def _(spark, d):
    """J15"""
    ways = F.explode(F.array(
        F.struct(F.col("src").alias("id_norma"), F.col("dst").alias("otra"), F.concat("kind", F.lit(":sale")).alias("sentido")),
        F.struct(F.col("dst").alias("id_norma"), F.col("src").alias("otra"), F.concat("kind", F.lit(":entra")).alias("sentido"))))
    return links(spark, d).select(ways.alias("w")).select("w.*")


@query("in_references", f"with {LINK_SQL} select l.dst as id_norma, l.src as citante, l.kind as via, n.titulo from links l join ({norms_sql('id_norma', 'titulo')}) n on n.id_norma = l.src")
def _(spark, d):
    """G2"""
    n = norms(spark, d, "id_norma", "titulo").withColumnRenamed("id_norma", "src")
    return links(spark, d).join(n, "src").select(F.col("dst").alias("id_norma"), F.col("src").alias("citante"), F.col("kind").alias("via"), "titulo")


@query("most_referenced", f"with {LINK_SQL} select dst as id_norma, count(*) as refs, count(distinct kind) as tipos from links group by dst order by refs desc, dst limit 15")
def _(spark, d):
    """A5, K1"""
    per_kind = links(spark, d).groupBy("dst", "kind").agg(F.count(F.lit(1)).alias("n"))
    totals = per_kind.groupBy(F.col("dst").alias("id_norma")).agg(F.sum("n").alias("refs"), F.count(F.lit(1)).alias("tipos"))
    return totals.orderBy(F.desc("refs"), "id_norma").limit(15)


@query("in_degree_by_kind", f"with {LINK_SQL} select dst, count(*) as grado from links where kind in ('MODIFICA', 'DEROGA') group by dst")
def _(spark, d):
    """A6"""
    return graph.in_degree(links(spark, d), ["MODIFICA", "DEROGA"])


@query("modification_chains", f"with {LINK_SQL} select dst as id_norma, count(*) as modificadores, min(cast(src as bigint)) as primero from links where kind = 'MODIFICA' group by dst having count(*) > 1")
def _(spark, d):
    """G5"""
    mods = links(spark, d).where(F.col("kind") == "MODIFICA")
    return mods.groupBy(F.col("dst").alias("id_norma")).agg(
        F.count(F.lit(1)).alias("modificadores"), F.min(F.col("src").cast("bigint")).alias("primero")).where(F.col("modificadores") > 1)


@query("orphan_norms", f"with {LINK_SQL} select id_norma from ({norms_sql('id_norma')}) where id_norma not in (select src from links) and id_norma not in (select dst from links)")
def _(spark, d):
    """J7"""
    return graph.orphans(norms(spark, d, "id_norma"), links(spark, d))


@query("related_subgraph", f"with {LINK_SQL} select id_norma, tipo || ' ' || numero as etiqueta from ({norms_sql('id_norma', 'tipo', 'numero')}) where id_norma in (select src from links union select dst from links)")
def _(spark, d):
    """Nodes with at least one relation"""
    touched = links(spark, d).select(F.explode(F.array("src", "dst")).alias("id_norma"))
    n = norms(spark, d, "id_norma", "tipo", "numero").join(touched, "id_norma", "left_semi")
    return n.select("id_norma", F.concat_ws(" ", "tipo", "numero").alias("etiqueta"))


@query("reach_two_levels",
       f"""with {LINK_SQL}, hub as (select dst as node from links group by dst order by count(*) desc, dst limit 1), und as (select dst as a, src as b from links),
 l1 as (select distinct b as node from und join hub on a = node where b not in (select node from hub)), l2 as (select distinct b as node from und join l1 on a = l1.node where b not in (select node from hub) and b not in (select node from l1))
 select node, 1 as level from l1 union all select node, 2 from l2""")
def _(spark, d):
    """Who cites the most cited norm, directly or in two steps"""
    e = links(spark, d)
    hub = graph.in_degree(e).orderBy(F.desc("grado"), "dst").limit(1).select(F.col("dst").alias("node"))
    backwards = e.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return graph.reach(backwards, hub, 2)


@query("weak_components",
       f"""with recursive {LINK_SQL}, und as materialized (select cast(src as bigint) as a, cast(dst as bigint) as b from links union select cast(dst as bigint), cast(src as bigint) from links),
 cc(node, comp) using key (node) as (select o_orderkey, o_orderkey from orders union (select c.node, min(o.comp) as comp from recurring.cc c join und on und.a = c.node join recurring.cc o on o.node = und.b where o.comp < c.comp group by c.node))
 select comp as component, count(*) as tamano from cc group by comp""")
def _(spark, d):
    """Component sizes"""
    e = links(spark, d).select(F.col("src").cast("bigint").alias("src"), F.col("dst").cast("bigint").alias("dst"))
    nodes = norms(spark, d, "id_norma").select(F.col("id_norma").cast("bigint").alias("node"))
    return graph.components(nodes, e).groupBy("component").agg(F.count(F.lit(1)).alias("tamano"))


@query("graph_density", f"with {LINK_SQL} select count(*) as nodos, any_value(m) as aristas, round(any_value(m) / (count(*) * (count(*) - 1.0)), 9) as densidad from orders, (select count(*) as m from (select distinct src, dst from links))")
def _(spark, d):
    """A26"""
    return graph.density(table(spark, d, "orders", "o_orderkey"), links(spark, d))


@query("status_after_relations",
       f"""with {LINK_SQL}, st as (select id_norma, case when prioridad = '5-LOW' then 'VIGENTE' else 'DESCONOCIDO' end as estado from ({norms_sql('id_norma', 'prioridad')}))
 select id_norma, case when id_norma in (select dst from links where kind = 'DEROGA') then 'DEROGADA' when estado = 'DESCONOCIDO' and id_norma in (select dst from links where kind = 'MODIFICA') then 'MODIFICADA' else estado end as estado from st""")
def _(spark, d):
    """G7"""
    rel = links(spark, d).select(F.col("dst").alias("destino"), F.col("kind").alias("relacion"))
    n = norms(spark, d, "id_norma", "prioridad").select(
        "id_norma", F.when(F.col("prioridad") == "5-LOW", "VIGENTE").otherwise("DESCONOCIDO").alias("estado"))
    return graph.status_after(rel, n)


@query("one_edge_per_pair",
       f"with e as ({EDGES_SQL}) select id_norma as src, concepto_id as dst, arg_max(kind, cast(numero as int)) as kind from e group by all")
def _(spark, d):
    """Graph with one edge per pair, the last layer wins"""
    e = edges(spark, d).select(F.col("id_norma").alias("src"), F.col("concepto_id").alias("dst"), "kind", F.col("numero").cast("int").alias("layer"))
    return graph.last_layer(e)


@query("multi_defined_concepts",
       f"with e as (select distinct id_norma as src, concepto_id as dst from ({EDGES_SQL}) where kind = 'define_termino'), c as (select dst, count(*) as n_defs from e group by dst having count(*) > 1) select dst, n_defs, src from e join c using (dst)")
def _(spark, d):
    """A7"""
    e = edges(spark, d).where(F.col("kind") == "define_termino").select(F.col("id_norma").alias("src"), F.col("concepto_id").alias("dst"))
    return graph.multiply_defined(e)


@query("singly_defined_concepts",
       f"select concepto_id, nombre from ({CONCEPTS_SQL}) where concepto_id in (select concepto_id from ({EDGES_SQL}) where kind = 'define_termino' group by concepto_id having count(distinct articulo_id) = 1)")
def _(spark, d):
    """J5, A15"""
    defs = edges(spark, d).where(F.col("kind") == "define_termino").select("concepto_id", "articulo_id").distinct()
    once = defs.groupBy("concepto_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == 1)
    return concepts(spark, d).join(once, "concepto_id", "left_semi").select("concepto_id", "nombre")


@query("where_defined",
       f"select c.concepto_id, c.nombre, e.id_norma, n.titulo from ({CONCEPTS_SQL}) c join ({EDGES_SQL}) e using (concepto_id) join ({norms_sql('id_norma', 'titulo')}) n using (id_norma) where e.kind = 'define_termino' and contains(lower(c.nombre), 'ring')")
def _(spark, d):
    """Definers of concepts whose name holds a word"""
    named = concepts(spark, d).where(F.contains(F.lower("nombre"), F.lit("ring"))).select("concepto_id", "nombre")
    e = edges(spark, d).where(F.col("kind") == "define_termino").select("concepto_id", "id_norma")
    return named.join(e, "concepto_id").join(norms(spark, d, "id_norma", "titulo"), "id_norma")


@query("norm_concept_view", f"select distinct id_norma, concepto_id, kind as relacion from ({EDGES_SQL}) where concepto_id is not null")
def _(spark, d):
    """View norm -> concept"""
    return edges(spark, d).where(F.col("concepto_id").isNotNull()).select("id_norma", "concepto_id", F.col("kind").alias("relacion")).distinct()


@query("norm_norm_view",
       f"""with {LINK_SQL}, refs as (select case when kind = 'MODIFICA' then cast(src as bigint) * 10 + 1 end as origen_articulo, case when kind <> 'MODIFICA' then src end as origen_norma, dst as destino_norma, kind from links),
 arts as (select distinct l_orderkey * 10 + l_linenumber as articulo_id, cast(l_orderkey as string) as id_norma from lineitem)
 select distinct coalesce(a.id_norma, r.origen_norma) as origen, r.destino_norma as destino, r.kind as tipo from refs r left join arts a on a.articulo_id = r.origen_articulo where r.destino_norma is not null""")
def _(spark, d):
    """Double left join, coalesce, distinct"""
    modifies = F.col("kind") == "MODIFICA"
    refs = links(spark, d).select(
        F.when(modifies, F.col("src").cast("bigint") * 10 + 1).alias("articulo_id"),
        F.when(~modifies, F.col("src")).alias("origen_norma"), F.col("dst").alias("destino"), F.col("kind").alias("tipo"))
    arts = table(spark, d, "lineitem", "l_orderkey", "l_linenumber").select(
        F.expr("l_orderkey * 10 + l_linenumber").alias("articulo_id"), F.col("l_orderkey").cast("string").alias("id_norma")).distinct()
    return references.with_norms_of_articles(refs, arts).where(F.col("destino").isNotNull()).select(
        F.coalesce("id_norma", "origen_norma").alias("origen"), "destino", "tipo").distinct()


@query("edge_violations", f"select articulo_id, concepto_id, kind, confianza, count(*) as n from ({EDGES_SQL}) where confianza > 0.82 or kind not in ('cita','define_termino','remite','aplica','modifica','complementa','deroga','referencia_implicita') group by all")
def _(spark, d):
    """E16, edge constraints: confidences above one once stretched"""
    stretched = edges(spark, d).withColumn("confianza", F.col("confianza") + 0.18)
    bad = references.edge_violations(stretched)
    return bad.select("articulo_id", "concepto_id", "kind", F.round(F.col("confianza") - 0.18, 2).alias("confianza")).groupBy(
        "articulo_id", "concepto_id", "kind", "confianza").agg(F.count(F.lit(1)).alias("n"))


@query("reference_edges",
       """select o_orderkey as ref_id, case when o_orderstatus = 'F' then o_orderkey end as origen_articulo, case when o_orderstatus <> 'F' then cast(o_orderkey as string) end as origen_norma, kinds as n_destinos
 from (select *, (case when o_custkey % 2 = 0 then 1 else 0 end) + (case when o_custkey % 3 = 0 then 1 else 0 end) + (case when o_custkey % 5 = 0 then 1 else 0 end) as kinds from orders) where kinds = 1""")
def _(spark, d):
    """Exactly one target; the origin falls back to the norm"""
    n = F.col("o_custkey")
    refs = table(spark, d, "orders", "o_orderkey", "o_orderstatus", "o_custkey").select(
        F.col("o_orderkey").alias("ref_id"),
        F.when(F.col("o_orderstatus") == "F", F.col("o_orderkey")).alias("origen_articulo"),
        F.col("o_orderkey").cast("string").alias("origen_norma"),
        F.when(n % 2 == 0, n).alias("destino_articulo"), F.when(n % 3 == 0, n.cast("string")).alias("destino_norma"),
        F.when(n % 5 == 0, n).alias("destino_concepto"))
    return references.to_edges(refs).select("ref_id", "origen_articulo", "origen_norma", F.lit(1).alias("n_destinos"))


@query("context_boosts",
       f"""with {LINK_SQL}, q as (select distinct l_returnflag || l_linestatus as estado, l_partkey as concepto_id from lineitem where l_quantity >= 50), defs as (select distinct id_norma, concepto_id from ({EDGES_SQL}) where kind = 'define_termino'),
 def2 as (select distinct estado, id_norma from q join defs using (concepto_id)), ref2 as (select estado, src as id_norma from def2 join links on dst = id_norma)
 select estado as query_id, id_norma as norm, max(b) as boost from (select *, cast(2.0 as double) as b from def2 union all select *, cast(1.3 as double) from ref2) group by all""")
def _(spark, d):
    """Questions are line states asking about the parts they sell in full lots"""
    asked = table(spark, d, "lineitem", "l_returnflag", "l_linestatus", "l_partkey", "l_quantity").where(F.col("l_quantity") >= 50).select(
        F.concat("l_returnflag", "l_linestatus").alias("query_id"), F.col("l_partkey").alias("concept")).distinct()
    defs = edges(spark, d).where(F.col("kind") == "define_termino").select(F.col("id_norma").alias("norm"), F.col("concepto_id").alias("concept")).distinct()
    return graph.context_boosts(asked, defs, links(spark, d))
