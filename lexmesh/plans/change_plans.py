"""Queries over incremental change, upserts and the streamed question log."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from lexmesh.functions import text as T
from lexmesh.operators import increments as I
from lexmesh.plans.graph_plans import LINK_SQL, links
from lexmesh.plans.register import query
from lexmesh.plans.views import norms, norms_sql
from lexmesh.session import shared_folder
from lexmesh.sources.keyed import KeyedTable
from lexmesh.sources.tables import table, texts as rows
from lexmesh.streaming import query_log

_SNAP_SQL = "snap as (select doc_id as id, md5(text) as h from documents where source <> 'src3'), st as (select doc_id as id, case when lang = 'es' then null when lang = 'de' then 'viejo' else md5(text) end as h, case when n_chars < 1000 then 'pending' else 'downloaded' end as estado from documents where source <> 'src7')"


def snapshot(spark, d):
    docs = rows(spark, d, "documents", "doc_id", "text", "source").where(F.col("source") != "src3")
    return docs.select(F.col("doc_id").alias("id"), F.md5("text").alias("hash"))


def state(spark, d):
    docs = rows(spark, d, "documents", "doc_id", "text", "source", "lang", "n_chars").where(F.col("source") != "src7")
    return docs.select(
        F.col("doc_id").alias("id"), F.when(F.col("lang") == "es", F.lit(None).cast("string")).when(F.col("lang") == "de", "viejo").otherwise(F.md5("text")).alias("hash"),
        F.when(F.col("n_chars") < 1000, "pending").otherwise("downloaded").alias("estado"))


@query("index_diff", f"with {_SNAP_SQL} select id, case when st.id is null then 'new' when snap.id is null then 'gone' else 'outdated' end as cambio from snap full join st using (id) where st.id is null or snap.id is null or (snap.h is distinct from st.h and estado = 'downloaded')")
def _(spark, d):
    """U3, I1"""
    return I.index_diff(snapshot(spark, d), state(spark, d))


@query("content_changes", f"with {_SNAP_SQL} select id, st.h as antes, snap.h as ahora from snap join st using (id) where snap.h <> st.h")
def _(spark, d):
    """I2, T15"""
    return I.content_changes(snapshot(spark, d), state(spark, d).select("id", "hash"))


@query("new_modifications", f"with {LINK_SQL} select dst as id_norma, src as modificador from links where kind = 'MODIFICA' and src not in (select id_norma from ({norms_sql('id_norma', 'fecha')}) where fecha < date '1998-01-01')")
def _(spark, d):
    """Modifications absent from the snapshot of the end of 1997"""
    mods = links(spark, d).where(F.col("kind") == "MODIFICA").select(F.col("dst").alias("id_norma"), F.col("src").alias("modificador"))
    old = norms(spark, d, "id_norma", "fecha").where(F.col("fecha") < F.lit("1998-01-01").cast("date")).select(F.col("id_norma").alias("modificador"))
    before = mods.join(old, "modificador", "left_semi")
    return mods.join(before, ["id_norma", "modificador"], "left_anti")


_UP_SQL = """select l_orderkey, l_linenumber, first(l_partkey order by layer desc, seq desc, l_partkey desc) as l_partkey from (select *, 0 as layer, l_suppkey as seq from lineitem where l_returnflag <> 'R' union all select *, 1, l_suppkey from lineitem where l_returnflag = 'R') group by all"""


@query("upsert_articles", _UP_SQL)
def _(spark, d):
    """Returned lines are the new batch, the last writer wins by (norm, article)"""
    rows = table(spark, d, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag").withColumn("seq", F.struct("l_suppkey", "l_partkey"))
    old, new = (rows.where(c).drop("l_returnflag", "l_suppkey") for c in (F.col("l_returnflag") != "R", F.col("l_returnflag") == "R"))
    return I.upsert(old, new, ["l_orderkey", "l_linenumber"])


@query("point_lookup", "select o_orderkey, o_totalprice from orders where o_orderkey = (select max(l_orderkey) from lineitem where l_shipdate = (select min(l_shipdate) from lineitem))")
def _(spark, d):
    """One norm by key, the key being the newest order of the first shipping day"""
    lines = table(spark, d, "lineitem", "l_orderkey", "l_shipdate")
    first = lines.agg(F.min("l_shipdate")).scalar()
    key = lines.where(F.col("l_shipdate") == first).agg(F.max("l_orderkey")).scalar()
    return table(spark, d, "orders", "o_orderkey", "o_totalprice").where(F.col("o_orderkey") == key)


@query("delete_and_rebuild", """select l_orderkey, l_linenumber, l_quantity, 'viejo' as origen from lineitem where l_orderkey not in (select l_orderkey from lineitem where l_quantity >= 50) union all select l_orderkey, 1, sum(l_quantity), 'nuevo' from lineitem where l_orderkey in (select l_orderkey from lineitem where l_quantity >= 50) group by l_orderkey""")
def _(spark, d):
    """Orders with a full lot are rebuilt as one line"""
    lines = table(spark, d, "lineitem", "l_orderkey", "l_linenumber", "l_quantity")
    touched = lines.where(F.col("l_quantity") >= 50)
    rebuilt = lines.join(touched.select("l_orderkey").distinct(), "l_orderkey", "left_semi").groupBy("l_orderkey").agg(
        F.lit(1).alias("l_linenumber"), F.sum("l_quantity").alias("l_quantity"), F.lit("nuevo").alias("origen"))
    return I.rebuild(lines.withColumn("origen", F.lit("viejo")), touched, rebuilt, ["l_orderkey"])


@query("pending_downloads", f"with {LINK_SQL}, deg as (select src as id, count(*) as n from links group by src) select cast(o_orderkey as string) as id_norma, coalesce(n, 0) as enlaces from orders left join deg on id = cast(o_orderkey as string) where o_orderkey not in (select doc_id from documents where n_chars > 500) order by enlaces desc, o_orderkey limit 200")
def _(spark, d):
    """Not yet downloaded, most linked first"""
    degree = links(spark, d).groupBy(F.col("src").alias("id_norma")).agg(F.count(F.lit(1)).alias("n"))
    wanted = table(spark, d, "orders", "o_orderkey").select(F.col("o_orderkey").cast("string").alias("id_norma")).join(degree, "id_norma", "left").select(
        "id_norma", F.coalesce("n", F.lit(0)).alias("enlaces"))
    done = rows(spark, d, "documents", "doc_id", "n_chars").where(F.col("n_chars") > 500).select(F.col("doc_id").cast("string").alias("id_norma"))
    return I.pending(wanted, done, "id_norma", [F.desc("enlaces"), F.col("id_norma").cast("bigint").asc()], 200)


@query("merge_metadata", "select o_orderkey, 'b' || o_orderstatus as clase, case when o_orderstatus = 'F' then 'parche' else 'base' end as origen, case when o_orderstatus = 'F' then o_orderpriority end as extra from orders")
def _(spark, d):
    """Shallow merge, the patch wins, a missing patch changes nothing"""
    base = F.create_map(F.lit("clase"), F.concat(F.lit("b"), F.col("o_orderstatus")), F.lit("origen"), F.lit("base"))
    patch = F.when(F.col("o_orderstatus") == "F", F.create_map(F.lit("origen"), F.lit("parche"), F.lit("extra"), F.col("o_orderpriority")))
    m = table(spark, d, "orders", "o_orderkey", "o_orderstatus", "o_orderpriority").select("o_orderkey", I.merge_metadata(base, patch).alias("m"))
    at = lambda k: F.try_element_at("m", F.lit(k)).alias(k)
    return m.select("o_orderkey", at("clase"), at("origen"), at("extra"))


@query("json_slices", """select event_id, cast(regexp_extract(props, '"k": ([0-9]+)', 1) as int) as k from events""")
def _(spark, d):
    """JSON inside free text"""
    said = F.concat(F.lit("Propuesta: "), F.col("props"), F.lit(" fin"))
    return table(spark, d, "events", "event_id", "props").select(
        "event_id", F.from_json(I.json_slice(said), "k int")["k"].alias("k"))


@query("daily_log_stream", "select cast(cast(ts as date) as string) as dia, event_type as rama, count(*) as n, round(sum(value), 4) as total from events group by all")
def _(spark, d):
    """The log read as a stream, daily windows with a watermark, landed as parquet"""
    return query_log.daily_report(spark, d)


@query("changed_documents_stream", "select lang, count(*) as n, count(distinct md5(text)) as distintos from documents group by lang")
def _(spark, d):
    """Documents arrive as a stream, each batch is upserted into the buckets it touches; this query names no job folder, so it starts anew"""
    landed = query_log.ingest_documents(spark, d)
    per_hash = landed.groupBy("lang", "hash").agg(F.count(F.lit(1)).alias("n"))
    return per_hash.groupBy("lang").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("distintos"))


@query("keyed_upserts",
       """with old as (select l_orderkey, l_linenumber, max(l_quantity) as l_quantity from lineitem group by all), new as (select l_orderkey, l_linenumber, max(l_quantity) * 2 as l_quantity from lineitem where l_returnflag = 'R' and l_linenumber = 1 group by all)
 select l_orderkey, l_linenumber, coalesce(n.l_quantity, o.l_quantity) as l_quantity, true as fechado from old o left join new n using (l_orderkey, l_linenumber) where l_orderkey % 10 <> 3""")
def _(spark, d):
    """A keyed table is filled, changed and cut; rows carry the time of their last change"""
    lines = table(spark, d, "lineitem", "l_orderkey", "l_linenumber", "l_quantity", "l_returnflag")
    keyed = KeyedTable(spark, f"{shared_folder(spark)}/keyed/{uuid.uuid4().hex}", ["l_orderkey", "l_linenumber"], buckets=16)
    keyed.upsert(lines.groupBy("l_orderkey", "l_linenumber").agg(F.max("l_quantity").alias("l_quantity")))
    keyed.upsert(lines.where("l_returnflag = 'R' and l_linenumber = 1").groupBy("l_orderkey", "l_linenumber").agg((F.max("l_quantity") * 2).alias("l_quantity")))
    keyed.delete(lines.where("l_orderkey % 10 = 3").select("l_orderkey", "l_linenumber"))
    return keyed.read().select("l_orderkey", "l_linenumber", "l_quantity", F.col("updated_at").isNotNull().alias("fechado"))
