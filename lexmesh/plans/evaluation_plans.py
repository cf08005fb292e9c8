"""Queries that evaluate retrieval, answers and the question log."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexmesh.functions import classify, lexicon as L, text as T
from lexmesh.operators import evaluation as E, fusion, quantiles
from lexmesh.plans.concept_plans import ASKED_SQL, _DEFINED_SQL, index
from lexmesh.plans.register import query
from lexmesh.plans.text_plans import content_sql, normalize_sql
from lexmesh.plans.views import CONCEPTS_SQL, concepts, norms, norms_sql
from lexmesh.sources.tables import table, texts as rows


@query("log_by_branch", """select event_type as rama, count(*) as n, round(quantile_cont(value, 0.5), 6) as p50, round(quantile_cont(value, 0.95), 6) as p95,
 round(avg(case when cast(regexp_extract(props, '([0-9]+)', 1) as int) % 2 = 0 then 1.0 else 0.0 end), 6) as grounding from events where ts > (select max(ts) from events) - interval 30 day group by event_type""")
def _(spark, d):
    """The last thirty days of the log, clock pinned to its newest entry"""
    log = table(spark, d, "events", "ts", "event_type", "value", "props")
    newest = log.agg(F.max("ts")).scalar()
    recent = log.where(F.col("ts") > newest - F.expr("INTERVAL 30 DAYS"))
    k = F.get_json_object("props", "$.k").cast("int")
    sums = recent.groupBy(F.col("event_type").alias("rama")).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg(F.when(k % 2 == 0, 1.0).otherwise(0.0)), 6).alias("grounding"))
    q = quantiles.exact_quantiles(recent.withColumnRenamed("event_type", "rama"), ["rama"], "value", [0.5, 0.95])
    return sums.join(q, "rama").select("rama", "n", F.round("q0", 6).alias("p50"), F.round("q1", 6).alias("p95"), "grounding")


@query("latency_percentiles", "select cast(floor(quantile_cont(value * 1000, 0.5)) as bigint) as p50, cast(floor(quantile_cont(value * 1000, 0.95)) as bigint) as p95, cast(floor(quantile_cont(value * 1000, 0.99)) as bigint) as p99 from events")
def _(spark, d):
    """A3"""
    return E.latency_percentiles(table(spark, d, "events", "value").select((F.col("value") * 1000).alias("ms")), "ms")


@query("price_quantiles", "select l_returnflag, l_linestatus, quantile_cont(l_extendedprice, 0.25) as p25, quantile_cont(l_extendedprice, 0.5) as p50, quantile_cont(l_extendedprice, 0.99) as p99 from lineitem group by all".replace("quantile_cont(", "round(quantile_cont(").replace(") as p", "), 4) as p"))
def _(spark, d):
    """A2 at fact-table size"""
    q = quantiles.exact_quantiles(table(spark, d, "lineitem", "l_returnflag", "l_linestatus", "l_extendedprice"), ["l_returnflag", "l_linestatus"], "l_extendedprice", [0.25, 0.5, 0.99])
    return q.select("l_returnflag", "l_linestatus", *[F.round(f"q{i}", 4).alias(f"p{p}") for i, p in enumerate((25, 50, 99))])


@query("hang_rate", "select event_type as rama, count(*) as n, count(*) filter (where value * 1000 >= 300000) as colgadas, round(count(*) filter (where value * 1000 >= 300000) / count(*), 6) as tasa from events group by event_type")
def _(spark, d):
    """A24"""
    hang = (F.col("value") * 1000 >= L.HANG_MS).cast("bigint")
    return table(spark, d, "events", "event_type", "value").groupBy(F.col("event_type").alias("rama")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(hang).alias("colgadas"), E.share(F.sum(hang), F.count(F.lit(1))).alias("tasa"))


_RUNS_SQL = """runs as (select case when day(ts) <= 15 then 'run1' else 'run2' end as run, case when user_id < 30 then 'negative' when user_id < 60 then 'offdomain' else 'electric' end as dominio, event_type <> 'error' as answered, cast(regexp_extract(props, '([0-9]+)', 1) as int) % 2 = 0 as grounded from events)"""


@query("run_decomposition", f"""with {_RUNS_SQL}, r as (select run, dominio, count(*) as n, count(*) filter (where answered) / count(*) as a, count(*) filter (where answered and grounded) / count(*) filter (where answered) as ga, count(*) filter (where grounded) / count(*) as gt from runs group by all)
 select dominio, sum(n) as n, round(avg(a), 6) as answered, round(avg(ga), 6) as grounded_given_answer, round(avg(gt), 6) as grounded_total from r group by dominio""")
def _(spark, d):
    """Rates per bucket, averaged over two runs"""
    log = table(spark, d, "events", "ts", "user_id", "event_type", "props")
    norm = F.when(F.col("user_id") >= 30, F.when(F.col("user_id") < 60, "off").otherwise("elec"))
    rows = log.select(
        F.when(F.dayofmonth("ts") <= 15, "run1").otherwise("run2").alias("run"), classify.domain_class(norm, ["off"]).alias("dominio"),
        (F.col("event_type") != "error").alias("answered"), (F.get_json_object("props", "$.k").cast("int") % 2 == 0).alias("grounded"))
    one = lambda c: F.sum(c.cast("bigint"))
    per_run = rows.groupBy("run", "dominio").agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.col("answered").cast("int")).alias("a"),
        (one(F.col("answered") & F.col("grounded")) / one(F.col("answered"))).alias("ga"), F.avg(F.col("grounded").cast("int")).alias("gt"))
    return per_run.groupBy("dominio").agg(
        F.sum("n").alias("n"), F.round(F.avg("a"), 6).alias("answered"), F.round(F.avg("ga"), 6).alias("grounded_given_answer"), F.round(F.avg("gt"), 6).alias("grounded_total"))


# Expected (norm, article) per customer: the dearest order line; the pool: the customer's best five.
_EVAL_SQL = """pool as (select o_custkey as query_id, cast(l_orderkey as string) as id_norma, cast(l_linenumber as string) || '°' as numero, max(l_extendedprice) as score from lineitem join orders on o_orderkey = l_orderkey group by all),
 best as (select *, row_number() over (partition by query_id order by score desc, id_norma, numero) as rank from pool qualify rank <= 5),
 expd as (select c_custkey as query_id, c_mktsegment as category, case when c_acctbal < 0 then null else cast(o as string) end as expected_norma, case when c_acctbal > 5000 then null else cast(1 + c_custkey % 7 as string) end as expected_articulo from customer left join (select o_custkey, min(o_orderkey) as o from orders group by o_custkey) on o_custkey = c_custkey),
 hits as (select e.query_id, any_value(e.category) as category, any_value(e.expected_norma) as expected_norma, coalesce(bool_or(b.id_norma = e.expected_norma), false) as norm_hit,
   coalesce(bool_or(b.id_norma = e.expected_norma and (e.expected_articulo is null or replace(b.numero, '°', '') = e.expected_articulo)), false) as hit from expd e left join best b on b.query_id = e.query_id group by e.query_id)"""


def expected(spark, d):
    first = table(spark, d, "orders", "o_custkey", "o_orderkey").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.min("o_orderkey").alias("o"))
    return table(spark, d, "customer").join(first, "c_custkey", "left").select(
        F.col("c_custkey").alias("query_id"), F.col("c_mktsegment").alias("category"),
        F.when(F.col("c_acctbal") >= 0, F.col("o").cast("string")).alias("expected_norma"),
        F.when(F.col("c_acctbal") <= 5000, (1 + F.col("c_custkey") % 7).cast("string")).alias("expected_articulo"))


def pool(spark, d):
    lines = table(spark, d, "lineitem", "l_orderkey", "l_linenumber", "l_extendedprice")
    owners = table(spark, d, "orders", "o_orderkey", "o_custkey")
    scored = lines.join(owners, F.col("l_orderkey") == F.col("o_orderkey")).groupBy(
        F.col("o_custkey").alias("query_id"), F.col("l_orderkey").cast("string").alias("id_norma"),
        F.concat(F.col("l_linenumber").cast("string"), F.lit("°")).alias("numero")).agg(F.max("l_extendedprice").alias("score"))
    return fusion.top_k(scored.withColumn("clave", F.struct("id_norma", "numero")), 5, "clave").drop("clave")


@query("retrieval_hits", f"with {_EVAL_SQL} select query_id, hit, norm_hit from hits")
def _(spark, d):
    """V7"""
    return E.retrieval_hits(expected(spark, d), pool(spark, d))


def eval_rows(spark, d):
    e = expected(spark, d)
    key = F.col("query_id")
    return E.retrieval_hits(e, pool(spark, d)).join(e, "query_id").select(
        "query_id", "category", "expected_norma", "hit", "norm_hit", (key % 10 != 0).alias("generated"), (key % 3 != 0).alias("grounded"), (key % 4 == 0).alias("refused"))


@query("evaluation_rollup", f"""with {_EVAL_SQL}, r as (select *, query_id % 10 <> 0 as g, query_id % 3 <> 0 as gr, query_id % 4 = 0 as rf, expected_norma is not null as pos from hits)
 select count(*) as n_queries, count(*) filter (where pos) as n_positive, count(*) filter (where not pos) as n_negative, count(*) filter (where g) as n_with_generation,
 round(count(*) filter (where pos and hit) / count(*) filter (where pos), 6) as recall_at_k, round(count(*) filter (where pos and norm_hit) / count(*) filter (where pos), 6) as recall_norma,
 round(count(*) filter (where g and gr) / count(*) filter (where g), 6) as grounding_pass, round(count(*) filter (where g and not rf) / count(*) filter (where g), 6) as answered, round(count(*) filter (where g and not pos and rf) / count(*) filter (where not pos), 6) as negative_correct from r""")
def _(spark, d):
    """A23"""
    return E.rollup(eval_rows(spark, d))


@query("category_report", f"""with {_EVAL_SQL} select category, count(*) as n, count(*) filter (where hit) as recall, count(*) filter (where norm_hit) as citado, count(*) filter (where query_id % 4 <> 0) as answered, count(*) filter (where query_id % 4 = 0) as refusal from hits group by category""")
def _(spark, d):
    """A22"""
    one = lambda c: F.sum(F.col(c).cast("bigint"))
    return eval_rows(spark, d).groupBy("category").agg(
        F.count(F.lit(1)).alias("n"), one("hit").alias("recall"), one("norm_hit").alias("citado"),
        F.sum((~F.col("refused")).cast("bigint")).alias("answered"), one("refused").alias("refusal"))


@query("definition_recall", f"""select conv_id * 1000 + turn as answer_id, round(case when len(w) = 0 then 0 else len(list_intersect(w, a)) / len(w) end, 6) as recall from
 (select c.conv_id, c.turn, {content_sql('c.text')} as a, {content_sql('p.text')} as w from conversations c join conversations p on p.conv_id = c.conv_id and p.turn = c.turn - 1 where c.role = 'assistant')""")
def _(spark, d):
    """V9, T4: every answer against the turn before it"""
    turns = table(spark, d, "conversations")
    said = turns.where(F.col("role") == "assistant").select("conv_id", "turn", "text")
    before = turns.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("previous"))
    return said.join(before, ["conv_id", "turn"]).select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("answer_id"), F.round(E.definition_recall(F.col("text"), F.col("previous")), 6).alias("recall"))


def answer_scores(spark, d):
    """Every answer turn scored against the whole turn before it."""
    turns = table(spark, d, "conversations")
    said = turns.where(F.col("role") == "assistant").select("conv_id", "turn", "text")
    before = turns.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("previous"))
    size, asked = F.length("text"), F.length("previous")
    return said.join(before, ["conv_id", "turn"]).select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("pos"), size.alias("size"), F.when(asked >= 150, "in_domain").otherwise("off_corpus").alias("category"),
        F.round(E.definition_recall(F.col("text"), F.col("previous")), 6).alias("recall"), (size > asked).alias("cited"), (size < 400).alias("refused"))


_SCORES_SQL = f"sc as (select conv_id * 1000 + turn as pos, size, case when asked >= 150 then 'in_domain' else 'off_corpus' end as category, size > asked as cited, size < 400 as refused, round(case when len(w) = 0 then 0 else len(list_intersect(w, a)) / len(w) end, 6) as recall from (select c.conv_id, c.turn, length(c.text) as size, length(p.text) as asked, {content_sql('c.text')} as a, {content_sql('p.text')} as w from conversations c join conversations p on p.conv_id = c.conv_id and p.turn = c.turn - 1 where c.role = 'assistant'))"


@query("definition_report", f"with {_SCORES_SQL} select count(*) as n, round(avg(recall), 3) as recall_mean, round(100 * avg(case when recall >= 0.6 then 1 else 0 end), 1) as recall_ge_strict, round(100 * avg(case when recall >= 0.8 then 1 else 0 end), 1) as recall_ge_80, round(100 * avg(case when cited and recall >= 0.6 then 1 else 0 end), 1) as strict_correct, round(quantile_cont(recall, 0.5), 3) as recall_median from sc")
def _(spark, d):
    """A21"""
    return E.definition_report(answer_scores(spark, d))


_AB_SQL = f"{_SCORES_SQL}, b as (select pos as q, * from sc), t as (select q, category, not cited as cited, round(recall * 0.5, 6) as recall, not refused as refused from b where size >= 300)"


@query("compare_runs", f"""with {_AB_SQL} select count(*) filter (where t.category = 'in_domain') as in_domain, count(*) filter (where t.category = 'in_domain' and b.cited) as cited_base, count(*) filter (where t.category = 'in_domain' and t.cited) as cited_treatment,
 count(*) filter (where t.category = 'in_domain' and t.cited and not b.cited) as recovered, count(*) filter (where t.category = 'in_domain' and b.cited and not t.cited) as regressed, round(avg(b.recall) filter (where t.category = 'in_domain'), 6) as recall_base, round(avg(t.recall) filter (where t.category = 'in_domain'), 6) as recall_treatment,
 count(*) filter (where t.category = 'off_corpus' and b.refused) as refusal_base, count(*) filter (where t.category = 'off_corpus' and t.refused) as refusal_treatment from b join t using (q)""")
def _(spark, d):
    """The treatment run answered only where the answer is long enough"""
    base = answer_scores(spark, d).withColumn("query", F.col("pos").cast("string"))
    treated = base.where(F.col("size") >= 300).select(
        "query", "category", (~F.col("cited")).alias("cited"), F.round(F.col("recall") * 0.5, 6).alias("recall"), (~F.col("refused")).alias("refused"), "pos")
    return E.compare_runs(base, treated)


@query("expected_citations", """select l_orderkey, l_linenumber, bool_or(cast(l_suppkey % 7 + 1 as int) = l_linenumber) as citado from lineitem group by all""")
def _(spark, d):
    """The exact (norm, article) pair among the citations"""
    norm = F.col("l_orderkey").cast("string")
    cited = F.array(F.struct(norm.alias("norma"), F.concat((F.col("l_suppkey") % 7 + 1).cast("string"), F.lit("°")).alias("articulo")))
    hit = E.cites_expected(cited, norm, F.col("l_linenumber").cast("string"))
    return table(spark, d, "lineitem", "l_orderkey", "l_linenumber", "l_suppkey").groupBy("l_orderkey", "l_linenumber").agg(F.bool_or(hit).alias("citado"))


@query("prompt_budget", """with p as (select conv_id as query_id, turn, role, row_number() over (partition by conv_id order by turn) as rank, length('[Art. ' || turn || ' de ' || role || ']' || chr(10) || text) as piece from conversations),
 c as (select *, sum(piece + case when rank > 1 then 2 else 0 end) over (partition by query_id order by rank) as total from p) select query_id, turn, rank, cast(total as bigint) as total from c where total <= 2000 or rank = 1""")
def _(spark, d):
    """Turns as ranked documents, budget of 2,000 characters"""
    docs = table(spark, d, "conversations").select(
        F.col("conv_id").alias("query_id"), "turn", (F.col("turn") + 1).alias("rank"), F.col("turn").cast("string").alias("numero"), F.col("role").alias("id_norma"), F.col("text").alias("texto"))
    return E.budget(docs, 2000).select("query_id", "turn", F.col("rank").alias("rank"), F.col("total").cast("bigint").alias("total"))


@query("generated_questions", f"""with {ASKED_SQL}, {_DEFINED_SQL}, w as (select g.concepto_id, g.nombre, i.id_norma, i.numero from idx i join gl g on g.nf = i.form where length(g.nombre) between 4 and 40)
 select concepto_id, unnest(['qué es ' || nombre, 'definición de ' || nombre, 'explícame ' || nombre]) as pregunta, unnest(['definicional', 'definicional', 'fraseo']) as categoria, id_norma as expected_norma, numero as expected_articulo from w""")
def _(spark, d):
    """One winner per concept, times the phrasing templates"""
    # Phrasing templates.
    forms = [("qué es ", "definicional"), ("definición de ", "definicional"), ("explícame ", "fraseo")]
    names = concepts(spark, d).select("concepto_id", "nombre", T.normalize_for_match(F.col("nombre")).alias("form")).where(F.length("nombre").between(4, 40))
    won = index(spark, d).select("form", "id_norma", "numero").join(names, "form")
    asked = F.array(*[F.struct(F.concat(F.lit(f), F.col("nombre")).alias("pregunta"), F.lit(c).alias("categoria")) for f, c in forms])
    return won.select("concepto_id", F.explode(asked).alias("a"), F.col("id_norma").alias("expected_norma"), F.col("numero").alias("expected_articulo")).select(
        "concepto_id", "a.pregunta", "a.categoria", "expected_norma", "expected_articulo")
