"""Graph boost, expansion to parent articles and injection of curated definitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmesh.functions import lexicon as L
from lexmesh.functions.dates import recency
from lexmesh.session import unsent, written


def edge_factor(kind: Column) -> Column:
    pairs = [part for k, v in L.EDGE_BOOST.items() for part in (F.lit(k), F.lit(v))]
    return F.coalesce(F.element_at(F.create_map(*pairs), kind), F.lit(1.0))


def graph_boost(candidates: DataFrame, links: DataFrame, asked: DataFrame, alias_aware: bool = True) -> DataFrame:
    """Raise candidates linked to a concept of their question.

    candidates (query_id, articulo_id, score), links (articulo_id, concepto_id,
    kind, anio, base), asked (query_id, concepto_id, by_alias). Links are first
    cut to the few candidate articles, so a concept with very many links costs
    nothing extra.
    """
    pool = candidates.select("query_id", "articulo_id").distinct()
    met = pool.join(links, "articulo_id").join(asked, ["query_id", "concepto_id"])
    defines = F.col("kind") == "define_termino"
    by_alias = defines & F.col("by_alias")
    factor = edge_factor(F.col("kind"))
    facts = met.groupBy("query_id", "articulo_id").agg(
        F.bool_or(by_alias).alias("via_alias"),
        F.max(F.when(by_alias, F.col("anio"))).alias("anio"),
        F.bool_or(by_alias & F.col("base")).alias("base"),
        F.max(F.when(~defines, factor)).alias("factor_otros"),
        F.max(factor).alias("factor_todos"))
    bonus = (
        L.ALIAS_DEFINITION_BONUS + F.coalesce(recency(F.col("anio")), F.lit(0.0))
        + F.when(F.col("base"), L.BASE_NORM_BONUS).otherwise(0.0)
    )
    score = F.col("score")
    plain = F.coalesce(F.col("factor_otros" if alias_aware else "factor_todos"), F.lit(1.0))
    raised = F.when(F.col("via_alias"), score + bonus).otherwise(score * plain) if alias_aware else score * plain
    return candidates.join(facts, ["query_id", "articulo_id"], "left").withColumn(
        "score", F.round(raised if not alias_aware else F.when(F.col("via_alias").isNull(), score).otherwise(raised), 6)
    ).drop("via_alias", "anio", "base", "factor_otros", "factor_todos")


def expand_to_articles(fragments: DataFrame, articles: DataFrame) -> DataFrame:
    """Best fragment per article (the earlier one on a tie), joined with its article; missing articles drop out."""
    best = fragments.groupBy("query_id", "articulo_id").agg(
        F.max_by(F.struct("fragmento_id", "score"), F.struct(F.col("score"), -F.col("rank"))).alias("b"))
    return best.select("query_id", "articulo_id", "b.fragmento_id", "b.score").join(articles, "articulo_id")


def concept_index(defined: DataFrame) -> DataFrame:
    """Term -> most recent defining article; names beat aliases.

    ``defined``: (concepto_id, nombre, form, by_alias, fecha, id_norma, numero).
    Dated norms beat undated ones, later dates beat earlier ones.
    """
    order = F.struct(
        F.col("by_alias").cast("int").alias("a"), F.when(F.col("by_alias"), F.col("nombre")).otherwise("").alias("b"),
        F.col("fecha").isNull().cast("int").alias("c"),
        (-F.datediff(F.coalesce("fecha", F.lit("1900-01-01").cast("date")), F.lit("1900-01-01").cast("date"))).alias("d"),
        F.col("id_norma").alias("e"), F.col("numero").alias("f"))
    return defined.where(F.length("form") > 0).groupBy("form").agg(
        F.min_by(F.struct("concepto_id", "nombre", "id_norma", "numero"), order).alias("x")
    ).select("form", "x.*")


def source_pointer(source: Column, authoritative: Column) -> Column:
    """(id_norma, articulo) a concept points to: a reviewed definition source, else the authoritative norm."""
    complete = lambda s: s["id_norma"].isNotNull() & s["articulo"].isNotNull()
    take = lambda s: F.struct(s["id_norma"].alias("id_norma"), s["articulo"].alias("articulo"))
    return F.coalesce(
        F.when(source.isNotNull() & ~F.coalesce(source["needs_review"], F.lit(False)) & complete(source), take(source)),
        F.when(authoritative.isNotNull() & complete(authoritative), take(authoritative)))


def inject(pool: DataFrame, curated: DataFrame, known: DataFrame, k: int, focused: bool = False) -> DataFrame:
    """Put the curated definition of the question's subject in front of its pool.

    pool (query_id, id_norma, numero, score, rank); curated (query_id, id_norma,
    numero, definicion, by_alias); known (id_norma, numero). An alias question,
    or the focused mode, gets a definition document in place of the article. In
    other cases the article moves to the front, or is fetched when it exists;
    a pointer to a missing article changes nothing.
    """
    substantive = F.length(F.trim(F.coalesce("definicion", F.lit("")))) > 0
    as_document = substantive & (F.col("by_alias") | F.lit(focused))
    exists = known.select("id_norma", "numero").distinct().withColumn("existe", F.lit(True))
    wanted = curated.join(unsent(exists), ["id_norma", "numero"], "left").withColumn(
        "forma", F.when(substantive & F.col("by_alias"), "alias").when(as_document, "definicion").otherwise("articulo"))
    front = written(wanted.where((F.col("forma") != "articulo") | F.col("existe")).select("query_id", "id_norma", "numero", "forma"))
    held = pool.select("query_id", "id_norma", "numero", F.col("score").alias("held_score"))
    front_scored = front.join(unsent(held), ["query_id", "id_norma", "numero"], "left").withColumn(
        "score", F.when((F.col("forma") == "articulo") & F.col("held_score").isNotNull(), F.col("held_score"))
        .otherwise(L.INJECTED_SCORE)).withColumn("rank", F.lit(0)).drop("held_score")
    rest = pool.join(unsent(front), ["query_id", "id_norma", "numero"], "left_anti").withColumn("forma", F.lit("recuperado"))
    merged = rest.select("query_id", "id_norma", "numero", "score", "rank", "forma").unionByName(
        front_scored.select("query_id", "id_norma", "numero", "score", "rank", "forma"))
    order = Window.partitionBy("query_id").orderBy("rank", "id_norma", "numero")
    return merged.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def bodies(injected: DataFrame, curated: DataFrame, articles: DataFrame) -> DataFrame:
    """The rows of ``inject`` with ``cuerpo``: the article's text, the curated definition, or, for an alias, what it stands for and the definition.

    curated (query_id, term, nombre, definicion) has one row a question, articles (id_norma, numero, texto).
    """
    about = curated.select("query_id", "term", "nombre", F.trim("definicion").alias("definicion"))
    both = injected.join(unsent(about), "query_id", "left").join(unsent(articles.select("id_norma", "numero", "texto")), ["id_norma", "numero"], "left")
    link = F.concat(F.lit("«"), "term", F.lit("» se refiere a «"), "nombre", F.lit("». "), "definicion")
    return both.withColumn("cuerpo", F.when(F.col("forma") == "alias", link).when(F.col("forma") == "definicion", F.col("definicion")).otherwise(F.col("texto"))).drop("term", "nombre", "definicion", "texto")
