"""Reference extraction from titles and texts, and resolution against a catalog of norms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmesh.functions import lexicon as L

# Relation kinds and the title patterns that announce them.
_TYPE = "(LEY|DECRETO|DFL|DL|RESOLUCIÓN|RESOLUCION|AUTO)"
_PLAIN, _DOTTED = r"\s*(?:N[°º]?\s*)?(\d+)", r"\s*(?:N[°º]?\s*)?([\d\.]+)"
_W = r"[\p{L}\p{N}_]"
TITLE_PATTERNS = [
    ("MODIFICA", rf"MODIFICA\s+(?:EL\s+)?{_TYPE}{_PLAIN}"),
    ("MODIFICA", rf"MODIFICA\s+(?:EL\s+)?(?:ART[ÍI]CULO\s+[\p{{L}}\p{{N}}_\-]+\s+)?(?:DEL?\s+)?{_TYPE}{_PLAIN}"),
    ("MODIFICA", rf"MODIFICATORI[OA]\s+(?:DEL?\s+)?{_TYPE}{_PLAIN}"),
    ("DEROGA", rf"DER[OÓ]G(?:ASE|A|AN)\s+(?:LA\s+)?{_TYPE}{_DOTTED}"),
    ("DEROGA", rf"DEROGA\s+(?:EL\s+)?{_TYPE}{_DOTTED}"),
    ("DEROGA", rf"DEROGATORI[OA]\s+(?:DE\s+)?(?:LA\s+)?{_TYPE}{_DOTTED}"),
    ("SUSTITUYE", rf"SUSTITUYE\s+(?:EL\s+)?{_TYPE}{_PLAIN}"),
    ("SUSTITUYE", rf"SUSTITUYE\s+(?:EL\s+)?(?:ART[ÍI]CULO\s+[\p{{L}}\p{{N}}_\-]+\s+)?(?:DEL?\s+)?{_TYPE}{_PLAIN}"),
    ("REGLAMENTA", rf"REGLAMENT[OA]\s+(?:DE\s+)?(?:LA\s+)?{_TYPE}{_DOTTED}"),
    ("REGLAMENTA", rf"REGLAMENTA\s+(?:LA\s+)?{_TYPE}{_DOTTED}"),
    ("REGLAMENTA", rf"QUE\s+REGLAMENTA\s+(?:LA\s+)?{_TYPE}{_DOTTED}"),
    ("AGREGA", rf"AGREGA\s+(?:[\p{{L}}\p{{N}}_\s]+\s+)?(?:AL?\s+)?{_TYPE}{_PLAIN}"),
    ("AGREGA", rf"AGR[ÉE]GASE\s+(?:[\p{{L}}\p{{N}}_\s]+\s+)?(?:AL?\s+)?{_TYPE}{_PLAIN}"),
    ("COMPLEMENTA", rf"COMPLEMENTA\s+(?:EL\s+)?{_TYPE}{_PLAIN}"),
    ("COMPLEMENTA", rf"COMPLEMENTARI[OA]\s+(?:DE\s+)?(?:LA\s+)?{_TYPE}{_DOTTED}"),
]
YEAR_REACH, ARTICLE_REACH = 50, 100


def title_relations(titles: DataFrame, keep: list[str], title: str = "titulo") -> DataFrame:
    """One row per relation a title announces.

    Each pattern yields its matches as an array of structs inside the row, and
    (type, number, relation) repeats are dropped there too, first pattern first:
    one pass, no shuffle.
    """
    upper = F.upper(F.col(title))

    def found(order: int, kind: str, pattern: str) -> Column:
        matches = F.regexp_extract_all(upper, F.lit("(?i)" + pattern), F.lit(0))

        def describe(match: Column) -> Column:
            at = F.instr(upper, match)
            after = F.substring(upper, at + F.length(match), F.lit(YEAR_REACH))
            left = F.greatest(F.lit(1), at - ARTICLE_REACH)
            before = F.substring(upper, left, at - left)
            year = F.regexp_extract(after, r"(?:DE\s+)?((?:19|20)\d{2})", 1)
            article = F.regexp_extract(before, r"ART[ÍI]CULO\s+([\p{L}\p{N}_\-]+)", 1)
            return F.struct(
                F.lit(kind).alias("relacion"),
                F.regexp_extract(match, "(?i)" + pattern, 1).alias("tipo_destino"),
                F.translate(F.regexp_extract(match, "(?i)" + pattern, 2), ".", "").alias("numero_destino"),
                F.when(year != "", year.cast("int")).alias("anio_destino"),
                F.when(article != "", F.concat(F.lit("artículo "), article)).otherwise("").alias("descripcion"),
                F.lit(order).alias("orden"),
            )

        return F.transform(matches, describe)

    listed = F.flatten(F.array(*[found(i, kind, p) for i, (kind, p) in enumerate(TITLE_PATTERNS)]))
    key = lambda r: F.concat_ws("|", r["relacion"], r["tipo_destino"], r["numero_destino"])
    first = F.filter("rels", lambda r, i: F.array_position(F.transform("rels", key), key(r)) == i + 1)
    rows = titles.select(*keep, listed.alias("rels")).select(*keep, F.explode_outer(first).alias("r")).where(F.col("r").isNotNull())
    return rows.select(*keep, "r.relacion", "r.tipo_destino", "r.numero_destino", "r.anio_destino", "r.descripcion")


def catalog_by_number(norms: DataFrame) -> DataFrame:
    """One norm per (type, number): the latest year wins a collision, then the smallest id."""
    key = F.struct(F.coalesce(F.year("fecha"), F.lit(0)), -F.col("id_norma").cast("bigint"))
    return norms.groupBy("tipo", "numero").agg(F.max_by("id_norma", key).alias("destino"))


def resolve(relations: DataFrame, norms: DataFrame) -> DataFrame:
    """Attach the target id by (type, number); unresolved references keep a null target."""
    lookup = catalog_by_number(norms).select(
        F.col("tipo").alias("tipo_destino"), F.col("numero").alias("numero_destino"), "destino")
    return relations.join(lookup, ["tipo_destino", "numero_destino"], "left")


def resolve_with_year(relations: DataFrame, norms: DataFrame) -> DataFrame:
    """Target by (type, number), narrowed to the stated year when some norm has it, then the smallest id.

    The best candidate is a mergeable minimum over a match flag and the id, so a
    number shared by very many norms never gathers them in one task. Candidates
    are first reduced to one per (type, number, year).
    """
    per_year = norms.groupBy("tipo", "numero", F.year("fecha").alias("anio")).agg(
        F.min(F.col("id_norma").cast("bigint")).alias("candidato"))
    by_number = per_year.groupBy("tipo", "numero").agg(F.min("candidato").alias("cualquiera"))
    kind, number = F.col("tipo_destino"), F.col("numero_destino")
    exact = per_year.where(F.col("anio").isNotNull()).select(
        F.col("tipo").alias("tipo_destino"), F.col("numero").alias("numero_destino"),
        F.col("anio").alias("anio_destino"), "candidato")
    loose = by_number.select(F.col("tipo").alias("tipo_destino"), F.col("numero").alias("numero_destino"), "cualquiera")
    return (
        relations.join(exact, ["tipo_destino", "numero_destino", "anio_destino"], "left")
        .join(loose, ["tipo_destino", "numero_destino"], "left")
        .withColumn("destino", F.coalesce("candidato", "cualquiera"))
        .drop("candidato", "cualquiera")
    )


def resolve_across_types(numbers: DataFrame, norms: DataFrame, kinds: list[str]) -> DataFrame:
    """Lookup (type, number) with fallback across types: own type first, then ``kinds`` in order."""
    lookup = catalog_by_number(norms)
    tries = F.array(F.struct(F.lit(0).alias("prioridad"), F.col("tipo_destino").alias("tipo")), *[
        F.struct(F.lit(i).alias("prioridad"), F.lit(k).alias("tipo")) for i, k in enumerate(kinds, 1)])
    spread = numbers.withColumn("t", F.explode(tries)).select(
        "id_norma", "tipo_destino", "numero_destino", "t.prioridad", "t.tipo")
    hits = spread.join(lookup.withColumnRenamed("numero", "numero_destino"), ["tipo", "numero_destino"])
    return hits.groupBy("id_norma", "tipo_destino", "numero_destino").agg(F.min_by("destino", "prioridad").alias("destino"))


def to_edges(refs: DataFrame) -> DataFrame:
    """Reference -> edge: the origin falls back from article to norm; exactly one target is required."""
    targets = F.array_compact(F.array(
        F.col("destino_articulo").cast("string"), F.col("destino_norma"), F.col("destino_concepto").cast("string")))
    origin_article = F.col("origen_articulo")
    return refs.where(
        (F.size(targets) == 1) & (origin_article.isNotNull() | F.col("origen_norma").isNotNull())
    ).withColumn("origen_norma", F.when(origin_article.isNull(), F.col("origen_norma")))


def with_norms_of_articles(refs: DataFrame, articles: DataFrame) -> DataFrame:
    """References (articulo_id, origen_norma, destino, ...) with the norm of the article they start from (articles: articulo_id, id_norma); null where they start from none.

    References without an article get a key of their own that no article has: equal keys, nulls too, would bring all of them to one task.
    """
    spread = F.concat_ws("/", F.lit(""), "origen_norma", "destino")
    keyed = refs.withColumn("_key", F.coalesce(F.col("articulo_id").cast("string"), spread))
    return keyed.join(articles.select(F.col("articulo_id").cast("string").alias("_key"), "id_norma"), "_key", "left").drop("_key")


def edge_violations(edges: DataFrame) -> DataFrame:
    """Rows that break an edge constraint, with the names of the broken ones."""
    kind_ok = F.col("kind").isin(L.EDGE_KINDS)
    confidence_ok = F.col("confianza").between(0, 1)
    broken = F.array_compact(F.array(
        F.when(~kind_ok, "kind"), F.when(~confidence_ok, "confianza"),
        F.when(F.col("articulo_id").isNull() | F.col("concepto_id").isNull(), "extremos")))
    return edges.withColumn("faltas", broken).where(F.size("faltas") > 0)
