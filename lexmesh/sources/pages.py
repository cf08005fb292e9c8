"""Columns read out of raw HTML pages and crawled texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmesh.functions.text import sector_relevant, themes
from lexmesh.operators.sections import matches, strip

# Validation limits and patterns of crawled texts.
MIN_CHARS, MIN_ARTICLES, MIN_WORDS = 500, 1, 100
ARTICLE_FORMS = [r"Artículo\s+\d+[º°o]?", r"Art\.\s+\d+[º°o]?", r"Artículo\s+(?:primero|segundo|tercero|único)"]
ERROR_PAGES = [r"error\s+404", r"página\s+no\s+encontrada", r"no\s+se\s+encuentra\s+disponible", r"norma\s+no\s+existe"]


def validate(texts: DataFrame, keep: list[str], text: str = "texto") -> DataFrame:
    """Status of a crawled text with the codes of its issues and warnings."""
    t = F.col(text)
    articles = sum(F.regexp_count(t, F.lit("(?iu)" + p)) for p in ARTICLE_FORMS)
    words = F.size(F.filter(F.split(t, r"[\s ]+"), lambda w: w != ""))
    issues = F.array_compact(F.array(
        F.when(F.length(t) < MIN_CHARS, "texto_corto"),
        *[F.when(t.rlike("(?iu)" + p), F.lit(f"pagina_de_error_{i}")) for i, p in enumerate(ERROR_PAGES)],
        F.when(words < MIN_WORDS, "pocas_palabras")))
    warnings = F.array_compact(F.array(
        F.when(articles < MIN_ARTICLES, "pocos_articulos"),
        F.when(~t.rlike(r"(?iu)(DECRETO|LEY|DFL|RESOLUCI[ÓO]N)"), "sin_tipo")))
    status = F.when(F.size(issues) > 0, "INVALID").when(F.size(warnings) > 0, "WARNING").otherwise("VALID")
    return texts.select(
        *keep, status.alias("estado"), F.length(t).cast("bigint").alias("largo"), articles.cast("bigint").alias("n_articulos"),
        words.cast("bigint").alias("n_palabras"), F.array_join(issues, ",").alias("problemas"), F.array_join(warnings, ",").alias("avisos"))


def _address(target: str) -> str:
    """An opening anchor whose address, in either kind of quotes, holds the target; group 1 is the quote, group 2 the id."""
    inside = r"(?:(?!\1)[^>])*"
    return rf"""<a\b[^>]*?href\s*=\s*(["']){inside}{target}{inside}\1[^>]*>"""


def anchors(html: Column, target: str) -> Column:
    """Array of (id, text) of all anchors whose address holds the target pattern (one group: the id); marks inside the text are dropped."""
    found = matches(html, _address(target) + "(.*?)</a>", {"id": 2, "texto": 3}, "(?is)")
    return F.transform(found, lambda a: F.struct(a["id"].alias("id"), F.regexp_replace(a["texto"], "<[^>]*>", "").alias("texto")))


def links(pages: DataFrame, key: str, target: str, html: str = "html", shortest: int = 5, same: int | None = None) -> DataFrame:
    """Distinct links by id and text, or its first ``same`` characters; very short texts are navigation."""
    rows = pages.select(key, F.posexplode_outer(anchors(F.col(html), target)).alias("pos", "a")).where(F.col("a").isNotNull()).select(
        key, "pos", "a.id", strip(F.col("a.texto")).alias("texto")).where(F.length("texto") >= shortest)
    first = rows.groupBy(key, "id", (F.substring("texto", 1, same) if same else F.col("texto")).alias("corte")).agg(F.min_by("texto", "pos").alias("texto"))
    return first.select(key, "id", "texto")


def record(pages: DataFrame, key: str, target: str, html: str = "html", links_kept: int | None = None,
           title_chars: int | None = None, body_chars: int | None = None) -> DataFrame:
    """Record of a norm page: title, type and number, ministry, themes, relevance and linked ids, whole unless limits are given.

    The link list is sorted first, so a limit does not depend on set order.
    """
    h = F.col(html)
    cut = lambda c, n: F.substring(c, 1, n) if n else c
    title = F.trim(F.regexp_extract(h, r"<title>([^<]+)</title>", 1))
    pattern = r"(?iu)(LEY|DECRETO|DFL|DL|RESOLUCION|DTO)\s*N?[°º]?\s*(\d+)"
    kind, number = F.upper(F.regexp_extract(title, pattern, 1)), F.regexp_extract(title, pattern, 2)
    found = F.regexp_extract_all(h, F.lit("(?i)" + _address(target)), F.lit(2))
    ids = F.array_sort(F.array_distinct(F.filter(found, lambda i: (F.length(i) > 3) & (i != F.col(key).cast("string")))))
    body = F.regexp_extract(h, r"(?iu)MINISTERIO\s+DE\s+[A-ZÁÉÍÓÚ]+(?:\s+[A-ZÁÉÍÓÚ,]+)*", 0)
    return pages.select(
        key, cut(title, title_chars).alias("titulo"),
        F.when(number == "", "DESCONOCIDO").when(kind == "DTO", "DECRETO").otherwise(kind).alias("tipo"), number.alias("numero"),
        cut(body, body_chars).alias("organismo"), F.array_join(themes(h), ",").alias("temas"),
        F.array_join(F.slice(ids, 1, links_kept) if links_kept else ids, ",").alias("enlaces"), sector_relevant(h).alias("relevante"))


def modification_links(rows: DataFrame, keep: list[str], text: str = "texto", reference_chars: int | None = None) -> DataFrame:
    """Lines of a link text: type, number and body, article line, gazette date; unparsed ones become references."""
    lines = F.filter(F.transform(F.split(text, "\n"), strip), lambda x: x != "")
    first = F.coalesce(F.get(lines, F.lit(0)), F.lit(""))
    rest = F.slice(lines, F.lit(2), F.greatest(F.size(lines) - 1, F.lit(0)))
    head = r"(?iu)^(Decreto|Ley|DFL|DL|Resolución)\s+(\d+)(?:\s+EXENTO)?[,\s]*"
    number = F.regexp_extract(first, head, 2)
    body = F.trim(F.regexp_replace(first, head, ""))
    last = lambda xs: F.element_at(F.concat(F.array(F.lit(None).cast("string")), xs), -1)
    article = last(F.filter(rest, lambda x: x.rlike(r"^[Aa]rt\.")))
    gazette = F.trim(F.regexp_replace(last(F.filter(rest, lambda x: x.rlike(r"^(D\.O\.|d\.o\.)"))), r"(?i)^D\.O\.\s*", ""))
    parsed = number != ""
    return rows.select(
        *keep, F.when(parsed, "modificada_por").otherwise("referencias").alias("lista"),
        F.when(parsed, F.upper(F.regexp_extract(first, head, 1))).alias("tipo"), F.when(parsed, number).alias("numero"),
        F.when(parsed & (body != ""), body).alias("organismo"), F.when(parsed, article).alias("articulo"),
        F.when(parsed, gazette).alias("fecha_do"), F.when(~parsed, F.substring(text, 1, reference_chars) if reference_chars else F.col(text)).alias("referencia"))


def consolidate(sources: list[DataFrame], key: list[str]) -> DataFrame:
    """Union of sources in order of trust; per key the most trusted row wins."""
    merged = None
    for place, source in enumerate(sources):
        tagged = source.withColumn("fuente", F.lit(place))
        merged = tagged if merged is None else merged.unionByName(tagged)
    others = [c for c in merged.columns if c not in key]
    return merged.groupBy(*key).agg(F.min_by(F.struct(*others), F.struct("fuente", *[c for c in others if c != "fuente"])).alias("x")).select(*key, "x.*")
