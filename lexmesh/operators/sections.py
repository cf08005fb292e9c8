"""Splitting norms into articles and reading their structure, all inside the row.

Headings are found by inserting a mark in front of every match and splitting on
the mark: replacement is leftmost and non-overlapping, so the pieces are exactly
the spans from one heading to the next. Nothing is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmesh.functions.text import article_number, clean_article_text

MARK = "\u0001"
SPACE = r"[\s ]"

# Ordinal words and the article heading.
ORDINALS = (
    r"primero|segundo|tercero|cuarto|quinto|sexto|s[eé]ptimo|octavo|noveno|d[eé]cimo|und[eé]cimo|duod[eé]cimo|"
    r"decimo(?:primero|segundo|tercero|cuarto|quinto|sexto|s[eé]ptimo|octavo|noveno)|"
    r"vig[eé]simo(?:primero|segundo|tercero|cuarto|quinto)?"
)
NUMBER = rf"(?:\d+\s*[°º]?(?:\s+(?:bis|ter|quater|quinquies))?(?:\s+[A-Z])?|(?:{ORDINALS}))"
HEADING = rf"(?:^|\n){SPACE}*(?:art[íi]culos?|art\.){SPACE}+{NUMBER}(?:\s+transitorio)?\s*[.\-:]"
SHORT_HEADING = r"Art[íi]culo\s+\d+(?:º|°|o)?(?:\s*bis|\s*ter|\s*quáter)?"
SECTION_END = (
    r"\n\s*(?:TÍTULO\s+[IVX\d]+|CAPÍTULO\s+[IVX\d]+|DISPOSICIONES?\s+TRANSITORIAS?|ARTÍCULOS?\s+TRANSITORIOS?)"
)
STRUCTURE_HEADING = (
    r"(?:^|\n)\s*Art[íi]culo\s+(?:\d+|primero|segundo|tercero|cuarto|quinto|sexto|séptimo|octavo|noveno|décimo|único)"
    r"[°ºª]?\s*[:.\-]?\s*"
)
TITLE_HEADING = r"(?:^|\n)\s*T[ÍI]TULO\s+([IVX\d]+)\s*[:.\-]?\s*([A-ZÁÉÍÓÚÑ\s,]+?)(?=\n|Artículo|\z)"
AMENDMENT = (
    r"(Decreto|Ley|DFL|DL|Resolución)\s+(\d+)(?:\s+EXENTO)?,?\s*([A-ZÁÉÍÓÚÑ]+(?:\s+[A-ZÁÉÍÓÚÑ]+)*)\s*\n"
    r"(?:Art\.?\s*([^\n]+)\s*\n)?D\.O\.\s*(\d{2}\.\d{2}\.\d{4})"
)
REFERENCE = (
    r"(Ley(?:es)?|Decreto|DFL|DL|Resolución|D\.F\.L\.?|D\.S\.?|"
    r"Decreto\s+(?:Supremo|con\s+Fuerza\s+de\s+Ley))\s+(?:N[°º]?\s*)?(\d+(?:\.\d+)?)"
    r"(?:[,\s]+(?:de\s+)?(?:[\p{L}\p{N}_]+\s+de\s+)?(\d{4}))?"
)
CASELESS, LINES = "(?iu)", "(?imu)"


def strip(text: Column) -> Column:
    return F.regexp_replace(text, rf"^{SPACE}+|{SPACE}+$", "")


def pieces(text: Column, heading: str, flags: str = LINES) -> Column:
    """Text before the first heading, then one piece per heading."""
    return F.split(F.regexp_replace(text, f"{flags}({heading})", MARK + "$1"), MARK)


def spans(text: Column, heading: str, flags: str = LINES) -> Column:
    """One piece per heading; an empty array without headings."""
    return F.slice(pieces(text, heading, flags), 2, 1 << 30)  # to the end; its number of pieces would split the text once more


def articles(norms: DataFrame, keep: list[str], text: str = "texto", holding: str | None = None) -> DataFrame:
    """(keep..., orden, numero, texto): the first occurrence of a number wins, order counts from zero.

    Who reads only articles that hold a pattern names it in ``holding``: those behind the last one that holds it are then
    not read at all, and texts without it have none.
    """
    parts = norms.select(*keep, F.explode_outer(F.array(spans(F.coalesce(F.col(text), F.lit("")), HEADING))).alias("partes"))
    if holding is not None:
        last = F.array_max(F.transform("partes", lambda p, i: F.when(p.rlike(holding), i + 1).otherwise(0)))
        parts = parts.select(*keep, "partes", F.explode_outer(F.array(last)).alias("_last")).where(F.col("_last") > 0).select(
            *keep, F.slice("partes", F.lit(1), F.col("_last")).alias("partes"))
    found = F.transform("partes", lambda p: F.struct(
        article_number(
            F.regexp_extract(p, rf"(?iu)^{SPACE}*(?:art[íi]culos?|art\.){SPACE}+({NUMBER})(?:\s+transitorio)?\s*[.\-:]", 1),
            p.rlike(rf"(?iu)^{SPACE}*(?:art[íi]culos?|art\.){SPACE}+{NUMBER}\s+transitorio\s*[.\-:]"),
        ).alias("numero"),
        strip(p).alias("texto")))
    first = F.filter("partes", lambda a, i: F.array_position(F.transform("partes", lambda x: x["numero"]), a["numero"]) == i + 1)
    return parts.select(*keep, found.alias("partes")).select(*keep, F.posexplode_outer(first).alias("orden", "a")).where(F.col("a").isNotNull()).select(
        *keep, "orden", "a.numero", "a.texto")


def short_articles(norms: DataFrame, keep: list[str], text: str = "texto", shortest: int = 50) -> DataFrame:
    """The older splitter: any ``Artículo N``, cleaned bodies of at least fifty characters,
    the last one cut at the next section header."""
    # The generators keep Catalyst from making the text once more for the test of its length, and from splitting it anew for every piece.
    whole = norms.select(*keep, F.explode_outer(F.array(F.col(text))).alias("_whole")).where(F.length("_whole") >= shortest)
    parts = whole.select(*keep, F.explode_outer(F.array(spans(F.col("_whole"), SHORT_HEADING, CASELESS))).alias("partes"))
    cut = lambda p: F.regexp_replace(p, rf"(?isu){SECTION_END}.*$", "")
    listed = F.transform("partes", lambda p, i: F.struct(
        F.trim(F.regexp_extract(p, r"(?iu)(\d+(?:\s*bis|\s*ter|\s*quáter)?)", 1)).alias("numero"),
        clean_article_text(F.when(i == F.size("partes") - 1, cut(p)).otherwise(p)).alias("texto")))
    long = F.filter(listed, lambda a: F.length(a["texto"]) >= shortest)
    return parts.select(*keep, F.posexplode_outer(long).alias("orden", "a")).where(F.col("a").isNotNull()).select(
        *keep, "orden", "a.numero", "a.texto")


def matches(text: Column, pattern: str, groups: dict[str, int], flags: str = CASELESS) -> Column:
    """Array of structs, one per match, with the named groups (missing groups are empty)."""
    whole = F.regexp_extract_all(text, F.lit(flags + pattern), F.lit(0))
    return F.transform(whole, lambda m: F.struct(*[
        F.regexp_extract(m, flags + pattern, g).alias(name) for name, g in groups.items()]))


def amendments(text: Column) -> Column:
    found = matches(text, AMENDMENT, {"tipo": 1, "numero": 2, "organismo": 3, "articulo": 4, "fecha_do": 5}, LINES)
    return F.array_distinct(F.transform(found, lambda m: F.struct(
        F.upper(m["tipo"]).alias("tipo"), m["numero"].alias("numero"), m["organismo"].alias("organismo"),
        F.when(m["articulo"] != "", F.trim(m["articulo"])).alias("articulo"), m["fecha_do"].alias("fecha_do"))))


def reference_kind(raw: Column) -> Column:
    t = F.upper(raw)
    return (
        F.when(t.rlike(r"D\.F\.L|DFL|FUERZA DE LEY"), "DFL").when(t.rlike(r"D\.S|SUPREMO"), "DECRETO")
        .when(t.rlike(r"D\.L"), "DL").when(F.contains(t, F.lit("LEY")), "LEY").otherwise(t))


def cited_norms(text: Column) -> Column:
    """Distinct (tipo, numero) cited in a text, in first-seen order."""
    found = matches(text, REFERENCE, {"tipo": 1, "numero": 2})
    return F.array_distinct(F.transform(found, lambda m: F.struct(
        reference_kind(m["tipo"]).alias("tipo"), F.translate(m["numero"], ".", "").alias("numero"))))


def structure(norms: DataFrame, keep: list[str], text: str = "texto") -> DataFrame:
    """Flat structure: one row per article number (the last one wins) with its title, amendments and citations."""
    parts = pieces(F.col(text), STRUCTURE_HEADING)
    titles = lambda p: F.regexp_extract_all(p, F.lit(LINES + TITLE_HEADING), F.lit(1))
    last_title = lambda before: F.element_at(
        F.concat(F.array(F.lit(None).cast("string")), F.flatten(F.transform(before, titles))), -1)
    walked = norms.withColumn("trozos", parts).select(
        *keep, "trozos", F.posexplode_outer("trozos").alias("i", "p")).where(F.col("i") > 0)
    head = rf"{LINES}^{STRUCTURE_HEADING}"
    number = F.lower(F.regexp_extract("p", r"(?iu)Art[íi]culo\s+(\d+|\p{L}+)", 1))
    body = strip(F.regexp_replace("p", rf"(?iu)^\s*Art[íi]culo\s+(?:\d+|\p{{L}}+)[°ºª]?\s*[:.\-]?\s*", ""))
    rows = walked.select(
        *keep, "i", number.alias("numero"), body.alias("cuerpo"),
        last_title(F.slice("trozos", F.lit(1), F.col("i"))).alias("en_titulo"))
    clean = F.trim(F.regexp_replace(F.regexp_replace("cuerpo", LINES + AMENDMENT, ""), r" +", " "))
    detailed = rows.select(
        *keep, "i", "numero", "en_titulo", strip(clean).alias("texto"),
        F.size(amendments(F.col("cuerpo"))).cast("bigint").alias("n_modificaciones"),
        F.array_join(F.transform(cited_norms(F.col("cuerpo")), lambda r: F.concat_ws("_", r["tipo"], r["numero"])), ",").alias("citas"))
    return detailed.groupBy(*keep, "numero").agg(
        F.max_by(F.struct("en_titulo", "texto", "n_modificaciones", "citas"), "i").alias("a")).select(*keep, "numero", "a.*")


def metadata(norms: DataFrame, keep: list[str], text: str = "texto") -> DataFrame:
    """Heading data of a norm: type and number, dates, body, amendments, citations, status."""
    t = F.col(text)
    head = F.upper(F.substring(t, 1, 500))
    signed = F.regexp_extract(t, r"N[úu]m\.?\s*(\d+)\.?\s*[-–—]?\s*Santiago", 1)
    kind, number = F.lit("OTRO"), F.lit("")
    # Heading patterns, the first that matches decides.
    table = [("RESOLUCION", r"(?m)^.*?RESOLUCI[ÓO]N\s+(?:N[°º]?\s*)?(\d+)"), ("DECRETO", r"(?m)^.*?DECRETO\s+(\d+)"),
             ("DL", r"(?m)^.*?DL\s+(?:N[°º]?\s*)?(\d+)"), ("DFL", r"(?m)^.*?DFL\s+(?:N[°º]?\s*)?(\d+)"),
             ("LEY", r"(?m)^.*?LEY\s+(?:N[°º]?\s*)?(\d+(?:\.\d+)?)")]
    for name, pattern in table:
        kind = F.when(head.rlike(pattern), name).otherwise(kind)
        number = F.when(head.rlike(pattern), F.translate(F.regexp_extract(head, pattern, 1), ".", "")).otherwise(number)
    some = lambda c: F.when(c != "", c)
    body = F.coalesce(
        some(F.trim(F.regexp_extract(t, r"MINISTERIO\s+DE\s+([A-ZÁÉÍÓÚÑ\s,]+?)(?:\n|;)", 1))),
        some(F.trim(F.regexp_extract(t, r"del\s+Ministerio\s+de\s+([A-Za-záéíóúñÁÉÍÓÚÑ\s]+?)(?:,|\.|\n)", 1))))
    changes = amendments(t)
    upper = F.upper(t)
    repealed = F.contains(upper, F.lit("DEROGAD")) & (F.contains(upper, F.lit("TOTALMENTE")) | F.contains(upper, F.lit("ÍNTEGRAMENTE")))
    return norms.select(
        *keep, F.when(signed != "", "DECRETO").otherwise(kind).alias("tipo_leido"),
        F.when(signed != "", signed).otherwise(number).alias("numero_leido"),
        some(F.regexp_extract(t, r"D\.O\.\s*(\d{2}\.\d{2}\.\d{4})", 1)).alias("fecha_do"),
        some(F.regexp_extract(t, r"(?iu)Santiago,\s*(\d{1,2}\s*de\s*[\p{L}]+\s*de\s*\d{4})", 1)).alias("promulgacion"),
        body.alias("ministerio"), F.size(changes).cast("bigint").alias("n_modificaciones"),
        F.size(cited_norms(t)).cast("bigint").alias("n_citas"),
        F.when(repealed, "DEROGADA").when(F.size(changes) > 0, "MODIFICADA").otherwise("VIGENTE").alias("estado"))


def siblings(sections: DataFrame, key: str = "id_norma") -> DataFrame:
    """Article pairs named by position: previous and next in the same norm, found by an equi-join on order."""
    before = F.col("texto").rlike(r"(?iu)(?<![\p{L}\p{N}_])art[íi]culo\s+(precedente|anterior)(?![\p{L}\p{N}_])")
    after = F.col("texto").rlike(r"(?iu)(?<![\p{L}\p{N}_])art[íi]culo\s+(siguiente|posterior|próximo)(?![\p{L}\p{N}_])")
    asks = F.array_compact(F.array(
        F.when(before, F.struct((F.col("orden") - 1).alias("orden_destino"), F.lit("precedente").alias("via"))),
        F.when(after, F.struct((F.col("orden") + 1).alias("orden_destino"), F.lit("siguiente").alias("via")))))
    wanted = sections.select(key, F.col("numero").alias("origen"), F.explode_outer(asks).alias("w")).where(F.col("w").isNotNull()).select(
        key, "origen", "w.orden_destino", "w.via")
    targets = sections.select(key, F.col("orden").alias("orden_destino"), F.col("numero").alias("destino"))
    return wanted.join(targets, [key, "orden_destino"]).select(key, "origen", "destino", "via")
