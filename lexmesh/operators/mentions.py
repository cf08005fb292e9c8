"""References that a text makes, each with its place, its context and how far it is to be trusted."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexmesh.functions import lexicon as L
from lexmesh.functions.text import WORD, catalog_key
from lexmesh.operators.extraction import ARTICLE_LEADS, ARTICLE_OF_NORM, NORM_ALONE, NORM_LEADS
from lexmesh.operators.spans import following, matched, occurrences
from lexmesh.session import unsent, written

CITATION_MARGIN, TERM_MARGIN = 50, 30
# How far a name or an alias is trusted, verbs of reform, the norm they may name, and how far behind them it may stand.
ALIAS_TRUST, CONCEPT_TRUST = 0.85, 0.90
REFORM_VERB = r"\b(der[óo]gan?se|mod[ií]f[íi]case|reempl[áa]zase|interc[áa]lase|sustit[úu]yese|agr[ée]gase)\b"
NUMBERED_NORM = r"(ley|decreto|D\.?F\.?L\.?|reglamento)\s+(?:con fuerza de ley\s+)?N[°º]\s*([\d\.]+)"
REFORM_REACH = 120

_python = lambda pattern: pattern.replace(WORD, r"\w").replace(r"[\p{L}\p{N}_]+", r"\w+")


def citations(texts: DataFrame, keep: list[str], targets: DataFrame, text: str = "texto", margin: int = CITATION_MARGIN) -> DataFrame:
    """(keep..., canonico, articulo, sub, confianza, start, context): norms a text cites, resolved by ``targets`` (llave, canonico).

    Articles of norms come first, one for each (norm, article, part). A norm named alone counts once,
    and not where it lies inside one of those. ``keep`` tells texts apart.
    """
    found = matched(texts, {"article": _python(ARTICLE_OF_NORM), "norm": _python(NORM_ALONE)}, keep, text, margin, {"article": ARTICLE_LEADS, "norm": NORM_LEADS})
    part = lambda i: F.get("groups", F.lit(i))
    article = F.col("kind") == "article"
    cited = F.concat(F.trim(F.when(article, part(3)).otherwise(part(0))), F.lit(" "), F.translate(F.when(article, part(4)).otherwise(part(1)), ".", ""))
    rows = found.select(*keep, "kind", "start", "end", "context", catalog_key(cited).alias("llave"), F.when(article, part(1)).alias("articulo"),
                        F.when(article, F.coalesce(part(0), part(2))).alias("sub"))
    # What a text cites meets once; all that follows is decided there, without another shuffle.
    known = rows.join(unsent(targets), "llave").drop("llave").repartition(*keep)
    alike = Window.partitionBy(*keep, "kind", "canonico", "articulo", "sub").orderBy("start")
    before = Window.partitionBy(*keep).orderBy("start").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    first = known.withColumn("_n", F.row_number().over(alike)).where(~article | (F.col("_n") == 1))
    # A norm lies inside an article's span if one of those that begin no later reaches as far.
    outside = first.withColumn("_to", F.max(F.when(article, F.col("end"))).over(before)).where(article | F.col("_to").isNull() | (F.col("_to") < F.col("end")))
    once = outside.withColumn("_n", F.row_number().over(alike)).where("_n = 1")
    trust = F.when(article, L.CONFIDENCE_ARTICLE_REF).otherwise(L.CONFIDENCE_NORM_REF)
    return once.select(*keep, "canonico", "articulo", "sub", trust.alias("confianza"), "start", "context")


def _named(texts: DataFrame, keep: list[str], names: DataFrame, text: str, trust: float) -> DataFrame:
    hits = occurrences(texts, names.select(F.lower("term").alias("form")), keep, text, "letters", TERM_MARGIN)
    # The walk lower-cases sign by sign; names are joined in the spelling that it reports.
    both = hits.join(names.withColumn("form", F.lower("term")), "form")
    best = both.groupBy(*keep, "entry").agg(F.min_by(F.struct("term", "start", "context"), F.struct("place", "term")).alias("m"))
    return best.select(*keep, "entry", "m.term", F.lit(trust).alias("confianza"), "m.start", "m.context")


def alias_references(texts: DataFrame, keep: list[str], aliases: DataFrame, text: str = "texto") -> DataFrame:
    """(keep..., entry, term, confianza, start, context): norms whose alias stands in a text as a whole term, one row a norm.

    ``aliases`` (entry, term, place): of several aliases in a text that of the least place counts.
    """
    return _named(texts, keep, aliases, text, ALIAS_TRUST)


def concept_mentions(texts: DataFrame, keep: list[str], names: DataFrame, text: str = "texto") -> DataFrame:
    """As ``alias_references`` for concepts: ``names`` (entry, term, place) with the name at place 0 and aliases behind it."""
    return _named(texts, keep, names, text, CONCEPT_TRUST)


def silenced_terms(names: DataFrame) -> DataFrame:
    """Names that begin or end with a sign that is no part of a word: a matcher of word borders never finds them."""
    return names.where((F.length("term") > 0) & ~F.rlike("term", F.lit(rf"(?s)^{WORD}(.*{WORD})?$")))


def regained_edges(texts: DataFrame, keep: list[str], names: DataFrame, existing: DataFrame, text: str = "texto") -> DataFrame:
    """Mentions of silenced terms that the edge table (keep..., entry) lacks. Adds only; each edge once."""
    found = concept_mentions(texts, keep, silenced_terms(names), text)
    return found.join(existing.select(*keep, "entry"), [*keep, "entry"], "left_anti")


def reform_references(texts: DataFrame, keep: list[str], text: str = "texto") -> DataFrame:
    """(keep..., verbo, start, tipo, numero): verbs that change a norm, with the first numbered norm within reach behind each; null where there is none."""
    found = written(matched(texts, {"verb": REFORM_VERB, "norm": NUMBERED_NORM}, keep, text, 0))  # texts are walked once
    verbs = found.where("kind = 'verb'").select(*keep, "start", F.lower(F.get("groups", F.lit(0))).alias("verbo"))
    norms = found.where("kind = 'norm'").select(*keep, "start", "end", F.lower(F.get("groups", F.lit(0))).alias("tipo"), F.translate(F.get("groups", F.lit(1)), ".", "").alias("numero"))
    near = following(verbs, norms, keep, REFORM_REACH).select(*keep, "start", "verbo", F.col("next.tipo").alias("tipo"), F.col("next.numero").alias("numero"))
    # The kinds of norm that the words name.
    kind = F.when(F.col("tipo") == "ley", "LEY").when(F.translate("tipo", ".", "") == "dfl", "DFL").when(F.col("tipo").isNotNull(), "DECRETO")
    return verbs.join(near.drop("verbo"), [*keep, "start"], "left").select(*keep, "verbo", "start", kind.alias("tipo"), "numero")
