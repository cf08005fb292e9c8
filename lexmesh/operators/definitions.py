"""Definition quality, canonical names and choice of the authoritative source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmesh.functions import lexicon as L
from lexmesh.functions.text import WORD, definition_words, fold_accents

# Phrases that point elsewhere instead of defining.
REMISSION = (
    rf"(?iu)(?<!{WORD})(a que se refiere|se refiere|señalad[oa] en|definid[oa] en|establecid[oa] en|"
    rf"en los t[ée]rminos de|conforme a lo dispuesto)(?!{WORD})"
)
# Words and signs that end the noun phrase of a definition.
BOUNDARY = (
    rf"(?iu)(?:[.;:,]|(?<!{WORD})(?:a\s+que|al\s+que|a\s+los\s+que|a\s+las\s+que|a\s+la\s+que|que\s+se\s+refiere|"
    rf"que\s+establece|que\s+fija|que\s+indica|que\s+se\s+{WORD}+|en\s+adelante|seg[uú]n|conforme)(?!{WORD})"
    rf"|(?<!{WORD})(?:establecid[oa]s?|definid[oa]s?|constituid[oa]s?|conformad[oa]s?|integrad[oa]s?|denominad[oa]s?|"
    rf"es|son|ser[aá]n?|consiste|corresponde|comprende|contemplad[oa]s?|se\s+entender[aá])(?!{WORD}))"
)


def is_label(name: Column, definition: Column) -> Column:
    """Hardly more words than the name itself."""
    own = F.array_distinct(definition_words(name))
    extra = F.filter(definition_words(definition), lambda w: ~F.array_contains(own, w))
    return F.size(extra) < L.MIN_EXTRA_WORDS


def is_remission(definition: Column) -> Column:
    return F.coalesce(definition, F.lit("")).rlike(REMISSION)


def suspicion(name: Column, definition: Column) -> Column:
    """Reasons to doubt a definition, comma separated; empty when it looks sound."""
    blank = F.length(F.trim(F.coalesce(definition, F.lit("")))) == 0
    reasons = F.array_compact(F.array(
        F.when(is_remission(definition), "remission"), F.when(is_label(name, definition), "label")))
    return F.when(blank, "empty").otherwise(F.array_join(reasons, ","))


def canonical_name(name: Column, definition: Column) -> tuple[Column, Column]:
    """(canonical, confidence) when the definition restates and extends the name."""
    text = F.trim(F.coalesce(definition, F.lit("")))
    restated = F.startswith(fold_accents(F.lower(text)), F.trim(fold_accents(F.lower(name))))
    after = F.substring(text, F.length(name) + 1, F.length(text))
    extends = after.rlike(r"^\s")
    cut = F.regexp_instr(after, F.lit(BOUNDARY))
    phrase = F.regexp_replace(F.trim(F.concat(name, F.substring(after, F.lit(1), cut - 1))), r"[ ,;:.]+$", "")
    words = lambda c: F.size(F.split(F.trim(c), r"\s+"))
    extra = words(phrase) - words(name)
    fires = (text != "") & restated & extends
    confidence = (
        F.when(~fires, "no-fire").when(cut == 0, "low").when(extra <= 0, "no-fire")
        .when(extra <= L.MAX_CANONICAL_EXTRA_WORDS, "high").otherwise("low"))
    canonical = F.when(fires & (cut > 0) & (extra > 0), phrase)
    return canonical, confidence


def naming_actions(concepts: DataFrame) -> DataFrame:
    """rename / review / skip per concept; a rename that meets another concept's name goes to review."""
    canonical, confidence = canonical_name(F.col("nombre"), F.col("definicion"))
    key = lambda c: fold_accents(F.lower(c))
    proposed = concepts.select("concepto_id", "nombre", canonical.alias("canonico"), confidence.alias("confianza"))
    names = concepts.groupBy(key(F.col("nombre")).alias("llave")).agg(F.lit(True).alias("choca"))
    joined = proposed.withColumn("llave", key(F.col("canonico"))).join(names, "llave", "left")
    clash = F.coalesce("choca", F.lit(False)) & (F.col("llave") != key(F.col("nombre")))
    action = (
        F.when(F.col("confianza") == "no-fire", "skip")
        .when((F.col("confianza") == "low") | clash, "review").otherwise("rename"))
    reason = (
        F.when(F.col("confianza") == "no-fire", "no-fire")
        .when((F.col("confianza") == "low") & F.col("canonico").isNull(), "low_confidence: no_boundary")
        .when(F.col("confianza") == "low", "low_confidence: too_long")
        .when(clash, "collision").otherwise("high"))
    return joined.select("concepto_id", "canonico", action.alias("accion"), reason.alias("motivo"))


def first_per_norm(candidates: DataFrame) -> DataFrame:
    """One candidate per (concept, norm): the lowest article number."""
    others = [c for c in candidates.columns if c not in ("concepto_id", "id_norma")]
    return candidates.groupBy("concepto_id", "id_norma").agg(
        F.min_by(F.struct(*others), F.struct("articulo", "pos")).alias("c")).select("concepto_id", "id_norma", "c.*")


def authority(candidates: DataFrame) -> DataFrame:
    """Authoritative article per concept, or a conflict with its reason.

    candidates: (concepto_id, id_norma, articulo, rank, fecha, pos). Everything is
    a mergeable aggregate at three levels (date, rank, concept), so a concept with
    very many candidates is never gathered in one place. ``pos`` keeps the input
    order that decides exact ties.
    """
    age = F.struct(F.col("fecha").isNotNull().alias("dated"), F.coalesce(F.col("fecha").cast("string"), F.lit("")).alias("day"))
    entry = F.struct("id_norma", "articulo")
    by_date = candidates.withColumn("age", age).groupBy("concepto_id", "rank", "age").agg(
        F.count(F.lit(1)).alias("n"), F.min("id_norma").alias("lo"), F.max("id_norma").alias("hi"),
        F.min("pos").alias("pos"), F.min_by(entry, "pos").alias("first"))
    by_rank = by_date.groupBy("concepto_id", "rank").agg(
        F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"),
        F.max_by(F.struct("n", "first"), "age").alias("top"),
        F.max(F.struct("age", (-F.col("pos")).alias("back"), "first")).alias("latest"))
    final = by_rank.groupBy("concepto_id").agg(
        F.sum("n").alias("n"),
        F.max_by(F.struct("n", "lo", "hi", "top"), "rank").alias("best"),
        F.max("latest").alias("latest"))
    winner, latest = F.col("best.top.first"), F.col("latest.first")
    reason = (
        F.when(F.col("n") == 1, "unico")
        .when(F.col("best.top.n") > 1, "empate")
        .when(F.col("best.lo") != F.col("best.hi"), "varias_normas")
        .when(winner["id_norma"] == latest["id_norma"], "rango_y_fecha")
        .otherwise("rango_contra_fecha"))
    resolved = reason.isin("unico", "rango_y_fecha")
    return final.select(
        "concepto_id", F.when(resolved, "resolved").otherwise("conflict").alias("estado"), reason.alias("motivo"),
        F.when(resolved, winner["id_norma"]).alias("id_norma"), F.when(resolved, winner["articulo"]).alias("articulo"),
        F.col("best.n").alias("n_rango_mayor"), F.col("n").alias("n_candidatos"))


def definition_source(candidates: DataFrame) -> DataFrame:
    """Substantive curated candidates only: none, one, or the authority rule among many."""
    concepts = candidates.select("concepto_id").distinct()
    sound = candidates.where((F.col("origin") == "curated") & ~is_label(F.col("nombre"), F.col("definicion")))
    chosen = authority(sound.select("concepto_id", "id_norma", "articulo", "rank", "fecha", "pos"))
    criterion = (
        F.when(F.col("n_candidatos") == 1, "sustancia").when(F.col("n_rango_mayor") == 1, "jerarquia").otherwise("fecha"))
    resolved = F.coalesce(F.col("estado") == "resolved", F.lit(False))
    return concepts.join(chosen, "concepto_id", "left").select(
        "concepto_id", F.when(resolved, "resolved").otherwise("unresolved").alias("estado"), "id_norma", "articulo",
        F.when(resolved, criterion).when(F.col("n_candidatos").isNull(), "no-substantive-candidate")
        .otherwise("rank-recency-conflict").alias("criterio"))


def gather(curated: DataFrame, retrieved: DataFrame) -> DataFrame:
    """Union tagged by origin; per (concept, norm, article) the curated row wins."""
    tagged = curated.withColumn("origin", F.lit("curated")).unionByName(retrieved.withColumn("origin", F.lit("retrieved")))
    others = [c for c in tagged.columns if c not in ("concepto_id", "id_norma", "articulo")]
    return tagged.groupBy("concepto_id", "id_norma", "articulo").agg(
        F.min_by(F.struct(*others), F.struct("origin", "pos")).alias("c")).select("concepto_id", "id_norma", "articulo", "c.*")


def decisions(concepts: DataFrame, candidates: DataFrame, confirmed: DataFrame, proposals: DataFrame) -> DataFrame:
    """Staged resolution: confirmed by a person, then only suspect concepts: rule, proposal, nothing.

    confirmed (concepto_id, id_norma, articulo); proposals (concepto_id, id_norma,
    articulo, criterio) come from a pluggable proposer and count only when they
    name one of the candidates.
    """
    rule = definition_source(candidates).where(F.col("estado") == "resolved").select(
        "concepto_id", F.struct("id_norma", "articulo", "criterio").alias("regla"))
    allowed = candidates.select("concepto_id", "id_norma", "articulo").distinct()
    proposed = proposals.join(allowed, ["concepto_id", "id_norma", "articulo"], "left_semi").groupBy("concepto_id").agg(
        F.min(F.struct("id_norma", "articulo", "criterio")).alias("propuesta"))
    fixed = confirmed.select("concepto_id", F.struct("id_norma", "articulo", F.lit("confirmado_humano").alias("criterio")).alias("confirmada"))
    have = candidates.select("concepto_id").distinct()
    rows = (
        concepts.join(have, "concepto_id", "left_semi")
        .withColumn("sospecha", suspicion(F.col("nombre"), F.col("definicion")))
        .join(fixed, "concepto_id", "left").join(rule, "concepto_id", "left").join(proposed, "concepto_id", "left")
        .where(F.col("confirmada").isNotNull() | (F.col("sospecha") != ""))
    )
    pick = F.coalesce("confirmada", "regla", "propuesta")
    sure = F.col("confirmada").isNotNull() | F.col("regla").isNotNull()
    return rows.select(
        "concepto_id", pick["id_norma"].alias("id_norma"), pick["articulo"].alias("articulo"),
        F.coalesce(pick["criterio"], F.lit("ninguno")).alias("criterio"),
        F.when(sure, "alta").otherwise("baja").alias("confianza"), (~sure).alias("needs_review"),
        F.when(F.col("confirmada").isNotNull(), "confirmado").otherwise(F.col("sospecha")).alias("razones"))
