"""Keyword and title rules as ``when`` chains."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexmesh.functions import lexicon as L

_EDGE = r"(?![\p{L}\p{N}_])"


def _has(text: Column, *needles: str) -> Column:
    test = F.contains(text, F.lit(needles[0]))
    for needle in needles[1:]:
        test = test | F.contains(text, F.lit(needle))
    return test


def norm_class(title: Column) -> Column:
    """Operative verb at the start of the title, else within its first 80 characters."""
    body = F.trim(F.regexp_replace(F.upper(title), r"^[A-Z]+\s+\d+\s*", ""))
    head = F.substring(body, 1, 80)
    # Class, opening verb.
    verbs = [("reglamento_base", r"APRUEBA\s+REGLAMENTO"), ("fija_valores", "FIJA"),
             ("modifica", "MODIFICA"), ("deroga", "DEROGA")]
    rule = F.when(F.lit(False), F.lit(None).cast("string"))
    for label, verb in verbs:
        rule = rule.when(body.rlike(rf"^(?:T\s+)?{verb}{_EDGE}"), label)
    for label, verb in verbs:
        rule = rule.when(_has(head, verb.replace(r"\s+", " ")), label)
    return rule


def title_relation(title: Column) -> Column:
    """Relation kind announced by a title."""
    t = F.upper(title)
    return (
        F.when(_has(t, "MODIFICA"), "MODIFICA")
        .when(_has(t, "DEROGA", "DERÓGA"), "DEROGA")
        .when(_has(t, "SUSTITUYE"), "SUSTITUYE")
        .when(_has(t, "REGLAMENTA", "REGLAMENTO"), "REGLAMENTA")
        .when(_has(t, "APRUEBA"), "APRUEBA")
        .otherwise("REFERENCIA")
    )


def title_rank(title: Column) -> Column:
    """Legal rank stated by the title, null when it states none."""
    t = F.upper(F.coalesce(title, F.lit("")))
    b = r"(?<![\p{L}\p{N}_])"
    legal = (
        t.rlike(rf"{b}DECRETO\s+LEY{_EDGE}")
        | t.rlike(rf"{b}D\.?L\.?(?:(?<=\.)(?=[\p{{L}}\p{{N}}_])|(?<!\.){_EDGE})")
        | t.rlike(rf"{b}D\.?F\.?L\.?(?:(?<=\.)(?=[\p{{L}}\p{{N}}_])|(?<!\.){_EDGE})")
        | _has(t, "FUERZA DE LEY")
        | t.startswith("LEY")
        | t.rlike(rf"{b}LEY\s+N")
    )
    return (
        F.when(legal, L.RANK_LEGAL)
        .when(_has(t, "RESOLUCION", "RESOLUCIÓN"), L.RANK_RESOLUTION)
        .when(_has(t, "DECRETO"), L.RANK_DECREE)
    )


def kind_rank(kind: Column) -> Column:
    k = F.upper(F.coalesce(kind, F.lit("")))
    return (
        F.when(k.isin("LEY", "DFL", "DL"), L.RANK_LEGAL)
        .when(k == "DECRETO", L.RANK_DECREE)
        .when(k.isin("RESOLUCIÓN", "RESOLUCION"), L.RANK_RESOLUTION)
    )


def legal_rank(kind: Column, title: Column) -> tuple[Column, Column]:
    """(rank, flagged): the title decides; a silent or contradicting title is flagged."""
    from_title, from_kind = title_rank(title), kind_rank(kind)
    rank = F.coalesce(from_title, from_kind, F.lit(L.RANK_DECREE))
    flagged = from_title.isNull() | F.coalesce(from_kind != from_title, F.lit(False))
    return rank, flagged


def organism(name: Column) -> Column:
    """Nine-way normalisation of the issuing body; the order of tests matters."""
    n = F.upper(name)
    return (
        F.when(name.isNull() | (name == ""), F.lit(None).cast("string"))
        .when(_has(n, "ENERGÍA", "ENERGIA") & _has(n, "COMISIÓN NACIONAL", "CNE"), "CNE")
        .when(_has(n, "ENERGÍA", "ENERGIA"), "MIN_ENERGIA")
        .when(_has(n, "ELECTRICIDAD", "SEC"), "SEC")
        .when(_has(n, "ECONOMÍA", "ECONOMIA"), "MIN_ECONOMIA")
        .when(_has(n, "HACIENDA"), "MIN_HACIENDA")
        .when(_has(n, "MEDIO AMBIENTE"), "MIN_MEDIO_AMBIENTE")
        .when(_has(n, "MINERÍA", "MINERIA"), "MIN_MINERIA")
        .when(_has(n, "OBRAS PÚBLICAS"), "MOP")
        .when(_has(n, "INTERIOR"), "MIN_INTERIOR")
        .otherwise("OTRO")
    )


def kind_and_number(raw: Column) -> tuple[Column, Column]:
    """Type and number of ``DECRETO 62``-like strings."""
    t = F.upper(F.trim(raw))
    number = F.regexp_extract(t, r"^(?:LEY|DFL|DL|DECRETO|RESOLUCIÓN|RESOLUCION)\s*(\d+)", 1)
    kind = (
        F.when(t.rlike(r"^LEY\s*\d+"), "LEY")
        .when(t.rlike(r"^DFL\s*\d+"), "DFL")
        .when(t.rlike(r"^DL\s*\d+"), "DL")
        .when(t.rlike(r"^DECRETO\s*\d+"), "DECRETO")
        .when(t.rlike(r"^(RESOLUCIÓN|RESOLUCION)\s*\d+"), "RESOLUCION")
        .when(t.rlike(r"^AUTO\s+"), "AUTO")
        .otherwise("OTRO")
    )
    return kind, F.when(number != "", number)


def domain_class(expected_norm: Column, off_domain: list[str]) -> Column:
    """Evaluation bucket by expected norm."""
    return (
        F.when(expected_norm.isNull(), "negative")
        .when(expected_norm.isin(off_domain), "offdomain")
        .otherwise("electric")
    )


def length_weights(question: Column) -> tuple[Column, Column]:
    """(lexical, dense) fusion weights by the number of words longer than three letters."""
    n = F.size(F.filter(F.split(F.trim(question), r"\s+"), lambda w: F.length(w) > 3))
    lexical = F.when(n <= 3, 0.65).when(n >= 7, 0.35).otherwise(0.5)
    dense = F.when(n <= 3, 0.35).when(n >= 7, 0.65).otherwise(0.5)
    return lexical, dense


def search_strategy(question: Column) -> Column:
    """Keyword, dense or hybrid route of the adaptive search."""
    low = F.lower(question)
    hits = sum(F.when(F.contains(low, F.lit(t)), 1).otherwise(0) for t in L.TECHNICAL_TERMS)
    return (
        F.when(low.rlike(r"(decreto|ley|resolución|d\.)\s*[0-9]+"), "keywords")
        .when(hits <= 2, "embeddings")
        .otherwise("hybrid")
    )
