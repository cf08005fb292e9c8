"""Text normalisation and tokenising as Column -> Column expressions (no Python workers)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexmesh.functions import lexicon as L

WORD = r"[\p{L}\p{N}_]"


def fold_accents(text: Column) -> Column:
    """Replace accented Latin letters by their base letter."""
    return F.translate(text, L.ACCENTED, L.UNACCENTED)


def squeeze(text: Column) -> Column:
    """One space for each whitespace run, none at the ends."""
    return F.trim(F.regexp_replace(text, r"[\s ]+", " "))


def collapse_acronyms(text: Column) -> Column:
    """``v.a.t.t.`` -> ``vatt``: drop dots inside runs of at least two letter-dot pairs.

    ``\\G`` anchors each further pair to the end of the one before, so only
    dots that belong to the run are removed.
    """
    run = (
        rf"(?:(?<!{WORD})(?=(?:[a-zñ]\.){{2}})|\G(?<=[a-zñ]\.))([a-zñ])\."
        r"|\G(?<=[a-zñ]\.)\."
    )
    return F.regexp_replace(text, run, "$1")


def normalize_for_match(text: Column) -> Column:
    """Orthographic canonical form: case, acronym dots, accents and spacing."""
    return squeeze(fold_accents(collapse_acronyms(F.lower(F.coalesce(text, F.lit(""))))))


def contains_term(text: Column, term: Column) -> Column:
    """Whole-term test on two already normalised columns.

    Both sides are padded with one space and every non-word character of the
    haystack is mapped to a space, so a plain substring test respects word
    borders without a per-row regex.
    """
    as_words = lambda c: F.concat(F.lit(" "), squeeze(F.regexp_replace(c, rf"[^\p{{L}}\p{{N}}_]+", " ")), F.lit(" "))
    return (F.length(term) > 0) & F.contains(as_words(text), as_words(term))


def escape_regex(text: Column) -> Column:
    return F.regexp_replace(text, r"([\\.\[\]{}()*+?^$|\-])", r"\\$1")


def flanked_pattern(term: Column) -> Column:
    """Regex for ``term`` as a standalone token; also right for dotted acronyms."""
    flank = "0-9A-Za-zÀ-ÿ"
    return F.concat(F.lit(f"(?iu)(?<![{flank}])"), escape_regex(term), F.lit(f"(?![{flank}])"))


def _words(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), F.lit(0))


def _without(words: Column, stopwords: list[str], shortest: int) -> Column:
    stop = F.array(*[F.lit(w) for w in stopwords])
    return F.filter(words, lambda w: (F.length(w) >= shortest) & ~F.array_contains(stop, w))


def lexical_tokens(text: Column) -> Column:
    """Index tokens: lower case words of three letters or more, few stop words dropped."""
    return _without(_words(F.lower(text), rf"{WORD}+"), L.LEXICAL_STOPWORDS, 3)


def content_tokens(text: Column) -> Column:
    """Distinct content words without accents, used to measure definition recall."""
    folded = fold_accents(F.lower(text))
    return F.array_distinct(_without(_words(folded, "[a-zñ0-9]+"), L.CONTENT_STOPWORDS, 3))


def significant_words(text: Column) -> Column:
    """Distinct alphabetic words of four letters or more that may reveal an off-topic query."""
    words = _words(F.lower(text), rf"(?<!{WORD})[a-záéíóúñü]{{4,}}(?!{WORD})")
    return F.array_distinct(_without(words, L.OFF_TOPIC_STOPWORDS, 4))


def vocabulary_words(text: Column) -> Column:
    """Same shape as :func:`significant_words` but keeping stop words."""
    return F.array_distinct(_words(F.lower(text), rf"(?<!{WORD})[a-záéíóúñü]{{4,}}(?!{WORD})"))


def definition_words(text: Column) -> Column:
    """Content words of a definition, repeats kept."""
    folded = fold_accents(F.lower(text))
    return _without(_words(folded, "[a-záéíóúñ]{2,}"), L.DEFINITION_STOPWORDS, 2)


def keywords(text: Column) -> Column:
    """Keywords of a question: words longer than three letters, repeats kept."""
    return _without(_words(F.lower(text), rf"{WORD}+"), L.KEYWORD_STOPWORDS, 4)


def catalog_key(text: Column) -> Column:
    """Catalog lookup form: lower case, single spaces, no leading article."""
    return F.regexp_replace(squeeze(F.lower(text)), r"^(la|el|los|las)\s+", "")


def norm_variants(kind: Column, number: Column) -> Column:
    """Orthographic ways to cite one norm."""
    # Spelling patterns per norm type.
    forms = {
        "DECRETO": ["D.S. N° %s", "D.S. %s", "Decreto Supremo %s", "Decreto Supremo N° %s",
                    "decreto %s", "D.S. N°%s"],
        "LEY": ["Ley N° %s", "Ley %s", "ley %s", "Ley N°%s"],
        "DFL": ["DFL N° %s", "DFL %s", "D.F.L. %s", "DFL N°%s", "D.F.L. N° %s"],
        "RESOLUCION": ["Resolución Exenta N° %s", "Res. Ex. %s", "Resolución %s", "Res. Ex. N° %s"],
    }
    spell = lambda form: F.concat(F.lit(form.split("%s")[0]), number)
    pick = None
    for name, spellings in forms.items():
        listed = F.array(*[spell(s) for s in spellings])
        pick = F.when(kind == name, listed) if pick is None else pick.when(kind == name, listed)
    return pick.otherwise(F.array(F.concat(kind, F.lit(" "), number)))


def article_number(raw: Column, transitory: Column) -> Column:
    """Canonical article number: lower-case suffix words, optional ``transitorio``."""
    number = squeeze(raw)
    for suffix in ("BIS", "TER", "QUATER", "QUINQUIES"):
        number = F.regexp_replace(number, rf"(?<!{WORD}){suffix}(?!{WORD})", suffix.lower())
    return F.when(transitory, F.concat(number, F.lit(" transitorio"))).otherwise(number)


def degree_grounding(value: Column) -> Column:
    """Degree rule of the citation check: both signs dropped, spaces collapsed."""
    return squeeze(F.translate(value, "°º", ""))


def degree_retrieval(value: Column) -> Column:
    """Degree rule of the retrieval hit: only the degree sign dropped."""
    return F.coalesce(F.regexp_replace(F.trim(value), "°", ""), F.lit(""))


def degree_scoring(value: Column) -> Column:
    """Degree rule of answer scoring: both signs dropped, inner spaces kept."""
    return F.coalesce(F.translate(F.trim(value), "°º", ""), F.lit(""))


def display_title(title: Column) -> Column:
    """Title without the (possibly doubled) type and number, first 120 characters."""
    lead = r"^[A-ZÁÉÍÓÚÑ]+\s+\d+\s*"
    once = F.trim(F.regexp_replace(title, lead, ""))
    twice = F.trim(F.regexp_replace(once, lead, ""))
    return F.substring(F.trim(F.regexp_replace(twice, r"^T\s+", "")), 1, 120)


def clean_article_text(text: Column) -> Column:
    """One space for each whitespace run, no control signs. Plain replacements come first, since few texts need more than them."""
    for sign in "\t\n\x0b\f\r\u00a0":
        text = F.replace(text, F.lit(sign), F.lit(" "))
    return F.trim(F.regexp_replace(F.regexp_replace(text, " {2,}", " "), r"[\x00-\x08\x0e-\x1f\x7f]", ""))


def first_letters(name: Column) -> Column:
    """Initials of the capitalised words of a name."""
    initials = F.transform(F.split(name, r"\s+"), lambda w: F.substring(w, 1, 1))
    return F.array_join(F.filter(initials, lambda c: c.rlike(r"^\p{Lu}$")), "")


def context_window(text: Column, start: Column, length: Column, margin: int) -> Column:
    """Characters around a match; ``start`` counts from zero."""
    left = F.greatest(F.lit(0), start - margin)
    return F.substring(text, left + 1, (start + length + margin - left).cast("int"))


def content_hash(text: Column) -> Column:
    return F.substring(F.sha2(text, 256), 1, 16)


def token_estimate(text: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(text) / 4)).cast("bigint")


def word_count(text: Column) -> Column:
    """Words between single spaces (empty pieces count, as in array splitting on one space)."""
    return F.size(F.split(text, " "))


def _holds(low: Column, stems: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(low, F.lit(s)) for s in stems])


def _tags(text: Column, table: list[tuple[str, list[str]]]) -> Column:
    """Tags whose stems occur; the one-element transform lower-cases the text only once."""
    tagged = lambda low: F.array_compact(F.array(*[F.when(_holds(low, stems), F.lit(tag)) for tag, stems in table]))
    return F.get(F.transform(F.array(F.lower(text)), tagged), F.lit(0))


def themes(text: Column) -> Column:
    """Theme tags in fixed order, by stem containment in lower-cased text."""
    return _tags(text, L.THEME_STEMS)


def sector_relevant(text: Column) -> Column:
    return F.exists(F.array(F.lower(text)), lambda low: _holds(low, L.SECTOR_STEMS))


def themes_short(text: Column) -> Column:
    """The eight-theme variant of the tagger."""
    # Tag and its stems.
    table = [
        ("DISTRIBUCION", ["distribuci"]), ("TRANSMISION", ["transmisi"]),
        ("GENERACION", ["generaci"]), ("MEDIDAS", ["medid", "medici"]), ("TARIFAS", ["tarifa"]),
        ("POTENCIA", ["potencia"]), ("ENERGIA", ["energ"]), ("PEAJES", ["peaje"]),
    ]
    return _tags(text, table)
