"""Citations in answers: extraction, cleaning and the strings that constrain them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexmesh.functions.text import degree_grounding

# The citation format.
_OPEN = r"\[(?:art[íi]culos?\.?|arts?\.)"
_STRICT = r"\s*(\d+\s*[°º]?(?:\s*(?:bis|ter|quater|quinquies))?(?:\s*[A-Z])?)\s+(?:de|del)\s+([A-Z_0-9]+)\]"
CITATION = rf"(?iu){_OPEN}{_STRICT}"
MALFORMED = rf"(?iu)\s*(?!{_OPEN}{_STRICT})(?<!\s){_OPEN}[^\]]*\]"


def citations(text: Column) -> Column:
    """Array of (norma, articulo), article numbers without degree signs."""
    text = F.coalesce(text, F.lit(""))
    numbers = F.regexp_extract_all(text, F.lit(CITATION), F.lit(1))
    norms = F.regexp_extract_all(text, F.lit(CITATION), F.lit(2))
    return F.zip_with(norms, numbers, lambda n, a: F.struct(n.alias("norma"), degree_grounding(a).alias("articulo")))


def strip_malformed(text: Column) -> Column:
    """Drop citation-like brackets, with the blanks before them, that break the format."""
    return F.regexp_replace(text, rf"(?iu)\s*(?={_OPEN})(?!{_OPEN}{_STRICT}){_OPEN}[^\]]*\]", "")


def is_refusal(text: Column, phrase: str) -> Column:
    return F.contains(F.lower(F.coalesce(text, F.lit(""))), F.lit(phrase))


# Fixed value: a number that may be a norm's: thousands with dots, or three digits and more.
NORM_NUMBER = r"\b\d{1,3}(?:\.\d{3})+\b|\b\d{3,}\b"


def norm_numbers(text: Column) -> Column:
    """Distinct norm numbers of a text, without dots."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(NORM_NUMBER), F.lit(0))
    return F.array_distinct(F.transform(found, lambda n: F.replace(n, F.lit("."), F.lit(""))))


def cites_its_norm(reasons: Column, title: Column, number: Column) -> Column:
    """Whether a justification that names norm numbers names the one it picked, by title or number; true where there is nothing to compare."""
    cited = norm_numbers(reasons)
    bare = F.replace(F.coalesce(number, F.lit("")), F.lit("."), F.lit(""))
    own = F.concat(norm_numbers(title), F.when(bare != "", F.array(bare)).otherwise(F.array().cast("array<string>")))
    return (F.size(cited) == 0) | (F.size(own) == 0) | F.arrays_overlap(cited, own)
