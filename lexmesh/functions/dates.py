"""Date parsing as guarded Column expressions; anything invalid becomes null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexmesh.functions import lexicon as L

_MONTH_WORDS = "|".join(L.MONTHS)


def _month_from(name: Column, table: dict[str, int]) -> Column:
    pairs = [part for key, value in table.items() for part in (F.lit(key), F.lit(value))]
    return F.element_at(F.create_map(*pairs), name)


def _date(year: Column, month: Column, day: Column) -> Column:
    """Null instead of an error for impossible dates such as 30 February."""
    text = F.concat_ws("-", F.lpad(year, 4, "0"), F.lpad(month, 2, "0"), F.lpad(day, 2, "0"))
    return F.when(year.isNotNull() & month.isNotNull() & day.isNotNull(), F.try_to_date(text, "yyyy-MM-dd"))


def _group(text: Column, pattern: str, index: int) -> Column:
    found = F.regexp_extract(text, pattern, index)
    return F.when(found != "", found)


ISO = r"^([0-9]{4})-([0-9]{1,2})-([0-9]{1,2})$"
NUMERIC = r"^([0-9]{1,2})[.\-/]([0-9]{1,2})[.\-/]([0-9]{2,4})$"
SPANISH = rf"(?i)([0-9]{{1,2}})\s+de\s+({_MONTH_WORDS})\s+de\s+([0-9]{{4}})"


def _spanish_date(text: Column, pattern: str) -> Column:
    month = _month_from(F.lower(_group(text, pattern, 2)), L.MONTHS)
    return _date(_group(text, pattern, 3), month.cast("string"), _group(text, pattern, 1))


def parse_date(raw: Column) -> Column:
    """ISO, day-month-year with a two-digit pivot at 50, then written-out Spanish dates."""
    text = F.trim(raw)
    iso = _date(_group(text, ISO, 1), _group(text, ISO, 2), _group(text, ISO, 3))
    year = _group(text, NUMERIC, 3).cast("int")
    full_year = F.when(year >= 100, year).when(year < 50, year + 2000).otherwise(year + 1900)
    numeric = _date(full_year.cast("string"), _group(text, NUMERIC, 2), _group(text, NUMERIC, 1))
    return (
        F.when(text.rlike(ISO), iso)
        .when(text.rlike(NUMERIC), numeric)
        .otherwise(_spanish_date(text, SPANISH))
    )


HEADER = r"(?iu)Publicaci[oó]n\s*:?\s*([0-9]{1,2})-([A-ZÁÉÍÓÚ]{3,4})-([0-9]{4})"
CITY = (
    r"(?iu)(?<![\p{L}\p{N}_])[A-ZÁÉÍÓÚÑ][a-záéíóúñ]+(?:\s+[A-ZÁÉÍÓÚÑ][a-záéíóúñ]+)*,\s+"
    rf"([0-9]{{1,2}})\s+de\s+({_MONTH_WORDS})\s+de\s+([0-9]{{4}})"
)
HEADER_CHARS = 5000  # headers sit at the top of a norm: part of the rule, not a shortcut


def header_date(text: Column) -> Column:
    """``Publicación: 15-MAR-2020`` near the top of the text."""
    head = F.substring(text, 1, HEADER_CHARS)
    code = F.substring(F.upper(_group(head, HEADER, 2)), 1, 3)
    month = _month_from(code, L.MONTH_CODES).cast("string")
    return _date(_group(head, HEADER, 3), month, _group(head, HEADER, 1))


def signing_date(text: Column) -> Column:
    """``Santiago, 15 de marzo de 2020`` near the top of the text."""
    return _spanish_date(F.substring(text, 1, HEADER_CHARS), CITY)


def _plausible_version(version: Column) -> Column:
    day = parse_date(F.when(version["id_version"].rlike(ISO), version["id_version"]))
    return F.when(F.year(day).between(1900, 2100), day)


def original_version_date(versions: Column) -> Column:
    dated = F.transform(
        F.filter(versions, lambda v: F.contains(F.lower(F.trim(v["descripcion"])), F.lit("texto original"))),
        _plausible_version,
    )
    return F.get(F.array_compact(dated), F.lit(0))


def oldest_version_date(versions: Column) -> Column:
    return F.array_min(F.array_compact(F.transform(versions, _plausible_version)))


def publication_date(field: Column, text: Column, versions: Column) -> Column:
    """First layer that yields a date: field, header, original version, oldest version, signing."""
    return F.coalesce(
        parse_date(field),
        header_date(text),
        original_version_date(versions),
        oldest_version_date(versions),
        signing_date(text),
    )


def coded_date(raw: Column) -> Column:
    """``08-ABR-2024``; an unknown month code counts as January."""
    parts = F.split(raw, "-")
    month = F.coalesce(_month_from(F.upper(F.get(parts, F.lit(1))), L.MONTH_CODES), F.lit(1))
    return F.when(
        F.size(parts) == 3,
        _date(F.get(parts, F.lit(2)), month.cast("string"), F.get(parts, F.lit(0))),
    )


def norm_year(text: Column, title: Column) -> Column:
    """Year signed in Santiago (first 1,000 characters), else a 19xx/20xx year of the title."""
    signed = _group(F.substring(text, 1, 1000), r"Santiago,\s+[0-9]+\s+de\s+[\p{L}\p{N}_]+\s+de\s+([0-9]{4})", 1)
    titled = _group(title, r"(?<![\p{L}\p{N}_])((?:19|20)[0-9]{2})(?![\p{L}\p{N}_])", 1)
    return F.coalesce(signed, titled, F.lit(""))


def recency(year: Column) -> Column:
    """0 for 1935 and before, 0.9 for 2025 and after, linear in between."""
    share = (year - L.RECENCY_START) / L.RECENCY_SPAN
    return F.least(F.greatest(share, F.lit(0.0)), F.lit(1.0)) * L.RECENCY_WEIGHT


def year_filter(published: Column, promulgated: Column, title: Column, year: int) -> Column:
    """A date of that year or later; undated rows pass when the title names the year."""
    late = lambda c: F.coalesce(_group(c, r"([0-9]{4})", 1).cast("int") >= year, F.lit(False))
    return late(published) | late(promulgated) | F.contains(title, F.lit(str(year)))
