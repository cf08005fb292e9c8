"""Whole-term matching of many texts against many terms.

Terms up to a bound go to the tasks to be looked up, and each text is read once.
Beyond it texts and terms are joined: a term of ``n`` words can only occur where ``n``
consecutive words of the text spell it, so texts are cut into word n-grams of the
lengths that terms really have, joined to the terms on the spelling, and verified on
what surrounds it. No text is ever compared with a term it does not contain.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmesh.functions.text import WORD, normalize_for_match
from lexmesh.operators.spans import occurrences
from lexmesh.session import unsent, written

#: Bytes of terms that are sent to tasks; more are joined.
SENT_BYTES = 16 << 20


def words_of(form: Column) -> Column:
    return F.regexp_extract_all(form, F.lit(f"{WORD}+"), F.lit(0))


def spelled(terms: DataFrame) -> DataFrame:
    """Add ``form`` (normalised), ``gram`` (its words) and ``n`` (word count); empty terms are dropped."""
    form = terms.withColumn("form", normalize_for_match(F.col("term")))
    listed = form.withColumn("words", words_of(F.col("form")))
    return listed.withColumn("gram", F.array_join("words", " ")).withColumn("n", F.size("words")).drop("words").where(F.col("n") > 0)


def find_terms(texts: DataFrame, terms: DataFrame, keep: list[str], sent: int = SENT_BYTES) -> DataFrame:
    """Rows of texts (keep..., text) joined with the terms (any columns, term) that occur in them, in canonical spelling.

    A term counts where no letter, digit or underscore stands beside it. The texts stay where they were read.
    """
    table = spelled(terms).drop("gram", "n")
    size = table.agg(F.coalesce(F.sum(F.octet_length("form")), F.lit(0)).alias("bytes")).first().bytes
    form = texts.select(*keep, normalize_for_match(F.col("text")).alias("haystack"))
    if size > sent:
        return _by_grams(form, spelled(terms), keep)
    hits = occurrences(form, table, keep, "haystack", "words", margin=None)
    return hits.select(*keep, "form").join(table, "form")


def _by_grams(form: DataFrame, table: DataFrame, keep: list[str]) -> DataFrame:
    """The same by an equi-join on word n-grams; what is joined is a gram and its surface, the gram with the signs between and around its words."""
    lengths = table.agg(F.array_sort(F.collect_set("n"))).scalar()
    cut = form.select(*keep, words_of(F.col("haystack")).alias("words"), F.split("haystack", f"{WORD}+").alias("gaps")).withColumn("lengths", lengths)
    led = cut.withColumn("led", F.zip_with(F.slice("gaps", 1, F.size("words")), F.col("words"), lambda g, w: F.concat(g, w)))
    gram = lambda i, n: F.struct(
        F.array_join(F.slice("words", i, n), " ").alias("gram"),
        F.concat(F.array_join(F.slice("led", i, n), ""), F.element_at("gaps", i + n)).alias("surface"))
    none = F.array().cast("array<struct<gram:string,surface:string>>")
    grams = F.flatten(F.transform("lengths", lambda n: F.when(
        F.size("words") >= n, F.transform(F.sequence(F.lit(1), F.size("words") - n + 1), lambda i: gram(i, n))).otherwise(none)))
    spread = led.select(*keep, F.explode_outer(grams).alias("g")).where(F.col("g").isNotNull()).select(*keep, "g.*")
    hits = unsent(spread).join(unsent(table), "gram").where(F.contains("surface", F.col("form"))).drop("surface", "gram", "n")
    return hits.dropDuplicates([*keep, *(c for c in table.columns if c not in ("gram", "n") and not c.startswith("_"))])


def name_and_alias_terms(concepts: DataFrame) -> DataFrame:
    """(concepto_id, nombre, term, by_alias, place) from concepts (concepto_id, nombre, aliases array)."""
    names = F.array(F.struct(F.col("nombre").alias("term"), F.lit(False).alias("by_alias"), F.lit(0).alias("place")))
    aliases = F.transform(
        F.coalesce("aliases", F.array().cast("array<string>")),
        lambda a, i: F.struct(a.alias("term"), F.lit(True).alias("by_alias"), (i + 1).alias("place")))
    return concepts.select("concepto_id", "nombre", F.explode(F.concat(names, aliases)).alias("t")).select(
        "concepto_id", "nombre", "t.term", "t.by_alias", "t.place").where(F.length(F.coalesce("term", F.lit(""))) > 0)


def concepts_in(texts: DataFrame, concepts: DataFrame, keep: list[str]) -> DataFrame:
    """One row per (text, concept): by name if the name occurs, else by its first alias that does."""
    hits = find_terms(texts, name_and_alias_terms(concepts), keep)
    return hits.groupBy(*keep, "concepto_id", "nombre").agg(
        F.min_by(F.struct("term", "form", "by_alias"), "place").alias("m")
    ).select(*keep, "concepto_id", "nombre", F.col("m.term").alias("term"), F.col("m.form").alias("form"),
             F.col("m.by_alias").alias("by_alias"))


def subject_concept(matches: DataFrame) -> DataFrame:
    """The one concept a question is about, if any.

    ``matches`` holds (query_id, concepto_id, nombre, term, form, by_alias). The
    longest term is the subject; a further term that is not a part of it makes
    the question relational, and it gets no subject. Matches are found once and written.
    """
    matches = written(matches)
    longest = matches.groupBy("query_id").agg(F.max_by(
        F.struct("concepto_id", "nombre", "term", "form", "by_alias"),
        F.struct(F.length("term"), -F.col("concepto_id"))).alias("s"))
    others = matches.select("query_id", F.col("form").alias("other")).join(unsent(longest), "query_id")
    single = others.groupBy("query_id").agg(F.bool_and(F.contains(F.col("s.form"), F.col("other"))).alias("single"))
    return longest.join(unsent(single.where("single")), "query_id").select("query_id", "s.*")
