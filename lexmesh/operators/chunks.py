"""Chunking of long texts: fixed windows, sentence packing and glossary items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmesh.operators.sections import MARK, SPACE, strip


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, rf"{SPACE}+"), lambda w: w != "")


def windows(texts: DataFrame, keep: list[str], text: str = "text", target: int = 400, overlap: int = 50) -> DataFrame:
    """(keep..., chunk_index, text, token_count): overlapping word windows in closed form.

    A text within the target stays whole. Otherwise windows start every
    ``target - overlap`` words and stop as soon as one reaches the end.
    """
    step = target - overlap
    words = words_of(F.col(text))
    last = F.ceil((F.size("words") - target) / step) * step
    starts = F.when(F.size("words") <= target, F.array(F.lit(0).cast("bigint"))).otherwise(
        F.sequence(F.lit(0).cast("bigint"), last.cast("bigint"), F.lit(step).cast("bigint")))
    cut = texts.select(*keep, F.col(text).alias("whole"), words.alias("words")).select(
        *keep, "whole", "words", F.posexplode_outer(starts).alias("chunk_index", "start"))
    piece = F.slice("words", F.col("start").cast("int") + 1, F.lit(target))
    return cut.select(
        *keep, "chunk_index",
        F.when(F.size("words") <= target, F.col("whole")).otherwise(F.array_join(piece, " ")).alias("text"),
        F.size(piece).alias("token_count"))


def _count(unit: Column) -> Column:
    return F.size(words_of(unit))


def sentences(texts: DataFrame, keep: list[str], text: str = "text", target: int = 400, smallest: int = 100,
              overlap: int = 2, preamble: Column | None = None) -> DataFrame:
    """(keep..., chunk_index, text, token_count): whole sentences packed up to the target.

    A left fold over the sentences carries the finished chunks, the open chunk
    and its word count. A finished chunk lends its last ``overlap`` sentences to
    the next one; a last chunk below the minimum joins the one before it.
    """
    body = F.col(text)
    total = _count(body)
    units = F.filter(F.transform(F.split(body, r"(?<=[.!?;])[\s ]+(?=[A-ZÁÉÍÓÚÑa-z])"), strip), lambda u: u != "")
    words = words_of(body)
    blocks = F.transform(
        F.sequence(F.lit(0), F.greatest(F.size(words) - 1, F.lit(0)), F.lit(target)),
        lambda i: F.array_join(F.slice(words, i + 1, F.lit(target)), " "))
    units = F.when((F.size(units) == 1) & (total > 2 * target), blocks).otherwise(units)
    prepared = texts.select(*keep, body.alias("whole"), total.alias("total"), units.alias("units"),
                            (preamble if preamble is not None else F.lit("")).alias("preamble"))
    empty = F.expr("named_struct('done', cast(array() as array<string>), 'open', cast(array() as array<string>), 'n', 0)")

    def step(state: Column, unit: Column) -> Column:
        n = _count(unit)
        full = (state["n"] + n > target) & (state["n"] >= smallest)
        held = F.size(state["open"])
        lent = F.slice(state["open"], F.greatest(held - overlap + 1, F.lit(1)), F.lit(overlap))
        reopened = F.concat(lent, F.array(unit))
        return F.struct(
            F.when(full, F.concat(state["done"], F.array(F.array_join(state["open"], " ")))).otherwise(state["done"]).alias("done"),
            F.when(full, reopened).otherwise(F.concat(state["open"], F.array(unit))).alias("open"),
            F.when(full, F.aggregate(reopened, F.lit(0), lambda acc, u: acc + _count(u))).otherwise(state["n"] + n).alias("n"))

    def finish(state: Column) -> Column:
        tail = F.array_join(state["open"], " ")
        done = F.size(state["done"])
        merged = F.concat(
            F.slice(state["done"], F.lit(1), F.greatest(done - 1, F.lit(0))),
            F.array(F.concat_ws(" ", F.try_element_at(state["done"], F.lit(-1)), tail)))
        return (
            F.when(F.size(state["open"]) == 0, state["done"])
            .when((done > 0) & (state["n"] < smallest), merged)
            .otherwise(F.concat(state["done"], F.array(tail))))

    packed = F.aggregate("units", empty, step, finish)
    chunks = F.when(F.col("total") <= target, F.array(F.col("whole"))).otherwise(packed)
    rows = prepared.select(*keep, "preamble", F.posexplode_outer(chunks).alias("chunk_index", "t")).where(F.col("t").isNotNull())
    return rows.select(
        *keep, "chunk_index", F.concat("preamble", strip(F.col("t"))).alias("text"), _count(F.col("t")).alias("token_count"))


# Glossary opener and item marks.
GLOSSARY_OPENER = r"(?iu)se\s+entender[áa]\s+por\s*:"
ITEM_MARK = r"(?:^|\n|;)\s*(?:[a-zñ]{1,2}|\d{1,2})[.)]\s+"
MIN_DEFINITIONS, LONGEST_TERM = 4, 90


def glossary_items(text: Column) -> Column:
    """Array of (term, definition) after the opener; pieces without a short term are not items."""
    body = F.try_element_at(F.split(text, GLOSSARY_OPENER, 2), F.lit(2))
    marked = F.split(F.regexp_replace(F.coalesce(F.when(text.rlike(GLOSSARY_OPENER), body), F.lit("")), f"({ITEM_MARK})", MARK), MARK)
    parts = F.transform(
        F.slice(marked, F.lit(2), F.greatest(F.size(marked) - 1, F.lit(0))),
        lambda p: strip(F.regexp_replace(strip(p), r";+$", "")))
    pairs = F.transform(F.filter(parts, lambda p: F.contains(p, F.lit(":"))), lambda p: F.struct(
        strip(F.substring_index(p, ":", 1)).alias("term"),
        strip(F.substring(p, F.instr(p, ":") + 1, F.length(p))).alias("definition")))
    return F.filter(pairs, lambda x: (x["term"] != "") & (x["definition"] != "") & (F.length(x["term"]) <= LONGEST_TERM))


def glossary_chunks(sections: DataFrame, keep: list[str], number: str = "numero", norm: str = "id_norma") -> DataFrame:
    """Header chunk plus one chunk per definition, only for sections with four definitions or more."""
    header = strip(F.concat(F.try_element_at(F.split("texto", GLOSSARY_OPENER, 2), F.lit(1)), F.regexp_extract("texto", GLOSSARY_OPENER, 0)))
    lead = F.concat(F.lit("[Artículo "), F.col(number), F.lit(" de "), F.col(norm), F.lit("]"))
    # The generator keeps Catalyst from reading the items again for the test of their number and for each use of them.
    read = sections.where(F.col("texto").rlike(GLOSSARY_OPENER)).withColumn("items", F.explode_outer(F.array(glossary_items(F.col("texto")))))
    kept = read.where(F.size("items") >= MIN_DEFINITIONS)
    first = F.array(F.struct(header.alias("raw"), F.concat(lead, F.lit(" "), header).alias("contextual")))
    rest = F.transform("items", lambda x: F.struct(
        F.concat(x["term"], F.lit(": "), x["definition"]).alias("raw"),
        F.concat(lead, F.lit(" Definición en el glosario: «"), x["term"], F.lit("». "), x["term"], F.lit(": "), x["definition"]).alias("contextual")))
    return kept.select(*keep, F.posexplode_outer(F.concat(first, rest)).alias("chunk_index", "c")).where(F.col("c").isNotNull()).select(*keep, "chunk_index", "c.*")
