"""Catalog analytics: themes, coverage, profiles and listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmesh.functions import lexicon as L


def theme_sets(rows: DataFrame, key: str, number: Column, tags: list[str]) -> DataFrame:
    """(key, temas): sorted distinct tags per key, from the tag number of each row.

    A bit mask per key is a plain hash aggregate that merges before the shuffle;
    arrays are only unpacked at the end.
    """
    masks = rows.select(key, F.expr("cast(1 as bigint)").alias("one"), number.cast("int").alias("i")).groupBy(key).agg(
        F.bit_or(F.expr("shiftleft(one, i)")).alias("mask"))
    named = [F.when(F.col("mask").bitwiseAND(F.lit(1 << i)) != 0, F.lit(tag)) for tag, i in sorted((t, i) for i, t in enumerate(tags))]
    return masks.select(key, F.array_compact(F.array(*named)).alias("temas"))


def theme_pairs(norms: DataFrame, themes: str = "temas", by: list[str] = ()) -> DataFrame:
    """(by..., tema1 < tema2, n): pairs inside each row's small theme set, then one mergeable count."""
    ordered = F.array_sort(F.array_distinct(themes))
    pairs = F.flatten(F.transform(ordered, lambda a, i: F.transform(
        F.slice(ordered, i + 2, F.size(ordered)), lambda b: F.struct(a.alias("tema1"), b.alias("tema2")))))
    rows = norms.select(*by, F.explode_outer(pairs).alias("p")).where(F.col("p").isNotNull())
    return rows.groupBy(*by, "p.tema1", "p.tema2").agg(F.count(F.lit(1)).alias("n"))


def low_coverage(pairs: DataFrame) -> DataFrame:
    """Pairs held by fewer than ten norms; critical below five."""
    return pairs.where(F.col("n") < 10).withColumn("nivel", F.when(F.col("n") < 5, "CRITICO").otherwise("MODERADO"))


def clusters(norms: DataFrame, keep: list[str], themes: str = "temas") -> DataFrame:
    """(keep..., cluster): norms that share at least two themes with a cluster."""
    tests = [
        F.when(F.size(F.array_intersect(F.col(themes), F.array(*[F.lit(t) for t in members]))) >= 2, F.lit(name))
        for name, members in L.THEME_CLUSTERS.items()]
    return norms.select(*keep, F.explode_outer(F.array_compact(F.array(*tests))).alias("cluster")).where(F.col("cluster").isNotNull())


def kind_share(norms: DataFrame, themes: str = "temas", kind: str = "tipo") -> DataFrame:
    """(tema, tipo, n, porcentaje, dominante): share of each norm type inside a theme."""
    counts = norms.select(kind, F.explode(themes).alias("tema")).groupBy("tema", kind).agg(F.count(F.lit(1)).alias("n"))
    per_theme = Window.partitionBy("tema")  # already one row per (theme, type)
    total = F.sum("n").over(per_theme)
    return counts.select(
        "tema", kind, "n", F.round(F.col("n") * 100 / total, 6).alias("porcentaje"), (F.col("n") > total * 0.6).alias("dominante"))


def profile(norms: DataFrame, links: str, themes: str) -> DataFrame:
    n = F.count(F.lit(1))
    return norms.agg(
        n.alias("normas"), F.round(F.avg(F.size(links)), 6).alias("enlaces_promedio"), F.max(F.size(links)).cast("bigint").alias("enlaces_max"),
        F.sum((F.size(links) > 0).cast("bigint")).alias("con_enlaces"), F.sum((F.size(themes) > 0).cast("bigint")).alias("con_temas"))


def incomplete_fields(df: DataFrame, group: str, fields: list[str]) -> DataFrame:
    """(group, campo, presentes, total) for fields not present in every row of the group."""
    counted = df.groupBy(group).agg(
        F.count(F.lit(1)).alias("total"), *[F.count(F.col(f)).alias(f) for f in fields])
    return counted.unpivot([group, "total"], fields, "campo", "presentes").where(F.col("presentes") < F.col("total"))


def counts_with_zeros(df: DataFrame, column: str, allowed: list[str]) -> DataFrame:
    """Counts over a fixed list of values, absent ones as zero."""
    base = df.sparkSession.createDataFrame([(v,) for v in allowed], f"{column} string")
    counts = df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    return base.join(counts, column, "left").select(column, F.coalesce("n", F.lit(0)).alias("n"))


def first_per_group(df: DataFrame, group: str, order: list[Column], k: int = 10) -> DataFrame:
    """First ``k`` rows of every group, cut per task before the shuffle."""
    window = Window.partitionBy(group).orderBy(*order)
    return df.withColumn("orden", F.row_number().over(window)).where(F.col("orden") <= k)


def merged_aliases(concepts: DataFrame, key: str, aliases: str) -> DataFrame:
    """Sorted distinct union of alias lists per key; the set is built by a mergeable aggregate."""
    return concepts.select(key, F.explode(aliases).alias("a")).groupBy(key, "a").agg(F.lit(1).alias("x")).groupBy(key).agg(
        F.array_sort(F.collect_list("a")).alias("aliases"))


def themes_in_order(df: DataFrame, key: str, theme: str, order: str) -> DataFrame:
    """Distinct themes per key in first-seen order; the theme set is small and fixed."""
    first = df.groupBy(key, theme).agg(F.min(order).alias("o"))
    return first.groupBy(key).agg(F.transform(
        F.sort_array(F.collect_list(F.struct("o", theme))), lambda x: x[theme]).alias("temas"))


def link_coverage(links: DataFrame, known: DataFrame) -> DataFrame:
    """Share of distinct linked ids that exist in the catalog."""
    wanted = links.select(F.col("destino").alias("id")).where(F.length("id") > 3).distinct()
    marked = wanted.join(known.select("id", F.lit(True).alias("existe")).distinct(), "id", "left")
    return marked.agg(
        F.count(F.lit(1)).alias("enlazadas"), F.count("existe").alias("existentes"),
        F.round(F.count("existe") / F.count(F.lit(1)), 6).alias("cobertura"))


def off_domain(primary: Column, secondary: Column, name: Column, dropped: list[str], kept: list[str]) -> Column:
    """White-listed names stay; undetermined ones and dropped secondaries go."""
    return (
        F.when(name.isin(kept), F.lit(False)).when(F.coalesce(primary, F.lit("")) == "indeterminado", F.lit(True))
        .otherwise((F.coalesce(primary, F.lit("")) == "regulatorio_otros") & F.coalesce(secondary.isin(dropped), F.lit(False))))


def by_text_reference(references: DataFrame, norms: DataFrame) -> DataFrame:
    """Smallest norm id for a textual reference: number equality, first type word contained, optional year.

    references (ref_id, texto, numero, anio); norms (id, tipo, numero, anio).
    """
    # Type words in the order they are tried.
    words = [("LEY", "LEY"), ("DECRETO", "DECRETO"), ("DFL", "DFL"), ("DL", "DL"), ("RESOLUCIÓN", "RESOLUCION"), ("RESOLUCION", "RESOLUCION")]
    upper = F.upper("texto")
    kind = F.lit(None).cast("string")
    for word, name in reversed(words):
        kind = F.when(F.contains(upper, F.lit(word)), name).otherwise(kind)
    asked = references.withColumn("tipo", kind)
    per_year = norms.groupBy("tipo", "numero", "anio").agg(F.min("id").alias("id"))
    with_year = asked.where(F.col("anio").isNotNull() & F.col("tipo").isNotNull()).join(per_year, ["tipo", "numero", "anio"])
    any_year = norms.groupBy("tipo", "numero").agg(F.min("id").alias("id"))
    without = asked.where(F.col("anio").isNull() & F.col("tipo").isNotNull()).join(any_year, ["tipo", "numero"])
    any_kind = norms.groupBy("numero").agg(F.min("id").alias("id"))
    untyped = asked.where(F.col("anio").isNull() & F.col("tipo").isNull()).join(any_kind, "numero")
    return with_year.select("ref_id", "id").unionByName(without.select("ref_id", "id")).unionByName(untyped.select("ref_id", "id"))
