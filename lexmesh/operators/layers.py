"""The graph of a corpus in four layers read from its texts: definitions, formal references, aliases, manual concepts.

An earlier layer wins: an alias adds no edge where a formal reference is, a manual concept none
where the text defines it. All edges of a norm follow from its own text, so they are kept in a table keyed by
norm, and a changed norm replaces its edges and no other's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmesh.functions.text import fold_accents, squeeze
from lexmesh.operators import mentions, sections
from lexmesh.operators.chunks import GLOSSARY_OPENER
from lexmesh.operators.extraction import definition_items
from lexmesh.operators.spans import occurrences
from lexmesh.session import unsent
from lexmesh.sources.keyed import KeyedTable

CONCEPT = "concepto:"
# What each layer's edges are called and where they come from.
RELATIONS, SOURCES = ("define", "referencia", "alias", "define"), ("texto", "texto", "texto", "manual")


def concept_id(name: Column) -> Column:
    return F.concat(F.lit(CONCEPT), squeeze(fold_accents(F.lower(name))))


def edges(texts: DataFrame, targets: DataFrame, catalog: DataFrame, aliases: DataFrame, manual: DataFrame) -> DataFrame:
    """(origen, destino, relacion, fuente) of norms (id_norma, texto).

    targets (llave, canonico) resolves citations to canonical names, catalog (canonico, destino) those to norms,
    aliases (entry, term) name norms in other words, manual (id_norma, concepto) adds concepts that texts lack. Norms do
    not refer to themselves, and each pair has one edge.
    """
    items = definition_items(sections.articles(texts, ["id_norma"], holding=GLOSSARY_OPENER), ["id_norma"])
    edge = lambda df, destino, layer: df.select(F.col("id_norma").alias("origen"), destino.alias("destino"), F.lit(layer).alias("layer"))
    defines = edge(items, F.concat(F.lit(CONCEPT), "llave"), 0)
    cited = mentions.citations(texts, ["id_norma"], targets, margin=0).select("id_norma", "canonico").distinct().join(unsent(catalog), "canonico")
    refers = edge(cited.where(F.col("destino") != F.col("id_norma")), F.col("destino"), 1)
    named = occurrences(texts, aliases.select(F.lower("term").alias("form")), ["id_norma"], "texto", borders=None, margin=None).join(
        unsent(aliases.select(F.lower("term").alias("form"), "entry")), "form")
    other = edge(named.where(F.col("entry") != F.col("id_norma")), F.col("entry"), 2)
    here = manual.join(texts.select("id_norma"), "id_norma", "left_semi")
    added = edge(here, concept_id(F.col("concepto")), 3)
    # Aliases give way to references and manual concepts to defined ones: of the layers of either kind the earliest has the edge.
    concept = F.col("layer").isin(0, 3).alias("concept")
    found = defines.unionByName(refers).unionByName(other).unionByName(added).groupBy("origen", "destino", concept).agg(F.min("layer").alias("layer"))
    said = lambda names: F.element_at(F.array(*map(F.lit, names)), F.col("layer") + 1)
    return found.select("origen", "destino", said(RELATIONS).alias("relacion"), said(SOURCES).alias("fuente"))


def update(table: KeyedTable, changed: DataFrame, *inputs: DataFrame) -> list[int]:
    """Replace the edges of the changed norms (id_norma, texto; ``inputs`` as for ``edges``). Norms without an edge any more lose theirs."""
    table.delete(changed.select(F.col("id_norma").alias("origen")))
    return table.upsert(edges(changed, *inputs))
