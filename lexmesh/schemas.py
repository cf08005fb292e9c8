"""Table schemas and their constraints as DataFrame checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmesh.functions import lexicon as L

NORMS = ("id_norma string, tipo string, numero string, titulo string, fecha date, organismo string, clase string, "
         "texto string, metadata map<string,string>")
ARTICLES = "articulo_id bigint, id_norma string, numero string, titulo string, texto string, orden int"
FRAGMENTS = ("fragmento_id bigint, articulo_id bigint, chunk_index int, text string, contextual_text string, "
             "embedding array<float>, token_count int")
CONCEPTS = "concepto_id bigint, nombre string, definicion string, aliases array<string>, metadata map<string,string>"
EDGES = ("origen_articulo bigint, origen_norma string, destino_articulo bigint, destino_norma string, destino_concepto bigint, "
         "kind string, confianza double, metodo string, subdivision string, contexto string")
QUERY_LOG = ("ts timestamp, query string, branch string, n_results int, latency_ms int, rerank_ms int, generation_ms int, "
             "model string, tokens int, grounding_pass boolean")
DOWNLOAD_STATE = "id_norma string, estado string, intentos int, last_attempt timestamp, last_error string, hash string"
LEARNED_ALIASES = "alias_text string, id_norma string, confianza double, fuente string, aprobado boolean"

# Allowed states.
DOWNLOAD_STATES = ["pending", "downloaded", "failed", "outdated"]
BRANCHES = ["simple", "complejo"]


def article_id(df: DataFrame) -> DataFrame:
    """Deterministic id from (norm, number): the same on every run and however rows are spread."""
    return df.withColumn("articulo_id", F.xxhash64("id_norma", "numero"))


def edge_faults(edges: DataFrame) -> DataFrame:
    """Edges that break a constraint: one origin, one target, known kind and method, confidence in [0, 1]."""
    given = lambda *cs: F.size(F.array_compact(F.array(*[F.col(c).cast("string") for c in cs])))
    faults = F.array_compact(F.array(
        F.when(given("origen_articulo", "origen_norma") != 1, "origen"),
        F.when(given("destino_articulo", "destino_norma", "destino_concepto") != 1, "destino"),
        F.when(~F.col("kind").isin(L.EDGE_KINDS), "kind"), F.when(~F.col("metodo").isin(L.EDGE_METHODS), "metodo"),
        F.when(~F.col("confianza").between(0, 1), "confianza")))
    return edges.withColumn("faltas", faults).where(F.size("faltas") > 0)


def repeated_keys(df: DataFrame, key: list[str]) -> DataFrame:
    """Keys that occur more than once."""
    return df.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
