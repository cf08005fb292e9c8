"""Routing of questions to the simple or the complex branch."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LinearSVC
from pyspark.ml.feature import CountVectorizer, IDF, Normalizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmesh.functions.text import WORD

# Labelled questions the default router learns from.
EXAMPLES = [
    ("¿qué es COMA?", "simple"),
    ("define potencia firme", "simple"),
    ("Art. 5 del D.S. 62", "simple"),
    ("ley 20.936", "simple"),
    ("LGSE", "simple"),
    ("DFL 4 artículo 102", "simple"),
    ("VATT", "simple"),
    ("¿qué dice el reglamento de transferencias?", "simple"),
    ("definición de servicio público de distribución", "simple"),
    ("¿cómo se calcula la potencia firme considerando todas las enmiendas?", "complejo"),
    ("compara cómo el D.S. 62 y el DFL 4 regulan la potencia firme", "complejo"),
    ("relación entre el reglamento de transferencias y los servicios complementarios", "complejo"),
    ("evolución del concepto de COMA en la regulación", "complejo"),
    ("qué cambios introduce el D.S. 71 al cálculo de transferencias respecto al D.S. 62 original", "complejo"),
    ("explica el flujo completo de tarificación desde la ley hasta los decretos de fija valores", "complejo"),
    ("interacción entre AVI, VATT y COMA en el cálculo total", "complejo"),
    ("normativa aplicable a generadoras renovables en transmisión troncal", "complejo"),
]


def _grams(text: str):
    words = F.regexp_extract_all(F.lower(text), F.lit(rf"(?<!{WORD}){WORD}{{2,}}(?!{WORD})"), F.lit(0))
    pairs = F.when(F.size(words) >= 2, F.transform(
        F.sequence(F.lit(1), F.size(words) - 1), lambda i: F.concat_ws(" ", F.get(words, i - 1), F.get(words, i)))).otherwise(
        F.array().cast("array<string>"))
    return F.concat(words, pairs)


def train(examples: DataFrame) -> PipelineModel:
    """Unit-length TF-IDF of word 1- and 2-grams and a linear SVM. examples: text, branch."""
    rows = examples.select(_grams("text").alias("grams"), (F.col("branch") == "complejo").cast("double").alias("label"))
    stages = [
        CountVectorizer(inputCol="grams", outputCol="tf"), IDF(inputCol="tf", outputCol="tfidf"),
        Normalizer(inputCol="tfidf", outputCol="features", p=2.0), LinearSVC(maxIter=10, regParam=0.01, tol=1e-3)]
    return Pipeline(stages=stages).fit(rows)


def default_router(spark: SparkSession) -> PipelineModel:
    # Seventeen rows: one partition keeps each optimiser step a single small task.
    return train(spark.createDataFrame(EXAMPLES, "text string, branch string").coalesce(1))


def route(questions: DataFrame, model: PipelineModel) -> DataFrame:
    """Add the branch of every question (query_id, text)."""
    scored = model.transform(questions.withColumn("grams", _grams("text")))
    return scored.select(*questions.columns, F.when(F.col("prediction") > 0.5, "complejo").otherwise("simple").alias("branch"))
