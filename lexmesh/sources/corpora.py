"""Readers of norm corpora: JSON documents, text files, JSON lines, alias and glossary configs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexmesh.functions.classify import norm_class
from lexmesh.functions.dates import publication_date

# Corpus sub-folders and the fields every norm must have.
FOLDERS = ["decretos", "leyes", "dfl", "resoluciones", "otros"]
REQUIRED = ["id_norma", "tipo", "numero", "titulo"]

_STRING = T.StringType()
VERSION = T.StructType([T.StructField("id_version", _STRING), T.StructField("descripcion", _STRING)])
NORM = T.StructType([
    T.StructField("id_norma", _STRING), T.StructField("tipo", _STRING), T.StructField("numero", _STRING),
    T.StructField("titulo", _STRING), T.StructField("fecha_publicacion", _STRING), T.StructField("fecha_promulgacion", _STRING),
    T.StructField("organismo", _STRING), T.StructField("estado", _STRING), T.StructField("url", _STRING),
    T.StructField("texto_completo", _STRING), T.StructField("content_hash", _STRING),
    T.StructField("versiones", T.ArrayType(VERSION)),
])
#: What becomes a column of its own; every other key of a document is metadata.
CORE = ["id_norma", "tipo", "numero", "titulo", "fecha_publicacion", "organismo", "texto_completo"]


def norm_files(spark: SparkSession, folder: str, subfolders: list[str] | None = None, id_from_name: bool = False) -> DataFrame:
    """One row per JSON file: archivo, legible, the fields of a norm, and ``resto``, all its keys that are no core field.

    A broken file keeps its row, with ``legible`` false. With ``id_from_name`` a
    document without an id gets its file's stem.
    """
    paths = [p for p in (f"{folder}/{s}/*.json" for s in (subfolders or FOLDERS)) if _exists(spark, p)]
    if not paths:
        whole = spark.createDataFrame([], "archivo string, value string")
    else:
        whole = spark.read.text(paths, wholetext=True).select(F.input_file_name().alias("archivo"), "value")
    readable = F.try_parse_json("value").isNotNull() & F.ltrim("value").startswith("{")
    keys = F.from_json("value", "map<string,string>")
    parsed = whole.select(
        "archivo", readable.alias("legible"), F.when(readable, F.from_json("value", NORM)).alias("n"),
        F.when(readable, F.map_filter(keys, lambda k, v: ~k.isin(CORE) & v.isNotNull())).alias("resto"))
    rows = parsed.select("archivo", "legible", "n.*", "resto")
    stem = F.regexp_extract("archivo", r"([^/]+)\.json$", 1)
    return rows.withColumn("id_norma", F.when(F.col("legible"), F.coalesce("id_norma", stem))) if id_from_name else rows


def norm_documents(spark: SparkSession, folder: str, subfolders: list[str] | None = None, id_from_name: bool = False) -> DataFrame:
    """One row per readable JSON document under the sub-folders; ``rejected_files`` names the others."""
    return norm_files(spark, folder, subfolders, id_from_name).where("legible").drop("archivo", "legible")


def rejected_files(spark: SparkSession, folder: str, subfolders: list[str] | None = None) -> DataFrame:
    """(archivo): files that are not a JSON object."""
    return norm_files(spark, folder, subfolders).where(~F.col("legible")).select("archivo")


def _exists(spark: SparkSession, pattern: str) -> bool:
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(pattern)
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path)
    return found is not None and len(found) > 0


def with_required_fields(norms: DataFrame) -> DataFrame:
    keep = F.lit(True)
    for field in REQUIRED:
        keep = keep & (F.coalesce(F.col(field), F.lit("")) != "")
    return norms.where(keep)


def missing_required_fields(norms: DataFrame) -> DataFrame:
    """(campo, faltan): how many rows lack each required field."""
    counted = norms.agg(*[F.sum((F.coalesce(F.col(f), F.lit("")) == "").cast("bigint")).alias(f) for f in REQUIRED])
    return counted.unpivot([], REQUIRED, "campo", "faltan")


def as_norms(raw: DataFrame) -> DataFrame:
    """Raw documents -> norms: resolved date, class, and every key that is no core field as metadata."""
    return raw.select(
        "id_norma", "tipo", "numero", "titulo",
        publication_date(F.col("fecha_publicacion"), F.coalesce("texto_completo", F.lit("")),
                         F.coalesce("versiones", F.array().cast(T.ArrayType(VERSION)))).alias("fecha"),
        F.when(F.col("organismo") != "", F.col("organismo")).alias("organismo"), norm_class(F.col("titulo")).alias("clase"),
        F.col("texto_completo").alias("texto"), F.col("resto").alias("metadata"))


def text_files(spark: SparkSession, folder: str) -> DataFrame:
    """(id_norma, texto) of ``*.txt`` files, the id being the file stem."""
    rows = spark.read.option("pathGlobFilter", "*.txt").text(folder, wholetext=True)
    return rows.select(F.regexp_extract(F.input_file_name(), r"([^/]+)\.txt$", 1).alias("id_norma"), F.col("value").alias("texto"))


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; blank lines are skipped by the reader."""
    return spark.read.schema(schema).json(path)


def alias_config(spark: SparkSession, path: str, section: str = "confirmados") -> DataFrame:
    """(alias, id_norma) from a section of an alias file, lower-cased: the confirmed ones, or ``por_confirmar``."""
    rows = spark.read.schema(f"`{section}` map<string,string>").option("multiLine", True).json(path)
    return rows.select(F.explode(section).alias("alias", "id_norma")).select(F.lower("alias").alias("alias"), "id_norma")


def base_concepts(spark: SparkSession, path: str) -> DataFrame:
    """(id_norma, concepto) from the manual section of an alias file."""
    schema = "conceptos_base map<string,struct<conceptos:array<string>>>"
    rows = spark.read.schema(schema).option("multiLine", True).json(path)
    listed = rows.select(F.explode("conceptos_base").alias("id_norma", "info"))
    return listed.select("id_norma", F.explode("info.conceptos").alias("concepto"))


GLOSSARY = (
    "id bigint, name string, definition string, status string, domain_context string, "
    "aliases array<struct<alias:string,confidence:string,validated:boolean>>, "
    "source struct<norm_id:string,norm_label:string,article:string,url:string>, domain struct<primary:string,secondary:string>"
)


def glossary(spark: SparkSession, entries: list[dict]) -> DataFrame:
    """Glossary entries parsed from YAML by the caller (a hand-curated file, a few hundred entries)."""
    return spark.createDataFrame(entries, GLOSSARY)


def eligible_aliases(entries: DataFrame) -> DataFrame:
    """Reviewed entries with their validated aliases; entries without any are left out."""
    valid = F.transform(F.filter("aliases", lambda a: a["validated"]), lambda a: a["alias"])
    return entries.where(F.col("status").isin("ok", "corrected")).select("id", "name", valid.alias("aliases")).where(F.size("aliases") > 0)


def curate_aliases(entries: DataFrame, decisions: DataFrame) -> DataFrame:
    """Apply promote / remove / keep decisions (name, alias, decision) to electric entries.

    Promoted aliases become high-confidence and validated, removed ones go, all
    others stay; an entry that gained a validated alias becomes reviewed.
    """
    rows = entries.where(F.col("domain.primary") == "electricidad").select(
        "name", "status", F.posexplode("aliases").alias("pos", "a")).select("name", "status", "pos", "a.*")
    decided = rows.join(decisions, ["name", "alias"], "left")
    promoted = F.coalesce(F.col("decision") == "promote", F.lit(False))
    kept = decided.where(F.coalesce(F.col("decision") != "remove", F.lit(True))).select(
        "name", "status", "pos", "alias", F.when(promoted, "high").otherwise(F.col("confidence")).alias("confidence"),
        (promoted | F.col("validated")).alias("validated"), promoted.alias("touched"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("pos", "alias", "confidence", "validated"))), lambda x: F.struct(
        x["alias"].alias("alias"), x["confidence"].alias("confidence"), x["validated"].alias("validated")))
    done = kept.groupBy("name", "status").agg(
        listed.alias("aliases"), F.bool_or(F.col("touched")).alias("touched"), F.bool_or("validated").alias("any_valid"))
    flips = F.col("touched") & F.col("any_valid") & ~F.col("status").isin("ok", "corrected")
    return done.select("name", F.when(flips, "ok").otherwise(F.col("status")).alias("status"), "aliases")


def definition_edges(entries: DataFrame, articles: DataFrame, concepts: DataFrame) -> DataFrame:
    """Edges from glossary sources: (name, articulo_id, concepto_id, motivo), the reason saying why one is skipped.

    articles (id_norma, numero, articulo_id), concepts (nombre, concepto_id).
    """
    reviewed = entries.where((F.col("domain.primary") == "electricidad") & F.col("status").isin("ok", "corrected")).select(
        "name", F.col("source.norm_id").alias("id_norma"), F.col("source.article").alias("numero"))
    sourced = (F.coalesce("id_norma", F.lit("")) != "") & (F.col("id_norma") != "unknown") & (F.coalesce("numero", F.lit("")) != "")
    found = reviewed.join(articles, ["id_norma", "numero"], "left").join(concepts.withColumnRenamed("nombre", "name"), "name", "left")
    reason = (
        F.when(~sourced, "sin_fuente").when(F.col("articulo_id").isNull(), "sin_articulo")
        .when(F.col("concepto_id").isNull(), "sin_concepto").otherwise("ok"))
    return found.select("name", "articulo_id", "concepto_id", reason.alias("motivo"))
