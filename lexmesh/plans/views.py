"""Norm-shaped views over the given tables.

Every view derives row by row from whole tables, so it grows with them. The
expressions are plain SQL that Spark and other engines read alike; they are
kept as text so that a check in another engine starts from the same input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmesh.sources.tables import table, texts

_NL = "chr(10)"
_S = lambda c: f"cast({c} as string)"
_DAY, _MONTH, _YEAR = _S("day(o_orderdate)"), "month(o_orderdate)", _S("year(o_orderdate)")
_REF = _S("cast(floor(o_orderkey / 10) as bigint)")
_MONTH_WORD = "case month(o_orderdate) " + " ".join(
    f"when {i} then '{m}'" for i, m in enumerate(
        "enero febrero marzo abril mayo junio julio agosto septiembre octubre noviembre diciembre".split(), 1)
) + " end"
_MONTH_CODE = "case month(o_orderdate) " + " ".join(
    f"when {i} then '{m}'" for i, m in enumerate("ENE FEB MAR ABR MAY JUN JUL AGO SEP OCT NOV DIC".split(), 1)
) + " end"

KIND = "case o_orderstatus when 'F' then 'DECRETO' when 'O' then 'LEY' else 'RESOLUCION' end"
NUMBER = _S("o_custkey")
TITLE = (
    f"({KIND}) || ' ' || {NUMBER} || "
    f"case when o_orderstatus = 'P' then ({KIND}) || ' ' || {NUMBER} else '' end || ' ' || "
    "case o_orderpriority "
    f"when '1-URGENT' then 'MODIFICA EL ARTÍCULO 5 DEL DECRETO N° ' || {_REF} || ' DE ' || {_YEAR} "
    f"when '2-HIGH' then 'APRUEBA REGLAMENTO DE LA LEY N° ' || {_REF} "
    f"when '3-MEDIUM' then 'FIJA TARIFAS Y SUSTITUYE RESOLUCION ' || {_REF} || ', DE ' || {_YEAR} "
    f"when '4-NOT SPECIFIED' then 'DEROGA LEY ' || {_REF} "
    f"else 'T COMPLEMENTA DECRETO ' || {_REF} end"
)
DATE = "case when o_totalprice < 25000 then null else cast(o_orderdate as date) end"
BODY = (
    "case o_custkey % 10 when 0 then 'Ministerio de Energía' when 1 then 'Comisión Nacional de Energía' "
    "when 2 then 'Superintendencia de Electricidad' when 3 then 'MINISTERIO DE ECONOMÍA' "
    "when 4 then 'Hacienda' when 5 then 'Medio Ambiente' when 6 then 'MINERÍA' "
    "when 7 then 'Obras Públicas' when 8 then 'Interior' else 'Banco Central' end"
)
TEXT = (
    f"'MINISTERIO DE ENERGÍA' || {_NL} || {TITLE} || {_NL} || "
    f"case when o_totalprice < 100000 then '' else 'Publicación: ' || lpad({_DAY}, 2, '0') || '-' || {_MONTH_CODE} || '-' || {_YEAR} || {_NL} end || "
    f"'Santiago, ' || {_DAY} || ' de ' || {_MONTH_WORD} || ' de ' || {_YEAR} || '.' || {_NL} || "
    f"'TÍTULO I: Disposiciones generales' || {_NL} || "
    f"'Artículo 1°.- Para los efectos del presente reglamento se entenderá por:' || {_NL} || "
    f"'a) Cliente: Cliente regulado de la zona ' || {NUMBER} || ' que se refiere a la ley;' || {_NL} || "
    f"'b) V.A.T.T.: valor anual de la transmisión por tramo del pedido ' || {_S('o_orderkey')} || ';' || {_NL} || "
    f"'c) Potencia Firme: potencia que un generador inyecta con seguridad durante las horas de punta;' || {_NL} || "
    f"'d) COMA: Costo de Operación, Mantenimiento y Administración del tramo ' || {_REF} || '.' || {_NL} || "
    f"'Artículo 2º.- Conforme a la letra b) del artículo 7 de la Ley N° ' || {_REF} || ' y al Decreto Supremo N° ' || {NUMBER} || ', según el artículo anterior.' || {_NL} || "
    f"case when o_orderstatus = 'P' then 'Artículo 2 bis.- Derógase la ley N° ' || {_REF} || ', en adelante, la Comisión, salvo el peaje.' || {_NL} else '' end || "
    f"case when o_orderstatus = 'F' then 'Artículo 1°.- Repetido, sin efecto alguno para la norma.' || {_NL} else '' end || "
    f"'TÍTULO II: Disposiciones finales' || {_NL} || "
    f"'Artículo 3°.- El artículo siguiente rige: Comisión Nacional de Energía (CNE) y su tarifa de distribución, potencia y energía.' || {_NL} || "
    f"'Decreto ' || {_REF} || ', ENERGÍA' || {_NL} || 'Art. primero N° 1' || {_NL} || 'D.O. ' || lpad({_DAY}, 2, '0') || '.' || lpad({_S(_MONTH)}, 2, '0') || '.' || {_YEAR} || {_NL} || "
    f"'Artículo primero transitorio.- Vigencia desde su publicación.'"
)

NORM_COLUMNS = {
    "id_norma": _S("o_orderkey"), "tipo": KIND, "numero": NUMBER, "ref": _REF, "titulo": TITLE,
    "fecha": DATE, "organismo": BODY, "precio": "o_totalprice", "prioridad": "o_orderpriority",
}


def norms_sql(*columns: str, text: bool = False) -> str:
    """The same view as SQL text, for a check in another engine."""
    parts = [f"{NORM_COLUMNS[c]} as {c}" for c in (columns or NORM_COLUMNS)]
    if text:
        parts.append(f"{TEXT} as texto")
    return "select " + ", ".join(parts) + " from orders"


def norms(spark: SparkSession, folder: str, *columns: str, text: bool = False) -> DataFrame:
    """Orders seen as legal norms: type, number, title, date, issuing body and full text."""
    picked = [F.expr(NORM_COLUMNS[c]).alias(c) for c in (columns or NORM_COLUMNS)]
    if text:
        picked.append(F.expr(TEXT).alias("texto"))
    orders = table(spark, folder, "orders")
    return (texts(spark, folder, "orders") if text or "titulo" in columns else orders).select(*picked)


# Line items seen as article -> concept edges; the line number decides the kind.
EDGE_KIND = (
    "case l_linenumber when 1 then 'define_termino' when 2 then 'cita' when 3 then 'aplica' "
    "when 4 then 'modifica' when 5 then 'remite' when 6 then 'complementa' else 'deroga' end"
)
EDGES_SQL = (
    f"select l_orderkey * 10 + l_linenumber as articulo_id, {_S('l_orderkey')} as id_norma, "
    f"{_S('l_linenumber')} as numero, l_partkey as concepto_id, {EDGE_KIND} as kind, "
    "round(0.5 + l_discount * 4, 2) as confianza from lineitem"
)


def edges(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "lineitem").select(
        F.expr("l_orderkey * 10 + l_linenumber").alias("articulo_id"),
        F.expr(_S("l_orderkey")).alias("id_norma"),
        F.expr(_S("l_linenumber")).alias("numero"),
        F.col("l_partkey").alias("concepto_id"),
        F.expr(EDGE_KIND).alias("kind"),
        F.expr("round(0.5 + l_discount * 4, 2)").alias("confianza"),
    )


# Parts seen as concepts.
CONCEPTS_SQL = (
    "select p_partkey as concepto_id, p_name || ' ' || cast(p_partkey as string) as nombre, "
    "'COD-' || cast(p_partkey as string) as alias, case when p_type = 'PROMO' then 'regulatorio_otros' "
    "when p_type = 'LARGE' then null else 'electricidad' end as dominio, "
    "case when p_size < 10 then '' when p_size < 25 then p_name || ' ' || cast(p_partkey as string) || ' de ' || lower(p_type) "
    "when p_size < 35 then 'elemento a que se refiere la marca ' || p_brand || ' en el registro público anual' "
    "else p_name || ' ' || cast(p_partkey as string) || ' con capacidad nominal declarada ante el registro, según norma ' || lower(p_brand) end as definicion "
    "from part"
)


def concepts(spark: SparkSession, folder: str) -> DataFrame:
    name = "p_name || ' ' || cast(p_partkey as string)"
    return table(spark, folder, "part").select(
        F.col("p_partkey").alias("concepto_id"),
        F.expr(name).alias("nombre"),
        F.expr("'COD-' || cast(p_partkey as string)").alias("alias"),
        F.expr("case when p_type = 'PROMO' then 'regulatorio_otros' when p_type = 'LARGE' then null "
               "else 'electricidad' end").alias("dominio"),
        F.expr(f"case when p_size < 10 then '' when p_size < 25 then {name} || ' de ' || lower(p_type) "
               "when p_size < 35 then 'elemento a que se refiere la marca ' || p_brand || ' en el registro público anual' "
               f"else {name} || ' con capacidad nominal declarada ante el registro, según norma ' || lower(p_brand) end"
               ).alias("definicion"),
    )


# Questions about parts, phrased by part size.
QUESTION = (
    "case p_size % 5 when 0 then 'qué es ' || p_name || ' ' || cast(p_partkey as string) || '?' "
    "when 1 then 'Definición de COD-' || cast(p_partkey as string) "
    "when 2 then 'relación de ' || p_name || ' ' || cast(p_partkey as string) || ' con cod-' || cast(p_partkey + 1 as string) "
    "when 3 then '¿cómo se aplica el Cód-' || cast(p_partkey as string) || ' a la tarifa?' "
    "else 'Cómo se define ' || upper(p_name) || '  ' || cast(p_partkey as string) || ' ?' end"
)
QUESTIONS_SQL = f"select p_partkey as query_id, {QUESTION} as text from part"


def part_questions(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "part").select(F.col("p_partkey").alias("query_id"), F.expr(QUESTION).alias("text"))


# Defining and citing edges seen as candidates for the source of a definition.
_RANK = "case when upper(titulo) like 'LEY%' or {ley} then 3 when contains(titulo, 'RESOLUCION') then 1 when contains(titulo, 'DECRETO') then 2 else 2 end"
_CANDIDATE = """select e.concepto_id, c.nombre, e.id_norma, e.numero as articulo, {rank} as rank, n.fecha, e.articulo_id as pos,
 case when e.kind = 'define_termino' then 'curated' else 'retrieved' end as origin,
 case when e.confianza > 0.75 then c.nombre else c.definicion end as definicion
 from {edges} e join {concepts} c on c.concepto_id = e.concepto_id join {norms} n on n.id_norma = e.id_norma
 where e.kind in ('define_termino', 'cita')"""
CANDIDATES_SQL = _CANDIDATE.format(
    rank=_RANK.format(ley="regexp_matches(titulo, '\\bLEY +N')"), edges=f"({EDGES_SQL})", concepts=f"({CONCEPTS_SQL})",
    norms=f"({norms_sql('id_norma', 'titulo', 'fecha', 'tipo')})")


def candidates(spark: SparkSession, folder: str) -> DataFrame:
    from lexmesh.functions.classify import legal_rank

    rank, _ = legal_rank(F.col("tipo"), F.col("titulo"))
    n = norms(spark, folder, "id_norma", "titulo", "fecha", "tipo").select("id_norma", "fecha", rank.alias("rank"))
    e = edges(spark, folder).where(F.col("kind").isin("define_termino", "cita"))
    c = concepts(spark, folder).select("concepto_id", "nombre", "definicion")
    return e.join(c, "concepto_id").join(n, "id_norma").select(
        "concepto_id", "nombre", "id_norma", F.col("numero").alias("articulo"), "rank", "fecha",
        F.col("articulo_id").alias("pos"),
        F.when(F.col("kind") == "define_termino", "curated").otherwise("retrieved").alias("origin"),
        F.when(F.col("confianza") > 0.75, F.col("nombre")).otherwise(F.col("definicion")).alias("definicion"))
