"""Queries over text, date and classification expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmesh.functions import classify, dates, lexicon as L, text as T
from lexmesh.plans.register import query
from lexmesh.plans.views import concepts, norms, norms_sql, CONCEPTS_SQL
from lexmesh.sources.tables import table, texts as rows

_LIST = lambda words: "[" + ",".join("'" + w + "'" for w in words) + "]"
_FOLD = f"translate({{}}, '{L.ACCENTED}', '{L.UNACCENTED}')"
_SQUEEZE = "trim(regexp_replace({}, '[ \t\n\r\f\v ]+', ' ', 'g'))"
ACRONYM = "(?:^|[^\\p{L}\\p{N}_])((?:[a-zñ]\\.){2,}[a-zñ]?\\.?)"


def normalize_sql(expr: str) -> str:
    low = f"lower(coalesce({expr}, ''))"
    dotless = (f"list_reduce(list_prepend({low}, regexp_extract_all({low}, '{ACRONYM}', 1)), "
               "lambda acc, m: replace(acc, m, replace(m, '.', '')))")
    return _SQUEEZE.format(_FOLD.format(dotless))


def tokens_sql(expr: str) -> str:
    return (f"list_filter(regexp_extract_all(lower({expr}), '[\\p{{L}}\\p{{N}}_]+'), "
            f"lambda w: length(w) >= 3 and not list_contains({_LIST(L.LEXICAL_STOPWORDS)}, w))")


def content_sql(expr: str) -> str:
    return (f"list_distinct(list_filter(regexp_extract_all({_FOLD.format(f'lower({expr})')}, '[a-zñ0-9]+'), "
            f"lambda w: length(w) >= 3 and not list_contains({_LIST(L.CONTENT_STOPWORDS)}, w)))")


def keywords_sql(expr: str) -> str:
    return (f"list_filter(regexp_extract_all(lower({expr}), '[\\p{{L}}\\p{{N}}_]+'), "
            f"lambda w: length(w) >= 4 and not list_contains({_LIST(L.KEYWORD_STOPWORDS)}, w))")


@query("normalize_for_match", f"select doc_id, md5({normalize_sql('text')}) as form from documents")
def _(spark: SparkSession, d: str) -> DataFrame:
    """T1, T2"""
    return rows(spark, d, "documents").select("doc_id", F.md5(T.normalize_for_match(F.col("text"))).alias("form"))


@query("normalize_norm_text",
       f"select id_norma, {normalize_sql('texto')} as form from ({norms_sql('id_norma', text=True)})")
def _(spark, d):
    """T1 on texts that hold dotted acronyms"""
    return norms(spark, d, "id_norma", text=True).select("id_norma", T.normalize_for_match(F.col("texto")).alias("form"))


@query("token_frequencies",
       f"select term, count(*) as n, count(distinct doc_id) as docs from (select doc_id, unnest({tokens_sql('text')}) as term "
       "from documents) group by term")
def _(spark, d):
    """Index tokens with collection and document frequency.

    Counting per (term, document) first keeps the distinct count mergeable on the map side.
    """
    words = rows(spark, d, "documents", "doc_id", "text").select("doc_id", F.explode_outer(T.lexical_tokens(F.col("text"))).alias("term")).where(F.col("term").isNotNull())
    per_doc = words.groupBy("term", "doc_id").agg(F.count(F.lit(1)).alias("tf"))
    return per_doc.groupBy("term").agg(F.sum("tf").alias("n"), F.count(F.lit(1)).alias("docs"))


@query("content_token_counts",
       f"select doc_id, len({content_sql('text')}) as n_content, list_aggregate(list_sort({content_sql('text')}), 'min') as first_word from documents")
def _(spark, d):
    """T4"""
    words = T.content_tokens(F.col("text"))
    return rows(spark, d, "documents").select(
        "doc_id", F.size(words).cast("bigint").alias("n_content"), F.array_min(words).alias("first_word"))


@query("definition_word_counts",
       f"select doc_id, len(list_filter(regexp_extract_all({_FOLD.format('lower(text)')}, '[a-záéíóúñ]{{2,}}'), "
       f"lambda w: not list_contains({_LIST(L.DEFINITION_STOPWORDS)}, w))) as n_words from documents")
def _(spark, d):
    """T6"""
    return rows(spark, d, "documents").select(
        "doc_id", F.size(T.definition_words(F.col("text"))).cast("bigint").alias("n_words"))


@query("catalog_keys",
       f"select id_norma, regexp_replace({_SQUEEZE.format('lower(organismo)')}, '^(la|el|los|las)[ ]+', '') as llave from ({norms_sql('id_norma', 'organismo')})")
def _(spark, d):
    """T7"""
    return norms(spark, d, "id_norma", "organismo").select("id_norma", T.catalog_key(F.col("organismo")).alias("llave"))


@query("norm_variants",
       f"""select id_norma, unnest(case tipo
 when 'DECRETO' then ['D.S. N° ' || numero, 'D.S. ' || numero, 'Decreto Supremo ' || numero, 'Decreto Supremo N° ' || numero, 'decreto ' || numero, 'D.S. N°' || numero]
 when 'LEY' then ['Ley N° ' || numero, 'Ley ' || numero, 'ley ' || numero, 'Ley N°' || numero]
 when 'DFL' then ['DFL N° ' || numero, 'DFL ' || numero, 'D.F.L. ' || numero, 'DFL N°' || numero, 'D.F.L. N° ' || numero]
 when 'RESOLUCION' then ['Resolución Exenta N° ' || numero, 'Res. Ex. ' || numero, 'Resolución ' || numero, 'Res. Ex. N° ' || numero]
 else [tipo || ' ' || numero] end) as variante from ({norms_sql('id_norma', 'tipo', 'numero')})""")
def _(spark, d):
    """T8"""
    n = norms(spark, d, "id_norma", "tipo", "numero")
    return n.select("id_norma", F.explode(T.norm_variants(F.col("tipo"), F.col("numero"))).alias("variante"))


_RAW_NUMBER = "cast(l_linenumber as string) || case l_returnflag when 'A' then '°' when 'N' then ' º  BIS' else '   TER' end"


@query("article_numbers",
       f"""select l_orderkey, l_linenumber, crudo, case when l_linestatus = 'F' then n || ' transitorio' else n end as numero,
 trim(regexp_replace(translate(crudo, '°º', ''), ' +', ' ', 'g')) as grado_cita, replace(trim(crudo), '°', '') as grado_busqueda,
 translate(trim(crudo), '°º', '') as grado_respuesta, count(*) as n
 from (select *, replace(replace({_SQUEEZE.format('crudo')}, 'BIS', 'bis'), 'TER', 'ter') as n
       from (select l_orderkey, l_linenumber, l_linestatus, {_RAW_NUMBER} as crudo from lineitem)) group by all""")
def _(spark, d):
    """T9 and the three degree rules of T10"""
    raw = F.col("crudo")
    lines = table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_linestatus", F.expr(_RAW_NUMBER).alias("crudo"))
    return lines.select(
        "l_orderkey", "l_linenumber", "crudo",
        T.article_number(raw, F.col("l_linestatus") == "F").alias("numero"),
        T.degree_grounding(raw).alias("grado_cita"),
        T.degree_retrieval(raw).alias("grado_busqueda"),
        T.degree_scoring(raw).alias("grado_respuesta"),
    ).groupBy("l_orderkey", "l_linenumber", "crudo", "numero", "grado_cita", "grado_busqueda", "grado_respuesta").agg(
        F.count(F.lit(1)).alias("n"))


_LEAD = "'^[A-ZÁÉÍÓÚÑ]+[ ]+[0-9]+[ ]*'"


@query("display_titles",
       f"select id_norma, substr(trim(regexp_replace(trim(regexp_replace(trim(regexp_replace(titulo, {_LEAD}, '')), {_LEAD}, '')), '^T[ ]+', '')), 1, 120) as nombre "
       f"from ({norms_sql('id_norma', 'titulo')})")
def _(spark, d):
    """T11"""
    return norms(spark, d, "id_norma", "titulo").select("id_norma", T.display_title(F.col("titulo")).alias("nombre"))


@query("clean_text_hash",
       "select doc_id, md5(trim(regexp_replace(regexp_replace(text, '[ \t\n\r\f\v ]+', ' ', 'g'), '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f]', '', 'g'))) as limpio, "
       "substr(sha256(text), 1, 16) as huella, greatest(1, length(text) // 4) as tokens, len(string_split(text, ' ')) as palabras from documents")
def _(spark, d):
    """T12, T15, T16, F5"""
    c = F.col("text")
    return rows(spark, d, "documents", "doc_id", "text").select(
        "doc_id", F.md5(T.clean_article_text(c)).alias("limpio"), T.content_hash(c).alias("huella"),
        T.token_estimate(c).alias("tokens"), T.word_count(c).cast("bigint").alias("palabras"))


@query("long_sections",
       "select doc_id, n_chars from documents where len(string_split(text, ' ')) > 400")
def _(spark, d):
    """F5"""
    docs = rows(spark, d, "documents", "doc_id", "text", "n_chars")
    return docs.where(T.word_count(F.col("text")) > 400).select("doc_id", "n_chars")


@query("initials",
       "select doc_id, array_to_string(list_filter(list_transform(regexp_split_to_array(text, '[ \t\n\r\f\v]+'), lambda w: substr(w, 1, 1)), "
       "lambda c: regexp_full_match(c, '\\p{Lu}')), '') as siglas from documents")
def _(spark, d):
    """T13"""
    return rows(spark, d, "documents", "doc_id", "text").select("doc_id", T.first_letters(F.col("text")).alias("siglas"))


@query("organism_codes",
       f"""select codigo, count(*) as n from (select case
 when u like '%ENERGÍA%' and (u like '%COMISIÓN NACIONAL%' or u like '%CNE%') then 'CNE' when u like '%ENERGÍA%' then 'MIN_ENERGIA'
 when u like '%ELECTRICIDAD%' or u like '%SEC%' then 'SEC' when u like '%ECONOMÍA%' then 'MIN_ECONOMIA' when u like '%HACIENDA%' then 'MIN_HACIENDA'
 when u like '%MEDIO AMBIENTE%' then 'MIN_MEDIO_AMBIENTE' when u like '%MINERÍA%' then 'MIN_MINERIA' when u like '%OBRAS PÚBLICAS%' then 'MOP'
 when u like '%INTERIOR%' then 'MIN_INTERIOR' else 'OTRO' end as codigo from (select upper(organismo) as u from ({norms_sql('organismo')}))) group by codigo""")
def _(spark, d):
    """T17"""
    return norms(spark, d, "organismo").groupBy(classify.organism(F.col("organismo")).alias("codigo")).agg(F.count(F.lit(1)).alias("n"))


@query("kind_and_number",
       f"""select id_norma, case when t like 'LEY%' then 'LEY' when t like 'DECRETO%' then 'DECRETO' when t like 'RESOLUCION%' then 'RESOLUCION' else 'OTRO' end as tipo_leido,
 regexp_extract(t, '^[A-Z]+ *([0-9]+)', 1) as numero_leido from (select id_norma, upper(trim(titulo)) as t from ({norms_sql('id_norma', 'titulo')}))""")
def _(spark, d):
    """T18"""
    kind, number = classify.kind_and_number(F.col("titulo"))
    return norms(spark, d, "id_norma", "titulo").select("id_norma", kind.alias("tipo_leido"), number.alias("numero_leido"))


_TAGS_SQL = "list_filter([" + ", ".join(
    "case when " + " or ".join(f"contains(low, '{s}')" for s in stems) + f" then '{tag}' end" for tag, stems in L.THEME_STEMS
) + "], lambda t: t is not null)"
THEMES_SQL = ("select id, low, " + _TAGS_SQL + " as temas from (select id, lower(texto) as low from ({src}))")
_SECTOR_SQL = " or ".join(f"contains(low, '{s}')" for s in L.SECTOR_STEMS)


@query("theme_tags",
       f"select id as id_norma, array_to_string(temas, ',') as temas, ({_SECTOR_SQL}) as relevante from ("
       + THEMES_SQL.format(src=norms_sql("id_norma", text=True).replace(" as id_norma", " as id")) + ")")
def _(spark, d):
    """T20"""
    n = norms(spark, d, "id_norma", text=True)
    return n.select("id_norma", F.array_join(T.themes(F.col("texto")), ",").alias("temas"),
                    T.sector_relevant(F.col("texto")).alias("relevante"))


@query("theme_tags_short",
       "select page_id, array_to_string(list_filter([case when contains(h, 'distribuci') then 'DISTRIBUCION' end, case when contains(h, 'transmisi') then 'TRANSMISION' end, "
       "case when contains(h, 'generaci') then 'GENERACION' end, case when contains(h, 'medid') or contains(h, 'medici') then 'MEDIDAS' end, case when contains(h, 'tarifa') then 'TARIFAS' end, "
       "case when contains(h, 'potencia') then 'POTENCIA' end, case when contains(h, 'energ') then 'ENERGIA' end, case when contains(h, 'peaje') then 'PEAJES' end], lambda t: t is not null), ',') as temas "
       "from (select page_id, lower(html) as h from pages)")
def _(spark, d):
    """T19 on raw pages"""
    return rows(spark, d, "pages", "page_id", "html").select("page_id", F.array_join(T.themes_short(F.col("html")), ",").alias("temas"))


_RAW_DATE = ("case o_orderpriority when '1-URGENT' then cast(cast(o_orderdate as date) as string) "
             "when '2-HIGH' then cast(day(o_orderdate) as string) || '.' || cast(month(o_orderdate) as string) || '.' || cast(year(o_orderdate) as string) "
             "when '3-MEDIUM' then cast(day(o_orderdate) as string) || '/' || cast(month(o_orderdate) as string) || '/' || lpad(cast(year(o_orderdate) % 100 as string), 2, '0') "
             "when '4-NOT SPECIFIED' then 'el ' || cast(day(o_orderdate) as string) || ' de ' || case month(o_orderdate) "
             + " ".join(f"when {i} then '{m}'" for i, m in enumerate("enero febrero marzo abril mayo junio julio agosto setiembre octubre noviembre diciembre".split(), 1))
             + " end || ' de ' || cast(year(o_orderdate) as string) else cast(year(o_orderdate) as string) || '-02-' || lpad(cast(day(o_orderdate) as string), 2, '0') end")


@query("parse_dates",
       f"""select o_orderkey, crudo, cast(case
 when o_orderpriority = '5-LOW' then try_cast(crudo as date)
 when o_orderpriority = '3-MEDIUM' then make_date(case when y2 < 50 then 2000 + y2 else 1900 + y2 end, month(o_orderdate), day(o_orderdate))
 else cast(o_orderdate as date) end as string) as fecha
 from (select *, cast(year(o_orderdate) % 100 as int) as y2, {_RAW_DATE} as crudo from orders)""")
def _(spark, d):
    """Five spellings of the order date, one of them often impossible"""
    raw = table(spark, d, "orders").select("o_orderkey", F.expr(_RAW_DATE).alias("crudo"))
    return raw.select("o_orderkey", "crudo", dates.parse_date(F.col("crudo")).cast("string").alias("fecha"))


_VERSIONS = ("case when o_orderstatus = 'F' then array(named_struct('id_version', '2222-02-02', 'descripcion', 'Texto Original'), "
             "named_struct('id_version', cast(cast(o_orderdate as date) as string), 'descripcion', 'Única')) "
             "when o_orderstatus = 'O' then array(named_struct('id_version', '2020-01-01', 'descripcion', 'Última'), "
             "named_struct('id_version', cast(cast(o_orderdate as date) as string), 'descripcion', 'Texto Original de la ley')) end")


@query("publication_dates",
       """select cast(o_orderkey as string) as id_norma, cast(cast(o_orderdate as date) as string) as fecha,
 cast(year(o_orderdate) as string) as anio, round(least(greatest((year(o_orderdate) - 1935) / 90.0, 0.0), 1.0) * 0.9, 6) as vigencia from orders""")
def _(spark, d):
    """Every layer of the fallback leads back to the order date"""
    from lexmesh.plans.views import NORM_COLUMNS, TEXT
    n = table(spark, d, "orders").select(
        F.expr(NORM_COLUMNS["id_norma"]).alias("id_norma"), F.expr(TEXT).alias("texto"), F.expr(NORM_COLUMNS["titulo"]).alias("titulo"),
        F.expr("case when o_totalprice > 300000 then date_format(o_orderdate, 'dd.MM.yyyy') else '' end").alias("campo"),
        F.expr(_VERSIONS).alias("versiones"))
    day = dates.publication_date(F.col("campo"), F.col("texto"), F.col("versiones"))
    year = dates.norm_year(F.col("texto"), F.col("titulo"))
    return n.select("id_norma", day.cast("string").alias("fecha"), year.alias("anio"),
                    F.round(dates.recency(year.cast("int")), 6).alias("vigencia"))


@query("coded_dates",
       """select o_orderkey, cast(make_date(cast(year(o_orderdate) as int), case when o_orderstatus = 'P' then 1 else cast(month(o_orderdate) as int) end, cast(day(o_orderdate) as int)) as string) as fecha from orders""")
def _(spark, d):
    """D3: unknown month codes fall back to January"""
    codes = ", ".join(f"'{m}'" for m in L.MONTH_CODES)
    raw = F.expr(f"date_format(o_orderdate, 'dd') || '-' || case when o_orderstatus = 'P' then 'XYZ' else element_at(array({codes}), month(o_orderdate)) end "
                 "|| '-' || cast(year(o_orderdate) as string)")
    return table(spark, d, "orders").select("o_orderkey", dates.coded_date(raw).cast("string").alias("fecha"))


@query("norms_since_year",
       f"select id_norma from ({norms_sql('id_norma', 'fecha', 'titulo')}) where coalesce(year(fecha) >= 1998, false) or contains(titulo, '1998')")
def _(spark, d):
    """F13"""
    n = norms(spark, d, "id_norma", "fecha", "titulo")
    return n.where(dates.year_filter(F.col("fecha").cast("string"), F.lit(None).cast("string"), F.col("titulo"), 1998)).select("id_norma")


_CLASS_SQL = """case when regexp_matches(b, '^(T +)?APRUEBA +REGLAMENTO\\b') then 'reglamento_base' when regexp_matches(b, '^(T +)?FIJA\\b') then 'fija_valores'
 when regexp_matches(b, '^(T +)?MODIFICA\\b') then 'modifica' when regexp_matches(b, '^(T +)?DEROGA\\b') then 'deroga'
 when contains(substr(b, 1, 80), 'APRUEBA REGLAMENTO') then 'reglamento_base' when contains(substr(b, 1, 80), 'FIJA') then 'fija_valores'
 when contains(substr(b, 1, 80), 'MODIFICA') then 'modifica' when contains(substr(b, 1, 80), 'DEROGA') then 'deroga' end"""
CLASSES_SQL = (f"select *, {_CLASS_SQL} as clase from (select *, trim(regexp_replace(upper(titulo), '^[A-Z]+[ ]+[0-9]+[ ]*', '')) as b from ({{src}}))")


@query("norm_classes",
       f"""select id_norma, clase, case when contains(u, 'MODIFICA') then 'MODIFICA' when contains(u, 'DEROGA') or contains(u, 'DERÓGA') then 'DEROGA'
 when contains(u, 'SUSTITUYE') then 'SUSTITUYE' when contains(u, 'REGLAMENTA') or contains(u, 'REGLAMENTO') then 'REGLAMENTA' when contains(u, 'APRUEBA') then 'APRUEBA' else 'REFERENCIA' end as relacion,
 case when u like 'LEY%' or regexp_matches(u, '\\bLEY +N') then 3 when contains(u, 'RESOLUCION') then 1 when contains(u, 'DECRETO') then 2 else 2 end as rango
 from (select *, upper(titulo) as u from ({CLASSES_SQL.format(src=norms_sql('id_norma', 'tipo', 'titulo'))}))""")
def _(spark, d):
    """E18, E19, E20"""
    t = F.col("titulo")
    rank, _flag = classify.legal_rank(F.col("tipo"), t)
    return norms(spark, d, "id_norma", "tipo", "titulo").select(
        "id_norma", classify.norm_class(t).alias("clase"), classify.title_relation(t).alias("relacion"), rank.alias("rango"))


@query("rank_mismatches",
       f"""select tipo, rango, marcado, count(*) as n from (select tipo, rango, coalesce((case tipo when 'LEY' then 3 when 'DECRETO' then 2 else 1 end) <> rango, false) as marcado
 from (select tipo, case when u like 'LEY%' or regexp_matches(u, '\\bLEY +N') then 3 when contains(u, 'RESOLUCION') then 1 when contains(u, 'DECRETO') then 2 end as rango
 from (select tipo, upper(titulo) as u from ({norms_sql('tipo', 'titulo')})))) group by all""")
def _(spark, d):
    """Title and type disagree"""
    rank, flagged = classify.legal_rank(F.col("tipo"), F.col("titulo"))
    return norms(spark, d, "tipo", "titulo").groupBy("tipo", rank.alias("rango"), flagged.alias("marcado")).agg(F.count(F.lit(1)).alias("n"))


_STRATEGY_HITS = " + ".join(f"(case when contains(q, '{t}') then 1 else 0 end)" for t in L.TECHNICAL_TERMS)


@query("question_profiles",
       f"""select id_norma, cast(case when n <= 3 then 0.65 when n >= 7 then 0.35 else 0.5 end as double) as peso_lexico, cast(case when n <= 3 then 0.35 when n >= 7 then 0.65 else 0.5 end as double) as peso_denso,
 case when regexp_matches(q, '(decreto|ley|resolución|d\\.)[ ]*[0-9]+') then 'keywords' when ({_STRATEGY_HITS}) <= 2 then 'embeddings' else 'hybrid' end as ruta
 from (select id_norma, lower(titulo) as q, len(list_filter(regexp_split_to_array(trim(titulo), '[ ]+'), lambda w: length(w) > 3)) as n from ({norms_sql('id_norma', 'titulo')}))""")
def _(spark, d):
    """Q8, Q12: weights and route by the question text"""
    q = F.col("titulo")
    lexical, dense = classify.length_weights(q)
    return norms(spark, d, "id_norma", "titulo").select(
        "id_norma", lexical.alias("peso_lexico"), dense.alias("peso_denso"), classify.search_strategy(q).alias("ruta"))
