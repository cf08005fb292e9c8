import json

from pyspark.sql import functions as F

from lexmesh import schemas
from lexmesh.operators import evaluation, router
from lexmesh.sources import corpora, pages, sinks


def write(path, content):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(content, encoding="utf-8")


def test_json_corpus(spark, tmp_path):
    good = {"id_norma": "1", "tipo": "LEY", "numero": "5", "titulo": "LEY 5 MODIFICA X", "fecha_publicacion": "", "organismo": "", "estado": "vigente",
            "texto_completo": "Santiago, 3 de mayo de 1981.", "versiones": [{"id_version": "1990-01-02", "descripcion": "Texto Original"}], "materia": "gas", "anexos": {"n": 2}}
    write(tmp_path / "leyes" / "a.json", json.dumps(good))
    write(tmp_path / "leyes" / "b.json", json.dumps({**good, "id_norma": "2", "titulo": ""}))
    write(tmp_path / "decretos" / "c.json", "{roto")
    raw = corpora.norm_documents(spark, str(tmp_path))
    assert sorted(r["id_norma"] for r in raw.collect()) == ["1", "2"] and raw.count() == 2
    assert [r["archivo"].rsplit("/", 1)[1] for r in corpora.rejected_files(spark, str(tmp_path)).collect()] == ["c.json"]
    assert corpora.norm_documents(spark, str(tmp_path / "none")).count() == 0
    assert {r["campo"]: r["faltan"] for r in corpora.missing_required_fields(raw).collect()}["titulo"] == 1
    norm = corpora.as_norms(corpora.with_required_fields(raw)).collect()
    assert len(norm) == 1 and str(norm[0]["fecha"]) == "1990-01-02" and norm[0]["clase"] == "modifica"
    assert norm[0]["organismo"] is None and norm[0]["metadata"]["estado"] == "vigente"
    assert norm[0]["metadata"]["materia"] == "gas" and json.loads(norm[0]["metadata"]["anexos"]) == {"n": 2}


def test_text_files_and_json_lines(spark, tmp_path):
    write(tmp_path / "t" / "123.txt", "línea uno\nlínea dos")
    write(tmp_path / "t" / "otro.md", "no")
    assert [tuple(r) for r in corpora.text_files(spark, str(tmp_path / "t")).collect()] == [("123", "línea uno\nlínea dos")]
    write(tmp_path / "q.jsonl", '{"query": "a"}\n\n{"query": "b"}\n')
    assert [r["query"] for r in corpora.json_lines(spark, str(tmp_path / "q.jsonl"), "query string").collect()] == ["a", "b"]


def test_alias_file(spark, tmp_path):
    write(tmp_path / "alias.json", json.dumps({"confirmados": {"LGSE": "10"}, "por_confirmar": {"RPC": "11"}, "conceptos_base": {"10": {"_norma": "x", "conceptos": ["COMA", "VATT"]}}}))
    path = str(tmp_path / "alias.json")
    assert [tuple(r) for r in corpora.alias_config(spark, path).collect()] == [("lgse", "10")]
    assert [tuple(r) for r in corpora.alias_config(spark, path, "por_confirmar").collect()] == [("rpc", "11")]
    assert sorted(tuple(r) for r in corpora.base_concepts(spark, path).collect()) == [("10", "COMA"), ("10", "VATT")]


def entry(name, status, aliases, primary="electricidad", source=None):
    return {"id": 1, "name": name, "definition": "d", "status": status, "domain_context": None, "aliases": [
        {"alias": a, "confidence": c, "validated": v} for a, c, v in aliases], "source": source, "domain": {"primary": primary, "secondary": None}}


def test_glossary(spark):
    g = corpora.glossary(spark, [
        entry("A", "ok", [("a1", "high", True), ("a2", "medium", False)], source={"norm_id": "10", "norm_label": "", "article": "5", "url": ""}),
        entry("B", "not_reviewed", [("b1", "medium", False)]), entry("C", "ok", [], source={"norm_id": "unknown", "norm_label": "", "article": "1", "url": ""}),
        entry("D", "ok", [("d", "high", True)], primary="otro")])
    assert sorted((r["name"], r["aliases"]) for r in corpora.eligible_aliases(g).collect()) == [("A", ["a1"]), ("D", ["d"])]
    decisions = spark.createDataFrame([("A", "a2", "remove"), ("B", "b1", "promote")], "name string, alias string, decision string")
    got = {r["name"]: (r["status"], [a["alias"] for a in r["aliases"]]) for r in corpora.curate_aliases(g, decisions).collect()}
    assert got == {"A": ("ok", ["a1"]), "B": ("ok", ["b1"])}
    articles = spark.createDataFrame([("10", "5", 77)], "id_norma string, numero string, articulo_id long")
    concepts = spark.createDataFrame([("A", 1)], "nombre string, concepto_id long")
    edges = {r["name"]: (r["articulo_id"], r["motivo"]) for r in corpora.definition_edges(g, articles, concepts).collect()}
    assert edges == {"A": (77, "ok"), "C": (None, "sin_fuente")}


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("1", "LEY", "20.936", 2016), ("2", "RESOLUCIÓN", "5", None)], "id_norma string, tipo string, numero string, anio int")
    sinks.write_by_kind(df, str(tmp_path / "out"))
    assert {p.name for p in (tmp_path / "out").glob("tipo=*")} == {"tipo=ley", "tipo=resolucion"}
    assert [r[0] for r in df.orderBy("id_norma").select(sinks.file_name(F.col("tipo"), F.col("numero"), F.col("anio"))).collect()] == ["ley_20-936_2016", "resolucion_5"]


def test_schema_checks(spark):
    edges = spark.createDataFrame([
        (1, None, None, "n", None, "cita", 0.9, "regex", None, None), (1, "n", None, "n", 3, "otra", 1.5, "magia", None, None)], schemas.EDGES)
    assert [r["faltas"] for r in schemas.edge_faults(edges).collect()] == [["origen", "destino", "kind", "metodo", "confianza"]]
    keys = spark.createDataFrame([("a", "1"), ("a", "1"), ("b", "1")], "id_norma string, numero string")
    assert schemas.repeated_keys(keys, ["id_norma", "numero"]).count() == 1
    assert schemas.article_id(keys).select("articulo_id").distinct().count() == 2


def test_router_learns_its_examples(spark):
    model = router.default_router(spark)
    q = spark.createDataFrame([(i, t, b) for i, (t, b) in enumerate(router.EXAMPLES)], "query_id int, text string, wanted string")
    wrong = router.route(q, model).where("branch <> wanted").count()
    assert wrong == 0


def test_links_with_marks_inside_and_either_quotes(spark):
    html = """<a class="x" href="https://s/n/1234?q=1">Ley <b>uno</b> larga</a> <a href='/n/777'>Otra norma</a> <a href="/n/9">no</a>
    """ + "".join(f'<a href="/n/{5000 + i}">Norma {i} con nombre</a>' for i in range(30))
    pages_df = spark.createDataFrame([(1, html)], "page_id long, html string")
    got = {(r["id"], r["texto"]) for r in pages.links(pages_df, "page_id", "/n/(\\d+)").collect()}
    assert {("1234", "Ley uno larga"), ("777", "Otra norma")} <= got and len(got) == 32
    listed = pages.record(pages_df, "page_id", "/n/(\\d+)").first()["enlaces"].split(",")
    assert len(listed) == 31 and "1234" in listed


def test_prompt_keeps_what_fits_whatever_the_ranks(spark):
    rows = [("q", 1, "1", "a", "x" * 20), ("q", 40, None, "b", "y" * 20), ("q", 41, "3", "c", "z" * 500)]
    docs = spark.createDataFrame(rows, "query_id string, rank int, numero string, id_norma string, texto string")
    assert [r["rank"] for r in evaluation.budget(docs, 200).orderBy("rank").collect()] == [1, 40]


def test_rows_of_one_row_group_reach_all_cores(spark, tmp_path):
    """Splits of a file get no rows unless a row group's middle lies in them."""
    from lexmesh.sources.tables import spread

    spark.range(200_000).selectExpr("id", "uuid() as v").coalesce(1).write.option("parquet.block.size", 1 << 30).parquet(str(tmp_path / "t"))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "256k")
    try:
        scan = spark.read.parquet(str(tmp_path / "t"))
        assert scan.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
        rows = [r["count"] for r in spread(scan, 10_000).groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert sum(rows) == 200_000 and max(rows) <= 20_000
    even = spark.range(0, 1000, 1, 16)
    assert spread(even).rdd.getNumPartitions() == 16 and spread(even.where("id < 0")).count() == 0
