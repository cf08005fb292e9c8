import random

from pyspark.sql import functions as F

from lexmesh.operators import definitions as D, extraction as X, graph, increments as I, quantiles, references, terms


def test_components_against_union_find(spark):
    random.seed(2)
    n = 300
    pairs = [(random.randrange(n), random.randrange(n)) for _ in range(220)] + [(i, i + 1) for i in range(400, 440)] + [(500, 501 + i) for i in range(30)]
    nodes = list(range(n)) + list(range(400, 441)) + list(range(500, 531))
    parent = {v: v for v in nodes}

    def find(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    df = graph.components(spark.createDataFrame([(v,) for v in nodes], "node long"), spark.createDataFrame(pairs, "src long, dst long"))
    assert {r["node"]: r["component"] for r in df.collect()} == {v: find(v) for v in nodes}


def test_reach_with_cycle(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (4, 5)], "src long, dst long")
    start = spark.createDataFrame([(1,)], "node long")
    assert sorted(tuple(r) for r in graph.reach(e, start, 3).collect()) == [(2, 1), (3, 2), (4, 3)]


def candidates(spark, *rows):
    return spark.createDataFrame(list(rows), "concepto_id long, id_norma string, articulo string, rank int, fecha string, pos long").withColumn("fecha", F.to_date("fecha"))


def test_authority(spark):
    c = candidates(
        spark, (1, "A", "1", 2, None, 1),
        (2, "A", "1", 3, "2020-01-01", 1), (2, "B", "1", 2, "2010-01-01", 2),
        (3, "A", "1", 3, "2000-01-01", 1), (3, "B", "1", 2, "2010-01-01", 2),
        (4, "A", "1", 3, "2000-01-01", 1), (4, "B", "2", 3, "2010-01-01", 2),
        (5, "A", "1", 3, "2000-01-01", 1), (5, "A", "2", 3, "2000-01-01", 2),
        (6, "A", "1", 3, None, 1), (6, "B", "1", 3, None, 2),
        (7, "A", "1", 3, None, 1), (7, "B", "1", 2, None, 2))
    got = {r["concepto_id"]: (r["estado"], r["motivo"], r["id_norma"]) for r in D.authority(c).collect()}
    assert got == {
        1: ("resolved", "unico", "A"), 2: ("resolved", "rango_y_fecha", "A"), 3: ("conflict", "rango_contra_fecha", None),
        4: ("conflict", "varias_normas", None), 5: ("conflict", "empate", None), 6: ("conflict", "empate", None),
        7: ("resolved", "rango_y_fecha", "A")}
    assert sorted(map(tuple, D.authority(c.repartition(6)).collect())) == sorted(map(tuple, D.authority(c).collect()))


def test_canonical_names(spark):
    df = spark.createDataFrame([
        (1, "Comité", "Comité de adjudicación y supervisión, a que se refiere la ley"), (2, "Comité", "Órgano técnico del ramo"),
        (3, "Panel", "Panel de Expertos sin corte alguno"), (4, "Empresa", "Empresa: persona jurídica"),
        (5, "Zona", "Zona uno dos tres cuatro cinco seis siete ocho nueve, larga"), (6, "Cliente", "Cliente libre, según ley"), (7, "cliente libre", "x")],
        "concepto_id long, nombre string, definicion string")
    got = {r["concepto_id"]: (r["accion"], r["motivo"], r["canonico"]) for r in D.naming_actions(df).collect()}
    assert got[1] == ("rename", "high", "Comité de adjudicación y supervisión")
    assert got[2][:2] == ("skip", "no-fire")
    assert got[3][:2] == ("review", "low_confidence: no_boundary")
    assert got[4][:2] == ("skip", "no-fire")
    assert got[5][:2] == ("review", "low_confidence: too_long")
    assert got[6][:2] == ("review", "collision")


def test_suspicion(spark):
    df = spark.createDataFrame([("Panel", ""), ("Panel", "Panel de Expertos"), ("Panel", "aquello a que se refiere el artículo primero del reglamento vigente"),
                                ("Panel", "órgano técnico encargado resolver discrepancias del sector")], "n string, d string")
    assert [r[0] for r in df.select(D.suspicion(F.col("n"), F.col("d"))).collect()] == ["empty", "label", "remission", ""]


def test_subject_concept(spark):
    concepts = spark.createDataFrame([(1, "potencia", []), (2, "potencia firme", []), (3, "Comisión", ["CNE"])], "concepto_id long, nombre string, aliases array<string>")
    q = spark.createDataFrame([(1, "qué es la Potencia Firme"), (2, "qué es C.N.E."), (3, "potencia firme y CNE"), (4, "nada"), (5, "potencial")], "query_id long, text string")
    hits = terms.concepts_in(q, concepts, ["query_id"])
    assert sorted((r["query_id"], r["concepto_id"], r["by_alias"]) for r in hits.collect()) == [
        (1, 1, False), (1, 2, False), (2, 3, True), (3, 1, False), (3, 2, False), (3, 3, True)]
    subject = {r["query_id"]: r["concepto_id"] for r in terms.subject_concept(hits).collect()}
    assert subject == {1: 2, 2: 3}


def test_cited_references(spark):
    norms = spark.createDataFrame([("LEY", "20.936"), ("DECRETO", "62"), ("DFL", "4")], "tipo string, numero string")
    texts = spark.createDataFrame([("a", "Según la letra b) del artículo 5° del DFL 4, la Ley N° 20.936 y el D.S. N° 62; art. 9 de la Ley 1.")], "id string, texto string")
    got = sorted((r["canonico"], r["articulo"], r["confianza"]) for r in X.cited_references(texts, ["id"], X.citation_targets(norms)).collect())
    assert got == [("DECRETO_62", None, 0.85), ("DFL_4", "5", 0.9), ("LEY_20936", None, 0.85)]


def test_quantiles_on_a_skewed_group(spark):
    random.seed(4)
    rows = [("hot", round(random.gauss(0, 1), 2)) for _ in range(9000)] + [("hot", 1e6)] * 500 + [("one", 3.0)] + [("two", 1.0), ("two", 2.0)]
    df = spark.createDataFrame(rows, "k string, v double")
    got = {r["k"]: (r["q0"], r["q1"], r["q2"]) for r in quantiles.exact_quantiles(df, ["k"], "v", [0.0, 0.5, 0.95]).collect()}

    def exact(values, p):
        values = sorted(values)
        at = (len(values) - 1) * p
        lo = int(at)
        hi = min(lo + 1, len(values) - 1)
        return values[lo] + (values[hi] - values[lo]) * (at - lo)

    for key in ("hot", "one", "two"):
        values = [v for k, v in rows if k == key]
        assert all(abs(a - exact(values, p)) < 1e-9 for a, p in zip(got[key], (0.0, 0.5, 0.95))), key


def test_index_diff_is_null_safe(spark):
    new = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3"), ("d", "4")], "id string, hash string")
    old = spark.createDataFrame([("b", "2", "downloaded"), ("c", None, "downloaded"), ("d", "0", "pending"), ("e", "5", "downloaded")], "id string, hash string, estado string")
    assert sorted(tuple(r) for r in I.index_diff(new, old).collect()) == [("a", "new"), ("c", "outdated"), ("e", "gone")]


def test_status_dominance(spark):
    norms = spark.createDataFrame([("x", "DESCONOCIDO"), ("y", "DESCONOCIDO"), ("z", "VIGENTE")], "id_norma string, estado string")
    rel = spark.createDataFrame([("x", "MODIFICA"), ("x", "DEROGA"), ("y", "MODIFICA"), ("z", "MODIFICA")], "destino string, relacion string")
    assert sorted(tuple(r) for r in graph.status_after(rel, norms).collect()) == [("x", "DEROGADA"), ("y", "MODIFICADA"), ("z", "VIGENTE")]


def test_strict_definitions(spark):
    df = spark.createDataFrame([("A.V.I.", "el A.V.I.: anualidad"), ("Panel", "se entenderá por Panel el órgano"), ("Panel", "el Panel resolvió"), ("Zona", "Por Zona se entenderá")], "t string, x string")
    assert [r["x"] for r in X.strict_definitions(df, F.col("t"), F.col("x")).collect()] == ["el A.V.I.: anualidad", "se entenderá por Panel el órgano", "Por Zona se entenderá"]


def test_references_without_an_article_reach_many_tasks(spark):
    refs = spark.createDataFrame([(None, f"n{i}", "x", "DEROGA") for i in range(400)] + [(11, None, "x", "MODIFICA"), (12, None, "y", "MODIFICA"), (None, None, None, "DEROGA")],
                                 "articulo_id long, origen_norma string, destino string, tipo string")
    arts = spark.createDataFrame([(11, "1"), (21, "2"), (None, "3")], "articulo_id long, id_norma string")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = references.with_norms_of_articles(refs, arts).withColumn("task", F.spark_partition_id()).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert len(got) == 403 and [(r.articulo_id, r.id_norma) for r in got if r.id_norma] == [(11, "1")]
    assert len({r.task for r in got if r.articulo_id is None}) == 8
