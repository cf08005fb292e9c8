"""References with places: duplicates, spans inside spans, alias order, silenced terms and proximity, on small texts."""

from lexmesh.operators import mentions, spans


def frame(spark, *said):
    return spark.createDataFrame(list(enumerate(said)), "id int, texto string")


TARGETS = [("ley 20936", "LEY_20936"), ("decreto 13", "DECRETO_13")]


def test_a_norm_inside_a_citation_counts_with_it_but_a_repeated_citation_leaves_its_norm(spark):
    texts = frame(spark, "la letra b) del artículo 5 de la Ley 20.936.", "artículo 5 de la Ley 20.936; artículo 5 de la Ley 20.936", "Ley 999 y decreto 13, decreto 13", None, "")
    targets = spark.createDataFrame(TARGETS, "llave string, canonico string")
    got = sorted((r.id, r.canonico, r.articulo or "", r.sub or "", r.confianza, r.start) for r in mentions.citations(texts, ["id"], targets).collect())
    assert got == [(0, "LEY_20936", "5", "letra b)", 0.9, 3), (1, "LEY_20936", "", "", 0.85, 46), (1, "LEY_20936", "5", "", 0.9, 0), (2, "DECRETO_13", "", "", 0.85, 10)]
    context = {r.start: r.context for r in mentions.citations(texts, ["id"], targets).where("id = 2").collect()}
    assert context == {10: "Ley 999 y decreto 13, decreto 13"}


def test_the_first_alias_of_a_norm_counts(spark):
    texts = frame(spark, "la LGSE y el DFL4", "el dfl4, LGSEX", "nada")
    aliases = spark.createDataFrame([("n1", "LGSE", 0), ("n1", "DFL4", 1), ("n2", "", 0), ("n3", None, 0)], "entry string, term string, place int")
    got = sorted(tuple(r) for r in mentions.alias_references(texts, ["id"], aliases).collect())
    assert got == [(0, "n1", "LGSE", 0.85, 3, "la LGSE y el DFL4"), (1, "n1", "DFL4", 0.85, 3, "el dfl4, LGSEX")]


def test_only_terms_with_a_sign_at_an_end_are_regained(spark):
    names = spark.createDataFrame([(1, "A.V.I.", 0), (2, "VATT", 0), (3, "(x", 0), (4, "", 0), (5, "ñ", 0)], "entry int, term string, place int")
    assert sorted(r.entry for r in mentions.silenced_terms(names).collect()) == [1, 3]
    texts = frame(spark, "el A.V.I. del VATT (x)", "a.v.i.s", "A.V.I.")
    have = spark.createDataFrame([(2, 1)], "id int, entry int")
    got = sorted((r.id, r.entry) for r in mentions.regained_edges(texts, ["id"], names, have).collect())
    assert got == [(0, 1), (0, 3)]


def test_a_verb_meets_the_first_norm_within_reach(spark):
    far = "Derógase " + "x" * 110 + " la ley N° 5"
    texts = frame(spark, "Modifícase el decreto N° 1.2 y la ley N° 3", far, "ley N° 4, derógase", "Agrégase y sustitúyese el DFL N° 7")
    got = sorted((r.id, r.verbo, r.tipo, r.numero) for r in mentions.reform_references(texts, ["id"]).collect())
    assert got == [(0, "modifícase", "DECRETO", "12"), (1, "derógase", None, None), (2, "derógase", None, None), (3, "agrégase", "DFL", "7"), (3, "sustitúyese", "DFL", "7")]


def test_matches_have_groups_and_context(spark):
    texts = frame(spark, "ab AB xx", None)
    got = [tuple(r) for r in spans.matched(texts, {"p": "(a)(z)?b"}, ["id"], "texto", 1).orderBy("start").collect()]
    assert got == [(0, "p", 0, 2, ["a", None], "ab "), (0, "p", 3, 5, ["A", None], " AB ")]


def test_texts_are_walked_once_for_references(spark, tmp_path):
    texts = spark.createDataFrame([("1", "Derógase la ley N° 5, según artículo 7 de la ley N° 5."), ("2", "nada"), ("3", None)], "id_norma string, texto string")
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    targets = spark.createDataFrame([("ley 5", "LEY_5")], "llave string, canonico string")
    for read in (lambda t: mentions.reform_references(t, ["id_norma"]), lambda t: mentions.citations(t, ["id_norma"], targets)):
        before = seen.value
        assert read(texts.mapInArrow(counted, texts.schema)).count() >= 1
        assert seen.value - before == 3


def test_a_change_reads_its_rows_once(spark, tmp_path):
    from lexmesh.sources.keyed import KeyedTable

    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    rows = spark.range(50).selectExpr("id", "id * 2 as v").mapInArrow(counted, "id long, v long")
    table = KeyedTable(spark, str(tmp_path / "kept"), ["id"], buckets=4)
    table.upsert(rows)
    table.upsert(rows)
    assert seen.value == 100 and table.read().count() == 50
