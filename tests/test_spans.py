"""Terms in texts: the automaton against Python's own counting and regular expressions, and both ways of term search against each other."""

import re

import numpy as np

from lexmesh.operators import spans, terms

TEXTS = ["La A.V.I. y el VATT; avi.", "vatt vatt, Vattx", None, "", "aaaa aa", "Ñandú ñandú\nÑANDÚ", "x" * 50_000 + " vatt", "İ vatt İ", "V.A.T.T. (V.A.T.T.)"]
FORMS = ["A.V.I.", "vatt", "aa", "ñandú", "V.A.T.T.", "la", "", "no"]


def whole(form, text):
    flank = f"[{re.escape(spans.LETTERS)}]"
    return re.search(f"(?<!{flank}){re.escape(form.lower())}(?!{flank})", spans.lowered(text))


def test_occurrences_equal_counting(spark):
    texts = spark.createDataFrame(list(enumerate(TEXTS)), "id int, text string")
    forms = spark.createDataFrame([(f,) for f in FORMS], "form string")
    for most in (1 << 20, 20):  # one part, and many
        got = {(r.id, r.form): (r.n, r.start, r.context) for r in spans.occurrences(texts, forms, ["id"], borders=None, most=most).collect()}
        want = {}
        for i, t in enumerate(TEXTS):
            for f in filter(None, FORMS):
                low = spans.lowered(t or "")
                if f.lower() in low:
                    at = low.index(f.lower())
                    want[i, f.lower()] = low.count(f.lower()), at, t[max(0, at - 30):at + len(f) + 30]
        assert got == want
    got = {(r.id, r.form): r.start for r in spans.occurrences(texts, forms, ["id"]).collect()}
    assert got == {(i, f.lower()): m.start() for i, t in enumerate(TEXTS) if t for f in filter(None, FORMS) if (m := whole(f, t))}
    assert spans.occurrences(texts, forms.limit(0), ["id"]).count() == 0


def walked(form, text, borders):
    """(count, first) by Python's own search; of places that overlap only those that begin behind the last that counts."""
    beside = {None: lambda c: False, "letters": lambda c: c in spans.LETTERS, "words": lambda c: c.isalnum() or c == "_"}[borders]
    found, end, at = [], 0, text.find(form)
    while at >= 0:
        flanked = at and beside(text[at - 1]) or at + len(form) < len(text) and beside(text[at + len(form)])
        if at >= end and not flanked:
            found.append(at)
            end = at + len(form)
        at = text.find(form, at + 1)
    return (len(found), found[0]) if found else None


def test_a_lookup_finds_what_a_search_does(monkeypatch):
    """Terms were walked in parts of 4 MB, one pass over all texts for each, and each hit was a step of Python's."""
    rng = np.random.default_rng(5)
    said = lambda n: "".join(rng.choice(list("aab ñ1,\U0001f600"), n))
    long = "y" * 20 + "1" + "y" * 20
    forms = sorted({said(int(n)) for n in rng.integers(1, 40, 400)} | {"decreto 1, energía", "decreto 12, energía", "x" * 70, long, long.replace("1", "2")})
    texts = ["", "decreto 1, energía decreto 12, energía", "x" * 200, long, *(said(int(n)) for n in rng.integers(0, 300, 60)), "".join(forms)]
    for chunk in (spans.CHUNK, 64):
        monkeypatch.setattr(spans, "CHUNK", chunk)
        for borders in (None, "letters", "words"):
            got = {(int(w), forms[t]): (int(n), int(s)) for block in spans.Lookup(forms, borders).find(texts) for w, t, n, s in zip(*block)}
            want = {(i, f): x for i, t in enumerate(texts) for f in forms if (x := walked(f, t, borders))}
            assert got == want and len(want) > 500


def test_many_forms_are_one_pass(spark):
    forms = spark.range(300_000).selectExpr("concat('decreto ', id, ', energía') as form")
    texts = spark.createDataFrame([(0, "el Decreto 299999, ENERGÍA y el decreto 7, energía; Decreto 300000, ENERGÍA")], "id int, text string")
    hits = spans.occurrences(texts, forms, ["id"], borders=None)
    assert hits._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    assert sorted((r.form, r.n, r.start) for r in hits.collect()) == [("decreto 299999, energía", 1, 3), ("decreto 7, energía", 1, 32)]


def test_matches_are_tried_only_where_they_can_begin():
    from lexmesh.operators import mentions
    from lexmesh.operators.extraction import ARTICLE_LEADS, ARTICLE_OF_NORM, NORM_ALONE, NORM_LEADS

    rng = np.random.default_rng(6)
    slots = (["letra b)", "inciso X", "Número 3", "numero 3", ""], ["de la", "del", ""], ["art.", "ARTÍCULO", "Artículos", "art°", "partes"], ["5", "5°", "12"], ["letra b)", "inciso X", ""], ["de la", "del", "de", "y"],
             ["Ley", "ley", "D.S.", "DS", "D.F.L.", "dfl", "Decreto", "Decreto Supremo", "Res. Ex.", "Resolución Exenta"], ["N°", ""], ["20.936", "1,2", "12.3a", "x"])
    for kind, leads in ((ARTICLE_OF_NORM, ARTICLE_LEADS), (NORM_ALONE, NORM_LEADS)):
        pattern, hits = re.compile(mentions._python(kind), re.IGNORECASE), 0
        for _ in range(1000):
            text = "".join(str(rng.choice(slot)) + str(rng.choice(["", " ", " ", " ", "\n"])) for slot in slots * 3 if rng.random() < 0.95)
            got, want = ([m.span() for m in x] for x in (spans._places(pattern, leads, text, text.lower()), pattern.finditer(text)))
            assert got == want, text
            hits += len(got)
        assert hits > 300


def test_terms_are_found_alike_by_walking_and_by_joining(spark):
    rng = np.random.default_rng(1)
    words = ["peaje", "cod-1", "V.I.", "Área", "tarifa", "a", "cod", "1", "potencia firme"]
    texts = spark.createDataFrame([(i, " ".join(rng.choice(words, 30))) for i in range(60)] + [(99, None), (100, "cod--1 peajes")], "id int, text string")
    table = spark.createDataFrame([(i, t) for i, t in enumerate([*words, "tarifa a", "firme peaje", "absent", "", "área"])], "concept int, term string")
    both = [sorted({(r.id, r.concept, r.form) for r in terms.find_terms(texts, table, ["id"], sent=sent).collect()}) for sent in (1 << 20, 0)]
    assert both[0] == both[1] and len({c for _, c, _ in both[0]}) == 12


def test_terms_in_a_very_long_text(spark):
    texts = spark.createDataFrame([(0, " ".join(f"w{i}" for i in range(20_000)))], "id int, text string")
    table = spark.createDataFrame([(i, f"w{i} w{i + 1}") for i in range(0, 20_000, 1000)], "concept int, term string")
    for sent in (1 << 20, 0):
        assert terms.find_terms(texts, table, ["id"], sent=sent).count() == 20


def test_many_terms_are_not_sent_whole(spark, tmp_path):
    """A few compressed bytes may hold terms for which the driver has no room."""
    spark.range(20_000).selectExpr("id as concept", "concat('cod ', id) as term").write.parquet(str(tmp_path / "terms"))
    table = spark.read.parquet(str(tmp_path / "terms"))
    hits = terms.find_terms(table.selectExpr("concept as id", "term as text"), table, ["id"], sent=0)
    plan = hits._jdf.queryExecution().executedPlan().toString()
    assert hits.count() == 20_000 and "BroadcastHashJoin" not in plan and "SortMergeJoin" in plan
