import collections
import datetime as dt
import math
import random
import re

from pyspark.sql import functions as F

from lexmesh.functions import citations as C, classify, dates, text as T
from lexmesh.operators import extraction as X


def column(spark, expr, *values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, s string")
    return [r[0] for r in df.orderBy("i").select(expr(F.col("s"))).collect()]


def test_normalize(spark):
    got = column(spark, T.normalize_for_match, "V.A.T.T.", "  C.O.M.A.  del\nSistema ", "energética", "fin. Otra", None, "art. 5", "a.b.c")
    assert got == ["vatt", "coma del sistema", "energetica", "fin. otra", "", "art. 5", "abc"]


def test_terms_are_whole(spark):
    df = spark.createDataFrame([("la potencia firme", "potencia"), ("potencial", "potencia"), ("coma vatt", "vatt"), ("x", "")], "q string, t string")
    assert [r[0] for r in df.select(T.contains_term(F.col("q"), F.col("t"))).collect()] == [True, False, True, False]


def test_flanked_pattern_accepts_dotted_acronyms(spark):
    df = spark.createDataFrame([("el A.V.I. anual", "A.V.I."), ("xA.V.I.", "A.V.I."), ("ley", "Ley"), ("leyes", "Ley")], "q string, t string")
    got = [r[0] for r in df.select(F.rlike(F.col("q"), T.flanked_pattern(F.col("t")))).collect()]
    assert got == [True, False, True, False]


def test_degree_rules_differ(spark):
    assert column(spark, T.degree_grounding, "5°  bis", " 5º ") == ["5 bis", "5"]
    assert column(spark, T.degree_retrieval, "5°", "5º", None) == ["5", "5º", ""]
    assert column(spark, T.degree_scoring, "5º  a", None) == ["5  a", ""]


def test_titles(spark):
    assert column(spark, T.display_title, "DECRETO 13DECRETO 13 T FIJA PRECIOS", "LEY 5 NORMA") == ["FIJA PRECIOS", "NORMA"]
    assert column(spark, classify.norm_class, "DECRETO 13 T FIJA X", "LEY 1 APRUEBA REGLAMENTO Y", "LEY 2 QUE DEROGA Z", "OTRA") == [
        "fija_valores", "reglamento_base", "deroga", None]


def test_rank(spark):
    rank = lambda c: classify.legal_rank(F.lit("LEY"), c)[0]
    flag = lambda c: classify.legal_rank(F.lit("LEY"), c)[1]
    titles = ["DECRETO LEY 1", "D.F.L. N° 4", "DFL 4", "LEY N° 2", "RESOLUCIÓN 3", "DECRETO 9", "ACUERDO", "D.L. 5"]
    assert column(spark, rank, *titles) == [3, 3, 3, 3, 1, 2, 3, 3 if False else 3]
    assert column(spark, flag, *titles)[4:7] == [True, True, True]


def test_dates(spark):
    got = column(spark, dates.parse_date, "2020-3-5", "05.03.2020", "5/3/49", "5-3-50", "a 5 de Setiembre de 2001", "2020-02-30", "", None, "nada")
    day = dt.date
    assert got == [day(2020, 3, 5), day(2020, 3, 5), day(2049, 3, 5), day(1950, 3, 5), day(2001, 9, 5), None, None, None, None]


def test_header_and_signing_dates(spark):
    assert column(spark, dates.header_date, "Publicación: 15-MAR-2020", "PUBLICACION 1-ago-1999", "Publicación: 15-XYZ-2020") == [
        dt.date(2020, 3, 15), dt.date(1999, 8, 1), None]
    assert column(spark, dates.signing_date, "En Viña del Mar, 3 de mayo de 1981") == [dt.date(1981, 5, 3)]
    assert column(spark, dates.coded_date, "08-ABR-2024", "08-QQQ-2024", "x") == [dt.date(2024, 4, 8), dt.date(2024, 1, 8), None]


def test_citations(spark):
    answer = "Ver [Art. 5° de 1146553], [artículo 36 D del LEY_1], [Art. ag de 12] y [Art. 5 bis de 7]."
    got = column(spark, C.citations, answer, None)
    assert [(c["norma"], c["articulo"]) for c in got[0]] == [("1146553", "5"), ("LEY_1", "36 D"), ("7", "5 bis")]
    assert got[1] == []
    assert column(spark, C.strip_malformed, answer)[0] == "Ver [Art. 5° de 1146553], [artículo 36 D del LEY_1], y [Art. 5 bis de 7]."


def test_year_filter(spark):
    df = spark.createDataFrame([("1999-01-01", None, "x"), (None, "2021", "x"), (None, None, "norma 2020"), ("1990", None, "nada")], "a string, b string, t string")
    assert [r[0] for r in df.select(dates.year_filter(F.col("a"), F.col("b"), F.col("t"), 2020)).collect()] == [False, True, True, False]


def _weighed(texts, features, min_df, max_df, top):
    """The same by counting everything."""
    tf = collections.Counter()
    for i, t in texts:
        words = re.findall(r"(?<!\w)[a-z]{4,}(?!\w)", (t or "").lower())
        tf.update((i, " ".join(words[j:j + n])) for n in (1, 2, 3) for j in range(len(words) - n + 1))
    df, total = collections.Counter(term for _, term in tf), collections.Counter()
    for (_, term), n in tf.items():
        total[term] += n
    kept = sorted((t for t in df if min_df <= df[t] <= max_df * len(texts)), key=lambda t: (-total[t], t))[:features]
    idf = {t: math.log((1 + len(texts)) / (1 + df[t])) + 1 for t in kept}
    found = {}
    for i in {i for i, _ in texts if i is not None}:
        w = {t: n * idf[t] for (k, t), n in tf.items() if k == i and t in idf}
        length = math.sqrt(sum(x * x for x in w.values()))
        best = sorted(((round(x / length, 6), t) for t, x in w.items()), key=lambda p: (-p[0], p[1]))[:top]
        found |= {(i, t): (r, s) for r, (s, t) in enumerate(best, 1)}
    return found


def test_terms_equal_counting_everything(spark):
    rng = random.Random(4)
    words = [a + b for a in ("casa", "peso", "linea", "red") for b in ("", "mar", "sol", "uno")]
    texts = [(i % 50 if i % 9 else None, " ".join(rng.choices(words, [1 / (k + 1) for k in range(16)], k=rng.randrange(30)))) for i in range(70)] + [(90, None), (91, ""), (92, "casa casa casa casa")]
    rows = spark.createDataFrame(texts, "doc_id long, text string").repartition(5)
    for features, min_df, max_df in ((5000, 2, 0.7), (60, 2, 0.7), (25, 3, 0.3), (6, 1, 0.05)):
        got = {(r.doc_id, r.term): (r["rank"], r.score) for r in X.tfidf_terms(rows, features=features, min_df=min_df, max_df=max_df, top=8).collect()}
        want = _weighed(texts, features, min_df, max_df, 8)
        assert got.keys() == want.keys() and all(got[k][0] == want[k][0] and abs(got[k][1] - want[k][1]) < 2e-6 for k in want)


def test_grams_of_rare_words_are_not_shuffled(spark):
    counted = spark.createDataFrame([(1, "alta baja", 1), (1, "alta rara", 2), (1, "rara alta", 1), (2, "alta baja alta", 1)], "doc_id long, term string, tf long")
    parts = spark.createDataFrame([("alta",), ("baja",), ("alta baja",)], "term string")
    assert [tuple(r) for r in X._sound(counted, parts).collect()] == [(1, "alta baja", 1)]
    assert X._sound(counted.where("doc_id = 2"), parts.unionByName(spark.createDataFrame([("baja alta",)], "term string"))).count() == 1


def test_grams_are_added_up_and_pruned_where_they_are_read(spark):
    """Every gram of every text was sent to a join with the parts that are frequent enough."""
    from collections import Counter

    from lexmesh.operators.postings import gram_totals, grams

    rng = random.Random(4)
    lists = [[rng.choice("abcd") + rng.choice("xy") for _ in range(rng.randint(0, 9))] for _ in range(80)] + [None]
    df = spark.createDataFrame(list(enumerate(lists)), "id int, w array<string>")
    runs = lambda w, n: [" ".join(w[i:i + n]) for i in range(len(w or []) - n + 1)]
    for size in (1, 2, 3):
        parts = None if size == 1 else sorted({g for w in lists for g in runs(w, size - 1)})[::2]
        sound = lambda g: parts is None or {" ".join(g.split(" ")[:-1]), " ".join(g.split(" ")[1:])} <= set(parts)
        tf = Counter(g for w in lists for g in runs(w, size) if sound(g))
        dfs = Counter(g for w in lists for g in set(runs(w, size)) if sound(g))
        got = gram_totals(df, "w", size, parts).groupBy("term").agg({"df": "sum", "tf": "sum"}).collect()
        assert {r.term: (r["sum(df)"], r["sum(tf)"]) for r in got} == {g: (dfs[g], tf[g]) for g in tf} and tf
        only = sorted(tf)[::3]
        assert sorted(tuple(r) for r in grams(df, ["id"], "w", size, only).collect()) == sorted((i, g, n) for i, w in enumerate(lists) for g, n in Counter(runs(w, size)).items() if g in only)
