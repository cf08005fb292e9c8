import itertools
import random

import numpy as np
import pandas as pd
import pyarrow as pa

from lexmesh.operators import boosting, dense, extraction, fusion, ivf, lexical, postings, rerank


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_rrf_scores_order_and_permutation(spark):
    a = spark.createDataFrame([(1, 10, 1), (1, 20, 2)], "query_id long, id long, rank int")
    b = spark.createDataFrame([(1, 20, 1), (1, 30, 2)], "query_id long, id long, rank int")
    got = fusion.rrf([a, b], "id").orderBy("rank").collect()
    assert [r["id"] for r in got] == [20, 10, 30]
    assert got[0]["score"] == round(1 / 62 + 1 / 61, 9)
    again = fusion.rrf([a.repartition(5), b.repartition(3)], "id")
    assert rows(again) == rows(fusion.rrf([a, b], "id"))


def test_rrf_tie_keeps_first_seen(spark):
    a = spark.createDataFrame([(1, 99, 1)], "query_id long, id long, rank int")
    b = spark.createDataFrame([(1, 5, 1)], "query_id long, id long, rank int")
    assert [r["id"] for r in fusion.rrf([a, b], "id").orderBy("rank").collect()] == [99, 5]


def test_min_max_constant_is_zero(spark):
    df = spark.createDataFrame([(1, 1, 2.0), (1, 2, 2.0), (2, 1, 0.0), (2, 2, 4.0)], "query_id long, id long, s double")
    assert rows(fusion.min_max(df, "s").select("query_id", "id", "s")) == [(1, 1, 0.0), (1, 2, 0.0), (2, 1, 0.0), (2, 2, 1.0)]


def test_dense_blocks_give_the_same_rows(spark, monkeypatch):
    rng = np.random.default_rng(3)
    corpus = spark.createDataFrame([(i, rng.normal(size=8).tolist()) for i in range(120)] + [(500, [0.0] * 8)], "id long, vec array<double>")
    questions = spark.createDataFrame([(q, rng.normal(size=8).tolist()) for q in range(9)], "query_id long, vec array<double>")
    expected = rows(dense.dense_topk(corpus, questions, 4))
    monkeypatch.setattr(dense, "BLOCK_BYTES", 3 * 64)
    assert rows(dense.dense_topk(corpus, questions, 4)) == expected
    assert len(expected) == 36


def covers(tokens, terms):
    """Shortest windows by brute force."""
    spots = [i for i, t in enumerate(tokens) if t in terms]
    full = [(a, b) for a in spots for b in spots if a <= b and terms <= set(tokens[a:b + 1])]
    least = [(a, b) for a, b in full if not any((c, d) != (a, b) and a <= c and d <= b for c, d in full)]
    return sum(1 / (max(b - a - (len(terms) - 1), 0) + 1) for a, b in least)


def test_cover_density_against_brute_force(spark):
    random.seed(5)
    words = ["uno", "dos", "tres", "cuatro", "cinco"]
    texts = [(i, " ".join(random.choice(words) for _ in range(random.randint(3, 14)))) for i in range(40)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    for n in (1, 2, 3):
        terms = words[:n]
        questions = spark.createDataFrame([(1, terms)], "query_id long, tokens array<string>")
        got = {r["doc_id"]: r["score"] for r in lexical.cover_density(docs, questions, 1000).collect()}
        want = {i: round(covers(t.split(), set(terms)), 6) for i, t in texts if set(terms) <= set(t.split())}
        assert got.keys() == want.keys()
        assert all(abs(got[i] - want[i]) < 1e-5 for i in want)


def test_substring_counts_do_not_overlap(spark):
    documents = spark.createDataFrame([(1, "aaaa"), (2, "abc"), (3, None)], "doc_id long, text string")
    questions = spark.createDataFrame([(7, ["aa", "x", "b"]), (8, ["aa"])], "query_id long, tokens array<string>")
    got = rows(lexical.substring_hits(documents, questions).select("query_id", "token", "doc_id", "tf"))
    assert got == [(7, "aa", 1, 2), (7, "b", 2, 1), (8, "aa", 1, 2)]


def test_postings_follow_changes(spark, tmp_path):
    schema = "doc_id long, text string"
    store = postings.Store(spark, str(tmp_path / "index"))
    assert store.index().totals() == (0, 0)
    first = {1: "peaje peaje ley", 2: "tarifa", 3: None}
    store.add(spark.createDataFrame(list(first.items()), schema))
    found = {(r.doc_id, r.term): (r.dl, r.tf, r.positions) for r in store.index().terms.collect()}
    assert found == {(1, "peaje"): (3, 2, [0, 1]), (1, "ley"): (3, 1, [2]), (2, "tarifa"): (1, 1, [0])}
    store.add(spark.createDataFrame([(2, "peaje nuevo"), (4, "tarifa tarifa")], schema))
    store.remove(spark.createDataFrame([(1,)], "doc_id long"))
    now = {2: "peaje nuevo", 3: None, 4: "tarifa tarifa"}
    questions = spark.createDataFrame([(1, ["peaje", "tarifa"])], "query_id long, tokens array<string>")
    for _ in range(2):
        index = store.index()
        assert index.totals() == (3, 4)
        fresh = lexical.bm25_topk(spark.createDataFrame(list(now.items()), schema), questions, 5)
        assert rows(lexical.bm25_topk(index, questions, 5)) == rows(fresh)
        store.compact()
    assert store.segments() == [2]


def test_inverted_lists_give_most_neighbours_and_all_when_all_are_read(spark, data, tmp_path, monkeypatch):
    corpus = spark.read.parquet(f"{data}/embeddings.parquet").selectExpr("vec_id as id", "embedding as vec")
    zero = spark.createDataFrame([(10 ** 6, [0.0] * 64)], "id long, vec array<float>")
    corpus = corpus.unionByName(zero).cache()
    asked = corpus.where("id % 10 = 0 and id < 1000000").selectExpr("id as query_id", "vec")
    monkeypatch.setattr(ivf, "CHUNK", 7)
    index = ivf.InvertedLists.build(corpus, str(tmp_path / "lists"))
    assert index.rows.count() == corpus.count() and max(index.chunks.values()) > 1
    probes = ivf.probes_for(index, corpus, asked, 10)
    some = ivf.with_recall(index, corpus, asked, 10, probes).collect()
    assert sum(r.hallado for r in some) >= 0.9 * len(some) and probes < len(index.centroids)
    assert rows(index.search(asked, 10, len(index.centroids))) == rows(dense.dense_topk(corpus, asked, 10))
    assert index.search(asked.limit(0), 10, 3).count() == 0
    empty = ivf.InvertedLists.build(corpus.limit(0), str(tmp_path / "none"))
    assert empty.search(asked, 10, 3).count() == 0


def test_any_model_reranks(spark):
    pairs = spark.createDataFrame([(1, 10, "la tarifa base", "tarifa base"), (1, 11, "la tarifa base", "nada de eso aquí"), (1, 12, "la tarifa base", None), (2, 10, None, "tarifa base")],
                                  "query_id long, doc_id long, question string, text string")
    assert rows(rerank.rerank(pairs, rerank.word_overlap, "doc_id", 2, 0.1)) == [(1, 10, 1.0, 1)]
    longest = lambda: lambda questions, texts: [len(t) / 10 for t in texts]
    assert rows(rerank.rerank(pairs, longest, "doc_id", 2)) == [(1, 10, 1.1, 2), (1, 11, 1.6, 1), (2, 10, 1.1, 1)]


def test_graph_boost_rules(spark):
    pool = spark.createDataFrame([(1, 10, 1.0), (1, 20, 1.0), (1, 30, 1.0), (1, 40, 1.0)], "query_id long, articulo_id long, score double")
    links = spark.createDataFrame(
        [(10, 7, "define_termino", 2025, True), (20, 7, "modifica", 1990, False), (30, 8, "define_termino", 1990, False)],
        "articulo_id long, concepto_id long, kind string, anio int, base boolean")
    asked = spark.createDataFrame([(1, 7, True), (1, 8, False)], "query_id long, concepto_id long, by_alias boolean")
    got = {r["articulo_id"]: r["score"] for r in boosting.graph_boost(pool, links, asked).collect()}
    assert got == {10: 12.2, 20: 1.5, 30: 1.0, 40: 1.0}
    plain = {r["articulo_id"]: r["score"] for r in boosting.graph_boost(pool, links, asked, alias_aware=False).collect()}
    assert plain == {10: 2.0, 20: 1.5, 30: 2.0, 40: 1.0}


def test_injection(spark):
    pool = spark.createDataFrame(
        [(q, n, "1", 1.0 / r, r) for q in (1, 2, 3, 4) for r, n in enumerate(("A", "B", "C"), 1)],
        "query_id long, id_norma string, numero string, score double, rank int")
    curated = spark.createDataFrame(
        [(1, "B", "1", "texto", True), (2, "C", "1", "texto", False), (3, "Z", "9", "texto", False), (4, "K", "2", "", True)],
        "query_id long, id_norma string, numero string, definicion string, by_alias boolean")
    known = spark.createDataFrame([("A", "1"), ("B", "1"), ("C", "1"), ("K", "2")], "id_norma string, numero string")
    out = boosting.inject(pool, curated, known, 3).orderBy("query_id", "rank").collect()
    listed = {q: [(r["id_norma"], r["forma"]) for r in out if r["query_id"] == q] for q in (1, 2, 3, 4)}
    assert listed[1][0] == ("B", "alias") and len(listed[1]) == 3
    assert listed[2] == [("C", "articulo"), ("A", "recuperado"), ("B", "recuperado")]
    assert listed[3] == [("A", "recuperado"), ("B", "recuperado"), ("C", "recuperado")]
    assert listed[4][0] == ("K", "articulo")
    focused = boosting.inject(pool, curated, known, 3, focused=True).where("query_id = 2 and rank = 1").collect()[0]
    assert focused["forma"] == "definicion" and focused["score"] == 9999.0


def test_workers_count_tokens_in_runs():
    lists = [["a"] * 3, [], ["b"] * 9, ["c"] * 2, ["d"] * 2, []]
    batch = pa.RecordBatch.from_arrays([pa.array(range(6)), pa.array(lists, pa.list_(pa.string()))], ["doc_id", "tokens"])
    cut = list(postings.runs(iter([batch, batch.slice(2), batch.slice(0, 0)]), "tokens", 4))
    assert [r.column("doc_id").to_pylist() for r in cut] == [[0, 1], [2], [3, 4, 5], [2], [3, 4, 5]]
    assert [r.column("tokens").to_pylist() for r in cut[:3]] == [lists[:2], lists[2:3], lists[3:]]


def test_tasks_that_score_follow_questions_and_documents(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "uno dos tres") for i in range(60)], "doc_id long, text string")
    asked = spark.createDataFrame([(q, ["uno", "dos"]) for q in range(20)], "query_id long, tokens array<string>")
    before = rows(lexical.bm25_topk(docs, asked, 3))
    monkeypatch.setattr(postings, "TASK_PAIRS", 100)
    index = postings.Index.of(docs)
    assert index.holding(lexical.question_terms(asked), "tf").rdd.getNumPartitions() == 12
    assert rows(lexical.bm25_topk(index, asked, 3)) == before


def test_equal_scores_are_cut_in_the_batch():
    ids, vectors = np.random.default_rng(1).permutation(500), np.ones((500, 2)) / np.sqrt(2)
    got = dense._best(pd.Series(ids), vectors, [1, 2], np.eye(2), 7)
    assert sorted(zip(got.query_id, got.id)) == [(q, i) for q in (1, 2) for i in range(7)]
    with_null = dense._best(pd.Series([5.0, 3.0, None, 4.0]), vectors[:4], [1], np.eye(2)[:1], 2)
    assert sorted(map(str, with_null.id)) == ["3.0", "nan"]


def test_title_scores_follow_questions_and_documents(spark, monkeypatch):
    docs = spark.createDataFrame([(i % 25, "ley de peaje" if i % 2 else "decreto de ley") for i in range(30)] + [(None, "ley")], "doc_id long, text string")
    asked = spark.createDataFrame([(q, ["ley", "de", "no"]) for q in range(10)], "query_id long, tokens array<string>")
    before = rows(lexical.saturated_scores(lexical.substring_hits(docs, asked)).fillna(-1))
    monkeypatch.setattr(lexical, "TASK_PAIRS", 20)
    scored = lexical.saturated_scores(lexical.substring_hits(docs, asked))
    assert rows(scored.fillna(-1)) == before and len(before) == 260
    assert scored.rdd.getNumPartitions() == 16


def test_phrases_are_counted_in_tasks_of_so_many_texts(spark, monkeypatch):
    texts = spark.createDataFrame([(i % 30 if i else None, "La Comisión Nacional y la Comisión Nacional.") for i in range(40)], "id long, texto string")
    known = spark.createDataFrame([("nada",)], "nombre string")
    monkeypatch.setattr(extraction, "TASK_TEXTS", 3)
    got = extraction.frequent_phrases(texts, "id", known)
    assert rows(got) == [("Comisión Nacional", 40, 31)]
    assert "hashpartitioning(id" in (plan := got._jdf.queryExecution().executedPlan().toString()) and ", 14), REPARTITION_BY_NUM" in plan


def test_a_blend_works_out_its_pairs_once(spark):
    """Bounds and blend each worked out the vectors' cosines, with the lengths of both anew for every pair."""
    from lexmesh.plans.retrieval import by_strategy

    routed = spark.createDataFrame([(1, [1.0, 0.0], "hybrid"), (2, [0.0, 1.0], "keywords"), (3, [3.0, 4.0], "embeddings"), (4, [0.0, 0.0], "hybrid")], "query_id long, qvec array<double>, route string")
    words = spark.createDataFrame([(1, 1, 1.0), (1, 2, 0.5), (1, 3, 0.0), (2, 1, 0.2), (4, 1, 0.7)], "query_id long, doc_id long, score double")
    vectors = spark.createDataFrame([(1, [0.0, 2.0]), (2, [3.0, 4.0]), (3, [5.0, 0.0])], "doc_id long, vec array<double>")
    found = by_strategy(routed, words, vectors, 2)
    assert "zip_with" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert sorted((r.query_id, r.doc_id, r.score, r["rank"], r.route) for r in found.collect()) == [
        (1, 2, 0.57, 2, "hybrid"), (1, 3, 0.7, 1, "hybrid"), (2, 1, 0.2, 1, "keywords"), (3, 1, 0.8, 2, "embeddings"), (3, 2, 1.0, 1, "embeddings"), (4, 1, 0.0, 1, "hybrid")]
