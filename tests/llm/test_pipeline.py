"""Each stage of the pipeline against what its operator decides row by row, or brute force."""

import numpy as np
import pytest

import corpus_pipeline
from lexmesh.llm import decontaminate, language, rules, simhash
from lexmesh.session import written


@pytest.fixture(scope="module")
def kept(spark, data):
    """What goes into each stage, and what comes out of the last."""
    docs = [spark.read.parquet(f"{data}/documents.parquet")]
    for _, stage in corpus_pipeline.STAGES:
        docs.append(written(stage(spark, docs[-1], data)))
    return [d.toPandas() for d in docs]


def test_columns_stay_until_the_last_stage(kept):
    assert all(list(d.columns) == list(kept[0].columns) for d in kept[:-1])
    assert all(len(a) >= len(b) > 0 for a, b in zip(kept[:4], kept[1:5]))


def test_language_stage(spark, data, kept):
    documents = spark.read.parquet(f"{data}/documents.parquet")
    model = language.fit(documents.where("coalesce(crc32(cast(doc_id as string)) % 4 != 2, true)"))
    _, scores = language.predict(model, kept[0].text.tolist())
    assert set(kept[0].doc_id[scores >= corpus_pipeline.LEAST_LANGUAGE]) == set(kept[1].doc_id)


def test_quality_stage(spark, data, kept):
    labels = spark.read.parquet(f"{data}/labels.parquet")
    docs = spark.createDataFrame(kept[1])
    model = rules.learn(rules.with_statistics(docs.where("crc32(cast(doc_id as string)) % 3 != 1")), labels)
    scored = rules.scored(rules.with_statistics(docs), model).collect()
    assert {r.key for r in scored if r.score >= 0.5} == set(kept[2].doc_id)


def test_near_duplicate_stage(kept):
    prints = np.array([simhash.fingerprint((t or "").encode()) for t in kept[2].text], np.uint64)
    near = np.bitwise_count(prints[:, None] ^ prints[None, :]) <= 3
    group = np.arange(len(prints))
    for _ in range(len(prints)):
        least = np.where(near, group[None, :], len(prints)).min(axis=1)
        if (least == group).all():
            break
        group = least
    ids = kept[2].doc_id.to_numpy()
    assert {ids[group == g].min() for g in set(group)} == set(kept[3].doc_id)


def test_decontamination_stage(spark, data, kept):
    items = decontaminate.Items.of(spark.read.parquet(f"{data}/benchmark.parquet").select("item_id", "text").collect())
    found = {m[0] for m in decontaminate.matches(items, kept[3].text.tolist(), 0.8)}
    clean = [i for k, i in enumerate(kept[3].doc_id) if k not in found]
    assert set(clean) == set(kept[4].doc_id)
    passages = [str(t) for t in spark.read.parquet(f"{data}/benchmark.parquet").toPandas().text]
    assert not any(p in t for p in passages for t in kept[4].text)


def test_packing_stage(kept):
    pieces = kept[5]
    sizes = pieces.groupby("sequence_id").length.sum()
    assert (sizes.iloc[:-1] == 1024).all() and set(pieces.doc_id) == set(kept[4].doc_id)
    assert (pieces.groupby("doc_id").length.sum() == pieces.groupby("doc_id").doc_tokens.first()).all()


def test_odd_rows_pass_through(spark, data, odd):
    docs = odd.selectExpr("doc_id", "text", "'en' as lang", "source", "1L as n_chars", "score as _id", "'x' as gone", "key as rank")
    for name, stage in corpus_pipeline.STAGES[:4]:
        got = stage(spark, docs, data)
        assert got.columns == docs.columns, name
        got.count()
    once = corpus_pipeline.distinct(spark, docs, data).collect()
    assert len([r for r in once if r.doc_id == 4]) == 1 and not any(r.doc_id == 5 for r in once)
    assert len([r for r in once if r.doc_id is None]) == 2
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, data).count() == 0


def test_duplicates_are_decided_by_row(spark):
    rng = np.random.default_rng(1)
    a, b = (" ".join(f"w{x}" for x in rng.integers(0, 1000, 80)) for _ in range(2))
    rows = [(1, a, "x"), (1, b, "y"), (2, a, "z"), (3, b + " more", "u"), (3, None, "v"), (4, a, "w"), (4, a, "w"), (None, a, "n")]
    got = simhash.distinct(spark.createDataFrame(rows, "doc_id long, text string, _print string")).collect()
    assert sorted((r.doc_id or 0, r["_print"]) for r in got) == [(0, "n"), (1, "x"), (1, "y"), (3, "v")]
