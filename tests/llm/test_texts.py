"""Language, quality, scoring and decontamination against brute force or held-out rows."""

import math
import re
from collections import Counter

import numpy as np
import pytest

from lexmesh.llm import brown, decontaminate, gru, language, queries, rules


def test_gradients_equal_differences():
    rng = np.random.default_rng(0)
    net = gru.Network.fresh(3, 2)
    for part in net.parts:
        part += rng.standard_normal(part.shape).astype(np.float32) * 0.1
    codes, classes, weight = rng.integers(0, 5, (6, 4)), np.array([0, 1, 1, 0]), np.ones((6, 4), np.float32)
    _, slopes = gru._gradients(net, codes, classes, weight)
    for part, slope in zip(net.parts, slopes):
        for _ in range(6):
            at = tuple(rng.integers(0, n) for n in part.shape)
            if part is net.table:
                at = (at[0], int(codes[0, 0]), at[2])
            kept = part[at]
            part[at] = kept + 1e-2
            up, _ = gru._gradients(net, codes, classes, weight)
            part[at] = kept - 1e-2
            down, _ = gru._gradients(net, codes, classes, weight)
            part[at] = kept
            assert slope[at] == pytest.approx((up - down) / 2e-2, abs=2e-3)


def test_runs_hold_every_byte():
    texts = [b"", b"a" * 64, b"b" * 65, b"c"]
    codes, lengths, text = gru.runs(texts)
    assert [b"".join(bytes(codes[i, :lengths[i]]) for i in np.flatnonzero(text == k)) for k in range(4)] == texts


def test_language_of_odd_rows(spark, odd):
    rows = [(i, ("the cat and the dog " if i % 2 else "der Hund und die Katze ") * 5, "en" if i % 2 else "de") for i in range(40)]
    rows += [(50, None, "fr"), (51, "x", None)]
    model = language.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), rounds=60)
    assert model.languages == ["de", "en"]
    got = language.identify(odd, model).collect()
    assert len(got) == odd.count() and all(0 <= r.score <= 1 for r in got)
    by_id = {r.doc_id: r for r in got}
    assert [by_id[i].lang_pred for i in (0, 1, 2, 3, 12)] == ["und"] * 5 and by_id[4].lang_pred == "en"
    kept = language.keep(odd, model)
    assert kept.columns == odd.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(r.doc_id) for r in got if r.score >= 0.5)
    nothing = language.fit(odd.limit(0).withColumnRenamed("score", "lang"))
    assert {r.lang_pred for r in language.identify(odd, nothing).collect()} == {"und"}
    assert language.identify(odd.limit(0), model).count() == 0


def test_language_is_right_on_held_out_rows(spark, data):
    got = queries.op9_language(spark, data).where("held_out").select("doc_id", "lang_pred")
    both = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "lang").join(got, "doc_id").collect()
    assert len(both) > 20 and sum(r.lang == r.lang_pred for r in both) >= 0.9 * len(both)


def test_rules_compiled_to_columns_score_as_the_fit_does(spark, odd):
    rng = np.random.default_rng(1)
    values = rng.random((600, len(rules.NAMES)))
    labels = ((values[:, 0] > 0.5) & (values[:, 3] <= 0.7)).astype(float)
    model = rules.fit(values, labels)
    table = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(values)], ["key", *("_stat_" + n for n in rules.NAMES)])
    got = [r.score for r in rules.scored(table, model).orderBy("key").collect()]
    odds = np.full(len(values), model.bias)
    for rule in model.rules:
        holds = np.ones(len(values), bool)
        for name, above, at in rule.terms:
            holds &= (values[:, rules.NAMES.index(name)] > at) == above
        odds += rule.weight * holds
    assert np.allclose(got, 1 / (1 + np.exp(-odds)))
    assert np.mean((np.array(got) >= 0.5) == labels) > 0.97
    assert rules.fit(values, np.ones(600)).rules == [] and rules.fit(values[:0], labels[:0]).bias == 0.0
    one = rules.Ensemble(0.0, [rules.Rule((("words", True, 3.0),), 2.0)])
    assert rules.scored(rules.with_statistics(odd), one).count() == odd.count()
    kept = rules.keep(odd, rules.Ensemble(-1.0, one.rules))
    assert kept.columns == odd.columns and kept.count() == sum(len(re.split("[ \t\n\v\f\r]+", r.text or "")) > 3 for r in odd.collect())
    assert rules.scored(rules.with_statistics(odd.limit(0)), one).count() == 0


def test_quality_is_right_on_held_out_rows(spark, data):
    got = queries.op4_quality_rules(spark, data).where("held_out")
    both = spark.read.parquet(f"{data}/labels.parquet").join(got, "doc_id").collect()
    good, bad = [r.score for r in both if r.quality], [r.score for r in both if not r.quality]
    assert np.mean([g > b for g in good for b in bad]) > 0.9


def test_brown_scores_of_odd_rows(odd):
    training = odd.where("doc_id is null or doc_id % 4 != 2")
    got = sorted(brown.scores(odd, training).collect(), key=lambda r: (str(r.doc_id), r.n_tokens))
    count = Counter(w for r in training.collect() for w in [*(r.text or "").encode().lower().split(), b""])
    total, distinct = sum(count.values()), len(count)
    rows = sorted(odd.collect(), key=lambda r: (str(r.doc_id), len((r.text or "").encode().split()) + 1))
    for r, g in zip(rows, got):
        words = [*(r.text or "").encode().lower().split(), b""]
        base = sum(math.log10((count[w] + 1) / (total + distinct + 1)) for w in words)
        assert (g.n_tokens, g.n_known, g.train_tokens) == (len(words), sum(count[w] > 0 for w in words), total)
        assert g.base_score == pytest.approx(base) and g.score < 0
    assert brown.scores(odd.limit(0), training).count() == 0
    untaught = brown.scores(odd, training.limit(0)).collect()
    assert len(untaught) == len(rows) and all(r.score == 0 and r.base_score == 0 and r.n_known == 0 for r in untaught)


def test_brown_chances_sum_to_one(odd):
    words = brown.vocabulary(odd).cache()
    model = brown.fit(odd, words)
    emission = Counter()
    for r in words.collect():
        if r.word and bytes(r.word) not in model.known:  # too long to be sent
            emission[model.first_shape + r["shape"]] += (r.n + 1) / 10 ** model.tail[r["shape"]]
            continue
        kind, chance, _ = model.known.get(bytes(r.word), (len(model.steps) - 1, 0.0, 0.0))
        emission[kind] += 10 ** chance
    for s in range(brown.SHAPES):  # one more word of each shape, never seen
        emission[model.first_shape + s] += 10 ** -model.tail[s]
    assert all(v == pytest.approx(1) for v in emission.values())
    assert np.allclose((10 ** model.steps).sum(axis=1), 1)


def test_brown_scores_equal_a_slow_scorer(spark, data, monkeypatch):
    """Few words form classes, more are sent, the rest is looked up; scores are added up word by word from plain counts."""
    monkeypatch.setattr(brown, "CLASSED", 60)
    monkeypatch.setattr(brown, "SHIPPED", 400)
    documents = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").where("doc_id < 60")
    texts = {r.doc_id: (r.text or "").encode().lower().split() for r in documents.collect()}
    words = brown.vocabulary(documents).cache()
    model = brown.fit(documents, words)
    count = Counter(w for t in texts.values() for w in t)
    taught = sorted(count, key=lambda w: -count[w])[60:300]
    assert sum(w in model.known and model.known[w][0] < model.first_shape for w in taught) > 100  # by gain, not by shape
    of = lambda w: model.known[w][0] if w in model.known else model.first_shape + brown.shape(w)
    end, size = len(model.steps) - 1, len(model.steps)
    members, grid = Counter(), np.zeros((size, size))
    for w, n in count.items():
        members[of(w)] += n
    for t in texts.values():
        path = [end, *map(of, t), end]
        for a, b in zip(path, path[1:]):
            grid[a, b] += 1
    plain = (grid.sum(axis=0) + 1) / (grid.sum() + size)
    steps = (grid + 20 * plain) / (grid.sum(axis=1, keepdims=True) + 20)
    kinds = Counter(of(w) for w in count)
    for r in brown.scores(documents, documents).collect():
        path, want = [end, *map(of, texts[r.doc_id]), end], 0.0
        for a, b in zip(path, path[1:]):
            want += math.log10(steps[a, b])
        for w in texts[r.doc_id]:
            k = of(w)
            want += math.log10(count[w] / members[k] if k < model.first_shape else (count[w] + 1) / (members[k] + kinds[k] + 1))
        assert r.score == pytest.approx(want)


def test_frequent_words_are_never_none(spark):
    words = spark.createDataFrame([(f"w{i}".encode(), 0, 1) for i in range(300)], "word binary, shape int, n long")
    assert 50 <= len(brown.frequent(words, 100)) <= 100 and len(brown.frequent(words, 300)) == 300


def test_exchange_never_lowers_the_likelihood():
    rng = np.random.default_rng(0)
    topic = rng.integers(0, 3, 30)
    counts = rng.poisson(20 * (topic[:, None] == topic[None, :]) + 0.5).astype(float)

    def likelihood(own):
        member = np.zeros((30, own.max() + 1))
        member[np.arange(30), own] = 1
        grid = member.T @ counts @ member
        return brown._f(grid).sum() - brown._f(grid.sum(axis=0)).sum() - brown._f(grid.sum(axis=1)).sum()

    start, end = np.arange(30) % 3, brown.exchange(counts, 30, 3)
    assert likelihood(end) > likelihood(start)
    assert len({(a, b) for a, b in zip(topic, end)}) == 3


def edited(item, words):
    """Edits between the item and the best stretch of the words, by the textbook recurrence."""
    row = [0] * (len(words) + 1)
    for i, a in enumerate(item, 1):
        row = _next(row, i, a, words)
    return min(row)


def _next(row, i, a, words):
    out = [i]
    for j, b in enumerate(words, 1):
        out.append(min(row[j] + 1, out[-1] + 1, row[j - 1] + (a != b)))
    return out


def test_leaks_equal_brute_force(spark, odd):
    rng = np.random.default_rng(6)
    vocabulary = [f"w{i}" for i in range(40)]
    items = [(i, " ".join(rng.choice(vocabulary, n))) for i, n in enumerate((1, 3, 8, 14, 30, 60))] + [(90, None), (91, ""), (4, None)]
    texts = []
    for i in range(60):
        words = list(rng.choice(vocabulary, 30))
        item = (items[2 + i % 4][1]).split()
        for _ in range(i % 6):
            at = int(rng.integers(0, len(item)))
            item[at:at + 1] = [["new"], [], [item[at], "more"]][int(rng.integers(0, 3))]
        at = int(rng.integers(0, 30))
        texts.append(" ".join([*words[:at], *item, *words[at:]]).upper() if i % 2 else ", ".join([*words[:at], *item, *words[at:]]))
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    documents = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] + [(100, None, "x"), (101, "", "x"), (None, texts[0], "x")], "doc_id long, text string, item_id string")
    want = set()
    for i, t in enumerate(texts):
        words = t.lower().replace(",", "").split()
        for k, text in items[:6]:
            item = text.split()
            if edited(item, words) <= int(0.2 * len(item) + 1e-9):
                want.add((i, k))
    rows = decontaminate.leaks(documents, benchmark).collect()
    got = {(r.doc_id, r.item_id) for r in rows if r.doc_id is not None}
    assert got <= want and len(got) >= 0.98 * len(want)
    assert {r.item_id for r in rows if r.doc_id is None} == {r.item_id for r in rows if r.doc_id == 0}
    clean = decontaminate.keep(documents, benchmark)
    assert clean.columns == documents.columns and {r.doc_id for r in clean.collect()} == {*range(60), 100, 101} - {d for d, _ in got}
    assert decontaminate.leaks(documents.limit(0), benchmark).count() == 0 and decontaminate.leaks(documents, benchmark.limit(0)).count() == 0
    assert decontaminate.leaks(odd, benchmark).count() >= 0


def test_copies_with_all_edits_are_found_at_every_length():
    """Other words and edits than those by which the repetitions are found."""
    rng = np.random.default_rng(11)
    for size in (12, 13, 15, 16, 17, 20, 25, 30, 45):
        items, texts = [], []
        for i in range(200):
            words = [f"w{x}" for x in rng.integers(0, 1 << 40, size)]
            items.append((i, " ".join(words)))
            for _ in range(int(0.2 * size)):
                at = int(rng.integers(0, len(words)))
                words[at:at + 1] = [["new"], [], [words[at], "more"]][int(rng.integers(0, 3))]
            texts.append(" ".join(["before"] * 9 + words + ["after"] * 9))
        found = {(t, n) for t, n, *_ in decontaminate.matches(decontaminate.Items.of(items), texts, 0.8)}
        assert found == {(i, i) for i, _ in found} and len(found) >= 0.98 * len(items), (size, len(found))


def test_word_hashes_do_not_depend_on_what_is_around(monkeypatch):
    text = "Ab cd " + "x" * 5000 + " cd, ab é1 " + "y" * 90
    whole, counts = decontaminate.symbols([text, None, "", "ab"])
    assert counts.tolist() == [7, 0, 0, 1] and whole[0] == whole[4] == whole[7] and whole[1] == whole[3] and len(set(whole.tolist())) == 5
    monkeypatch.setattr(decontaminate, "_SPAN", 64)  # most words alone, one longer than a stretch
    decontaminate.held("other", dict)
    again, _ = decontaminate.symbols([text, None, "", "ab"])
    assert (again == whole).all()
    decontaminate.held("other", dict)
