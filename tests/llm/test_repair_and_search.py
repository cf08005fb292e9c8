"""Conversation repair, bag search and weak supervision against plain versions of the same."""

import hashlib
import heapq
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from lexmesh.llm import bag_search, common, lr_repair, queries, weak_rules

SPACE = " \t\n\x0b\x0c\r"


def plain_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind == 1:
            text = ""
        if kind == 2:
            text = re.sub("[.!?]", "", text)
        if kind == 4:
            role = "user"
        out += [(conv, turn, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return out


def plain_repair(rows):
    """Cheapest edits by Dijkstra's search over a deterministic automaton of the roles."""
    order = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2], hashlib.sha256(r[3].encode()).hexdigest()))
    seen, faults = set(), []
    for _, _, role, text in order:
        bare = text.strip(SPACE)
        fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None
        seen.add((role, text))
        faults.append(fault)
    step = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("a", "u"): "u", ("u", "a"): "a"}
    heap, done = [(0, "", 0, "", ())], set()
    while True:
        cost, audit, at, state, out = heapq.heappop(heap)
        if at == len(order) and state in ("", "a"):
            break
        if (at, state) in done:
            continue
        done.add((at, state))
        for role, name in (("u", "user"), ("a", "assistant")):
            if (state, role) in step:
                heapq.heappush(heap, (cost + 3, audit + "I", at, step[state, role], out + ((name, ""),)))
        if at < len(order):
            _, _, role, text = order[at]
            heapq.heappush(heap, (cost + 4, audit + "D", at + 1, state, out))
            if faults[at] not in ("blank", "duplicate"):
                more = 3 * (faults[at] == "truncated")
                if (state, role[:1]) in step:
                    heapq.heappush(heap, (cost + more, audit + "K", at + 1, step[state, role[:1]], out + ((role, text),)))
                for initial, name in (("u", "user"), ("a", "assistant")):
                    if (state, initial) in step:
                        heapq.heappush(heap, (cost + 3 + more, audit + "R", at + 1, step[state, initial], out + ((name, text),)))
    turns = [r[1] for r in order if r[1] is not None]
    illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(order, order[1:]))
    count = Counter(faults)
    return (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, count["blank"], count["duplicate"], count["truncated"], illegal, cost, audit,
            hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest())


def plain_report(rows):
    after = plain_damage(rows)
    return {conv: plain_repair([r for r in after if r[0] == conv]) for conv in {r[0] for r in rows}}


NAMES = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def conversations(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, audit string, step int")


def test_repair_equals_dijkstra_on_odd_conversations(spark):
    rng = np.random.default_rng(3)
    roles, texts = ["user", "assistant", "system", "tool", "", None, "ux"], ["Hi.", "no end", "", " \t", None, "Yes!", "é。", "x" * 20_000 + "?", "a\x0b"]
    rows = [(int(rng.integers(0, 90)), None if rng.random() < 0.1 else int(rng.integers(0, 12)), roles[int(rng.integers(0, 7))], texts[int(rng.integers(0, 9))])
            for _ in range(700)]
    rows += [(None, i, "user" if i % 2 else "system", "Hello.") for i in range(5)] + [(500, None, None, None)]
    rows += [(600 + i, t, r, "Well.") for i in range(60) for t, r in enumerate(rng.choice(["user", "assistant", "system"], 7))]
    table = conversations(spark, rows)
    got = {r.conv_id: tuple(r[n] for n in NAMES) for r in lr_repair.report(table, lr_repair.damaged(table)).collect()}
    assert got == plain_report(rows)


def test_repair_of_the_given_conversations(spark, data):
    rows = [tuple(r) for r in common.read(spark, data, "conversations", "conv_id", "turn", "role", "text").collect()]
    got = {r.conv_id: tuple(r[n] for n in NAMES) for r in queries.op11_lr_repair(spark, data).collect()}
    assert got == plain_report(rows)


def test_repair_of_a_very_long_conversation_and_of_none(spark):
    rows = [(1, i, ("user", "user", "assistant")[i % 3], f"Turn {i}.") for i in range(3000)]
    _, repaired = lr_repair.repair(conversations(spark, rows))
    out = [r.role for r in repaired.where("role is not null").orderBy("step").collect()]
    assert len(out) == 2 * (len(out) // 2) and out == ["user", "assistant"] * (len(out) // 2)
    ends = lr_repair.digests(repaired).collect()
    assert [(r.cost, len(r.audit)) for r in ends] == [(3000, 4000)]
    table = conversations(spark, rows[:0])
    assert lr_repair.report(table, lr_repair.damaged(table)).count() == 0 and lr_repair.repair(table)[1].count() == 0
    gone = lr_repair.report(conversations(spark, rows[:3]), conversations(spark, rows[:0])).collect()
    assert [tuple(r) for r in gone] == [(1, 0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())]


def test_settled_edits_do_not_change_the_result():
    rng = np.random.default_rng(8)
    for size in (5, 60, 400, 1000):
        rows = [(("u", "a", "s")[int(x)], (None, None, "truncated", "blank")[int(y)]) for x, y in zip(rng.integers(0, 3, size), rng.integers(0, 4, size))]
        found = []
        for settle in (1, 7, 10 ** 9):
            parser, audit = lr_repair.Parser(lr_repair.Stack(lr_repair.automaton())), ""
            for n, row in enumerate(rows, 1):
                audit += parser.row(*row)[0]
                if n % settle == 0:
                    audit += parser._settled()[0]
            found.append(audit + parser.end()[0])
        assert len(set(found)) == 1


def test_a_grammar_with_a_conflict_is_refused():
    with pytest.raises(ValueError):
        lr_repair.automaton((("e", ("e", "e")), ("e", ("u",))))


def plain_ranks(documents, benchmark, k=20):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = lambda t: re.findall("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", (t or "").translate(lower))
    held = [(d, Counter(words(t)), len(words(t))) for d, t in documents]
    held = [h for h in held if h[2]]
    n, length, df = len(held), sum(h[2] for h in held), Counter(w for h in held for w in h[1])
    out = []
    for item, text in benchmark:
        found = []
        for doc, tf, size in held:
            m = 75 + (25 * size * n) // length
            score = sum(math.floor(1000 * math.log((2.0 * n + 2) / (2 * df[w] + 1))) * ((10 ** 9 * tf[w]) // (1000 * tf[w] + 12 * m)) for w in words(text) if tf[w])
            if score > 0:
                found.append((-score, doc is not None, doc or 0, doc))
        out += [(item, rank, f[3], -f[0]) for rank, f in enumerate(sorted(found)[:k], 1)]
    return sorted(out, key=str)


def test_ranks_equal_brute_force(spark, odd):
    rng = np.random.default_rng(2)
    vocabulary = ["alpha", "Béta", "gamma9", "delta", "中文", "Ünit", "x", "y", "z", "common"]
    documents = [(i, " ".join(rng.choice(vocabulary, int(rng.integers(0, 12)))) + " common, common!") for i in range(300)]
    documents += [(1000 + i, "alpha gamma9 copy") for i in range(60)] + [(5000, "w " * 30_000 + "alpha")] + [(r.doc_id, r.text) for r in odd.where("doc_id is null or doc_id > 9").collect()]
    benchmark = [(i, " ".join(rng.choice(vocabulary, 4)) + (" unseen" if i % 2 else "")) for i in range(25)] + [(90, None), (91, ""), (92, "the the alpha, CAT"), (93, "absent")]
    docs = spark.createDataFrame([(d, t, 1.0, "x") for d, t in documents], "doc_id long, text string, score double, item string")
    items = spark.createDataFrame(benchmark + benchmark[:2], "item_id long, text string")
    want = plain_ranks(documents, benchmark)
    for block in (8 << 20, 200):  # one block of items, and many
        got = [tuple(r) for r in bag_search.ranked(docs, items, block=block).collect()]
        assert sorted(got, key=str) == want
    assert bag_search.ranked(docs.limit(0), items).count() == 0 and bag_search.ranked(docs, items.limit(0)).count() == 0
    assert bag_search.ranked(odd, items).where("score <= 0").count() == 0


def test_copies_are_scored_once(spark):
    docs = spark.createDataFrame([(i, "alpha beta" if i % 3 else "alpha") for i in range(600)], "doc_id long, text string")
    items = bag_search.Items.of([(1, "alpha beta")])
    held = bag_search.bags(docs, items).selectExpr("*", "100L AS m")
    found = bag_search.classes(held, 20).collect()
    assert sorted(len(r["keys"]) for r in found) == [20, 20] and {tuple(r["keys"])[0] for r in found} == {0, 1}


def plain_counts(text):
    words = [w for w in re.split(f"[{SPACE}]+", text or "") if w]
    windows = Counter(tuple(words[i:i + 3]) for i in range(len(words) - 2))
    covered = {j for i in range(len(words) - 2) if windows[tuple(words[i:i + 3])] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in (text or "").split("\n") if x.strip(SPACE)]
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered))


def test_counts_equal_brute_force(spark, odd):
    rng = np.random.default_rng(4)
    texts = [r.text for r in odd.collect()] + [" ".join(rng.choice(["a", "b", "$c", "|", "é#"], n)) for n in (1, 2, 3, 4, 10, 50, 300)]
    texts += ["one\ntwo\none\n\n \none ", "a b c a b c", "a a a", "x y z \x1c q", "b " * 40_000]
    table = spark.createDataFrame([(i, t, 1, "y") for i, t in enumerate(texts)], "doc_id long, text string, n_words int, votes string")
    got = {r.key: tuple(r[c] for c in weak_rules.COUNTS) for r in weak_rules.voted(weak_rules.counted(table)).collect()}
    assert got == {i: plain_counts(t) for i, t in enumerate(texts)}


def test_accuracies_equal_a_plain_expectation_maximisation():
    rng = np.random.default_rng(5)
    good = rng.random(4000) < 0.8
    right = np.where(good[:, None], rng.random((4000, 4)) < 0.95, rng.random((4000, 4)) < 0.6)
    votes = np.where(rng.random((4000, 4)) < 0.2, 0, np.where(right == good[:, None], 1, -1))
    model = weak_rules.estimate(sorted(Counter(map(tuple, votes.tolist())).items()), 4)
    chance = np.array([[k] * 4 for k in weak_rules._OPENING])
    prior = 0.85
    for _ in range(100):  # by document, not by pattern
        odds = np.log(prior / (1 - prior)) + sum(np.log(chance[1, k, votes[:, k] + 1] / chance[0, k, votes[:, k] + 1]) for k in range(4))
        p, before = 1 / (1 + np.exp(-odds)), prior
        prior = p.mean()
        for kind, w in ((1, p), (0, 1 - p)):
            for k in range(4):
                chance[kind, k] = np.bincount(votes[:, k] + 1, w, 3) + weak_rules._BELIEF * 4000 * np.array(weak_rules._OPENING[kind])
                chance[kind, k] /= chance[kind, k].sum()
        if abs(prior - before) < 1e-9:
            break
    assert model.prior == pytest.approx(prior) and np.allclose(model.chance, chance) and abs(model.prior - 0.8) < 0.1


def test_verdicts_of_odd_and_empty_tables(spark, odd):
    table = weak_rules.voted(weak_rules.counted(odd))
    model = weak_rules.learn(table)
    found = weak_rules.judged(table, model).collect()
    assert len(found) == odd.count() and all(0 <= r.posterior <= 1 for r in found)
    assert all(r.base_failed == (r.n_words < 50 or 2 * r.n_repeat_words > r.n_words) and not (r.base_failed and r.kept) for r in found)
    votes = {r.key: r.votes for r in table.where("key is not null").collect()}
    for r in found:
        if r.key is not None and r.key in votes:
            odds = math.log(model.prior / (1 - model.prior)) + sum(math.log(model.chance[1][k][v + 1] / model.chance[0][k][v + 1]) for k, v in enumerate(votes[r.key]))
            assert r.posterior == pytest.approx(1 / (1 + math.exp(-odds)))
    nothing = weak_rules.voted(weak_rules.counted(odd.limit(0)))
    assert weak_rules.judged(nothing, weak_rules.learn(nothing)).count() == 0


def test_verdicts_agree_with_labels_they_never_saw(spark, data):
    both = common.read(spark, data, "labels").join(queries.op13_weak_rules(spark, data), "doc_id").where("not base_failed").collect()
    assert len(both) > 20 and sum(bool(r.quality) == r.kept for r in both) >= 0.97 * len(both)
