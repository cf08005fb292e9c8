"""Links and components against brute force."""

import numpy as np
import pandas as pd

from lexmesh.llm import anchors, neighbours, simhash
from lexmesh.llm.components import components


def roots_of(n, pairs):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(int(a)), find(int(b))
        parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_components_of_chains_hubs_and_loops(spark):
    pairs = [(i, i + 1) for i in range(1, 60)] + [(100, i) for i in range(101, 400)] + [(500, 500), (3, 100), (600, 601), (601, 600)]
    got = {r.u: r.root for r in components(spark.createDataFrame(pairs, "u long, v long")).collect()}
    want = roots_of(602, pairs)
    assert {i: r for i, r in enumerate(want) if r != i} == got
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_anchors_cover_every_word():
    words = np.random.default_rng(2).integers(0, 1 << 32, 3000).astype(np.uint32)
    row, anchor, home = anchors.around(words)
    assert home.sum() == len(words)
    assert np.bitwise_count(anchor[home] ^ words[row[home]]).max() <= 4
    flipped = words ^ (np.uint32(1) << np.random.default_rng(3).integers(0, 32, len(words)).astype(np.uint32))
    there = {(int(r), int(a)) for r, a in zip(*anchors.around(flipped)[:2])}
    assert all((int(r), int(a)) in there for r, a, h in zip(row, anchor, home) if h)


def test_links_join_what_brute_force_joins(spark):
    rng = np.random.default_rng(1)

    def flipped(x, k):
        for p in rng.choice(64, k, replace=False):
            x ^= np.uint64(1) << np.uint64(p)
        return x

    base = rng.integers(0, 1 << 63, 60, dtype=np.uint64)
    prints = [*base, *(flipped(b, rng.integers(1, 7)) for b in base for _ in range(3)), *(flipped(base[0], rng.integers(1, 5)) for _ in range(1500))]
    prints = np.unique(np.array(prints, np.uint64))
    found = anchors.links(spark.createDataFrame(pd.DataFrame({"node": np.arange(len(prints)), "print": prints.view(np.int64)}))).toPandas()
    near = np.argwhere(np.bitwise_count(prints[:, None] ^ prints[None, :]) <= 3)
    assert (np.bitwise_count(prints[found.u] ^ prints[found.v]) <= 3).all()
    assert roots_of(len(prints), near) == roots_of(len(prints), found[["u", "v"]].to_numpy())


def slow_fingerprint(text):
    import xxhash

    words = bytes((text or "").encode()).lower().split()
    shingles = [b" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_near_duplicates_on_odd_rows(spark, odd):
    rows = odd.collect()
    prints = [slow_fingerprint(r.text) for r in rows]
    pairs = [(i, j) for i, a in enumerate(prints) for j, b in enumerate(prints) if (a ^ b).bit_count() <= 3]
    group = roots_of(len(rows), pairs)
    want = sorted((str(r.doc_id), f"{p:016x}", str(min((q.doc_id for q, g in zip(rows, group) if g == mine and q.doc_id is not None), default=None)))
                  for r, p, mine in zip(rows, prints, group))
    got = sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in simhash.near_duplicates(odd).collect())
    assert got == want
    assert simhash.near_duplicates(odd.limit(0)).count() == 0


def test_fingerprints_hash_as_spark_does(spark):
    text = "one two three"
    assert simhash.fingerprint(text.encode()) == spark.sql(f"select xxhash64('{text}') h").first().h % (1 << 64)
    assert simhash.fingerprint(b"A  b\x0bC") == simhash.fingerprint(b"a b c") and simhash.fingerprint(None) == simhash.fingerprint(b" \n") == 0


def test_linked_vectors_equal_brute_force(spark):
    rng = np.random.default_rng(4)
    vectors = rng.standard_normal((300, 16))
    for centre, count, spread in ((0, 40, 0.03), (1, 12, 0.05), (2, 2, 0.07)):
        vectors = np.vstack([vectors, vectors[centre] + spread * rng.standard_normal((count, 16))])
    rows = [(i, [float(x) for x in np.float32(v)], "x", 1.0) for i, v in enumerate(vectors)]
    n = len(rows)
    rows += [(n, rows[5][1], "x", 1.0), (n + 1, [2 * x for x in rows[5][1]], "x", 1.0)]  # a copy, and one twice as long
    rows += [(n + 2, None, "x", 1.0), (n + 3, [0.0] * 16, "x", 1.0), (n + 4, [float("nan")] * 16, "x", 1.0), (n + 5, [1.0, None], "x", 1.0),
             (n + 6, [], "x", 1.0), (n + 7, [1.0, 2.0], "x", 1.0), (n + 8, [2.0, 4.0], "x", 1.0), (None, rows[5][1], "x", 1.0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, unit string, links double")
    unit = np.array([r[1] for r in rows[:n + 2]], np.float64)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    near = unit @ unit.T >= 0.95
    links = near.sum(axis=1) - 1
    root = roots_of(n + 2, np.argwhere(near))
    got = {r.vec_id: r for r in neighbours.linked(df).collect()}
    assert [got[i].n_links for i in range(n + 2)] == links.tolist()
    assert [got[i].component_id for i in range(n + 2)] == root
    assert all(got[i].kept == (got[i].component_id == i) for i in range(n + 2))
    assert [(got[n + k].n_links, got[n + k].component_id) for k in range(2, 9)] == [*((0, n + k) for k in range(2, 7)), (1, n + 7), (1, n + 7)]
    assert got[None].n_links == 0 and got[None].component_id is None
    assert neighbours.linked(df.limit(0)).count() == 0


def test_links_between_tight_groups_are_kept(spark):
    """Two groups whose vectors have a full list of nearer ones in their own group, and are linked with the other too."""
    rng = np.random.default_rng(8)
    a, b = np.linalg.qr(rng.standard_normal((32, 2)))[0].T
    vectors = np.vstack([rng.standard_normal((6000, 32))] + [c + 0.003 * rng.standard_normal((40, 32)) for c in (a, 0.96 * a + 0.28 * b)])
    unit = np.float32(vectors).astype(np.float64)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    near = unit @ unit.T >= 0.95
    assert near[6000:6040, 6040:].all() and (unit[6000:6040] @ unit[6000:6040].T).min() > (unit[6000:6040] @ unit[6040:].T).max()
    df = spark.createDataFrame([(i, [float(x) for x in np.float32(v)]) for i, v in enumerate(vectors)], "vec_id long, embedding array<float>")
    for passes in (3, 0):  # without a pass all vectors are compared
        got = {r.vec_id: r for r in neighbours.linked(df, passes=passes).collect()}
        assert [got[i].n_links for i in range(len(vectors))] == (near.sum(axis=1) - 1).tolist()
        assert [got[i].component_id for i in range(len(vectors))] == roots_of(len(vectors), np.argwhere(near))


def test_pairs_of_a_block_hold_together_what_they_join():
    rng = np.random.default_rng(9)
    centres = rng.standard_normal((6, 8))
    m = np.float32(np.vstack([centres[i % 6] + 0.12 * rng.standard_normal(8) for i in range(120)]))
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    want = roots_of(120, np.argwhere(m @ m.T >= 0.95))
    for floor in (None, np.full(120, 0.999, np.float32)):
        src, dst, sim = neighbours._nearest(np.arange(120), m, 3, floor, 8, 0.95)
        kept = sim >= 0.95
        assert roots_of(120, zip(src[kept], dst[kept])) == want and len(src) < 120 * 12


def test_large_blocks_lose_no_pairs(spark):
    """Links between distant ids in a cone that falls into one block; what is not split is compared whole."""
    rng = np.random.default_rng(10)
    m = rng.standard_normal(32) + 0.6 * rng.standard_normal((3000, 32))
    m[1500:] = m[:1500] + 0.16 * rng.standard_normal((1500, 32))
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    m = np.float32(m)
    want = {(i, i + 1500) for i in range(1500) if m[i] @ m[i + 1500] >= 0.95}
    dealt = spark.createDataFrame([(0, i, bytearray(v.tobytes())) for i, v in enumerate(m)], "block long, node long, unit binary")
    found = []
    for seed, splits in ((0, 12), (1, 12), (0, 0)):
        blocks = {}
        for r in neighbours._fitted(dealt, seed, splits).collect():
            blocks.setdefault(r.block, set()).add(r.node)
        assert set.union(*blocks.values()) == set(range(3000)) and max(map(len, blocks.values())) <= (512 if splits else 2048)
        found.append({p for p in want for b in blocks.values() if b.issuperset(p)})
    assert len(want) > 1000 and len(found[0]) > len(want) / 2 and len(found[0] | found[1]) > len(found[0]) and found[2] == want
