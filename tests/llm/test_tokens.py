"""Token counts, coded ids and packing against the tokenizers library."""

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from lexmesh.llm import addressable, packing
from lexmesh.llm.piece_encoder import PieceEncoder
from lexmesh.llm.token_counts import MergeCounter, token_counts

ALPHABET = ["a", "b", " ", "  ", "\n", "\t", "'s", "'", "'ll", "É", "é", "ß", "İ", "1", "23", "²", "<|endoftext|>", "<|startoftext|>", "<|",
            "中", "😀", " ", "\u0085", "\x1c", "!", "...", "word", "Thing", "_", "-", "then,\nfoo", " end.\n"]


def library_ids(path, texts):
    return [e.ids for e in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]


def random_texts(count):
    rng = np.random.default_rng(3)
    return ["".join(rng.choice(ALPHABET, rng.integers(0, 14))) for _ in range(count)]


def test_counts_equal_the_library_on_random_texts():
    texts = random_texts(4000)
    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    merges = MergeCounter(path)
    assert [merges.text(t) for t in texts] == [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]


def test_pieces_equal_the_library_on_random_texts(tokenizer):
    texts = random_texts(4000)
    encoder = PieceEncoder(tokenizer, most=60_000)
    got = []
    for at in range(0, len(texts), 250):
        ids, sizes = encoder.encode(texts[at:at + 250])
        got += [list(x) for x in np.split(ids, np.cumsum(sizes)[:-1])]
    assert got == [list(x) for x in library_ids(tokenizer, texts)]


def test_equal_ranks_merge_from_the_left():
    merges = MergeCounter(public_tokenizers.path("word_bpe_49k.json"))
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    for word in ("aaaa", "aaaaa", "aaaaaaa", "ababab", "hahahahah"):
        assert merges.word(word) == len(library.encode(word, add_special_tokens=False).ids)


def test_token_counts_on_odd_rows(odd):
    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    rows = odd.collect()
    want = sorted((str(r.doc_id), len((r.text or "").encode()), len(library.encode(r.text or "", add_special_tokens=False).ids)) for r in rows)
    got = token_counts(odd, path).collect()
    assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens) for r in got) == want
    assert all(r.over_limit == (r.n_tokens > 2048) for r in got) and any(r.over_limit for r in got)
    assert token_counts(odd.limit(0), path).count() == 0


@pytest.mark.parametrize("high", [2, 300, 1 << 10, 1 << 16, 1 << 24])
def test_codes_give_every_token(high):
    rng = np.random.default_rng(high)
    for size in (0, 1, 7, 8, 9, 511, 512, 513, 3000):
        ids = rng.integers(0, high, size)
        codes = addressable.Codes(addressable.encode(ids))
        assert len(codes) == size and (codes.all() == ids).all()
        assert all(codes[i] == ids[i] for i in range(0, size, 13))
    with pytest.raises(IndexError):
        codes[3000]


def test_store_round_trip_on_odd_rows(spark, odd, tokenizer, tmp_path):
    folder = str(tmp_path / "store")
    addressable.write(odd, folder, tokenizer, segment_tokens=300)
    rows = sorted(odd.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.text is not None, r.text or ""))
    want, start = [], 0
    for r, ids in zip(rows, library_ids(tokenizer, [r.text or "" for r in rows])):
        want.append((r.doc_id, start, [*ids, 0]))
        start += len(ids) + 1
    got = [(r.key, r.start, np.frombuffer(r.ids, "<u4").tolist()) for r in addressable.read(spark, folder).collect()]
    assert sorted(got, key=lambda r: r[1]) == want
    key, _, ids = next(w for w in want if len(w[2]) > 600 and w[0] is not None)
    assert [addressable.token(spark, folder, key, i) for i in (0, 599, len(ids) - 1)] == [ids[0], ids[599], ids[-1]]
    empty = str(tmp_path / "empty")
    addressable.write(odd.limit(0), empty, tokenizer)
    assert addressable.read(spark, empty).count() == 0


def test_schedule_places_every_token_once_and_keeps_the_shares():
    rng = np.random.default_rng(5)
    for case in range(30):
        totals = rng.integers(0, 5000, rng.integers(1, 9))
        shares = rng.random(len(totals)) * (rng.random(len(totals)) > 0.2) if case % 2 else totals.astype(float)
        if not (shares > 0).any():
            continue
        window = int(rng.choice([1, 7, 64, 1024]))
        plan = packing.Schedule(totals, shares, window, 8)
        used: dict[int, list] = {}
        for q, total in enumerate(totals):
            cuts = np.unique(np.r_[0, rng.integers(0, total + 1, 6), total])
            doc, start, length, seq, offset = plan.pieces(q, cuts[:-1], np.diff(cuts))
            assert length.sum() == total
            order = np.argsort(start)
            assert (start[order] == np.r_[0, np.cumsum(length[order])[:-1]]).all() if len(order) else total == 0
            for s, o, n in zip(seq, offset, length):
                used.setdefault(int(s), []).append((int(o), int(n)))
        fills = []
        for s in sorted(used):
            at = 0
            for o, n in sorted(used[s]):
                assert o == at
                at += n
            fills.append(at)
        assert all(f == window for f in fills[:-1]) and sorted(used) == list(range(len(used)))


def test_deficits_carry_across_windows():
    plan = packing.Schedule(np.array([10_000, 10_000, 10_000]), np.array([0.5, 0.3, 0.2]), 7, 10)
    ends = [plan._of(q, np.arange(700)) for q in range(3)]
    for q, share in enumerate((0.5, 0.3, 0.2)):
        given = np.bincount(ends[q], minlength=60)[:60].cumsum()
        assert np.abs(given - share * 7 * np.arange(1, 61)).max() <= 1.5


def test_pack_on_odd_rows(odd, tokenizer):
    got = packing.pack(odd, tokenizer, window=64).collect()
    texts = {r.doc_id: r.text for r in odd.collect() if r.doc_id is not None}
    pieces: dict = {}
    for r in got:
        if r.doc_id is not None and r.doc_id != 4:
            pieces.setdefault(r.doc_id, []).append(r)
    for key, parts in pieces.items():
        want = [*library_ids(tokenizer, [texts[key] or ""])[0], 0]
        parts.sort(key=lambda r: r.start)
        assert np.concatenate([np.frombuffer(r.ids, "<u4") for r in parts]).tolist() == want
        assert all(r.doc_tokens == len(want) and len(r.ids) == 4 * r.length for r in parts)
    assert set(pieces) == set(texts) - {4}
    whole = packing.sequences(packing.pack(odd, tokenizer, window=64), 64, 9).orderBy("sequence_id").collect()
    sizes = [len(r.ids) // 4 for r in whole]
    assert sizes[:-1] == [64] * (len(whole) - 1)
    assert sizes[-1] == 64 or whole[-1].n_tokens == sizes[-1] and sizes[-1].bit_count() == 1
    assert sum(r.n_tokens for r in whole) == sum(r.length for r in got)
    assert packing.pack(odd.limit(0), tokenizer).count() == 0
