"""Whole texts to token ids with the tokenizers library, each distinct piece encoded once.

A byte-level tokenizer cuts a text into pre-tokens before it merges bytes, and some places always
lie between two of them: before a space that something visible follows, between a letter and a
sign, and on both sides of a line end between visible signs. Texts are cut there, and Arrow finds the distinct pieces
of a batch, so Python sees each of them once. Their ids are remembered by the worker
up to ``most`` bytes; then only the pieces of the latest batch stay.
"""

from __future__ import annotations

import os
from itertools import chain

import numpy as np
import pyarrow as pa

from lexmesh.llm.common import held
from lexmesh.llm.token_counts import byte_letters

_LETTER, _SIGN, _VISIBLE, _FOLLOWS = (np.zeros(256, bool) for _ in range(4))
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_SIGN[list(b".,;:!?|()[]{}\"%$#&*-/")] = True  # neither letters nor digits nor white space, and no apostrophe, which may join letters
_VISIBLE[33:127] = True
_FOLLOWS[33:127] = _FOLLOWS[0x80:] = True
_FOLLOWS[[0xC2, 0xE1, 0xE2, 0xE3]] = False  # these may begin white space of more than one byte
_APART = 160  # bytes that a remembered piece takes besides its own and its ids


def encoder(path: str) -> "PieceEncoder":
    """The encoder of this Python worker for a tokenizer file."""
    return held(f"encoder {path}", lambda: PieceEncoder(path))


def id_type(path: str) -> type:
    """The smallest unsigned type that holds the ids of a tokenizer file."""
    from tokenizers import Tokenizer

    return np.uint16 if Tokenizer.from_file(path).get_vocab_size() <= 1 << 16 else np.uint32


class PieceEncoder:
    def __init__(self, path: str, most: int = 64 << 20) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self._library = Tokenizer.from_file(path)
        self._special = [t.content for t in self._library.get_added_tokens_decoder().values()]
        self._model = self._library.model
        self._letters = dict(enumerate(byte_letters()))
        self._most = most
        self.id_type = np.uint16 if self._library.get_vocab_size() <= 1 << 16 else np.uint32
        self._slot: dict[bytes, int] = {}
        self._ids, self._starts, self._bytes = np.empty(0, self.id_type), np.zeros(1, np.int64), 0

    def _library_ids(self, text: str) -> list[int]:
        return self._library.encode_batch_fast([text], add_special_tokens=False)[0].ids

    def _piece_ids(self, piece: bytes) -> list[int]:
        """Letters, perhaps after a space, are one pre-token and go to the model; all else goes to the library."""
        text = piece.decode()
        if not (text[1:] if text[0] == " " else text).isalpha():
            return self._library_ids(text)
        spelt = text.replace(" ", "\u0120") if text.isascii() else piece.decode("latin-1").translate(self._letters)
        return [t.id for t in self._model.tokenize(spelt)]

    def _learn(self, pieces: list[bytes]) -> None:
        found = [self._piece_ids(p) for p in pieces]
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        flat = np.fromiter(chain.from_iterable(found), self.id_type, int(sizes.sum()))
        self._slot.update(zip(pieces, range(len(self._slot), len(self._slot) + len(pieces))))
        self._starts = np.concatenate([self._starts, self._starts[-1] + np.cumsum(sizes)])
        self._ids = np.concatenate([self._ids, flat])
        self._bytes += sum(map(len, pieces)) + _APART * len(pieces) + flat.nbytes

    def _forget(self, pieces: list[bytes]) -> None:
        """Keep these pieces only, or none if they alone are too many."""
        slots = np.array([self._slot[p] for p in pieces], np.int64)
        ids, sizes = self._gather(slots)
        size = sum(map(len, pieces)) + _APART * len(pieces) + ids.nbytes
        if size > self._most // 2:
            pieces, ids, sizes, size = [], ids[:0], sizes[:0], 0
        self._slot = dict(zip(pieces, range(len(pieces))))
        self._ids, self._starts, self._bytes = ids, np.concatenate([[0], np.cumsum(sizes)]), size

    def _gather(self, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        first = self._starts[slots]
        sizes = self._starts[slots + 1] - first
        ends = np.cumsum(sizes)
        return self._ids[np.repeat(first - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)], sizes

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after another, number of ids per text). Null reads as empty."""
        # A special string ends a run of text, which changes how white space before it is cut.
        whole = {i: np.array(self._library_ids(t), self.id_type) for i, t in enumerate(texts) if t and any(s in t for s in self._special)}
        parts = [b"" if not t or i in whole else t.encode() for i, t in enumerate(texts)]
        raw = np.frombuffer(b"\0".join(parts) + b"\0", np.uint8)
        ends = np.cumsum([len(p) + 1 for p in parts]) - 1 if parts else np.zeros(0, np.int64)  # a nought ends each text
        starts = self._cuts(raw, ends)
        cut = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(np.append(starts, len(raw))), pa.py_buffer(raw)])
        coded = cut.dictionary_encode()
        pieces = coded.dictionary.to_pylist()
        missing = [p for p in pieces if p not in self._slot]
        if missing:
            self._learn(missing)
        slots = np.fromiter(map(self._slot.__getitem__, pieces), np.int64, len(pieces))[coded.indices.to_numpy()]
        last = np.searchsorted(starts, ends)  # the piece that is a text's nought
        said = np.ones(len(starts), bool)
        said[last] = False
        ids, sizes = self._gather(slots[said])
        upto = np.concatenate([[0], np.cumsum(sizes)])[np.concatenate([[0], last - np.arange(len(last))])]
        per_text = np.diff(upto)
        if self._bytes > self._most:
            self._forget(pieces)
        if whole:
            out = [whole.get(i, ids[upto[i]:upto[i + 1]]) for i in range(len(texts))]
            ids, per_text = np.concatenate(out), np.array([len(p) for p in out], np.int64)
        return ids, per_text

    @staticmethod
    def _cuts(raw: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Places at which a piece begins: those always between two pre-tokens, the noughts, and what follows them."""
        cut = np.zeros(len(raw) + 1, bool)
        letter, sign, visible = _LETTER[raw], _SIGN[raw], _VISIBLE[raw]
        cut[:-2] |= (raw[:-1] == 32) & _FOLLOWS[raw[1:]]
        accented = (raw[:-1] == 0xC3) & (raw[1:] != 0x97) & (raw[1:] != 0xB7)  # the second byte of a Latin letter follows
        cut[1:-1] |= letter[:-1] & sign[1:] | sign[:-1] & letter[1:]
        cut[2:-1] |= accented[:-1] & sign[2:]
        line = np.flatnonzero((raw[1:-1] == 10) & visible[:-2] & visible[2:]) + 1
        cut[line] = cut[line + 1] = True
        cut[0] = cut[ends] = cut[ends + 1] = True
        return np.flatnonzero(cut[:-1])

    def encode_ended(self, texts: list[str | None], end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """As ``encode``, with ``end_id`` after each text."""
        ids, sizes = self.encode(texts)
        out = np.full(len(ids) + len(sizes), end_id, self.id_type)
        ends = np.cumsum(sizes + 1) - 1
        mask = np.ones(len(out), bool)
        mask[ends] = False
        out[mask] = ids
        return out, sizes + 1
