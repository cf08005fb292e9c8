"""Token counts by heap-and-linked-list byte-pair merging.

A text is normalised and cut into words as the tokenizer file says; within a word
the adjacent pair of lowest rank is merged again and again, taken from a heap over
a doubly linked list of symbols. The count is the number of initial symbols less the
number of merges, so no identifier is ever looked up. Counts of words and of
runs between white space are remembered per worker, up to a bound.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  (pa.compute)
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmesh.llm.common import held, slices

_ASCII_SPACE = re.compile(r"[ \t\n\v\f\r]+").split


def byte_letters() -> list[str]:
    """The printable letter that byte-level tokenizers use for each byte: itself, or the next one from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    out, following = [], 256
    for b in range(256):
        out.append(chr(b if b in plain else following))
        following += b not in plain
    return out


class MergeCounter:
    """Counts tokens for a tokenizer file of kind BPE with lower-casing, NFC, a split pattern and word-end marks."""

    def __init__(self, path: str, capacity: int = 400_000) -> None:
        import regex

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        self._end = model["end_of_word_suffix"] or ""
        self._ranks = {(a, b): i for i, (a, b) in enumerate(model["merges"])}
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self._words = regex.compile(split["pattern"]["Regex"]).findall
        special = [re.escape(t["content"]) for t in spec["added_tokens"]]
        self._special = re.compile("|".join(sorted(special, key=len, reverse=True)))
        self._letters = byte_letters()
        self._capacity = capacity
        self._word_counts: dict[str, int] = {}
        self._run_counts: dict[str, int] = {}

    def merges(self, symbols: list[str]) -> int:
        """How often the lowest-ranked adjacent pair can be merged; of equal ranks the leftmost goes first."""
        after = [*range(1, len(symbols)), -1]
        before = list(range(-1, len(symbols) - 1))
        ranks = self._ranks
        heap = [(ranks[pair], i, *pair) for i, pair in enumerate(zip(symbols, symbols[1:])) if pair in ranks]
        heapq.heapify(heap)
        done = 0
        while heap:
            _, i, left, right = heapq.heappop(heap)
            j = after[i]
            if j < 0 or symbols[i] != left or symbols[j] != right:
                continue  # one of the two has been merged meanwhile
            symbols[i], symbols[j] = left + right, ""
            done += 1
            after[i] = k = after[j]
            if k >= 0:
                before[k] = i
                if (pair := (symbols[i], symbols[k])) in ranks:
                    heapq.heappush(heap, (ranks[pair], i, *pair))
            if (h := before[i]) >= 0 and (pair := (symbols[h], symbols[i])) in ranks:
                heapq.heappush(heap, (ranks[pair], h, *pair))
        return done

    def word(self, word: str) -> int:
        n = self._word_counts.get(word)
        if n is None:
            symbols = [self._letters[b] for b in word.encode()]
            size = len(symbols)
            symbols[-1] += self._end
            n = self._word_counts[word] = size - self.merges(symbols)
        return n

    def run(self, run: str) -> int:
        """Tokens of a run without plain white space; a special string inside is one token."""
        n = self._run_counts.get(run)
        if n is None:
            n = 0
            for k, part in enumerate(self._special.split(run)):
                n += k > 0
                if part:
                    # Letter by letter: the library lower-cases without looking at neighbours.
                    low = part.lower() if part.isascii() else "".join(c.lower() for c in unicodedata.normalize("NFC", part))
                    n += sum(map(self.word, self._words(low)))
            self._run_counts[run] = n
        return n

    def text(self, text: str | None) -> int:
        if not text:
            return 0
        for known in (self._word_counts, self._run_counts):
            if len(known) > self._capacity:
                known.clear()
        return sum(map(self.run, filter(None, _ASCII_SPACE(text))))


def counter(path: str) -> MergeCounter:
    return held(f"counter {path}", lambda: MergeCounter(path))


def token_counts(documents: DataFrame, tokenizer: str, limit: int = 2048, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_bytes, n_tokens, over_limit) per row, without a shuffle.

    Null text reads as empty: no bytes, no tokens. Null keys and repeated rows pass
    through, extra columns are ignored, an empty table gives an empty one.
    """
    kind = documents.schema[key].dataType

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = counter(tokenizer)
        for batch in slices(batches, "text"):
            sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column("text")), 0).cast(pa.int64())
            tokens = np.fromiter(map(counts.text, batch.column("text").to_pylist()), np.int64, batch.num_rows)
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), sizes, pa.array(tokens), pa.array(tokens > limit)], ["key", "n_bytes", "n_tokens", "over_limit"])

    rows = documents.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    found = rows.mapInArrow(count, f"key {kind.simpleString()}, n_bytes long, n_tokens long, over_limit boolean")
    return found.select(F.col("key").alias(key), "n_bytes", "n_tokens", "over_limit")
