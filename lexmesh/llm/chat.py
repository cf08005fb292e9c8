"""Chat formatting through a template that is only ever called, never looked into.

The template renders the first turn, the first two, and so on. Where one output begins
with the one before it, the rest is the new turn's span; where it does not, the
template rewrites history, which is reported with the turn at which it did. The text
inside a turn's span is located by rendering the turn twice with probes in its place:
what the two outputs share before and after the probe surrounds the text.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Turns = list[tuple[str, str]]
Template = Callable[[Turns], str]

_CONTROL = re.compile(r"(\\)|(<)(/?s>)|(\[)(/?INST\])")
_ESCAPED = re.compile(r"\\(\\?)")
_TURN = re.compile(r"<s>\[INST\] (.*?) \[/INST\]\n(.*?)</s>\n", re.DOTALL)
_PROBES = ("a", "b")


def escape(text: str) -> str:
    """Control strings get a backslash after their first character, backslashes are doubled."""
    def put(m: re.Match) -> str:
        return "\\\\" if m[1] else f"{m[2] or m[4]}\\{m[3] or m[5]}"

    return _CONTROL.sub(put, text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


_SPELT: dict[tuple[str, str], str] = {}
_SPELT_TURNS, _SPELT_CHARS = 20_000, 1 << 12


def _spelt(turn: tuple[str, str]) -> str:
    """A turn between its marks. Turns are remembered, as every longer prefix of a conversation asks for them again."""
    found = _SPELT.get(turn)
    if found is None:
        role, text = turn
        found = f"<s>[INST] {escape(role)} [/INST]\n{escape(text)}</s>\n"
        if len(_SPELT) >= _SPELT_TURNS:
            _SPELT.clear()
        if len(found) <= _SPELT_CHARS:
            _SPELT[turn] = found
    return found


def marked_turns(turns: Turns) -> str:
    """The template of the registered query: each turn between marks that no escaped text holds."""
    return "".join(map(_spelt, turns))


def parse(formatted: str) -> Turns:
    """The turns of an output of ``marked_turns``; an error if anything else is in it."""
    turns, at = [], 0
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if m is None:
            raise ValueError(f"no turn at {at}")
        turns.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    return turns


@dataclass
class Rendered:
    """``spans``: (start, end, text start, text end) of each turn in the text; ``rewritten_at``: the turn whose rendering changed what came before it, or -1."""

    text: str
    spans: list[tuple[int, int, int, int]]
    rewritten_at: int = -1


def render(template: Template, turns: Turns, wanted: set[str]) -> Rendered:
    """Render turn by turn; text places are sought for turns of the wanted roles only, others have (end, end).

    A template that rewrites history gives its whole output without spans.
    """
    before, spans = template([]), []
    for k, (role, text) in enumerate(turns):
        now = template(turns[:k + 1])
        if not now.startswith(before):
            return Rendered(template(turns), [], k)
        place = (len(now), len(now))
        if role in wanted:
            one, two = (template([*turns[:k], (role, probe)]) for probe in _PROBES)
            if not (one.startswith(before) and two.startswith(before)):
                return Rendered(template(turns), [], k)
            one, two = one[len(before):], two[len(before):]  # only the new turn is compared letter by letter
            head = len(os.path.commonprefix([one, two]))
            tail = len(os.path.commonprefix([one[head:][::-1], two[head:][::-1]]))
            place = (len(before) + head, len(now) - tail)
        spans.append((len(before), len(now), *place))
        before = now
    return Rendered(before, spans)



def format_chats(rows: DataFrame, template: Template = marked_turns, trained: frozenset[str] = frozenset({"assistant"}), key: str = "conv_id") -> DataFrame:
    """(key, formatted, loss, rewritten_at) per conversation from rows (key, turn, role, text).

    ``loss``: an array of [start, end), in code points of ``formatted``, of the trained
    roles' texts. Turns are ordered by turn, then role and text; null turns come first,
    null roles and texts read as empty, repeated rows are turns of their own, rows with a
    null key are one conversation, extra columns are ignored, an empty table gives none.
    A conversation is rendered in one task, since a template needs it whole.
    """
    kind = rows.schema[key].dataType.simpleString()
    blank = F.lit("")
    turn = F.struct(F.col("turn").alias("turn"), F.coalesce(F.col("role").cast("string"), blank).alias("role"), F.coalesce(F.col("text").cast("string"), blank).alias("text"))
    whole = rows.groupBy(F.col(key).alias("key")).agg(F.sort_array(F.collect_list(turn)).alias("turns"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.column("turns").to_pylist():
                turns = [(t["role"], t["text"]) for t in row]
                done = render(template, turns, set(trained))
                loss = [[s[2], s[3]] for s, (role, _) in zip(done.spans, turns) if role in trained]
                out.append((done.text, loss, done.rewritten_at))
            texts, losses, at = zip(*out) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), pa.array(texts, pa.string()), pa.array(losses, pa.list_(pa.list_(pa.int64()))), pa.array(at, pa.int32())],
                ["key", "formatted", "loss", "rewritten_at"])

    found = whole.mapInArrow(run, f"key {kind}, formatted string, loss array<array<bigint>>, rewritten_at int")
    return found.withColumnRenamed("key", key)


def read_back(formatted: DataFrame, key: str = "conv_id") -> DataFrame:
    """(key, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars), read from what ``format_chats`` returned."""
    kind = formatted.schema[key].dataType.simpleString()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, loss in zip(batch.column("formatted").to_pylist(), batch.column("loss").to_pylist()):
                turns = parse(text)
                said = "".join(f"{role}\n{body}\n" for role, body in turns)
                learnt = "".join(unescape(text[a:b]) for a, b in loss)
                out.append((len(turns), hashlib.sha256(said.encode()).hexdigest(), len(learnt), hashlib.sha256(learnt.encode()).hexdigest(), len(text)))
            columns = list(zip(*out)) if out else [()] * 5
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), *(pa.array(c, k) for c, k in zip(columns, kinds))],
                ["key", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    rows = formatted.select(F.col(key).alias("key"), "formatted", "loss")
    found = rows.mapInArrow(read, f"key {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
    return found.withColumnRenamed("key", key)
