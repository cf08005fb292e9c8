"""Conversations repaired by generalised LR parsing of their roles.

The roles of a conversation must spell a sentence of a small grammar. An LR automaton
is built from the grammar; its stacks are nodes of one graph, each a state on the stack below
it, so equal stacks are one node and shared parts exist once. Each row may be kept, given
another role or deleted, and rows may be inserted, at a weight each; of all ways that lead to
one stack only the least (cost, audit) stays. As every row takes one letter of the audit and every insert
costs something, of two ways of equal cost neither audit is a prefix of the other, so the
least way to a stack is also the least with anything put behind it.

Rows pass through a task in order and nothing of their texts is held: once all surviving
ways agree on an edit it is put out, so memory does not grow with a conversation.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from os.path import commonprefix

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmesh.session import written

#: An optional system turn, then user and assistant in turn; or nothing.
ROLE_GRAMMAR = (("talk", ()), ("talk", ("s", "pairs")), ("talk", ("pairs",)), ("pairs", ("pair",)), ("pairs", ("pairs", "pair")), ("pair", ("u", "a")))
ROLES = {"u": "user", "a": "assistant"}
REROLE, DELETE, INSERT, CUT_OFF = 3, 4, 3, 3
END = "$"
_BLANK = "[^\\x20\\x09-\\x0D]"
_SETTLE = 256  # rows after which agreed edits are put out


def automaton(rules: tuple = ROLE_GRAMMAR) -> list[dict[str, int | tuple[str, int]]]:
    """SLR table: per state, symbol -> next state (shift or goto), ``(rule's head, its length)`` (reduce) or True (accept)."""
    heads = {h for h, _ in rules}
    top = (("", (rules[0][0],)), *rules)
    first: dict[str, set] = {h: set() for h in heads}
    empty: set[str] = set()
    follow: dict[str, set] = {h: set() for h in heads}
    follow[rules[0][0]].add(END)
    for _ in range(len(rules) ** 2 + 2):  # to the fixed point
        for head, body in rules:
            if all(b in empty for b in body):
                empty.add(head)
            for b in body:
                first[head] |= first.get(b, {b})
                if b not in empty:
                    break
            behind = set(follow[head])
            for b in reversed(body):
                if b in heads:
                    follow[b] |= behind
                    behind = first[b] | (behind if b in empty else set())
                else:
                    behind = {b}

    def closed(items: frozenset) -> frozenset:
        out, todo = set(items), list(items)
        while todo:
            rule, dot = todo.pop()
            for k, (head, _) in enumerate(top):
                if top[rule][1][dot:dot + 1] == (head,) and (k, 0) not in out:
                    out.add((k, 0))
                    todo.append((k, 0))
        return frozenset(out)

    states, table = [closed(frozenset({(0, 0)}))], []
    for state in states:  # grows while it is walked
        row: dict = {}
        for symbol in sorted({top[r][1][d] for r, d in state if d < len(top[r][1])}):
            onto = closed(frozenset((r, d + 1) for r, d in state if top[r][1][d:d + 1] == (symbol,)))
            if onto not in states:
                states.append(onto)
            row[symbol] = states.index(onto)
        for r, d in state:
            head, body = top[r]
            if d == len(body):
                for symbol in {END} if r == 0 else follow[head]:
                    if symbol in row:
                        raise ValueError(f"the grammar is not SLR at {symbol}")
                    row[symbol] = True if r == 0 else (head, len(body))
        table.append(row)
    return table


class Stack:
    """A state on the stack below it. A stack is made once; ``onto`` is its neighbour for a symbol."""

    __slots__ = ("table", "state", "below", "above", "moves")

    def __init__(self, table: list[dict], state: int = 0, below: Stack | None = None) -> None:
        self.table, self.state, self.below = table, state, below
        self.above: dict[int, Stack] = {}
        self.moves: dict[str, Stack | bool | None] = {}

    def put(self, state: int) -> Stack:
        if state not in self.above:
            self.above[state] = Stack(self.table, state, self)
        return self.above[state]

    def onto(self, symbol: str) -> Stack | bool | None:
        """The stack after the symbol, reductions done; True if the end is accepted; None if the symbol can't follow."""
        if symbol not in self.moves:
            at: Stack | bool | None = self
            while True:
                step = at.table[at.state].get(symbol)
                if not isinstance(step, tuple):
                    at = step if step is None or step is True else at.put(step)
                    break
                head, size = step
                for _ in range(size):
                    at = at.below
                at = at.put(at.table[at.state][head])
            self.moves[symbol] = at
        return self.moves[symbol]


Way = tuple[int, str, str]  # cost, audit, and per letter of it the role's initial, "-" where none comes out


class Parser:
    """One conversation: ``row`` for each of its rows in order, then ``end``; both return edits that are settled."""

    def __init__(self, bottom: Stack) -> None:
        self._ways: dict[Stack, Way] = {bottom: (0, "", "")}
        self._rows = 0
        self._insert()

    def _insert(self) -> None:
        todo = list(self._ways)
        while todo:
            stack = todo.pop()
            cost, audit, roles = self._ways[stack]
            for role in ROLES:
                onto = stack.onto(role)
                way = (cost + INSERT, audit + "I", roles + role)
                if onto is not None and (onto not in self._ways or way < self._ways[onto]):
                    self._ways[onto] = way
                    todo.append(onto)

    def row(self, initial: str, fault: str | None) -> tuple[str, str]:
        found: dict[Stack, Way] = {}

        def reach(stack: Stack | None, way: Way) -> None:
            if stack is not None and (stack not in found or way < found[stack]):
                found[stack] = way

        more = CUT_OFF if fault == "truncated" else 0
        for stack, (cost, audit, roles) in self._ways.items():
            reach(stack, (cost + DELETE, audit + "D", roles + "-"))
            if fault not in ("blank", "duplicate"):
                if initial and initial != END:
                    reach(stack.onto(initial), (cost + more, audit + "K", roles + initial))
                for role in ROLES:
                    reach(stack.onto(role), (cost + REROLE + more, audit + "R", roles + role))
        self._ways = found
        self._insert()
        self._rows += 1
        return self._settled() if self._rows % _SETTLE == 0 else ("", "")

    def _settled(self) -> tuple[str, str]:
        n = min(len(commonprefix([w[k] for w in self._ways.values()])) for k in (1, 2))
        _, audit, roles = next(iter(self._ways.values()))
        self._ways = {s: (c, a[n:], r[n:]) for s, (c, a, r) in self._ways.items()}
        return audit[:n], roles[:n]

    def end(self) -> tuple[str, str]:
        return min(way for stack, way in self._ways.items() if stack.onto(END) is True)[1:]


def faulted(conversations: DataFrame) -> DataFrame:
    """(conv_id, row_no, turn, role, text, fault, illegal): rows of each conversation in order of turn, nulls first.

    Null role or text reads as one space; rows of one turn lie in order of role and text, so
    repeated rows are adjacent. ``fault`` is the first of ``blank`` (no sign but white
    space), ``duplicate`` (role and text seen earlier), ``truncated`` (the last such sign ends no
    sentence) that holds, else null. ``illegal``: role initials that can't follow the row's before it.
    Null conv_ids are one conversation, extra columns are ignored.
    """
    said = conversations.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    known = said.withColumn("digest", F.sha2("text", 256))
    seen = F.row_number().over(Window.partitionBy("conv_id", "role", "digest").orderBy("turn"))
    last = F.substring(F.rtrim(F.translate("text", "\t\n\x0b\x0c\r", "     ")), -1, 1)
    fault = (F.when(~F.rlike("text", F.lit(_BLANK)), "blank").when(F.col("seen") > 1, "duplicate").when(~last.isin(".", "!", "?"), "truncated"))
    marked = known.withColumn("seen", seen).withColumn("fault", fault)
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "digest", "seen")
    initial = F.substring("role", 1, 1)
    before = F.lag(initial).over(order)
    return marked.select("conv_id", F.row_number().over(order).cast("long").alias("row_no"), "turn", "role", "text", "fault",
                         F.coalesce(~F.concat(before, initial).isin("su", "ua", "au"), F.lit(False)).alias("illegal"))


def edits(rows: DataFrame) -> DataFrame:
    """(conv_id, step, row_no, edit, role): the cheapest edits of ``faulted`` rows, those of the least audit where several are cheapest.

    ``edit`` is K, R, D or I, ``row_no`` null for an insert, ``role`` the initial that comes out (null for a deletion).
    """
    kind = rows.schema["conv_id"].dataType
    table = automaton()

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bottom = Stack(table)
        now, parser, step, row, out = None, None, 0, 0, []

        def put(audit: str, roles: str) -> None:
            nonlocal step, row
            for edit, role in zip(audit, roles):
                step, row = step + 1, row + (edit != "I")
                out.append((now[0], step, None if edit == "I" else row, edit, None if role == "-" else role))

        for batch in batches:
            for conv, initial, fault in zip(*(batch.column(k).to_pylist() for k in range(3))):
                if now != (conv,):
                    if now:
                        put(*parser.end())
                    now, parser, step, row = (conv,), Parser(bottom), 0, 0
                put(*parser.row(initial, fault))
            if out:
                yield batch_of(out)
                out.clear()
        if now:
            put(*parser.end())
        if out:
            yield batch_of(out)

    def batch_of(found: list) -> pa.RecordBatch:
        names = ["conv_id", "step", "row_no", "edit", "role"]
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*found), types)], names)

    from pyspark.sql.pandas.types import to_arrow_type

    types = [to_arrow_type(kind), pa.int64(), pa.int64(), pa.string(), pa.string()]
    few = rows.select("conv_id", F.substring("role", 1, 1).alias("initial"), "fault", "row_no")
    dealt = few.repartition("conv_id").sortWithinPartitions("conv_id", "row_no")
    return dealt.mapInArrow(parse, f"conv_id {kind.simpleString()}, step long, row_no long, edit string, role string")


def repair(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows with their faults, repaired rows with the edits that made them).

    The first is as ``faulted``. The second has a row for every edit: (conv_id, step, row_no,
    edit, role, text, cost), role and text null where a row was deleted; the rows that have
    a role are the repaired conversation in order of ``step``. Inserted rows have empty texts. A
    conversation of which nothing can be kept has only deletions; an empty table gives no rows.
    """
    rows = written(faulted(conversations))
    made = edits(rows)
    there = rows.select(F.col("conv_id").alias("_conv"), F.col("row_no").alias("_row"), F.col("role").alias("_role"), "text", "fault")
    both = made.join(there, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("row_no") == F.col("_row")), "left")
    stays = F.col("role").isNotNull()
    named: Column = F.when(F.col("edit") == "K", F.col("_role"))
    for initial, name in ROLES.items():
        named = named.when(F.col("role") == initial, F.lit(name))
    weight = F.when(F.col("edit") == "K", 0).when(F.col("edit") == "D", DELETE).when(F.col("edit") == "R", REROLE).otherwise(INSERT)
    cost = weight + F.when(stays & F.coalesce(F.col("fault") == "truncated", F.lit(False)), CUT_OFF).otherwise(0)
    text = F.when(F.col("edit") == "I", "").when(stays, F.col("text"))
    return rows, both.select("conv_id", "step", "row_no", "edit", F.when(stays, named).alias("role"), text.alias("text"), cost.cast("long").alias("cost"))


def digests(repaired: DataFrame) -> DataFrame:
    """(conv_id, cost, audit, repaired_sha256): one row for each conversation, its rows hashed as they pass by."""
    from pyspark.sql.pandas.types import to_arrow_type

    kind = repaired.schema["conv_id"].dataType
    arrow = to_arrow_type(kind)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, cost, audit, digest, begun, out = None, 0, [], None, False, []

        def put() -> None:
            if now:
                out.append((now[0], cost, "".join(audit), digest.hexdigest()))

        for batch in batches:
            for conv, edit, role, text, weight in zip(*(batch.column(k).to_pylist() for k in range(5))):
                if now != (conv,):
                    put()
                    now, cost, audit, digest, begun = (conv,), 0, [], hashlib.sha256(), False
                cost += weight
                audit.append(edit)
                if role is not None:
                    digest.update(f"{chr(10) if begun else ''}{role}:{text}".encode())
                    begun = True
            if out:
                yield rows_of(out)
                out.clear()
        put()
        if out:
            yield rows_of(out)

    def rows_of(found: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*found), [arrow, pa.int64(), pa.string(), pa.string()])],
                                          ["conv_id", "cost", "audit", "repaired_sha256"])

    dealt = repaired.repartition("conv_id").sortWithinPartitions("conv_id", "step").select("conv_id", "edit", "role", "text", "cost")
    return dealt.mapInArrow(fold, f"conv_id {kind.simpleString()}, cost long, audit string, repaired_sha256 string")


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows hurt in a fixed way: by crc32 of ``conv_id:turn`` modulo 20, 0 drops a row, 1 empties its text,
    2 takes the sentence ends from it, 3 repeats it, 4 makes it the user's. Nulls read as one space."""
    one = F.lit(" ")
    kind = F.crc32(F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), one), F.coalesce(F.col("turn").cast("string"), one))) % 20
    rows = conversations.select("conv_id", "turn", F.coalesce("role", one).alias("role"), F.coalesce("text", one).alias("text"), kind.alias("kind"))
    hurt = rows.where("kind != 0").select(
        "conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        F.explode(F.array_repeat(F.lit(0), F.when(F.col("kind") == 3, 2).otherwise(1))).alias("copy"))
    return hurt.drop("copy")


def report(conversations: DataFrame, after: DataFrame) -> DataFrame:
    """One row for every conv_id of ``conversations``: counts of faults of the rows ``after`` it, and what their repair costs."""
    rows, repaired = repair(after)
    is_fault = lambda name: F.coalesce(F.sum((F.col("fault") == name).cast("long")), F.lit(0)).alias(name)
    gaps = F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).cast("long").alias("gaps")
    counts = rows.groupBy("conv_id").agg(gaps, is_fault("blank"), is_fault("duplicate"), is_fault("truncated"), F.sum(F.col("illegal").cast("long")).alias("illegal"))
    every = conversations.select(F.col("conv_id").alias("_conv")).distinct()
    same = lambda df: F.col("_conv").eqNullSafe(df["conv_id"])
    ends = digests(repaired)
    out = every.join(counts, same(counts), "left").drop("conv_id").join(ends, same(ends), "left").drop("conv_id")
    numbers = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    return out.select(F.col("_conv").alias("conv_id"), *(F.coalesce(n, F.lit(0)).cast("long").alias(n) for n in numbers),
                      F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))
