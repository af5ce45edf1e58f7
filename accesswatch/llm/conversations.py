"""Repair of conversation structure: the cheapest edits that make roles alternate, by a search from both ends."""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from accesswatch.llm.common import BLANKS, slices

#: Costs of the edits; a truncated row that is not deleted adds ``TRUNCATED``.
RELABEL, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: Places in the wanted pattern (s?(ua)+)?: nothing yet, after s, after u, after a.
_START, _SYSTEM, _USER, _DONE = range(4)
_KEPT = {"s": {_START: _SYSTEM}, "u": {_START: _USER, _SYSTEM: _USER, _DONE: _USER}, "a": {_USER: _DONE}}
#: The one user or assistant row that may stand next, and the place it leads to.
_NEXT = {_START: _USER, _SYSTEM: _USER, _USER: _DONE, _DONE: _USER}
_ROLE = {_USER: "user", _DONE: "assistant"}
_INTO = {q: [p for p, x in _NEXT.items() if x == q] for q in range(4)}

SUMMARY = (
    "gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, "
    "repaired_sha256 string"
)
TURNS = "place bigint, role string, text string, edit string"
_BLANK, _CUT, _FULL = 0, 1, 2


class Lattice:
    """Edit lattice of one conversation: node ``4 * rows done + place in the pattern``.

    ``rows`` has a letter per row: s, u, a or another for a row that may stay, in upper case if it is truncated,
    and d for a row that must go. Edges are (letter of the edit, cost, node). At any place only one user or
    assistant row can stand next, so the letters of the edits name a path.
    """

    def __init__(self, rows: str):
        self.rows, self.n = rows, len(rows)
        self.goals = [4 * self.n + _START, 4 * self.n + _DONE]

    def forward(self, node: int) -> Iterator[tuple[str, int, int]]:
        i, q = divmod(node, 4)
        if i < self.n:
            row, after = self.rows[i], 4 * i + 4
            yield "D", DELETE, after + q
            if row != "d":
                extra, kept = TRUNCATED * row.isupper(), _KEPT.get(row.lower(), {}).get(q)
                if kept is not None:
                    yield "K", extra, after + kept
                yield "R", RELABEL + extra, after + _NEXT[q]
        yield "I", INSERT, 4 * i + _NEXT[q]

    def backward(self, node: int) -> Iterator[tuple[str, int, int]]:
        i, q = divmod(node, 4)
        if i:
            row, before = self.rows[i - 1], 4 * i - 4
            yield "D", DELETE, before + q
            if row != "d":
                extra = TRUNCATED * row.isupper()
                for p, to in _KEPT.get(row.lower(), {}).items():
                    if to == q:
                        yield "K", extra, before + p
                for p in _INTO[q]:
                    yield "R", RELABEL + extra, before + p
        for p in _INTO[q]:
            yield "I", INSERT, 4 * i + p


class _Side:
    """One of the two searches: costs found, nodes done, and a heap of open nodes."""

    def __init__(self, sources: Iterable[int], edges):
        self.edges, self.cost, self.done = edges, dict.fromkeys(sources, 0), {}
        self.heap = [(0, s) for s in self.cost]

    def top(self) -> int | None:
        while self.heap and self.heap[0][1] in self.done:
            heapq.heappop(self.heap)
        return self.heap[0][0] if self.heap else None

    def step(self) -> int:
        cost, node = heapq.heappop(self.heap)
        self.done[node] = cost
        for _, w, to in self.edges(node):
            if to not in self.done and cost + w < self.cost.get(to, 1 << 60):
                self.cost[to] = cost + w
                heapq.heappush(self.heap, (cost + w, to))
        return node


def cheapest(rows: str) -> tuple[int, str]:
    """Least cost and, of all audits of that cost, the least in ASCII order.

    Dijkstra's search from the start and one from the ends take turns. They go on until the sum of their open costs is above
    the best meeting, so each cheapest path then has a node or an edge between nodes that both searches have done. From
    these crossings the cheapest paths are marked back to the start; the walk along them, always by the least letter,
    is the least of all joined halves: letters name paths, so no two of them share letters and part later.
    """
    lattice = Lattice(rows)
    ahead, back = _Side([_START], lattice.forward), _Side(lattice.goals, lattice.backward)
    best, sides = 1 << 60, (ahead, back)
    while True:
        a, b = ahead.top(), back.top()
        if a is None or b is None or a + b > best:
            break
        mine, other = sides if a <= b else sides[::-1]
        node = mine.step()
        if node in other.cost:
            best = min(best, mine.done[node] + other.cost[node])
    total = best
    # Cheapest paths: nodes whose cost to an end is known, and those before a crossing.
    known, ends = ahead.done, dict.fromkeys(lattice.goals, 0) | back.done
    rest = lambda node: ends.get(node, 1 << 60)
    marked = [u for u, c in known.items() if c + rest(u) == total or any(c + w + rest(v) == total for _, w, v in lattice.forward(u))]
    on = set(marked)
    while marked:
        v = marked.pop()
        for _, w, u in lattice.backward(v):
            if u not in on and u in known and known[u] + w == known[v]:
                on.add(u)
                marked.append(u)
    audit, node, spent = [], _START, 0
    while not (spent == total and node in lattice.goals):
        letter, w, node = min(
            e for e in lattice.forward(node)
            if spent + e[1] + rest(e[2]) == total or (e[2] in on and known[e[2]] == spent + e[1])
        )
        spent += w
        audit.append(letter)
    return total, "".join(audit)


_remembered = lru_cache(maxsize=20_000)(cheapest)


class _Conversation:
    """What is known of one conversation after its short records: a letter a row and the counts, no text."""

    def __init__(self):
        self.letters, self.seen, self.turns = bytearray(), set(), set()
        self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.last: str | None = None
        self.ready = False

    def row(self, turn: int | None, initial: str, kind: int, digest: bytes) -> None:
        if turn is not None:
            self.turns.add(turn)
        if self.last is not None and self.last + initial not in ("su", "ua", "au"):
            self.illegal += 1
        self.last = initial
        letter = initial if initial in ("s", "u", "a") else "x"
        if kind == _BLANK:
            self.blank, letter = self.blank + 1, "d"
        elif digest in self.seen:
            self.duplicate, letter = self.duplicate + 1, "d"
        elif kind == _CUT:
            self.truncated, letter = self.truncated + 1, letter.upper()
        self.seen.add(digest)
        self.letters += letter.encode()

    def plan(self) -> None:
        rows = self.letters.decode()
        self.seen.clear()
        self.gaps = max(self.turns) - min(self.turns) + 1 - len(self.turns) if self.turns else 0
        self.cost, self.audit = (_remembered if len(rows) <= 200 else cheapest)(rows)
        self.at, self.state, self.hash, self.place, self.ready = 0, _START, hashlib.sha256(), 0, True

    def turn(self, role: str, text: str) -> Iterator[tuple[int, str, str, str]]:
        """Repaired turns up to and with this row."""
        yield from self._inserted()
        edit, self.at = self.audit[self.at], self.at + 1
        if edit == "K":
            self.state = _KEPT[role[0]][self.state]
            yield self._out(role, text, edit)
        elif edit == "R":
            self.state = _NEXT[self.state]
            yield self._out(_ROLE[self.state], text, edit)

    def close(self) -> Iterator[tuple[int, str, str, str]]:
        if not self.ready:
            self.plan()
        yield from self._inserted()

    def _inserted(self) -> Iterator[tuple[int, str, str, str]]:
        while self.audit[self.at : self.at + 1] == "I":
            self.at += 1
            self.state = _NEXT[self.state]
            yield self._out(_ROLE[self.state], "", "I")

    def _out(self, role: str, text: str, edit: str) -> tuple[int, str, str, str]:
        self.hash.update(f"{chr(10) if self.place else ''}{role}:{text}".encode())
        self.place += 1
        return self.place - 1, role, text, edit

    def summary(self) -> tuple:
        return (
            self.gaps, self.blank, self.duplicate, self.truncated, self.illegal, self.cost, self.audit, self.hash.hexdigest()
        )


def _records(rows: DataFrame, conv_id: str, turn: str, role: str, text: str, absent: Column | None) -> DataFrame:
    """Two records a row, of one conversation in one partition: first all short ones, then all texts, each by turn.

    Rows are shuffled once and numbered in order; Spark sorts and spills, so no task holds a conversation's texts.
    """
    given = rows.select(
        F.col(conv_id).alias("conv"), F.col(turn).cast("long").alias("turn"), F.coalesce(F.col(role).cast("string"), F.lit(" ")).alias("role"),
        F.coalesce(F.col(text).cast("string"), F.lit(" ")).alias("text"), F.coalesce(absent, F.lit(False)).alias("absent") if absent is not None else F.lit(False).alias("absent"),
    )
    order = Window.partitionBy("conv").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    stripped = F.rtrim("text", F.lit(BLANKS))
    kind = F.when(stripped == "", _BLANK).when(F.substring(stripped, -1, 1).isin(".", "!", "?"), _FULL).otherwise(_CUT)
    digest = F.unhex(F.md5(F.concat_ws("\0", "role", "text")))
    none = F.lit(None)
    short = F.struct(
        F.lit(0).alias("pass"), none.cast("string").alias("role"), none.cast("string").alias("text"),
        F.substring("role", 1, 1).alias("initial"), kind.cast("int").alias("kind"), digest.alias("digest"),
    )
    full = F.struct(
        F.lit(1).alias("pass"), F.col("role").alias("role"), F.col("text").alias("text"), none.cast("string").alias("initial"),
        none.cast("int").alias("kind"), none.cast("binary").alias("digest"),
    )
    both = F.explode(F.when(F.col("absent"), F.array(short)).otherwise(F.array(short, full))).alias("r")
    numbered = given.withColumn("nth", F.row_number().over(order))
    return numbered.select("conv", "turn", "absent", "nth", both).select("conv", "turn", "absent", "nth", "r.*").sortWithinPartitions(
        "conv", "pass", "nth"
    )


def _read(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[object, _Conversation, list | None]]:
    """(id, conversation, turns) for each row with a text, and with None for turns once the conversation is over."""
    name, held = None, None
    for batch in slices(batches, "text", 8_000_000):
        columns = [batch[c].to_pylist() for c in ("conv", "turn", "absent", "pass", "role", "text", "initial", "kind", "digest")]
        for conv, turn, absent, second, role, text, initial, kind, digest in zip(*columns):
            if held is None or conv != name:
                if held is not None:
                    yield name, held, list(held.close())
                    yield name, held, None
                name, held = conv, _Conversation()
            if second:
                if not held.ready:
                    held.plan()
                yield name, held, list(held.turn(role, text))
            elif not absent:
                held.row(turn, initial, kind, digest)
    if held is not None:
        yield name, held, list(held.close())
        yield name, held, None


def _run(records: DataFrame, schema: str, whole: bool) -> DataFrame:
    kind = records.schema["conv"].dataType.simpleString()
    schema = f"conv {kind}, {schema}"
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def repair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, size = [], 0
        for name, held, turns in _read(batches):
            if whole and turns is None:
                out.append((name, *held.summary()))
                size += len(held.audit)
            elif not whole and turns:
                out += [(name, *t) for t in turns]
                size += sum(len(t[2]) for t in turns)
            if len(out) >= 4096 or size > 8_000_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), arrow)], schema=arrow)
                out, size = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), arrow)], schema=arrow)

    return records.mapInArrow(repair, schema)


def repair_plans(
    rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", absent: Column | None = None
) -> DataFrame:
    """Faults, the cheapest repair and the digest of the repaired text of each conversation.

    A row is a blank (nothing but white space), else a duplicate (role and text stood before), else truncated (does not
    end in ``.``, ``!`` or ``?``), else sound. ``audit`` has a letter per edit in order: Keep, Rerole, Delete, Insert. Rows for
    which ``absent`` holds only name their conversation. Rows are taken by turn, null turns first; rows of one turn by role,
    then text. Null roles and texts are one space, repeated rows are duplicates, rows with a null conversation are one
    conversation, an empty table gives none. A conversation's rows are sorted and spilled by Spark and streamed through a
    task that holds a letter and a digest a row, never texts. Further columns are not looked at.
    """
    made = _run(_records(rows, conv_id, turn, role, text, absent), SUMMARY, True)
    return made.withColumnRenamed("conv", conv_id)


def repaired_turns(
    rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", absent: Column | None = None
) -> DataFrame:
    """The rows of the repaired conversations: place from 0, role, text, and the edit that made each. Cases as above."""
    made = _run(_records(rows, conv_id, turn, role, text, absent), TURNS, False)
    return made.withColumnRenamed("conv", conv_id)
