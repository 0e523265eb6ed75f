"""Repair of conversation structure by a generalised LR parser with weighted edits.

A conversation should spell ``(s?(ua)+)?`` in the initials of its roles: nothing, or turns of user and assistant in pairs,
after a system turn if there is one.  An LR automaton is built of that grammar.  The parser keeps every stack that some
edits of the turns so far lead to; stacks share their lower parts (each is a state on top of a shared stack),
and histories that lead to equal stacks are merged, of which the least by (cost, audit) stays.  A turn is kept,
given another role or deleted, and turns may be inserted before it; each action has a cost and a letter, and
the letters in order are the audit.  Live stacks are as many as the grammar has, whatever the length.

Audits of one position are never compared as strings: none is the beginning of another (each ends with the letter of the
same turn, and inserts come before it), so the order found so far decides and only new letters are
compared.

Turns of a conversation are read in order by one task, as a stream from an external sort.  It holds the live stacks and one
letter and link a turn; the repaired turns only where they are asked for, else a running digest for each live stack.  Repeated
turns are found before, in the same partitions, by a window.

Edge cases: a null role or text is one space; turns are ordered by number, nulls first, then by role and text (of repeats it does
not matter which is first); a null id is an id like others; roles are told by their first letter alone, and an empty
role has none, so it must be changed or deleted; a conversation without turns costs nothing; a conversation is one
row, so its audit, and its text where that is asked for, must fit a row (2 GB); an empty table gives an empty
result; other columns are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
from typing import Iterator, NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, small_batches

#: Rules of the role grammar; terminals are lower-case initials.
GRAMMAR = (("S", ""), ("S", "P"), ("S", "sP"), ("P", "ua"), ("P", "Pua"))
#: Roles that a turn can be given or inserted with, by initial.
GIVEN = {"u": "user", "a": "assistant"}
FAULTS = ("blank", "duplicate", "truncated")
END = "$"


class Costs(NamedTuple):
    rerole: int = 1
    delete: int = 2
    insert: int = 5
    truncated: int = 5  # a truncated turn that stays


class Table:
    """LR(0) states of a grammar with reductions by the terminals that can follow (SLR)."""

    def __init__(self, grammar: tuple[tuple[str, str], ...] = GRAMMAR):
        self.rules = [("^", grammar[0][0]), *grammar]
        self.inner = {left for left, _ in grammar}
        self.root = Stack(0)  # below every stack; the grammar must recurse on the left, so that stacks are few
        follow = self._follow()
        states: list[frozenset] = [self._closure({(0, 0)})]
        self.goto: dict[tuple[int, str], int] = {}
        self.reduce: dict[tuple[int, str], tuple[str, int]] = {}
        self.accept: set[int] = set()
        for k, state in enumerate(states):  # grows while it is read
            for rule, dot in state:
                left, right = self.rules[rule]
                if dot == len(right):
                    if rule == 0:
                        self.accept.add(k)
                    for t in follow[left] if rule else ():
                        if self.reduce.setdefault((k, t), (left, dot)) != (left, dot):
                            raise ValueError(f"two reductions before {t!r}")
            for symbol in sorted({self.rules[r][1][d] for r, d in state if d < len(self.rules[r][1])}):
                moved = self._closure({(r, d + 1) for r, d in state if d < len(self.rules[r][1]) and self.rules[r][1][d] == symbol})
                if moved not in states:
                    states.append(moved)
                self.goto[k, symbol] = states.index(moved)

    def _closure(self, items: set) -> frozenset:
        todo = list(items)
        for rule, dot in todo:
            right = self.rules[rule][1]
            new = [(r, 0) for r, (left, _) in enumerate(self.rules) if dot < len(right) and left == right[dot] and (r, 0) not in items]
            items.update(new)
            todo += new
        return frozenset(items)

    def _follow(self) -> dict[str, set[str]]:
        empty, first, follow = {l for l, r in self.rules if not r}, {n: set() for n in self.inner}, {n: set() for n in self.inner}
        start = self.rules[0][1]
        follow[start].add(END)
        before = None
        while before != (before := (len(empty), *(len(first[n]) for n in sorted(first)), *(len(follow[n]) for n in sorted(follow)))):
            for left, right in self.rules[1:]:
                if all(x in empty for x in right):
                    empty.add(left)
                after = set(follow[left])
                for x in reversed(right):
                    if x in self.inner:
                        follow[x] |= after
                        after = first[x] | (after if x in empty else set())
                    else:
                        after = {x}
                for x in right:
                    first[left] |= first[x] if x in self.inner else {x}
                    if x not in empty:
                        break
        return follow


class Stack:
    """A state on top of a stack; equal stacks are one object, so lower parts are shared and moves are found once."""

    __slots__ = ("state", "below", "above", "moves", "edits", "inserts")

    def __init__(self, state: int, below: "Stack | None" = None):
        self.state, self.below, self.above, self.moves, self.edits, self.inserts = state, below, {}, {}, {}, None

    def push(self, state: int) -> "Stack":
        if state not in self.above:
            self.above[state] = Stack(state, self)
        return self.above[state]

    def settled(self, table: Table, ahead: str) -> "Stack":
        """The stack after all reductions that the next symbol calls for."""
        top = self
        while rule := table.reduce.get((top.state, ahead)):
            left, n = rule
            for _ in range(n):
                top = top.below
            top = top.push(table.goto[top.state, left])
        return top

    def shift(self, table: Table, symbol: str) -> "Stack | None":
        """The stack after ``symbol``, if the grammar allows it here."""
        if symbol not in self.moves:
            top = self.settled(table, symbol)
            state = None if symbol in table.inner else table.goto.get((top.state, symbol))
            self.moves[symbol] = None if state is None else top.push(state)
        return self.moves[symbol]

    def inserted(self, table: Table) -> list[tuple["Stack", tuple[str, ...]]]:
        """This stack and those that inserts alone lead to, each by the fewest inserts."""
        if self.inserts is None:
            self.inserts, seen = [(self, ())], {self}
            for at, given in self.inserts:  # grows while it is read
                for symbol, role in GIVEN.items():
                    to = at.shift(table, symbol)
                    if to is not None and to not in seen:
                        seen.add(to)
                        self.inserts.append((to, given + (role,)))
        return self.inserts

    def edited(self, table: Table, costs: Costs, initial: str, fault: str | None) -> list[tuple]:
        """(stack, cost, letters, inserted roles, role or None) for a turn with this initial and fault: the least edit to each
        stack.  The role is that of a changed turn; a kept turn has its own, a deleted one none."""
        key = (initial, fault)
        if key not in self.edits:
            best: dict[Stack, tuple] = {}
            stay = costs.truncated if fault == "truncated" else 0
            for at, given in self.inserted(table):
                moves = [(costs.delete, "D", None, at)]
                if fault not in ("blank", "duplicate"):
                    moves.append((stay, "K", None, at.shift(table, initial)))
                    moves += [(costs.rerole + stay, "R", name, at.shift(table, symbol)) for symbol, name in GIVEN.items()]
                for cost, letter, name, to in moves:
                    if to is not None:
                        new = (costs.insert * len(given) + cost, "I" * len(given) + letter, given, name)
                        if to not in best or new[:2] < best[to][:2]:
                            best[to] = new
            self.edits[key] = [(to, *e) for to, e in best.items()]
        return self.edits[key]

    def accepts(self, table: Table) -> bool:
        return self.settled(table, END).state in table.accept


class Turns:
    """The turns of a repaired conversation; histories share their common beginning."""

    __slots__ = ("before", "own")

    def __init__(self, before: "Turns | None" = None):
        self.before, self.own = before, []

    def copy(self) -> "Turns":
        return Turns(self)

    def add(self, role: str, text: str) -> None:
        self.own.append({"role": role, "text": text})

    def value(self) -> list[dict]:
        parts, at = [], self
        while at is not None:
            parts += reversed(at.own)
            at = at.before
        return parts[::-1]


class Digest:
    """SHA-256 of the ``role:text`` lines of a repaired conversation, which are never held."""

    __slots__ = ("state", "empty")

    def __init__(self, state=None, empty: bool = True):
        self.state, self.empty = state or hashlib.sha256(), empty

    def copy(self) -> "Digest":
        return Digest(self.state.copy(), self.empty)

    def add(self, role: str, text: str) -> None:
        self.state.update(("" if self.empty else "\n").encode() + f"{role}:{text}".encode("utf-8", "replace"))
        self.empty = False

    def value(self) -> str:
        return self.state.hexdigest()


class History(NamedTuple):
    """The least edits that lead to a stack: ``order`` ranks the audits of all live stacks."""

    cost: int
    order: int
    links: tuple | None  # (letters, earlier links)
    out: Turns | Digest


class Parser:
    """Reads one conversation turn by turn; ``finish`` gives (cost, audit, repaired)."""

    def __init__(self, table: Table, costs: Costs = Costs(), sink=Turns):
        self.table, self.costs = table, costs
        self.live: dict[Stack, History] = {table.root: History(0, 0, None, sink())}

    def turn(self, role: str, text: str, fault: str | None) -> None:
        best: dict[Stack, tuple] = {}
        for stack, h in self.live.items():
            for to, cost, letters, given, name in stack.edited(self.table, self.costs, role[:1], fault):
                new = (h.cost + cost, h.order, letters)
                if to not in best or new < best[to][0]:
                    best[to] = (new, h, given, name)
        ranks = {key: k for k, key in enumerate(sorted({new[1:] for new, *_ in best.values()}))}
        self.live = {}
        for to, (new, h, given, name) in best.items():
            out, kept = h.out, new[2][-1] != "D"
            if given or kept:
                out = out.copy()
                for r in given:
                    out.add(r, "")
                if kept:
                    out.add(name or role, text)
            self.live[to] = History(new[0], ranks[new[1:]], (new[2], h.links), out)

    def finish(self) -> tuple[int, str, list[dict] | str]:
        ends = []
        for stack, h in self.live.items():
            for at, given in stack.inserted(self.table):
                if at.accepts(self.table):
                    ends.append(((h.cost + self.costs.insert * len(given), h.order, "I" * len(given)), h, given))
        (cost, _, letters), h, given = min(ends, key=lambda e: e[0])
        out = h.out.copy()
        for r in given:
            out.add(r, "")
        parts, links = [letters], h.links
        while links is not None:
            parts.append(links[0])
            links = links[1]
        return cost, "".join(reversed(parts)), out.value()


_PAIRS = {"su", "ua", "au"}
RESULT = "id {id}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired {repaired}"


class Conversation:
    """Counts and parser of the conversation that is being read."""

    def __init__(self, table: Table, costs: Costs, sink):
        self.parser = Parser(table, costs, sink)
        self.faults = dict.fromkeys(FAULTS, 0)
        self.low = self.high = self.initial = None
        self.distinct = self.illegal = 0

    def add(self, turn: int | None, role: str, text: str, fault: str | None) -> None:
        if fault:
            self.faults[fault] += 1
        if turn is not None:
            self.distinct += turn != self.high
            self.low, self.high = turn if self.low is None else self.low, turn
        if self.initial is not None:
            self.illegal += self.initial + role[:1] not in _PAIRS
        self.initial = role[:1]
        self.parser.turn(role, text, fault)

    def row(self) -> tuple:
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.distinct
        return (gaps, *self.faults.values(), self.illegal, *self.parser.finish())


def with_faults(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", present_col: str | None = None) -> DataFrame:
    """(id, turn, role, text, present, fault), partitioned by id and sorted: each turn with its first fault.

    ``present_col`` names a boolean column: rows without it only make their conversation known."""
    present = F.col(present_col) if present_col else F.lit(True)
    rows = turns.select(
        F.col(id_col).alias("id"),
        F.col(turn_col).cast("long").alias("turn"),
        F.coalesce(F.col(role_col), F.lit(" ")).alias("role"),
        F.coalesce(F.col(text_col), F.lit(" ")).alias("text"),
        present.alias("present"),
    ).repartition("id")
    # the window needs no exchange of its own: its keys begin with the partitioning's
    again = F.row_number().over(Window.partitionBy("id", "present", "role", "text").orderBy(F.asc_nulls_first("turn"))) > 1
    fault = F.when(~F.col("text").rlike(WORD), "blank").when(again, "duplicate").when(~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z"), "truncated")
    return rows.withColumn("fault", F.when(F.col("present"), fault)).sortWithinPartitions(F.asc_nulls_first("id"), F.asc_nulls_first("turn"), "role", "text")


def repair(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", present_col: str | None = None, costs: Costs = Costs(), digest: bool = False) -> DataFrame:
    """One row per conversation: id, gaps in the numbers, counts of faults and of illegal neighbours, the cost and audit of its
    cheapest repair, and its turns (role, text), or the SHA-256 of their ``role:text`` lines if ``digest``."""
    kind = turns.schema[id_col].dataType.simpleString()
    schema = RESULT.format(id=kind, repaired="string" if digest else "array<struct<role:string,text:string>>")
    sink, out_type = (Digest, pa.string()) if digest else (Turns, pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())])))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Table()
        types = [pa.int64()] * 6 + [pa.string(), out_type]
        at, current, ids, done, size = None, None, [], [], 0

        def flush():
            cols = [pa.array(ids, id_type)] + [pa.array(c, t) for c, t in zip(zip(*done), types)]
            return pa.RecordBatch.from_arrays(cols, [f.split()[0] for f in RESULT.split(", ")])

        for batch in batches:
            id_type = batch.schema.field(0).type
            for i, turn, role, text, present, fault in zip(*(c.to_pylist() for c in batch.columns)):
                if current is None or i != at:
                    if current is not None:
                        ids.append(at)
                        done.append(current.row())
                        size += sum(len(t["text"]) for t in done[-1][-1]) if not digest else len(done[-1][-2])
                        if len(done) == 4096 or size > 1 << 22:
                            yield flush()
                            ids, done, size = [], [], 0
                    at, current = i, Conversation(table, costs, sink)
                if present:
                    current.add(turn, role, text, fault)
        if current is not None:
            ids.append(at)
            done.append(current.row())
            yield flush()

    rows = with_faults(small_batches(turns), id_col, turn_col, role_col, text_col, present_col)
    out = rows.mapInArrow(run, schema)
    return out.withColumnRenamed("id", id_col)


def damaged(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, present): ``turns`` with faults set by the checksum of ``conv_id:turn`` modulo 20.  Nulls are
    one space; a row that is dropped stays as one that is not present."""
    space = F.lit(" ")
    key = F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), space), F.coalesce(F.col("turn").cast("string"), space))
    what = (F.crc32(key.cast("binary")) % 20).cast("int")
    rows = turns.select("conv_id", "turn", F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"), what.alias("what"))
    text = F.when(F.col("what") < 2, "").when(F.col("what") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("what") == 4, "user").otherwise(F.col("role"))
    rows = rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("what") != 0).alias("present"), F.when(F.col("what") == 3, 2).otherwise(1).alias("times"))
    return rows.withColumn("times", F.explode(F.array_repeat(F.lit(0), F.col("times")))).drop("times")


def repaired_damage(turns: DataFrame) -> DataFrame:
    """Every conversation, damaged and repaired."""
    rows = repair(damaged(turns), present_col="present", digest=True)
    return rows.withColumnRenamed("repaired", "repaired_sha256")
