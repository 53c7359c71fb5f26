"""Conversation structure repair by generalised LR parsing of the role grammar.

Roles count by their initial: conversation -> nothing | s? exchange+, exchange -> u a. The parser reads a conversation's rows
in order and keeps every stack that weighted edits allow: a row is kept, deleted or given another role, and turns without
text are inserted before it. All stacks hang in one graph. Stacks with equal tops (LR states) are merged by the least
(cost, audit), the audit being the edits' initials so far; a node keeps one way back, so the graph has at most one top for
each LR state. Two tops' audits never are prefixes of each other, as each ends with a row's edit: so tops stay sorted by
audit, a new audit is compared by its top's place and its own new letters, and no long text is ever compared. A step depends
on costs relative to the cheapest top, which are bounded, so all steps that occur make up one small table.

What all tops have in common is settled and handed out at once, so a conversation of any length streams through its task.
Which rows repeat an earlier one is found before, by joins that deal frequent texts over several tasks.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parchment.llm.common import cut, hot_keys, spread_join

#: LR states: 0 nothing yet, 1 behind s, 2 behind u, 3 behind an exchange.
GOTO = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
#: What can be inserted in a state, or what a row can be turned into.
NEXT = {0: "u", 1: "u", 2: "a", 3: "u"}
#: Inserts that lead from a state to a whole conversation.
CLOSE = {0: 0, 1: 2, 2: 1, 3: 0}
NAMES = {"u": "user", "a": "assistant"}
KEEP, DELETE, INSERT, REROLE, TRUNCATED = 0, 4, 3, 3, 3
BLANKS = " \t\n\x0b\x0c\r"
#: Rows that wait for the tops to agree before it is looked whether they do.
WAIT = 256


@functools.cache
def shift(tops: tuple[tuple[int, int], ...], initial: str, must_go: bool, truncated: bool):
    """(cost, tops, back) behind one more row.

    tops: (state, cost) sorted by audit, the least first, costs counted from the cheapest; cost is what all of them have
    grown by. back: for each new state, the state that it comes from and the edits in between.
    """
    found: dict[int, tuple[int, int, str]] = {}
    for rank, (state, cost) in enumerate(tops):
        at, edits = state, ""
        for _ in range(3):
            ways = [("D", at, DELETE)]
            if not must_go:
                late = TRUNCATED if truncated else 0
                if (at, initial) in GOTO:
                    ways.append(("K", GOTO[at, initial], KEEP + late))
                ways.append(("R", GOTO[at, NEXT[at]], REROLE + late))
            for edit, to, more in ways:
                way = (cost + more, rank, edits + edit)
                if to not in found or way < found[to]:
                    found[to] = way
            at, edits, cost = GOTO[at, NEXT[at]], edits + "I", cost + INSERT
    # A conversation that goes on from 0 or 1 goes on from 3 as well, once an s is deleted: tops that cost more than that are lost.
    behind = min([found[s][0] + more for s, more in ((3, 0), (2, INSERT)) if s in found], default=None)
    if behind is not None:
        for state, more in ((0, DELETE), (1, 0)):
            if state in found and found[state][0] > behind + more:
                del found[state]
    least = min(c for c, _, _ in found.values())
    order = sorted(found, key=lambda s: found[s][1:])
    return least, tuple((s, found[s][0] - least) for s in order), {s: (tops[found[s][1]][0], found[s][2]) for s in order}


class Parser:
    """One conversation: add() and finish() give the settled edits as (edit, role, text), a deleted row's text being None."""

    def __init__(self) -> None:
        self.cost, self.tops = 0, ((0, 0),)
        self.waiting: list[tuple[dict, str, str | None]] = []
        self.look = WAIT

    def add(self, role: str, text: str | None, must_go: bool, truncated: bool) -> Iterable[tuple[str, str, str | None]]:
        initial = role[:1] if role[:1] in ("s", "u", "a") else ""
        more, self.tops, back = shift(self.tops, initial, must_go, truncated)
        self.cost += more
        self.waiting.append((back, role, None if must_go else text))
        return self._settled() if len(self.waiting) >= self.look else ()

    def _settled(self) -> list:
        at = {s for s, _ in self.tops}
        n = len(self.waiting)
        while n and len(at) > 1:
            n -= 1
            at = {self.waiting[n][0][s][0] for s in at}
        out = self._edits(at.pop(), n) if n else []
        self.waiting = self.waiting[n:]
        self.look = max(WAIT, 2 * len(self.waiting))
        return out

    def _edits(self, state: int, n: int) -> list:
        """The edits of the first n waiting rows on the way that ends in state."""
        ways = []
        for back, role, text in reversed(self.waiting[:n]):
            state, edits = back[state]
            ways.append((state, edits, role, text))
        out = []
        for state, edits, role, text in reversed(ways):
            for edit in edits:
                letter = NEXT[state]
                if edit == "K":
                    out.append(("K", role, text))
                elif edit == "D":
                    out.append(("D", role, None))
                else:
                    out.append((edit, NAMES[letter], "" if edit == "I" else text))
                    state = GOTO[state, letter]
        return out

    def finish(self) -> list:
        closing = [(cost + INSERT * CLOSE[state], rank, state) for rank, (state, cost) in enumerate(self.tops)]
        more, _, state = min(closing)
        self.cost += more
        out = self._edits(state, len(self.waiting))
        for _ in range(CLOSE[state]):
            out.append(("I", NAMES[NEXT[state]], ""))
            state = GOTO[state, NEXT[state]]
        return out


COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal")


def _conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(conv_id, edits, None) as edits get settled, and (conv_id, edits, counts) at a conversation's end. Rows come sorted."""
    conv, begun, parser, counts, seen, initial = None, False, Parser(), {}, None, None
    turns: list = []  # first, last, number of different ones

    def end():
        edits = parser.finish()
        gaps = turns[1] - turns[0] + 1 - turns[2] if turns else 0
        return conv, edits, {**counts, "gaps": gaps, "cost": parser.cost}

    for b in batches:
        for c, there, turn, role, text, blank, truncated, repeat, key in zip(*(x.to_pylist() for x in b.columns), strict=True):
            if not begun or c != conv:
                if begun:
                    yield end()
                conv, begun, parser, counts, seen, initial, turns = c, True, Parser(), dict.fromkeys(COUNTS, 0), None, None, []
            if not there:
                continue
            if turn is not None:
                turns = [turn, turn, 1] if not turns else [turns[0], turn, turns[2] + (turn != turns[1])]
            if initial is not None:
                counts["illegal"] += (initial + role[:1]) not in ("su", "ua", "au")
            initial = role[:1]
            repeat, seen = repeat or (turn, key) == seen, (turn, key)
            fault = "blank" if blank else "duplicate" if repeat else "truncated" if truncated else None
            if fault:
                counts[fault] += 1
            if edits := parser.add(role, text, fault in ("blank", "duplicate"), fault == "truncated"):
                yield conv, edits, None
    if begun:
        yield end()


def _prepared(rows: DataFrame, conversations: DataFrame | None) -> DataFrame:
    """Rows with their faults, each conversation together and in order; one row that says so for each conversation, also an empty one."""
    r = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), *[F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")])
    named = F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.isnull("conv_id").cast("string"), F.length("role").cast("string"), "role", "text")
    order = F.struct(F.isnotnull("turn").alias("known"), F.coalesce("turn", F.lit(0)).alias("turn"))
    keyed = r.withColumn("key", F.sha2(named, 256))
    firsts = cut(keyed.groupBy("key").agg(F.min(order).alias("first"), F.count("*").alias("n")))
    many = spread_join(keyed, firsts.select("key", "first"), "key", hot_keys(firsts, "key"), ["turn"])
    last = F.right(F.rtrim("text", F.lit(BLANKS)), F.lit(1))
    out = many.select("conv_id", F.lit(True).alias("there"), "turn", "role", "text", (last == "").alias("blank"), (~last.isin(".", "!", "?")).alias("truncated"), (order > F.col("first")).alias("repeat"), "key")
    ids = rows.select("conv_id") if conversations is None else conversations.select("conv_id").unionByName(rows.select("conv_id"))
    none = F.lit(None)
    marks = ids.distinct().select("conv_id", F.lit(False).alias("there"), none.cast("long").alias("turn"), none.cast("string").alias("role"), none.cast("string").alias("text"), F.lit(False).alias("blank"), F.lit(False).alias("truncated"), F.lit(False).alias("repeat"), none.cast("string").alias("key"))
    return out.unionByName(marks).repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")


def _schema(rows: DataFrame, *fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField("conv_id", rows.schema["conv_id"].dataType), *[T.StructField(n, t) for n, t in fields]])


def _batches(rows: Iterable[tuple], schema: T.StructType, size: int = 4096) -> Iterator[pa.RecordBatch]:
    from pyspark.sql.pandas.types import to_arrow_schema

    kind, held = to_arrow_schema(schema), []
    pack = lambda: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), kind, strict=True)], schema=kind)
    for row in rows:
        held.append(row)
        if len(held) >= size:
            yield pack()
            held = []
    if held:
        yield pack()


def _map(rows: DataFrame, conversations: DataFrame | None, schema: T.StructType, of: Callable[[Iterator[tuple]], Iterator[tuple]]) -> DataFrame:
    return _prepared(rows, conversations).mapInArrow(lambda batches: _batches(of(_conversations(batches)), schema), schema)


def repair(rows: DataFrame) -> DataFrame:
    """(conv_id, place, edit, role, text): the repaired turns with a place from 0, and the rows that go with a null one.

    rows hold (conv_id, turn, role, text) and any other columns, which aren't looked at. They are taken by turn, null first,
    then by role and text. A null role or text is one blank; rows with a null conv_id are one conversation. A blank row, and
    one whose role and text came before, is deleted; a truncated one costs more where it stays. edit is K, D, R or I (kept,
    deleted, another role, inserted), of all cheapest repairs those with the least letters in ASCII order. An empty table gives
    an empty one. A conversation streams through one task, in bounded memory while its ways agree now and then.
    """

    def turns(found):
        conv, place = None, None
        for c, edits, done in found:
            if place is None:
                conv, place = c, 0
            for edit, role, text in edits:
                yield conv, None if edit == "D" else place, edit, role, text
                place += edit != "D"
            if done is not None:
                place = None

    return _map(rows, None, _schema(rows, ("place", T.LongType()), ("edit", T.StringType()), ("role", T.StringType()), ("text", T.StringType())), turns)


def repair_report(rows: DataFrame, conversations: DataFrame | None = None) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) for each conversation.

    As repair(). Each row counts for its first fault. gaps: missing turns between the first and the last one, null turns
    aside. illegal: neighbours whose initials are none of su, ua, au. repaired_sha256: of "role:text" of each repaired turn,
    joined by newlines. conversations: more conv_ids, whose rows may all be gone; these get zeros, an empty audit and
    the empty text's digest. The digest is of all turns in order, so it is one task's for each conversation, a text at a time.
    """

    def reports(found):
        sha = audit = None
        for c, edits, done in found:
            if sha is None:
                sha, audit, turns = hashlib.sha256(), [], 0
            audit.append("".join(e for e, _, _ in edits))
            for edit, role, text in edits:
                if edit != "D":
                    sha.update((("\n" if turns else "") + f"{role}:{text}").encode())
                    turns += 1
            if done is not None:
                yield (c, *[done[k] for k in (*COUNTS, "cost")], "".join(audit), sha.hexdigest())
                sha = None

    fields = [(k, T.LongType()) for k in (*COUNTS, "cost")]
    return _map(rows, conversations, _schema(rows, *fields, ("audit", T.StringType()), ("repaired_sha256", T.StringType())), reports)
