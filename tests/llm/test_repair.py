"""Conversation repair, held against an enumeration of all edits."""

import hashlib
import itertools
import random
import re
import zlib

from parchment.llm import queries, repair

WORD = re.compile(r"[^\x20\x09-\x0D]")
NAMES = {"u": "user", "a": "assistant"}


def faults(rows):
    """(fault, role, text) of (role, text) rows in order."""
    seen, out = set(), []
    for role, text in rows:
        body = WORD.findall(text)
        fault = "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else None
        seen.add((role, text))
        out.append((fault, role, text))
    return out


def all_repairs(rows, most=3):
    """Every sequence of edits with at most `most` inserts, as (cost, audit, turns)."""
    spots = len(rows) + 1
    for n in range(most + 1):
        for where in itertools.combinations_with_replacement(range(spots), n):
            for names in itertools.product("ua", repeat=n):
                for edits in itertools.product(["K", "D", ("R", "u"), ("R", "a")], repeat=len(rows)):
                    cost, audit, turns = 3 * n, "", []
                    for i in range(spots):
                        for w, x in zip(where, names):
                            if w == i:
                                audit += "I"
                                turns.append((NAMES[x], ""))
                        if i < len(rows):
                            (fault, role, text), e = rows[i], edits[i]
                            audit += e[0]
                            cost += {"K": 0, "D": 4, "R": 3}[e[0]] + (3 if fault == "truncated" and e != "D" else 0)
                            if e == "D":
                                continue
                            if fault in ("blank", "duplicate"):
                                cost = 10**6
                            turns.append((role, text) if e == "K" else (NAMES[e[1]], text))
                    if cost < 10**6 and re.fullmatch("(s?(ua)+)?", "".join(r[:1] if r else "-" for r, _ in turns)):
                        yield cost, audit, turns


def parsed(rows):
    p, edits = repair.Parser(), []
    for fault, role, text in rows:
        edits += p.add(role, text, fault in ("blank", "duplicate"), fault == "truncated")
    edits += p.finish()
    return p.cost, "".join(e[0] for e in edits), [(r, t) for e, r, t in edits if e != "D"]


def test_every_short_conversation(monkeypatch):
    rng = random.Random(5)
    for wait in (1, 2, 256):
        monkeypatch.setattr(repair, "WAIT", wait)
        for _ in range(60):
            rows = faults([(rng.choice(["system", "user", "assistant", "tool", "", " "]), rng.choice(["A.", "b", "", "c!", " \t", "A."])) for _ in range(rng.randrange(5))])
            assert parsed(rows) == min(all_repairs(rows), key=lambda x: x[:2])


def test_long_conversations_need_no_room(monkeypatch):
    """Tops agree again and again; the table of steps stays small."""
    rng, p, most, cost = random.Random(8), repair.Parser(), 0, 0
    repair.shift.cache_clear()
    for k in range(60_000):
        fault = rng.choice([None, None, "blank", "truncated"])
        list(p.add(rng.choice(["user", "assistant", "system", "x"]), str(k), fault == "blank", fault == "truncated"))
        most = max(most, len(p.waiting))
    assert most < 4 * repair.WAIT and repair.shift.cache_info().currsize < 2000
    p.finish()
    assert p.cost > cost


def plain(rows):
    """The report of conversations (conv_id, turn, role, text), one after another, with the cheapest edits by dynamic programming over whole audits."""
    out, order = {}, lambda r: (r[1] is not None, r[1] or 0, r[2], r[3])
    for conv in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == conv), key=order)
        found = faults([r[2:] for r in mine])
        count = lambda k: sum(f == k for f, _, _ in found)  # noqa: E731, B023
        turns = [r[1] for r in mine if r[1] is not None]
        pairs = [a[2][:1] + b[2][:1] for a, b in itertools.pairwise(mine)]
        ways = {"": (0, "", [])}
        for fault, role, text in found:
            new = {}
            for state, (cost, audit, said) in ways.items():
                for n in range(3):
                    at, extra = state, []
                    for _ in range(n):
                        nxt = "a" if at == "u" else "u"
                        extra, at = [*extra, (NAMES[nxt], "")], nxt
                    options = [("D", at, [], 4)]
                    if fault not in ("blank", "duplicate"):
                        late = 3 * (fault == "truncated")
                        want = "a" if at == "u" else "u"
                        options.append(("R", want, [(NAMES[want], text)], 3 + late))
                        if role[:1] == want or role[:1] == "s" and at == "":
                            options.append(("K", role[:1], [(role, text)], late))
                    for e, to, turn, more in options:
                        way = (cost + 3 * n + more, audit + "I" * n + e, [*said, *extra, *turn])
                        if to not in new or way[:2] < new[to][:2]:
                            new[to] = way
            ways = new
        tail = {"": 0, "a": 0, "u": 1, "s": 2}
        best = min(((c + 3 * tail[s], a + "I" * tail[s], [*t, *[(NAMES[x], "") for x in "ua"[2 - tail[s] :]]]) for s, (c, a, t) in ways.items()), key=lambda x: x[:2])
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        sha = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in best[2]).encode()).hexdigest()
        out[conv] = (gaps, count("blank"), count("duplicate"), count("truncated"), sum(p not in ("su", "ua", "au") for p in pairs), best[0], best[1], sha)
    return out


EDGE = [
    (1, 0, "user", "Hi."), (1, 1, "assistant", "Yes."), (2, None, "user", "x"), (2, None, None, None), (2, 5, "assistant", "z."), (3, 4, "system", ""), (None, 0, "user", "lost."), (None, 2, "assistant", "row."),
    (4, 1, "user", "same."), (4, 1, "user", "same."), (4, 9, "user", "same."), (4, 3, "assistant", "b."), (4, 3, "assistant", "a."), (5, 0, "user,assistant", "odd role."), (5, 0, "u", "long " * 50_000), (6, -3, "", "?"), (6, 7, "assistant", " "),
]


def test_edges(spark):
    rows = spark.createDataFrame([(*r, "x", 1) for r in EDGE], "conv_id long, turn long, role string, text string, first string, n int")
    got = {r[0]: tuple(r)[1:] for r in repair.repair_report(rows, spark.createDataFrame([(99,), (1,)], "conv_id long")).collect()}
    assert got.pop(99) == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert got == plain([(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in EDGE])
    assert repair.repair_report(rows.limit(0)).count() == 0 and repair.repair(rows.limit(0)).count() == 0


def test_repaired_rows(spark):
    rows = spark.createDataFrame(EDGE, "conv_id long, turn long, role string, text string")
    reports = {r.conv_id: r for r in repair.repair_report(rows).collect()}
    found = {}
    for r in repair.repair(rows).collect():
        found.setdefault(r.conv_id, []).append(r)
    for conv, edits in found.items():
        turns = sorted((r.place, r.role, r.text) for r in edits if r.place is not None)
        assert [p for p, _, _ in turns] == list(range(len(turns)))
        assert sorted(r.edit for r in edits) == sorted(reports[conv].audit)
        assert hashlib.sha256("\n".join(f"{r}:{t}" for _, r, t in turns).encode()).hexdigest() == reports[conv].repaired_sha256


def test_registered_query(spark, sf):
    rows, damaged = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()], []
    for c, t, role, text in rows:
        k = zlib.crc32(f"{c}:{t}".encode()) % 20
        if k:
            damaged += [(c, t, "user" if k == 4 else role, "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text)] * (2 if k == 3 else 1)
    want = {r[0]: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) for r in rows} | plain(damaged)
    assert {r[0]: tuple(r)[1:] for r in queries.op11_conversation_repair(spark, sf).collect()} == want
