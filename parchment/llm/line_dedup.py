"""Substring dedup by unit hashing: of every unit that texts repeat the earliest occurrence stays, the rest goes.

A unit is a line, a paragraph, or (the default) a sentence of a line: a line ends a unit, and so does a stop, question or
exclamation mark before a blank. A text is the sequence of its units, each with what separates it from the next, so what
goes is a list of spans and what stays is the rest. A unit's digest is taken of its normalised form: A to Z lower-cased,
runs of white space made one blank, ends trimmed. Digests are grouped globally with their earliest place, the smallest
(doc_id, text, unit number), by partial minima; only digests that occur again are joined back, a frequent one dealt over
several tasks.

Adjacent units that repeat make a run (units without words do not end it). A run goes when it has min_words words: a
passage that was copied into the middle of a paragraph goes with all its whole sentences however short they are, and a
greeting or a list item, which says little about its text, stays where it is.
"""

from __future__ import annotations

import re

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parchment.llm.common import LOWER, UPPER, as_bytes, cut, hot_keys, spread_join

#: Fewest words of a run that goes.
MIN_WORDS = 20
#: Equal rows beyond the first that one task gives out.
COPIES = 1000
#: One unit with what follows it up to the next, in regular expressions that Python and SQL read alike.
UNITS = {"sentence": r"[^\n]*?[.!?][ \t]+\n?|[^\n]*\n|[^\n]+", "line": r"[^\n]*\n|[^\n]+", "paragraph": r"(?:[^\n]+\n?)+\n*|\n+"}
_UNITS = {k: re.compile(p.encode()) for k, p in UNITS.items()}
_FOLD = bytes.maketrans(UPPER.encode(), LOWER.encode())


def words(unit: bytes) -> list[bytes]:
    return unit.translate(_FOLD).split()


def _row(doc_id: int | None, text: bytes) -> bytes:
    """Names a row by id and text."""
    return xxhash.xxh3_128_digest(f"{doc_id}|".encode() + text)


def _unit_rows(kind: str):
    def rows(batches):
        for b in batches:
            out: tuple[list, ...] = ([], [], [], [])
            for i, t in zip(b.column(0).to_pylist(), as_bytes(b.column(1)), strict=True):
                row, seen = _row(i, t or b""), set()
                for n, u in enumerate(_UNITS[kind].findall(t or b"")):
                    if w := words(u):
                        d = xxhash.xxh3_128_digest(b" ".join(w))
                        if d not in seen:  # the text's own repeats are found when it is rebuilt
                            seen.add(d)
                            for o, v in zip(out, (d, i, row, n), strict=True):
                                o.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.binary()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.binary()), pa.array(out[3], pa.int32())], names=["digest", "id", "row", "unit"])

    return rows


def rebuild(text: bytes, elsewhere: set[int] | None, kind: str = "sentence", min_words: int = MIN_WORDS) -> tuple[bytes, list[dict]]:
    """The text without the runs that go, and the spans of their units in the original, in code points.

    elsewhere: the numbers of units whose digest comes earlier in another row; None if all do.
    """
    units = _UNITS[kind].findall(text)
    again, n_words, seen = [], [], {}
    for n, u in enumerate(units):
        w = words(u)
        n_words.append(len(w))
        before = seen.setdefault(tuple(w), n)
        again.append(bool(w) and (elsewhere is None or before in elsewhere or before != n))
    gone, run = set(), []
    for n, a in enumerate([*again, False]):
        if a:
            run.append(n)
        elif n == len(units) or n_words[n]:
            if sum(n_words[k] for k in run) >= min_words:
                gone.update(run)
            run = []
    kept, spans, at = [], [], 0
    for n, u in enumerate(units):
        size = len(u.decode())
        if n in gone:
            spans.append({"unit": n, "start": at, "end": at + size})
        else:
            kept.append(u)
        at += size
    return b"".join(kept), spans


def _rebuilt(kind: str, min_words: int):
    spans = pa.list_(pa.struct([("unit", pa.int32()), ("start", pa.int32()), ("end", pa.int32())]))

    def rows(batches):
        for b in batches:
            texts, removed = [], []
            for t, units, copy in zip(as_bytes(b.column(1)), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                s: list[dict] = []
                if t:
                    t, s = rebuild(t, None if copy else set(units or ()), kind, min_words)
                texts.append(None if t is None else t.decode())
                removed.append(s)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string()), pa.array(removed, spans)], names=["doc_id", "text", "removed"])

    return rows


def _named(batches):
    for b in batches:
        rows = [_row(i, t or b"") for i, t in zip(b.column(0).to_pylist(), as_bytes(b.column(1)), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary()), b.column(0), b.column(1)], names=["row", "doc_id", "text"])


def deduplicate_units(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", unit: str = "sentence", min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, text, removed) for every row: the text that stays, and array<struct<unit, start, end>> of what went.

    unit: sentence, line or paragraph. Offsets are code points of the original text, from 0, and a unit's span includes
    what separates it from the next. A unit that repeats inside one text goes there too. Rows without an id rank last. Of
    rows that repeat both id and text the first keeps what such a row alone would keep, and in the others everything is a
    repeat. A null text stays null with nothing removed, an empty one empty. Texts of any length are taken whole; an
    empty table gives an empty one. Other columns are not looked at.
    """
    base = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    found = base.mapInArrow(_unit_rows(unit), "digest binary, id long, row binary, unit int")
    place = F.struct(F.col("id").isNull().alias("last"), "id", "row", "unit")
    first = cut(found.groupBy("digest").agg(F.min(place).alias("first"), F.count("*").alias("n")).filter("n > 1").select("digest", F.col("first.row").alias("first"), "n"))
    again = spread_join(found, first.select("digest", "first"), "digest", hot_keys(first, "digest"), ["row"]).filter("row <> first")
    repeats = again.groupBy("row").agg(F.collect_set("unit").alias("units"))
    # equal rows are counted, not ranked: the partial counts leave one row of them in each task
    rows = base.mapInArrow(_named, "row binary, doc_id long, text string").groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.first("text").alias("text"), F.count("*").alias("n"))
    joined = rows.join(repeats, "row", "left")
    copies = lambda df, a, b: df.withColumn("copy", F.explode(F.sequence(a, b))).select("doc_id", "text", "units", "copy")
    each = copies(joined.filter(F.col("n") <= COPIES), F.lit(0).cast("long"), F.col("n") - 1)
    if not base.groupBy(F.xxhash64("doc_id", "text")).count().filter(F.col("count") > COPIES).isEmpty():
        parts = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / COPIES)))
        many = joined.filter(F.col("n") > COPIES).withColumn("part", parts).repartition("row", "part")
        each = each.unionByName(copies(many, F.col("part") * COPIES, F.least(F.col("part") * COPIES + COPIES, F.col("n")) - 1))
    return each.mapInArrow(_rebuilt(unit, min_words), "doc_id long, text string, removed array<struct<unit:int,start:int,end:int>>")
