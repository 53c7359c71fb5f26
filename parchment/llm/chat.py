"""Chat formatting by schema fingerprints.

A record is a JSON object in some layout. Its fingerprint is a hash of its nested field paths (array places left out), and
a registry maps fingerprints to declarative mappings, which say where roles and texts are found. A mapping turns the record
into canonical turns, a template turns those into one text with marks, and control strings inside texts are escaped so that
the text can be read back exactly. The loss mask is a list of spans over the text, one for each assistant turn.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The control strings of the template. Each starts with the one character in it that no control string holds elsewhere.
OPEN = {"system": "[SYS]", "user": "[INST]", "assistant": "<s>"}
CLOSE = {"system": "[/SYS]", "user": "[/INST]", "assistant": "</s>"}
ROLE, END_ROLE, END = "[ROLE]", "[/ROLE]", "[/END]"
CONTROL = [*OPEN.values(), *CLOSE.values(), ROLE, END_ROLE, END]
_CONTROL = re.compile("|".join(map(re.escape, CONTROL)))
_ESCAPED = re.compile(r"\\(\\?)", re.S)


@dataclass(frozen=True)
class Mapping:
    """Where a layout keeps its turns: either a list with role and text fields, or fields that hold one turn each.

    turns: (role, path) in order; an absent or null path gives no turn. join: fields put together, by a blank line, into
    the turn of the first. roles: names that a layout uses for the canonical ones.
    """

    list_path: str | None = None
    role_key: str = "role"
    text_key: str = "content"
    turns: tuple[tuple[str, tuple[str, ...]], ...] = ()
    roles: tuple[tuple[str, str], ...] = (("human", "user"), ("gpt", "assistant"), ("bot", "assistant"), ("model", "assistant"))


def paths(value, at: str = "") -> set[str]:
    """The nested field paths of a JSON value; what is in arrays goes under []."""
    if isinstance(value, dict):
        return set().union(*[paths(v, f"{at}.{k}") for k, v in value.items()], {f"{at}{{}}"} if not value else set())
    if isinstance(value, list):
        return set().union({f"{at}[]"}, *[paths(v, f"{at}[]") for v in value])
    return {at}


def fingerprint(of: set[str]) -> str:
    return xxhash.xxh3_128_hexdigest("\n".join(sorted(of)).encode())


def _messages(key: str, role: str, text: str, **more) -> dict[str, Mapping]:
    m = Mapping(key, role, text, **more)
    return {fingerprint(p): m for p in ({f".{key}[]", f".{key}[].{role}", f".{key}[].{text}"}, {f".{key}[]"})}


def _fields(turns: tuple[tuple[str, tuple[str, ...]], ...]) -> dict[str, Mapping]:
    """One fingerprint for each choice of the optional fields; the last turn's fields are always there."""
    names = [f for _, fs in turns for f in fs]
    need = {turns[-1][1][0]} | {next(fs[0] for role, fs in turns if role == "user")}
    free = [f for f in names if f not in need]
    return {fingerprint({f".{f}" for f in need | {f for k, f in enumerate(free) if bits >> k & 1}}): Mapping(turns=turns) for bits in range(1 << len(free))}


#: Layouts known from the start. More are added by putting fingerprints and mappings into a copy of it.
REGISTRY: dict[str, Mapping] = {
    **_messages("messages", "role", "content"),
    **_messages("canonical", "role", "text", roles=()),  # from records_of(): roles as they are in the rows
    **_messages("conversations", "from", "value"),
    **_messages("turns", "speaker", "text"),
    **_fields((("user", ("prompt",)), ("assistant", ("completion",)))),
    **_fields((("system", ("system",)), ("user", ("prompt",)), ("assistant", ("response",)))),
    **_fields((("system", ("system",)), ("user", ("instruction", "input")), ("assistant", ("output",)))),
}


def _dig(record, path: str):
    for key in path.split("."):
        record = record.get(key) if isinstance(record, dict) else None
    return record


def _text(value) -> str:
    return "" if value is None else value if isinstance(value, str) else json.dumps(value, ensure_ascii=False)


def canonical(record, registry: dict[str, Mapping]) -> list[tuple[str, str]] | None:
    """The (role, text) turns of a record, or None if no mapping knows its layout."""
    m = registry.get(fingerprint(paths(record)))
    if m is None:
        return None
    names = dict(m.roles)
    if m.list_path:
        found = [(x.get(m.role_key), x.get(m.text_key)) for x in _dig(record, m.list_path) or [] if isinstance(x, dict)]
        return [(names.get(_text(r), _text(r)), _text(t)) for r, t in found]
    out = []
    for role, fields in m.turns:
        parts = [_text(v) for f in fields if (v := _dig(record, f)) is not None and (v != "" or f == fields[0])]
        if parts:
            out.append((role, "\n\n".join(parts)))
    return out


def escape(text: str) -> str:
    """Doubles backslashes, then breaks each control string by one backslash after its first character."""
    return _CONTROL.sub(lambda m: m[0][0] + "\\" + m[0][1:], text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted text and the spans under the loss mask, in code points."""
    out, spans, at = [], [], 0
    for role, text in turns:
        mark = OPEN.get(role, f"{ROLE}{escape(role)}{END_ROLE}")
        body = escape(text)
        if role == "assistant":
            spans.append((at + len(mark), at + len(mark) + len(body)))
        part = f"{mark}{body}{CLOSE.get(role, END)}"
        out.append(part)
        at += len(part)
    return "".join(out), spans


def read_back(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted text."""
    roles, turns, at = {v: k for k, v in OPEN.items()}, [], 0
    while at < len(formatted):
        mark = _CONTROL.match(formatted, at)
        at = mark.end()
        if mark[0] == ROLE:
            stop = formatted.index(END_ROLE, at)
            role, close, at = unescape(formatted[at:stop]), END, stop + len(END_ROLE)
        else:
            role, close = roles[mark[0]], CLOSE[roles[mark[0]]]
        stop = formatted.index(close, at)
        turns.append((role, unescape(formatted[at:stop])))
        at = stop + len(close)
    return turns


_SCHEMA = "conv_id long, fingerprint string, formatted string, mask array<struct<start:int,end:int>>, n_turns int"


def format_records(records: DataFrame, conv_id: str = "conv_id", record: str = "record", registry: dict[str, Mapping] | None = None) -> DataFrame:
    """(conv_id, fingerprint, formatted, mask, n_turns) for every row of records, a column of JSON texts.

    A record that is null, not JSON or of an unknown layout has formatted, mask and n_turns null, and its fingerprint
    (null if it isn't JSON) tells which mapping is missing. A record without turns gives an empty text. Null texts and
    roles count as empty ones. Records of any length are formatted whole; repeated rows get equal results.
    """
    registry = REGISTRY if registry is None else registry

    def rows(batches):
        for b in batches:
            out: list[dict] = []
            for i, r in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                row = {"conv_id": i, "fingerprint": None, "formatted": None, "mask": None, "n_turns": None}
                try:
                    value = json.loads(r) if r is not None else None
                except ValueError:
                    value = None
                if value is not None:
                    row["fingerprint"] = fingerprint(paths(value))
                    turns = canonical(value, registry)
                    if turns is not None:
                        text, spans = render(turns)
                        row |= {"formatted": text, "mask": [{"start": s, "end": e} for s, e in spans], "n_turns": len(turns)}
                out.append(row)
            kind = pa.schema([("conv_id", pa.int64()), ("fingerprint", pa.string()), ("formatted", pa.string()), ("mask", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), ("n_turns", pa.int32())])
            yield pa.RecordBatch.from_pylist(out, schema=kind)

    return records.select(F.col(conv_id).cast("long").alias("conv_id"), F.col(record).cast("string").alias("record")).mapInArrow(rows, _SCHEMA)


def records_of(rows: DataFrame) -> DataFrame:
    """(conv_id, record) from rows of (conv_id, turn, role, text): one JSON object for each conversation.

    Turns are put in order of turn (null first), then role and text; every row counts, repeated ones too. Conversations
    of a user's and an assistant's turn, with or without a system turn before, become prompt and response records, all
    others lists whose roles stay as they are. A row without a conv_id belongs to no other: it is a conversation of one turn,
    whose id is null. Texts of any length are taken whole; an empty table gives an empty one.
    """
    t = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    conv = rows.filter("conv_id is not null").groupBy("conv_id").agg(F.sort_array(F.collect_list(t)).alias("turns"))
    conv = conv.unionByName(rows.filter("conv_id is null").select("conv_id", F.array(t).alias("turns")))
    roles = lambda *names: F.col("turns.role") == F.array(*[F.lit(n) for n in names])
    text = lambda n: F.element_at("turns", n)["text"]
    pair = F.struct(text(1).alias("prompt"), F.try_element_at("turns", F.lit(2))["text"].alias("response"))
    three = F.struct(text(1).alias("system"), F.try_element_at("turns", F.lit(2))["text"].alias("prompt"), F.try_element_at("turns", F.lit(3))["text"].alias("response"))
    many = F.struct(F.transform("turns", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text"))).alias("canonical"))
    return conv.select("conv_id", F.when(roles("user", "assistant"), F.to_json(pair)).when(roles("system", "user", "assistant"), F.to_json(three)).otherwise(F.to_json(many)).alias("record"))
