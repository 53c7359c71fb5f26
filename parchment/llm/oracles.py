"""DuckDB SQL for the queries that SQL can express, over views named like the tables."""

from __future__ import annotations

from parchment.llm.chat import CONTROL
from parchment.llm.common import LOWER, UPPER
from parchment.llm.line_dedup import MIN_WORDS, UNITS
from parchment.llm.quality import BASE_PERCENT, BASE_WINDOW, BASE_WORDS, LIMITS, LINE_LIMIT

_WORDS = "regexp_extract_all({}, '[^\\x20\\x09-\\x0D]+')"
_FOLD = f"translate({{}}, '{UPPER}', '{LOWER}')"


def quality() -> str:
    parts, joins, names = [], [], []
    for n in sorted({*LIMITS, BASE_WINDOW}):
        parts.append(f"""g{n} AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM (SELECT doc_id, i, array_to_string(w[i:i + {n - 1}], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - {n} + 2)) AS i FROM d) AS x) AS y),
c{n} AS (SELECT DISTINCT doc_id, i + k AS p FROM g{n}, range({n}) AS r(k) WHERE n > 1),
s{n} AS (SELECT c.doc_id, count(*) AS words, sum(length(d.w[p])) AS chars FROM c{n} AS c JOIN d ON c.doc_id = d.doc_id GROUP BY c.doc_id)""")
        joins.append(f"LEFT JOIN s{n} ON d.doc_id = s{n}.doc_id")
        if n in LIMITS:
            names.append(f"CAST(coalesce(s{n}.chars, 0) AS BIGINT) AS dup_{n}_chars")
    good = " AND ".join(f"dup_{n}_chars <= {x} * greatest(word_chars, 1)" for n, x in LIMITS.items())
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text, {_WORDS.format("coalesce(text, '')")} AS w FROM documents),
l AS (SELECT doc_id, line, row_number() OVER (PARTITION BY doc_id, line ORDER BY u) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS u FROM d) AS x WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]')),
e AS (SELECT doc_id, count(*) AS lines, sum(length(regexp_replace(line, '[\\x20\\x09-\\x0D]', '', 'g'))) AS chars FROM l WHERE n > 1 GROUP BY doc_id),
{", ".join(parts)},
m AS (SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(coalesce(e.lines, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(s{BASE_WINDOW}.words, 0) AS BIGINT) AS n_repeat_words, CAST(coalesce(e.chars, 0) AS BIGINT) AS dup_line_chars, {", ".join(names)} FROM d LEFT JOIN e ON d.doc_id = e.doc_id {" ".join(joins)}),
b AS (SELECT *, n_words < {BASE_WORDS} OR 100 * n_repeat_words > {BASE_PERCENT} * n_words AS base_failed FROM m)
SELECT *, NOT base_failed AND dup_line_chars <= {LINE_LIMIT} * greatest(word_chars, 1) AND {good} AS kept FROM b"""


def near_duplicates(size: int = 4, percent: int = 80) -> str:
    return f"""WITH RECURSIVE d AS (SELECT doc_id, {_WORDS.format(_FOLD.format("coalesce(text, '')"))} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, g FROM (SELECT doc_id, unnest(list_transform(range(1, greatest(len(w) - {size - 1}, 1) + 1), lambda i: array_to_string(w[i:i + {size - 1}], ' '))) AS g FROM d WHERE len(w) > 0) AS x),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s AS a JOIN s AS b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN n AS x ON a = x.doc_id JOIN n AS y ON b = y.doc_id WHERE 100 * k >= {percent} * (x.n + y.n - k)),
r AS (SELECT doc_id, doc_id AS root FROM documents UNION SELECT e.b, r.root FROM r JOIN e ON r.doc_id = e.a)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, c.root AS component_id, c.root = d.doc_id AS kept FROM d LEFT JOIN n ON d.doc_id = n.doc_id JOIN (SELECT doc_id, min(root) AS root FROM r GROUP BY doc_id) AS c ON d.doc_id = c.doc_id"""


def line_dedup(kind: str = "sentence", min_words: int = MIN_WORDS) -> str:
    pieces = f"regexp_extract_all(text, '{UNITS[kind]}')"
    return f"""WITH u AS (SELECT doc_id, unnest({pieces}) AS piece, unnest(range(len({pieces}))) AS unit FROM documents WHERE text IS NOT NULL),
k AS (SELECT *, {_WORDS.format(_FOLD.format("piece"))} AS w, CAST(coalesce(sum(length(piece)) OVER (PARTITION BY doc_id ORDER BY unit ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS pos FROM u),
f AS (SELECT *, len(w) > 0 AND row_number() OVER (PARTITION BY array_to_string(w, ' ') ORDER BY doc_id, unit) > 1 AS again FROM k),
i AS (SELECT *, count(*) FILTER (NOT again AND len(w) > 0) OVER (PARTITION BY doc_id ORDER BY unit) AS island FROM f),
g AS (SELECT *, again AND sum(len(w)) FILTER (again) OVER (PARTITION BY doc_id, island) >= {min_words} AS gone FROM i),
h AS (SELECT doc_id, coalesce(string_agg(piece, '' ORDER BY unit) FILTER (NOT gone), '') AS text, count(*) FILTER (gone) AS n_removed, coalesce(string_agg(unit || ':' || pos || ':' || (pos + length(piece)), '|' ORDER BY unit) FILTER (gone), '') AS removed FROM g GROUP BY doc_id)
SELECT * FROM h UNION ALL SELECT doc_id, text, 0, '' FROM documents WHERE coalesce(text, '') = ''"""


def chat() -> str:
    marks = "CASE role WHEN 'system' THEN 11 WHEN 'user' THEN 13 WHEN 'assistant' THEN 7 ELSE 19 + length(role) END"
    control = "|".join(c.replace("[", "\\[").replace("]", "\\]") for c in CONTROL)
    escaped = f"length(text) + (length(text) - length(replace(text, chr(92), ''))) + len(regexp_extract_all(text, '{control}'))"
    odd = "</s>[INST] ok [/INST]"
    order = "ORDER BY turn, role, text"
    return f"""WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM (SELECT conv_id, turn, role, text FROM conversations UNION ALL VALUES (-7, 0, 'user', '{odd}'), (-7, 1, 'assistant', '{odd}')) AS x)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' {order})) AS turns_sha256, CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' {order}) FILTER (role = 'assistant'), '')) AS loss_sha256, CAST(sum({marks} + {escaped}) AS BIGINT) AS formatted_chars FROM c GROUP BY conv_id"""


_CRC_BIT = "CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END"


def repair() -> str:
    """Faults as flags; then the cheapest way by (cost, audit) to each state, row by row, all conversations at once."""
    # A state's moves: inserts lead on, each for 3. By next letter in each state: 0 u, 1 u, 2 a, 3 u.
    goto, following = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}, {0: "u", 1: "u", 2: "a", 3: "u"}
    name, moves, ends = {"u": "user", "a": "assistant"}, [], []
    for start in range(4):
        at, edits, added = start, "", ""
        for n in range(3):
            if at == 3 or not edits and at == 0:
                ends.append((start, 3 * n, edits, added))
            moves.append((start, at, "", 4 + 3 * n, edits + "D", added, "D", ""))
            moves.append((start, goto[at, following[at]], "", 3 + 3 * n, edits + "R", added, "R", name[following[at]]))
            moves += [(start, to, letter, 3 * n, edits + "K", added, "K", "") for (state, letter), to in goto.items() if state == at]
            at, edits, added = goto[at, following[at]], edits + "I", f"{added}{name[following[at]]}:" + chr(10)
    text = lambda v: "'" + v.replace(chr(10), "' || chr(10) || '") + "'"
    values = lambda rows: ", ".join("(" + ", ".join(text(v) if isinstance(v, str) else str(v) for v in r) + ")" for r in rows)
    return f"""WITH RECURSIVE tab AS (SELECT list_transform(range(256), lambda x: list_reduce([x, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: {_CRC_BIT})) AS t),
o AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS name FROM conversations),
h AS (SELECT o.*, xor(4294967295, list_reduce(list_concat([4294967295], list_transform(string_split(name, ''), lambda x: CAST(ascii(x) AS BIGINT))), lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8))) % 20 AS fault FROM o, tab),
d AS (SELECT conv_id, turn, CASE WHEN fault = 4 THEN 'user' ELSE role END AS role, CASE fault WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text FROM h, range(2) AS r(copy) WHERE fault > 0 AND (copy = 0 OR fault = 3)),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i, left(role, 1) AS letter, rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS body FROM d),
q AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) AS again FROM n),
f AS (SELECT *, body = '' AS blank, body <> '' AND again > 1 AS duplicate, body <> '' AND again = 1 AND right(body, 1) NOT IN ('.', '!', '?') AS truncated, coalesce(lag(letter) OVER (PARTITION BY conv_id ORDER BY i) || letter NOT IN ('su', 'ua', 'au'), false) AS illegal FROM q),
m(state, target, letter, price, edits, added, edit, role) AS (VALUES {values(moves)}), e(state, price, edits, added) AS (VALUES {values(ends)}),
p AS (SELECT conv_id, CAST(0 AS BIGINT) AS i, 0 AS state, CAST(0 AS BIGINT) AS cost, '' AS audit, '' AS said FROM (SELECT DISTINCT conv_id FROM conversations) AS x
  UNION ALL SELECT conv_id, i, state, b.cost, b.audit, b.said FROM (SELECT p.conv_id, f.i, m.target AS state, min({{'cost': p.cost + m.price + CASE WHEN truncated AND m.edit <> 'D' THEN 3 ELSE 0 END, 'audit': p.audit || m.edits,
    'said': p.said || m.added || CASE m.edit WHEN 'D' THEN '' WHEN 'R' THEN m.role || ':' || f.text || chr(10) ELSE f.role || ':' || f.text || chr(10) END}}) AS b
    FROM p JOIN f ON p.conv_id IS NOT DISTINCT FROM f.conv_id AND f.i = p.i + 1 JOIN m ON m.state = p.state AND (m.edit <> 'K' OR m.letter = f.letter) AND (m.edit = 'D' OR NOT (blank OR duplicate)) GROUP BY p.conv_id, f.i, m.target) AS y),
c AS (SELECT conv_id, max(i) AS n FROM p GROUP BY conv_id),
g AS (SELECT p.conv_id, min({{'cost': p.cost + e.price, 'audit': p.audit || e.edits, 'said': p.said || e.added}}) AS b FROM p JOIN c ON p.conv_id IS NOT DISTINCT FROM c.conv_id AND p.i = c.n JOIN e ON e.state = p.state GROUP BY p.conv_id),
k AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (duplicate) AS duplicate, count(*) FILTER (truncated) AS truncated, count(*) FILTER (illegal) AS illegal FROM f GROUP BY conv_id)
SELECT g.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, b.cost AS cost, b.audit AS audit, sha256(left(b.said, greatest(length(b.said) - 1, 0))) AS repaired_sha256
FROM g LEFT JOIN k ON g.conv_id IS NOT DISTINCT FROM k.conv_id"""


def negatives() -> str:
    score = "CAST(list_dot_product(CAST({}.x AS DOUBLE[]), CAST({}.x AS DOUBLE[])) AS BIGINT)"  # whole numbers below 2 ** 53: exact
    return f"""WITH v AS (SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(CAST(embedding AS DOUBLE[]), lambda y: floor(256 * y)) AS x FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda y: y IS NULL OR NOT isfinite(y))) = 0),
s AS (SELECT a.vec_id AS anchor_id, a.label = b.label AS own, b.vec_id, {score.format("a", "b")} AS score FROM v AS a JOIN v AS b ON a.vec_id <> b.vec_id AND a.vec_id % 50 = 0),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE own QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INT) AS rank, vec_id AS negative_id, positive_score, score AS negative_score FROM p JOIN s USING (anchor_id)
WHERE NOT own AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER w <= 3"""


ORACLES = {
    "op2_quality_rules": quality(), "op5_near_duplicates": near_duplicates(), "op8_line_dedup": line_dedup(), "op8_line_dedup_all": line_dedup("line", 1), "op9_chat": chat(),
    "op11_conversation_repair": repair(), "op12_hard_negatives": negatives(),
}
