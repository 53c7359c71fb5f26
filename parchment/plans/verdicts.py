"""Queries of the whole assessment: answers, notes, reasons, flags, summaries and reports, with SQL that states each rule again."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from parchment.config import ANSWER_KEYS, INFORMATIONAL, PILLARS, RED_PHRASES, REPORT_PILLARS, TEMPLATE_ARTIFACTS
from parchment.operators import assess, extract, lookups, report, rules, signals
from parchment.plans.catalog import _LINES, _MADE, _ONLINE, _SHEETS, _SUM, _YEAR, FEATURES, ORACLES, _list, _quote, chain, query
from parchment.plans.letters_sql import EXTRACTED, LETTERS
from parchment.plans.settings import SUITED
from parchment.sources import letters as src
from parchment.sources import store

LISTS = ["red_phrases", "artifacts", "warnings", "tampering", "composites"]

# ---------------------------------------------------------------- the scorer's answer

_OBJECT = "coalesce(TRY_CAST(regexp_replace(response, '```json|```', '', 'g') AS JSON), TRY_CAST(nullif(regexp_extract(response, '(?s)\\{.*\\}'), '') AS JSON))"


def _whole(key: str) -> str:
    """A JSON number cut to a whole one, or a string of digits."""
    v = f"CAST(j -> '$.{key}' AS VARCHAR)"
    return f"CASE WHEN {v} LIKE '\"%' THEN TRY_CAST(nullif(regexp_extract({v}, '^\"\\s*([+-]?[0-9]+)\\s*\"$', 1), '') AS INT) ELSE CAST(trunc(TRY_CAST({v} AS DOUBLE)) AS INT) END"


_SCORES = ", ".join(f"{f'CASE WHEN images THEN {_whole(k + chr(95) + "score")} END' if n in ('image', 'signature') else _whole(k + '_score')} AS {n}_score, coalesce(j ->> '$.{k}_reasoning', '') AS {n}_reasoning" for n, k in ANSWER_KEYS.items())
_RAW = "CASE WHEN json_type(j -> '$.flags') = 'ARRAY' THEN (CAST(j -> '$.flags' AS JSON[]))[1:15] ELSE [] END"
_FLAGS = f"list_transform({_RAW}, lambda f: {{'severity': coalesce(f ->> '$.severity', 'yellow'), 'title': coalesce(f ->> '$.title', ''), 'detail': coalesce(f ->> '$.detail', '')}})"
def answers(details: str) -> str:
    """CTEs up to a2: the scorers' answers, parsed, over details (SQL)."""
    return f"""a0 AS (SELECT *, n_rendered > 0 AS images, {_OBJECT} AS parsed FROM ({details}) AS z), a1 AS (SELECT *, CASE WHEN json_type(parsed) = 'OBJECT' AND len(json_keys(parsed)) > 0 THEN parsed END AS j FROM a0),
a2 AS (SELECT *, {_SCORES}, {_FLAGS} AS model_flags, coalesce(CAST(j -> '$.warnings' AS VARCHAR[]), []) AS model_warnings, j IS NULL AS failed, nullif(j ->> '$.company_name_found', '') AS name_found,
  CASE WHEN j IS NULL THEN 'AI scoring could not be completed (unreadable response) — manual review required' ELSE coalesce(j ->> '$.summary', '') END AS summary, CASE WHEN j IS NULL THEN 'REVIEW' ELSE coalesce(j ->> '$.recommended_action', 'REVIEW') END AS advice FROM a1)"""


ANSWERS = answers(src.plain(src.DETAILS))


def _details(spark, sf_dir):
    df = src.build(spark, sf_dir, src.DETAILS)
    df = df.withColumns({c: F.when(F.col(c) == "", F.array().cast("array<string>")).otherwise(F.split(c, "\\|")) for c in LISTS})
    return df.withColumn("answer", rules.parse_scores(F.col("response"), F.col("n_rendered") > 0)).drop("response")


_FLAG_TEXT = "array_to_string(list_transform(model_flags, lambda f: f.severity || '/' || f.title || '/' || f.detail), '|')"


@query("score_answers", f"WITH {ANSWERS} SELECT letter_id, {', '.join(f'{n}_score, {n}_reasoning' for n in ANSWER_KEYS)}, {_FLAG_TEXT} AS flags, array_to_string(model_warnings, '|') AS warnings, name_found, summary, advice, failed FROM a2")
def _(spark, sf_dir):
    """All that an answer holds: scores, reasonings, at most 15 flags, lists, and what to do when it cannot be read."""
    a = lambda c: F.col(f"answer.{c}")
    flags = F.array_join(F.transform(a("flags"), lambda f: F.concat_ws("/", f["severity"], f["title"], f["detail"])), "|")
    names = [a(f"{n}_{k}").alias(f"{n}_{k}") for n in ANSWER_KEYS for k in ("score", "reasoning")]
    return _details(spark, sf_dir).select("letter_id", *names, flags.alias("flags"), F.array_join(a("warnings"), "|").alias("warnings"), a("company_name_found").alias("name_found"), a("summary").alias("summary"), a("advice").alias("advice"), a("failed").alias("failed"))


_AMOUNTS = "CASE CAST(o_orderkey % 7 AS INT) WHEN 0 THEN NULL WHEN 1 THEN concat('₹ ', CAST(o_orderkey AS STRING), ',000.50') WHEN 2 THEN concat('Rs. ', CAST(o_orderkey AS STRING)) WHEN 3 THEN 'twelve' WHEN 4 THEN '' WHEN 5 THEN concat('Rs', CAST(o_orderkey AS STRING), ' ,5') ELSE CAST(o_orderkey AS STRING) END"


@query("tolerant_float", f"SELECT o_orderkey AS letter_id, TRY_CAST(nullif(regexp_replace(v, '[₹,\\s]|Rs\\.?\\s*', '', 'g'), '') AS DOUBLE) AS amount FROM (SELECT o_orderkey, {_AMOUNTS} AS v FROM orders) AS x")
def _(spark, sf_dir):
    df = src.build(spark, sf_dir, f"SELECT o_orderkey AS letter_id, {_AMOUNTS} AS v FROM {{orders}}")
    return df.select("letter_id", rules.tolerant_float(F.col("v")).alias("amount"))


# ---------------------------------------------------------------- the assessment

_FACTS = ["letter_id", "domain", "offer_date", "joining_date", "ctc", "basic", "hra", "special", "pf_employer", "gratuity", "dns_valid", "dns_error", "mx", "found", "checked"]
#: Fields that the facts do not hold, spelled from the key.
_MORE = """SELECT o_orderkey AS letter_id, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE concat('Nova & ', CAST(o_orderkey % 50 AS STRING), ' Ltd.') END AS company_name, CASE WHEN o_orderkey % 5 < 3 THEN 'No. 4, Main Road' END AS company_address, CASE WHEN o_orderkey % 3 > 0 THEN 'Asha Rao' END AS candidate_name,
  CASE WHEN o_orderkey % 7 > 1 THEN 'Clerk' END AS job_title, CASE WHEN o_orderkey % 8 > 4 THEN 'HR Manager' END AS hr_designation, CAST(NULL AS DOUBLE) AS gross, CASE WHEN o_orderkey % 6 = 1 THEN 'hr@nova.in' END AS company_email, CAST(NULL AS STRING) AS registration, CASE WHEN o_orderkey % 9 = 2 THEN 'Meera Sen' END AS hr_name,
  CASE WHEN o_orderkey % 2 = 0 THEN 'Full-time' END AS employment_type, CASE WHEN o_orderkey % 3 = 0 THEN 'Pune' END AS work_location, 'rules' AS source, concat('inbox/Letter ', CAST(o_orderkey AS STRING), ' (final).v2.pdf') AS file_name FROM {orders}"""


def _assessed(spark, sf_dir):
    facts, more = src.build(spark, sf_dir, src.FACTS).select(*_FACTS), src.build(spark, sf_dir, _MORE)
    return assess.assess(facts.join(more, "letter_id").join(_details(spark, sf_dir), "letter_id"), SUITED)


_BOTH = ["company_name", "company_address", "candidate_name", "job_title", "hr_designation"]
_FULL = " + ".join([*(f"CASE WHEN coalesce(CAST({c} AS VARCHAR), '') = '' THEN 0 ELSE 1 END" for c in [*_BOTH, "offer_date", "joining_date", "logo", "signature"]), "CASE WHEN coalesce(ctc, 0) <> 0 OR coalesce(gross, 0) <> 0 THEN 1 ELSE 0 END"])
_SPLIT = ", ".join(f"CASE WHEN {c} = '' THEN [] ELSE string_split({c}, '|') END AS {c}" for c in LISTS)


def rich(fields: str, details: str | None = None) -> str:
    """CTEs up to k: the chain of rules over facts of which `fields` (SQL) holds the letters' own part, with all texts. details: other ones than DETAILS."""
    base = f"""SELECT f.*, d.* EXCLUDE (letter_id, parsed, j, response) REPLACE ({_SPLIT}), len(CASE WHEN d.red_phrases = '' THEN [] ELSE string_split(d.red_phrases, '|') END) AS n_red, d.artifacts <> '' AS template, coalesce(d.suspicious, false) AS suspicious_metadata,
  d.online_tool IS NOT NULL AS online_edit, d.tampering <> '' AS floating_date, d.composites <> '' AS composite, round(({_FULL}) / 10.0, 2) AS completeness_ FROM ({fields}) AS f JOIN a2 AS d ON f.letter_id = d.letter_id"""
    say = lambda *parts: " || ".join(p if p.startswith("(") else _quote(p) for p in parts)
    gap = f"CASE WHEN gap_days IS NULL THEN 'Could not determine dates' WHEN gap_days < 0 THEN {say('Joining date is ', '(abs(gap_days))', ' days BEFORE offer date — impossible')} WHEN gap_days > 90 THEN {say('(gap_days)', ' days gap — unusually long (over 90 days)')} WHEN gap_days < 3 THEN {say('Only ', '(gap_days)', ' day(s) gap — very short, worth noting')} ELSE {say('Gap of ', '(gap_days)', ' days is within normal range')} END"
    tail = [(0, ' days old (over 1 year) — likely reused/recycled fraud'), (1, ' days old (6+ months) — unusually stale, may be resurrected'), (2, ' days old (3+ months) — consider verifying with company'), (3, ' days old — recent, normal range')]
    aged = [say('Offer is ', '(age_days)', t) for _, t in tail]
    age = f"CASE WHEN age_days IS NULL THEN 'Recent offer' WHEN age_days < 0 THEN {say('Offer dated ', '(-age_days)', ' days in the FUTURE — impossible')} WHEN age_days > 365 THEN {aged[0]} WHEN age_days > 180 THEN {aged[1]} WHEN age_days > 90 THEN {aged[2]} ELSE {aged[3]} END"
    money = lambda v: f"format('{{:,}}', CAST(round_even({v}, 0) AS BIGINT))"
    pay = f"""CASE WHEN salary_ok IS NULL THEN 'Insufficient data to verify salary math' WHEN salary_ok THEN 'Salary components account for ' || salary_percent || '% of CTC — remainder is variable pay / benefits (normal)'
    WHEN {_YEAR} > 1.05 * ctc THEN 'Salary components (' || {money(_YEAR)} || ') exceed stated CTC (' || {money('ctc')} || ') — impossible' ELSE 'Salary components account for only ' || salary_percent || '% of CTC — too many major components missing or numbers manipulated' END"""
    reason = """CASE p.reason WHEN 'template' THEN 'Unfilled placeholders: ' || array_to_string(artifacts[1:4], ', ') WHEN 'red phrases' THEN 'Fraud language: ' || array_to_string(red_phrases, ', ') WHEN 'impossible date' THEN 'Date issue: ' || gap_note WHEN 'salary math' THEN 'Salary math: ' || salary_note
    WHEN 'metadata' THEN 'Metadata: ' || coalesce(metadata_reasons, 'None') WHEN 'online edit' THEN 'PDF processed with ' || online_tool || ' — verify original source' WHEN 'incomplete' THEN 'Document only ' || CAST(CAST(completeness AS DECIMAL(10, 2)) * 100 AS INT) || '% complete — key fields missing' ELSE 'Offer age: ' || age_note END"""
    marks = "array_to_string(list_filter([CASE WHEN n_red > 0 THEN 'fraud language (' || array_to_string(red_phrases[1:3], ', ') || ')' END, CASE WHEN template THEN 'unfilled placeholder(s) (' || array_to_string(artifacts[1:3], ', ') || ')' END, CASE WHEN gap_days < 0 THEN 'joining date before offer date (impossible)' END, CASE WHEN age_days < 0 THEN 'offer dated in the future (impossible)' END], lambda m: m IS NOT NULL), '; ')"
    why = f"""CASE WHEN gate = 'composite forgery' THEN 'Composited document forgery: ' || composites[1] || '. Content was overlaid onto a blank letterhead and flattened — fabricated, not a genuine letter.'
    WHEN gate = 'edited date' THEN 'Confirmed edit-laundering: ' || online_tool || ' footprint together with an edit artifact (' || tampering[1] || ') — content was altered and re-saved. Treated as suspicious; manual verification against the original required.'
    WHEN gate = 'fraud signal' THEN 'Deterministic fraud marker(s) detected — ' || {marks} || ' — cannot auto-approve.' WHEN gate = 'company not found' THEN 'Company has no verifiable online presence (DNS + web both failed) — cannot auto-approve.'
    WHEN gate IS NOT NULL AND score >= 80 THEN 'Visual analysis incomplete — auto-accept blocked. Human review of signatures and images required.' WHEN gate IS NOT NULL THEN 'Visual analysis incomplete — conservative scores applied. Human review required.' END"""
    flag = lambda when, severity, title, detail: f"CASE WHEN {when} THEN {{'severity': {severity if severity.startswith('CASE') else _quote(severity)}, 'title': {_quote(title)}, 'detail': {detail}}} END"
    loud = " AND ".join(f"NOT starts_with(w, {_quote(i)})" for i in INFORMATIONAL)
    one = lambda severity, title, detail: f"{{'severity': {severity}, 'title': {_quote(title)}, 'detail': {detail}}}"
    flags = f"""list_concat(list_filter([{flag('failed', 'red', 'AI Scoring Failed', _quote('The AI returned an unreadable response, so all pillar scores fell back to conservative values. This score is NOT reliable — manual review required.'))}, {flag('gate IS NOT NULL', 'yellow', 'Visual Analysis Incomplete', 'gate_reason')}], lambda f: f IS NOT NULL), model_flags,
    list_filter([{flag('domain IS NOT NULL AND NOT dns_valid', 'yellow', 'Domain Does Not Resolve', "domain || ' — ' || coalesce(nullif(dns_note, ''), 'could not verify domain')")}, {flag('domain IS NOT NULL AND dns_valid AND NOT mx', 'yellow', 'No Mail Server Found', "domain || ' has no MX records — company may use Gmail or third-party email'")},
      {flag('gap_days BETWEEN 0 AND 2', 'yellow', 'Very Short Joining Gap', 'gap_note')}], lambda f: f IS NOT NULL),
    list_transform(penalty_reasons, lambda p: {one("CASE WHEN abs(p.points) >= 10 THEN 'red' ELSE 'yellow' END", 'Risk Signal Detected', 'p.reason')}), list_transform(list_filter(warnings, lambda w: {loud}), lambda w: {one("'yellow'", 'Document Processing Issue', "w || ' — some analysis may be based on partial data.'")}),
    list_transform(tampering, lambda a: {one("'yellow'", 'Possible Edit Artifact', "a || ' — a date appears outside the normal sentence/table flow, which can indicate the date was edited.' || CASE WHEN online_tool IS NULL THEN '' ELSE ' PDF also processed with ' || online_tool || '.' END || ' Verify against the original.'")}))"""
    first = "list_concat(list_filter(raised, lambda f: f.severity = 'red'), list_filter(raised, lambda f: f.severity NOT IN ('red', 'green')), list_filter(raised, lambda f: f.severity = 'green'))"
    available = "n_rendered > 0"
    seen = f"CASE WHEN {available} THEN 'Page renders available for visual analysis (' || n_rendered || ' pages).' ELSE 'No rendered pages — conservative scores will apply.' END"
    online = f"CAST(({_ONLINE}) AS VARCHAR) || '/11: ' || CASE WHEN dns_valid THEN 'domain resolves (+4)' WHEN domain IS NOT NULL THEN 'domain ' || chr(39) || domain || chr(39) || ' does not resolve' ELSE 'no domain to verify' END || '; ' || CASE WHEN found THEN 'online presence confirmed (+7) — ' ELSE 'no online presence — ' END || coalesce(online_note, '') || '.'"
    lost = {"image": "Images not extractable from PDF", "signature": "Images not extractable from PDF", "online": "Online/DNS verification could not complete (network/system error)"}

    def reasoning(n: str) -> str:
        notice = _quote(f"{lost.get(n, 'AI response incomplete')} — conservative score applied ({PILLARS[n] / 2}/{PILLARS[n]}). Manual review required.")
        own = online if n == "online" else f"{n}_reasoning"
        if n in ("image", "signature"):
            place = "logo" if n == "image" else "signature"
            own = f"coalesce(nullif({n}_reasoning, ''), CASE WHEN {place} IS NULL THEN 'No raster {place} extracted' ELSE '{place.title()} detected at ' || {place} END)"
        return f"CASE WHEN {n}_score IS NULL THEN {notice} ELSE {own} END AS {n}_why"

    return f"""{ANSWERS if details is None else answers(details)}, {chain(base, 'completeness_')},
k0 AS (SELECT *, {gap} AS gap_note, {age} AS age_note, {pay} AS salary_note, CASE WHEN gap_days IS NOT NULL THEN gap_days BETWEEN 0 AND 90 END AS gap_valid, coalesce(company_name, name_found) AS name_shown, {seen} AS images_reasoning, {', '.join(map(reasoning, PILLARS))} FROM j),
k1 AS (SELECT *, list_transform(penalties, lambda p: {{'reason': {reason}, 'points': p.points}}) AS penalty_reasons, {why} AS gate_reason FROM k0),
k2 AS (SELECT *, {flags} AS raised FROM k1), k AS (SELECT *, {first} AS all_flags FROM k2)"""


FIELDS = f"SELECT {', '.join('f.' + c for c in _FACTS)}, m.* EXCLUDE (letter_id) FROM ({src.plain(src.FACTS)}) AS f JOIN ({src.plain(_MORE)}) AS m ON f.letter_id = m.letter_id"
RICH = f"WITH {rich(FIELDS)}"


def _part(name: str, sql: str, columns, doc: str) -> None:
    """A query of some columns of the assessment. columns(): name to a Spark column over assess()'s."""

    @query(name, f"{RICH} SELECT letter_id, {sql} FROM k")
    def run(spark, sf_dir):
        return _assessed(spark, sf_dir).select("letter_id", *[c.alias(n) for n, c in columns().items()])

    run.__doc__ = doc


_joined = lambda c, *fields: F.array_join(F.transform(c, lambda x: F.concat_ws("/", *[x[f].cast("string") for f in fields])), "|")
_part("rule_notes", "gap_note, age_note, salary_note, gap_valid", lambda: {n: F.col(n) for n in ("gap_note", "age_note", "salary_note", "gap_valid")}, "What is said of dates, age and salary.")
_part("penalty_reasons", "array_to_string(list_transform(penalty_reasons, lambda p: p.reason || '/' || p.points), '|') AS penalties", lambda: {"penalties": _joined(F.col("penalty_reasons"), "reason", "points")}, "Penalties as they are shown.")
_part("gate_reasons", "gate, gate_reason, verdict, final_score, action", lambda: {n: F.col(n) for n in ("gate", "gate_reason", "verdict", "final_score", "action")}, "The gate that fired last, and why.")
_part("flag_details", "array_to_string(list_transform(all_flags, lambda f: f.severity || '/' || f.title || '/' || f.detail), '|') AS flags", lambda: {"flags": _joined(F.col("flags"), "severity", "title", "detail")}, "All flags in their order.")
_WHY = "array_to_string([" + ", ".join(f"'{n}/' || CASE WHEN {n}_score IS NULL THEN '{w / 2}' ELSE CAST(CAST({n}_score AS DOUBLE) AS VARCHAR) END || '/' || {n}_why" for n, w in PILLARS.items()) + "], '|')"
_part("pillar_reasonings", f"{_WHY} AS pillars", lambda: {"pillars": _joined(F.col("pillars"), "pillar", "score", "reasoning")}, "The nine pillars with their reasonings.")
_IMAGES = "CASE WHEN logo IS NULL THEN 'absent' ELSE 'present' END AS logo_, CASE WHEN logo IS NULL THEN 'No raster logo extracted' ELSE 'Logo detected at ' || logo END AS logo_note, CASE WHEN signature IS NULL THEN 'absent' ELSE 'present' END AS signature_, CASE WHEN signature IS NULL THEN 'No raster signature extracted' ELSE 'Signature detected at ' || signature END AS signature_note, CASE WHEN has_stamp THEN 'present' ELSE 'absent' END AS stamp, n_rendered > 0 AS images_available, images_reasoning, logo IS NOT NULL AS has_logo, logo AS logo_position"
_part(
    "image_details", _IMAGES,
    lambda: {"logo_": F.col("image_details.logo"), "logo_note": F.col("image_details.logo_note"), "signature_": F.col("image_details.signature"), "signature_note": F.col("image_details.signature_note"), "stamp": F.col("stamp_assessment"), "images_available": F.col("image_details.images_available"), "images_reasoning": F.col("images_reasoning"), "has_logo": F.col("image_details.has_logo"), "logo_position": F.col("image_details.logo_position")},
    "What is there of logo, signature and stamp, and how many pages a model can see.",
)
_SQL_NAMES = {"company_name": "name_shown", "department": "NULL", "red_phrases": "array_to_string(red_phrases, '|')", "artifacts": "array_to_string(artifacts, '|')", "offer_date": "CAST(offer_date AS VARCHAR)", "joining_date": "CAST(joining_date AS VARCHAR)", "created_on": "CAST(created_on AS VARCHAR)", "modified_on": "CAST(modified_on AS VARCHAR)"}
_text = lambda n, c: F.array_join(F.col(f"letter_summary.{n}"), "|") if c in LISTS else F.col(f"letter_summary.{n}").cast("string") if n.endswith("_date") or c is None else F.col(f"letter_summary.{n}")
_part("letter_summary", ", ".join(f"{_SQL_NAMES.get(c or 'department', c)} AS {n}" for n, c in assess.SUMMARY.items()), lambda: {n: _text(n, c) for n, c in assess.SUMMARY.items()}, "The thirty values of the summary.")

# ---------------------------------------------------------------- reports

_E = lambda v: f"replace(replace(replace(replace(replace({v}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), chr(34), '&quot;'), chr(39), '&#x27;')"
_ROWS = [
    ("Company", "name_shown"), ("Candidate", "candidate_name"), ("Position", "job_title"), ("Employment Type", "employment_type"), ("Offer Date", "CAST(offer_date AS VARCHAR)"), ("Joining Date", "CAST(joining_date AS VARCHAR)"), ("Date Gap", "gap_days || ' days'"), ("Work Location", "work_location"),
    ("HR Name", "hr_name"), ("HR Designation", "hr_designation"), ("CTC Annual", "CASE WHEN ctc <> 0 THEN '₹ ' || format('{:,}', CAST(round_even(ctc, 0) AS BIGINT)) END"), ("Completeness", "CAST(round_even(completeness * 100, 0) AS INT) || '%'"), ("Red Phrases", "CASE WHEN n_red > 0 THEN array_to_string(red_phrases, ', ') ELSE 'None found' END"),
    ("Salary Math", "CASE WHEN salary_ok THEN 'Correct' WHEN NOT salary_ok THEN 'Mismatch' ELSE 'N/A' END"), ("PDF Created With", "created_with"), ("PDF Author", "author"), ("PDF Created", "CAST(created_on AS VARCHAR)"), ("PDF Modified", "CAST(modified_on AS VARCHAR)"),
    ("Metadata", "CASE WHEN suspicious THEN metadata_reasons WHEN created_with IS NOT NULL THEN 'Clean' END"),
]
_TABLE = "list_filter([" + ", ".join(f"{{'label': '{n}', 'value': {v}}}" for n, v in _ROWS) + "], lambda r: coalesce(r.value, '') <> '')"


def _bar(n: str, title: str) -> str:
    w = PILLARS[n]
    percent = f"CAST(round_even({n}_score * 100.0 / {w}, 0) AS INT)"
    band = f"CASE WHEN {n}_score IS NULL THEN 'medium' WHEN {percent} >= 66 THEN 'high' WHEN {percent} >= 33 THEN 'medium' ELSE 'low' END"
    shown = f"CASE WHEN {n}_score IS NULL THEN '{w / 2:g}' ELSE CAST({n}_score AS VARCHAR) END || '/{w}'"
    why = f"CASE WHEN {n}_score IS NULL THEN '⚠ Conservative score applied — manual visual check required' ELSE {n}_why END"
    return f"{{'name': {_quote(title)}, 'score': {shown}, 'band': {band}, 'percent': CASE WHEN {n}_score IS NULL THEN 50 ELSE {percent} END, 'reason': {why}}}"


_BARS = "[" + ", ".join(_bar(n, t) for n, t in REPORT_PILLARS.items()) + "]"
_part("report_rows", f"array_to_string(list_transform({_TABLE}, lambda r: r.label || '=' || r.value), '|') AS overview", lambda: {"overview": F.array_join(F.transform(report.overview(), lambda r: F.concat_ws("=", r["label"], r["value"])), "|")}, "The overview's rows.")
_part("report_pillars", f"array_to_string(list_transform({_BARS}, lambda p: p.name || '/' || p.score || '/' || p.band || '/' || p.percent || '/' || p.reason), '|') AS pillars", lambda: {"pillars": _joined(report.pillar_rows(), "name", "score", "band", "percent", "reason")}, "The nine pillar rows.")
_LI = lambda severity, title: f"CASE WHEN len(list_filter(all_flags, lambda f: f.severity = '{severity}')) > 0 THEN '<h2 class=\"{severity}\">{title} (' || len(list_filter(all_flags, lambda f: f.severity = '{severity}')) || ')</h2><ul>' || array_to_string(list_transform(list_filter(all_flags, lambda f: f.severity = '{severity}'), lambda f: '<li><b>' || {_E('f.title')} || '</b> ' || {_E('f.detail')} || '</li>'), '') || '</ul>' ELSE '' END"
_PAGE = f"""'<html><h1>' || {_E('verdict')} || '</h1><p class="score">' || final_score || '</p><p class="action">' || {_E('action')} || '</p>' || CASE WHEN gate_reason IS NULL THEN '' ELSE '<div class="gate">' || {_E('gate_reason')} || '</div>' END
|| '<table>' || array_to_string(list_transform({_TABLE}, lambda r: '<tr><td>' || {_E('r.label')} || '</td><td>' || {_E('r.value')} || '</td></tr>'), '') || '</table>' || array_to_string(list_transform({_BARS}, lambda p: '<div class="' || p.band || '"><b>' || {_E('p.name')} || '</b> ' || p.score || '<p>' || {_E('p.reason')} || '</p></div>'), '')
|| CASE WHEN len(penalty_reasons) = 0 THEN '' ELSE '<ul class="risks">' || array_to_string(list_transform(penalty_reasons, lambda p: '<li>' || {_E('p.reason')} || '</li>'), '') || '</ul>' END || {_LI('red', 'Critical Issues')} || {_LI('yellow', 'Warnings')} || {_LI('green', 'Passed Checks')} || '</html>'"""


@query("report_page", f"{RICH} SELECT letter_id, final_score AS shown, md5({_PAGE}) AS page FROM k")
def _(spark, sf_dir):
    """Whole reports as HTML, with the score read back."""
    df = _assessed(spark, sf_dir).select("letter_id", report.page().alias("page"))  # a stage of its own: both columns read one page
    return df.select("letter_id", report.score_of(F.col("page")).alias("shown"), F.md5("page").alias("page"))


_SLUG = lambda v, n: f"substr(trim(regexp_replace({v}, '[^a-zA-Z0-9]+', '_', 'g'), '_'), 1, {n})"
_STEM = "regexp_replace(regexp_extract(file_name, '[^/]+$'), '[.][^.]*$', '')"
_part(
    "report_names", f"{_SLUG(_STEM, 30)} || '_' || {_SLUG(chr(99) + 'oalesce(name_shown, ' + _quote('Unknown') + ')', 20)} || '_' || {_SLUG('coalesce(candidate_name, ' + _quote('Unknown') + ')', 18)} || '_{SUITED.as_of}_s' || final_score || '_' || substr(md5(file_name), 1, 4) || '.html' AS report",
    lambda: {"report": report.file_name(F.col("file_name"), F.col("company_name"), F.col("candidate_name"), F.lit(SUITED.as_of), F.col("final_score"))}, "The names that reports are saved under.",
)

# ---------------------------------------------------------------- letters all the way: extracted fields, joined facts, parsed answers

_LOOKUPS = "SELECT DISTINCT concat('nova', CAST(o_custkey % 500 AS STRING), '.co.in') AS domain, o_custkey % 500 % 3 > 0 AS dns_valid, o_custkey % 500 % 4 > 0 AS mx, o_custkey % 500 % 11 = 0 AS lookup_error FROM {orders}"
_PRESENCE = "SELECT o_orderkey AS letter_id, o_orderkey % 4 < 2 AS found, o_orderkey % 9 <> 0 AS checked FROM {orders}"
_JOINED = f"""SELECT x.letter_id, x.domain, x.offer_date, x.joining_date, x.ctc, x.gross, x.basic, x.hra, x.special, x.pf_employer, x.gratuity, {', '.join('x.' + c for c in _BOTH)}, coalesce(d.dns_valid, false) AS dns_valid, coalesce(d.mx, false) AS mx,
  CASE WHEN x.domain IS NULL THEN false ELSE coalesce(d.lookup_error, true) END AS dns_error, o.found, o.checked FROM x LEFT JOIN ({src.plain(_LOOKUPS)}) AS d ON x.domain = d.domain JOIN ({src.plain(_PRESENCE)}) AS o ON x.letter_id = o.letter_id"""


def _store(spark, sf_dir):
    """The letters' six tables in one store: what lies in them of one letter is in the same bucket."""
    tables = {"letters": src.letters(spark, sf_dir).select("letter_id", "full_text")} | {n: src.build(spark, sf_dir, sql) for n, sql in (("pages", _SHEETS), ("lines", _LINES), ("images", src.IMAGES), ("meta", src.META))}
    tables["features"] = spark.sql(f"{FEATURES} FROM (SELECT DISTINCT letter_id, page_no FROM {{images}})", images=tables["images"])
    return store.put(spark, tables, store.shared_folder(spark), f"letters_{uuid.uuid4().hex}")


def _letters_assessed(spark, sf_dir):
    tables = _store(spark, sf_dir)
    own = signals.signals(*[tables[n] for n in ("letters", "pages", "features", "lines", "images", "meta")], SUITED.as_of)
    rest = src.build(spark, sf_dir, src.DETAILS).select("letter_id", "warnings", "dns_note", "online_note", "response")
    asked = own.join(rest, "letter_id").withColumn("warnings", F.filter(F.split("warnings", "\\|"), lambda w: w != ""))
    asked = asked.withColumn("answer", rules.parse_scores(F.col("response"), F.col("n_rendered") > 0)).drop("response")
    letters = extract.extract(tables["letters"], SUITED).withColumn("source", F.lit("rules"))
    known = lookups.join_dns(letters, src.build(spark, sf_dir, _LOOKUPS)).withColumnRenamed("lookup_error", "dns_error").withColumn("mx", F.coalesce("mx", F.lit(False)))
    return assess.assess(known.join(src.build(spark, sf_dir, _PRESENCE), "letter_id").join(asked, "letter_id"), SUITED)


_FINDINGS = f"SELECT letter_id, string_agg(finding, '|' ORDER BY page_no, line_no, finding) AS v FROM ({ORACLES['floating_dates']}) AS y GROUP BY letter_id"
_SMALL = f"SELECT letter_id, page_no, count(*) FILTER (CAST(px_w AS BIGINT) * px_h < 80000) AS n FROM ({src.plain(src.IMAGES)}) AS y GROUP BY letter_id, page_no"
_COMPOSED = f"SELECT c.letter_id, string_agg('page ' || c.page_no || ': ' || replace({_quote(signals.COMPOSED)}, '{{n}}', CAST(n AS VARCHAR)), '|' ORDER BY c.page_no) AS v FROM ({ORACLES['composite_forgery']}) AS c JOIN ({_SMALL}) AS s ON c.letter_id = s.letter_id AND c.page_no = s.page_no GROUP BY c.letter_id"
_TEXT_SIGNS = f"SELECT letter_id, array_to_string(list_filter({_list(RED_PHRASES)}, lambda p: contains(lower(full_text), lower(p))), '|') AS red, array_to_string(list_concat(list_filter({_list(TEMPLATE_ARTIFACTS)}, lambda p: contains(lower(full_text), lower(p))), regexp_extract_all(full_text, '\\[[A-Z][A-Z\\s]{{2,}}\\]')), '|') AS holders FROM letters"
#: DETAILS with every column that a letter's own stage computes replaced by it.
_OWN = f"""SELECT z.* REPLACE (coalesce(t.red, '') AS red_phrases, coalesce(t.holders, '') AS artifacts, coalesce(l.v, '') AS tampering, coalesce(c.v, '') AS composites, {_MADE} AS created_with, m.author AS author, CAST(m.created AS DATE) AS created_on, CAST(m.modified AS DATE) AS modified_on,
  r.reasons <> '' AS suspicious, nullif(r.reasons, '') AS metadata_reasons, r.online_tool AS online_tool, i.logo AS logo, i.signature AS signature, coalesce(i.has_stamp, false) AS has_stamp, coalesce(len(string_split(p.pages, ',')), 0) AS n_rendered)
FROM ({src.plain(src.DETAILS)}) AS z JOIN ({_TEXT_SIGNS}) AS t ON z.letter_id = t.letter_id LEFT JOIN ({_FINDINGS}) AS l ON z.letter_id = l.letter_id LEFT JOIN ({_COMPOSED}) AS c ON z.letter_id = c.letter_id LEFT JOIN ({src.plain(src.META)}) AS m ON z.letter_id = m.letter_id
LEFT JOIN ({ORACLES['metadata_suspicion']}) AS r ON z.letter_id = r.letter_id LEFT JOIN ({ORACLES['image_classify']}) AS i ON z.letter_id = i.letter_id LEFT JOIN ({ORACLES['page_selection']}) AS p ON z.letter_id = p.letter_id"""


@query("letter_signals", f"{LETTERS} SELECT letter_id, red_phrases, artifacts, tampering, composites, created_with, author, CAST(created_on AS VARCHAR) AS created_on, suspicious, metadata_reasons, online_tool, logo, signature, has_stamp, CAST(n_rendered AS BIGINT) AS n_rendered FROM ({_OWN}) AS s")
def _(spark, sf_dir):
    """What each letter's own texts, pages, lines, images and metadata tell, joined without an exchange."""
    tables = _store(spark, sf_dir)
    df = signals.signals(*[tables[n] for n in ("letters", "pages", "features", "lines", "images", "meta")], SUITED.as_of)
    joined = [F.concat_ws("|", c).alias(c) for c in ("red_phrases", "artifacts", "tampering", "composites")]
    return df.select("letter_id", *joined, "created_with", "author", F.col("created_on").cast("string").alias("created_on"), "suspicious", "metadata_reasons", "online_tool", "logo", "signature", "has_stamp", F.col("n_rendered").cast("long").alias("n_rendered"))


@query("letter_verdicts", f"{EXTRACTED}, {rich(_JOINED, _OWN)} SELECT letter_id, verdict, final_score, action, gate_reason, array_to_string(list_transform(all_flags, lambda f: f.severity || '/' || f.title || '/' || f.detail), '|') AS flags FROM k")
def _(spark, sf_dir):
    """Letters from their texts, pages, images and metadata to their verdicts: fields extracted, domains looked up, presence and answers joined."""
    return _letters_assessed(spark, sf_dir).select("letter_id", "verdict", "final_score", "action", "gate_reason", _joined(F.col("flags"), "severity", "title", "detail").alias("flags"))


_SENT = {
    "company": ("$.company.name", "name_shown"), "gap_note": ("$.dates.gap_note", "gap_note"), "impossible": ("$.dates.gap_impossible", "CASE WHEN coalesce(gap_days < 0, false) THEN 'true' ELSE 'false' END"), "pay_note": ("$.salary.math_check.discrepancy_note", "salary_note"),
    "hr_email": ("$.hr.email", "hr_email"), "red": ("$.document.red_phrases_found[0]", "red_phrases[1]"), "tool": ("$.document.online_edit_tool", "online_tool"), "made": ("$.document.created_with", "created_with"), "notes": ("$.extraction_notes", "'rules'"), "snippet": ("$.document.full_text_snippet", "full_text[1:4000]"),
}


@query("scoring_contexts", f"{EXTRACTED}, {rich(_JOINED.replace('x.letter_id, ', 'x.letter_id, x.full_text, x.hr_email, ', 1), _OWN)} SELECT letter_id, {', '.join(f'{sql} AS {n}' for n, (_, sql) in _SENT.items())} FROM k")
def _(spark, sf_dir):
    """What a scorer is given of each letter, as JSON, read back."""
    df = _letters_assessed(spark, sf_dir).select("letter_id", report.context().alias("c"))
    return df.select("letter_id", *[F.get_json_object("c", path).alias(n) for n, (path, _) in _SENT.items()])
