"""Queries of the field audit, the checks, requests and reports, and SQL for all audits over the letters."""

from __future__ import annotations

from pyspark.sql import functions as F

from parchment.config import CLAUSE_WORDS, HEADING_WORDS, LABEL_WORDS, METROS, PLACEHOLDERS, RED_PHRASES, ROLE_WORDS, SALARY_KEYWORDS, SCHOOL_WORDS, TEMPLATE_ARTIFACTS
from parchment.operators import audit, checks, extract, report, rules
from parchment.plans.catalog import CHAIN, ORACLES, _facts, _list, _quote, query
from parchment.plans.letters_sql import EXTRACTED
from parchment.plans.settings import SUITED
from parchment.sources import letters as src
from parchment.patterns import EMPLOYMENT_TYPES

# ---------------------------------------------------------------- audits of the extracted letters in SQL

ORACLES["field_repair"] = f"{EXTRACTED} SELECT letter_id, {', '.join(f'CAST({c} AS VARCHAR) AS {c}' for c in extract.FIELDS)} FROM x"
ORACLES["low_confidence"] = f"{EXTRACTED} SELECT letter_id, array_to_string(problems, '|') AS problems, low_confidence FROM x"
ORACLES["audit_extraction"] = f"""{EXTRACTED} SELECT (SELECT count(*) FROM l0) AS total, (SELECT count(*) FROM l0 WHERE trim(full_text) = '') AS no_text, count(*) AS audited, count(*) FILTER (low_confidence) AS low_confidence, count(*) FILTER (len(problems) > 0) AS implausible,
count(*) FILTER (len(problems) > 0 AND NOT low_confidence) AS silent_bad, round(count(*) FILTER (len(problems) > 0 AND NOT low_confidence) * 100.0 / count(*), 1) AS silent_percent FROM x WHERE trim(full_text) <> ''"""
ORACLES["audit_problems"] = f"{EXTRACTED} SELECT problem, count(*) AS n, count(*) FILTER (NOT low_confidence) AS silent, min(letter_id) AS first_letter FROM (SELECT letter_id, low_confidence, unnest(problems) AS problem FROM x) GROUP BY problem"
ORACLES["audit_final"] = f"""{EXTRACTED} SELECT CASE WHEN red OR artifact OR coalesce(joining_date < offer_date, false) THEN 'HOLD' ELSE 'PASS' END AS screen, employment_type, count(*) AS n,
count(*) FILTER (red) AS red, count(*) FILTER (artifact) AS templates FROM x GROUP BY ALL"""

# ---------------------------------------------------------------- field audit


def _rx(c: str, words: list[str]) -> str:
    return f"regexp_matches({c}, '(?i)\\b({'|'.join(words)})\\b')"


def _count(c: str) -> str:
    return f"length(regexp_replace({c}, '[^0-9]', '', 'g'))"


def _split(c: str) -> str:
    return f"list_filter(regexp_split_to_array(lower({c}), '\\s+'), lambda w: w <> '')"


_SUSPECT = {
    "company_name": [("too long", "length(v) > 60"), ("clause", _rx("v", CLAUSE_WORDS)), ("mail or digits", f"contains(v, '@') OR {_count('v')} > 4")],
    "candidate_name": [("too long", f"len({_split('v')}) > 5 OR length(v) > 40"), ("role word", _rx("v", ROLE_WORDS)), ("heading", _rx("v", HEADING_WORDS)), ("digits", "regexp_matches(v, '[0-9]')")],
    "job_title": [
        ("too long", "length(v) > 60"), ("equals company", "lower(trim(v)) = lower(trim(company_name))"), ("equals candidate", "lower(trim(v)) = lower(trim(candidate_name))"),
        ("schooling", f"list_has_any(list_transform({_split('v')}, lambda w: trim(w, './,')), {_list(SCHOOL_WORDS)})"), ("clause", _rx("v", CLAUSE_WORDS)),
    ],
    "hr_name": [
        ("designation", _rx("v", ROLE_WORDS)), ("clause", f"{_rx('v', CLAUSE_WORDS)} OR length(v) > 40"), ("digits", "regexp_matches(v, '[0-9]')"), ("label", f"list_has_any({_split('v')}, {_list(LABEL_WORDS)})"),
        ("holds candidate", "contains(lower(v), lower(nullif(candidate_name, '')))"),
    ],
    "hr_designation": [("too long", f"length(v) > 46 OR len({_split('v')}) > 7"), ("clause", _rx("v", CLAUSE_WORDS))],
    "company_email": [("format", "NOT regexp_matches(v, '(?i)^[^@\\s]+@[^@\\s]+\\.[a-z]{2,}$')")],
    "domain": [("format", "NOT regexp_matches(v, '(?i)^[a-z0-9][a-z0-9.\\-]*\\.[a-z]{2,}$')")],
    "phone": [("digits", f"{_count('v')} NOT BETWEEN 10 AND 13")],
    "registration": [("format", "NOT regexp_matches(v, '^[A-Z][0-9]{5}[A-Z]{2}[0-9]{4}[A-Z]{3}[0-9]{6}$|(?i:^[0-9]{2}[A-Z]{5}[0-9]{4}[A-Z][A-Z0-9]Z[A-Z0-9]$|^udyam)')")],
    "employment_type": [("unknown", f"NOT list_contains({_list([n for _, n in EMPLOYMENT_TYPES])}, v)")],
    "work_location": [("too long", "length(v) > 50"), ("clause", _rx("v", CLAUSE_WORDS)), ("blank", "length(regexp_replace(v, '[^A-Za-z0-9]', '', 'g')) < 3")],
}


def _audited(table: str) -> str:
    """SQL of audit.audited over a table of fields."""
    case = lambda f: " ".join(f"WHEN {test} THEN {_quote(reason)}" for reason, test in _SUSPECT[f])
    return " UNION ALL ".join(f"SELECT letter_id, {k} AS place, '{f}' AS field, v AS value, CASE {case(f)} END AS reason FROM (SELECT *, nullif({f}, '') AS v FROM {table})" for k, f in enumerate(_SUSPECT))


#: Fields with something wrong in most of their values, from the order key.
ODD = """
SELECT o_orderkey AS letter_id,
  CASE CAST(o_orderkey % 7 AS INT) WHEN 0 THEN NULL WHEN 1 THEN 'Nova Systems Limited' WHEN 2 THEN 'We Hereby confirm' WHEN 3 THEN 'hr@nova' WHEN 4 THEN 'Plot 12345' WHEN 5 THEN repeat('Nova', 16) ELSE 'Nova 1234' END AS company_name,
  CASE CAST(o_orderkey % 8 AS INT) WHEN 0 THEN '' WHEN 1 THEN 'Asha Rao' WHEN 2 THEN 'HR Team' WHEN 3 THEN 'Offer Note' WHEN 4 THEN 'Asha 2' WHEN 5 THEN 'A B C D E F' WHEN 6 THEN repeat('Asha', 11) ELSE 'Christopher Shallow' END AS candidate_name,
  CASE CAST(o_orderkey % 9 AS INT) WHEN 0 THEN NULL WHEN 1 THEN 'Engineer' WHEN 2 THEN ' asha rao ' WHEN 3 THEN 'NOVA SYSTEMS LIMITED' WHEN 4 THEN 'Diploma, Science' WHEN 5 THEN 'Clerk effective now' WHEN 6 THEN repeat('Clerk', 13) WHEN 7 THEN 'Undergraduate' ELSE 'Post-Graduation.' END AS job_title,
  CASE CAST(o_orderkey % 11 AS INT) WHEN 0 THEN NULL WHEN 1 THEN 'Vikram Das' WHEN 2 THEN 'HR Manager' WHEN 3 THEN 'we will be' WHEN 4 THEN 'Vikram 1' WHEN 5 THEN 'Dear Vikram' WHEN 6 THEN 'Ms Asha Rao' WHEN 7 THEN repeat('Das', 14) ELSE 'Vikram' END AS hr_name,
  CASE CAST(o_orderkey % 5 AS INT) WHEN 0 THEN NULL WHEN 1 THEN 'Manager' WHEN 2 THEN 'a b c d e f g h' WHEN 3 THEN 'I have read' ELSE repeat('Head', 12) END AS hr_designation,
  CASE CAST(o_orderkey % 4 AS INT) WHEN 0 THEN NULL WHEN 1 THEN 'hr@nova.in' WHEN 2 THEN 'hr@nova' ELSE 'a@b@c.in' END AS company_email,
  CASE CAST(o_orderkey % 4 AS INT) WHEN 0 THEN NULL WHEN 1 THEN 'nova.co.in' WHEN 2 THEN '-nova.in' ELSE 'nova' END AS domain,
  CASE CAST(o_orderkey % 4 AS INT) WHEN 0 THEN NULL WHEN 1 THEN '+91 98765 43210' WHEN 2 THEN '98765' ELSE '+91 98765 43210 99' END AS phone,
  CASE CAST(o_orderkey % 6 AS INT) WHEN 0 THEN NULL WHEN 1 THEN 'U72200KA2015PTC123456' WHEN 2 THEN 'u72200ka2015ptc123456' WHEN 3 THEN '29abcde1234F1Z5' WHEN 4 THEN 'udyam 7' ELSE '29ABCDE1234' END AS registration,
  CASE CAST(o_orderkey % 3 AS INT) WHEN 0 THEN NULL WHEN 1 THEN 'Trainee' ELSE 'Volunteer' END AS employment_type,
  CASE CAST(o_orderkey % 5 AS INT) WHEN 0 THEN NULL WHEN 1 THEN 'Pune' WHEN 2 THEN '__' WHEN 3 THEN 'as the company asks' ELSE repeat('Pune ', 11) END AS work_location
FROM {orders}
"""
_BY_FIELD = "SELECT place, field, count(*) FILTER (value IS NULL) AS missing, count(reason) AS suspect, arg_min(value, letter_id) FILTER (reason IS NOT NULL) AS example FROM a GROUP BY place, field"


@query("audit_fields", f"{EXTRACTED}, a AS ({_audited('x')}) {_BY_FIELD}")
def _(spark, sf_dir):
    return audit.summary(audit.audited(extract.extract(src.letters(spark, sf_dir), SUITED)))


@query("field_problems", f"WITH o AS ({src.plain(ODD)}), a AS ({_audited('o')}) SELECT letter_id, field, value, reason FROM a WHERE reason IS NOT NULL")
def _(spark, sf_dir):
    return audit.audited(src.build(spark, sf_dir, ODD)).filter("reason is not null").select("letter_id", "field", "value", "reason")


@query("field_summary", f"WITH o AS ({src.plain(ODD)}), a AS ({_audited('o')}) {_BY_FIELD}")
def _(spark, sf_dir):
    return audit.summary(audit.audited(src.build(spark, sf_dir, ODD)))


@query("field_examples", f"WITH o AS ({src.plain(ODD)}), a AS ({_audited('o')}), r AS (SELECT field, row_number() OVER (PARTITION BY field ORDER BY letter_id, value) AS nth, letter_id, reason FROM a WHERE reason IS NOT NULL) SELECT field, nth, letter_id, reason FROM r WHERE nth <= 4")
def _(spark, sf_dir):
    """The report's top four of each field."""
    return audit.examples(audit.audited(src.build(spark, sf_dir, ODD))).select("field", F.col("nth").cast("long").alias("nth"), "letter_id", "reason")


# ---------------------------------------------------------------- checks

_INTERN = "coalesce(employment_type IN ('Internship', 'Trainee', 'Apprentice'), false)"
_SHORT = f"({_INTERN} OR coalesce(employment_type IN ('Contract', 'Part-time', 'Consultant'), false))"
_TWO = "(CASE WHEN hr_name IS NULL THEN 0 ELSE 1 END + CASE WHEN hr_designation IS NULL THEN 0 ELSE 1 END)"
_WAYS = "(CASE WHEN company_email IS NULL THEN 0 ELSE 1 END + CASE WHEN phone IS NULL THEN 0 ELSE 1 END + CASE WHEN website IS NULL THEN 0 ELSE 1 END)"
_SAYS = {name: f"regexp_matches(full_text, {_quote(r)})" for name, r in checks.CLAUSES.items()}
_TERMS = f"(CASE WHEN employment_type IS NULL THEN 0 ELSE 1 END + CAST({_SAYS['probation']} AS INT) + CAST({_SAYS['notice']} AS INT))"
_MONEY = f"len(list_filter({_list([*SALARY_KEYWORDS['ctc'], *SALARY_KEYWORDS['gross'], 'stipend'])}, lambda k: contains(lower(full_text), k))) > 0"
_HELD = " OR ".join(f"regexp_matches(full_text, {_quote(p)})" for _, p in PLACEHOLDERS)
_CHECKS = {
    "offer date": ("false", "offer_date IS NULL"), "joining date": ("joining_date < offer_date", "joining_date IS NULL OR joining_date = offer_date"), "contacts": (f"{_WAYS} = 0", f"{_WAYS} = 1"),
    "registration": ("false", "registration IS NULL"), "signatory": (f"{_TWO} = 0", f"NOT (coalesce(regexp_matches(hr_designation, '(?i)authori[sz]ed signatory'), false) OR {_TWO} = 2)"),
    "salary stated": (f"ctc IS NULL AND gross IS NULL AND NOT ({_MONEY})", "ctc IS NULL AND gross IS NULL"),
    "basic share": (f"NOT {_INTERN} AND 12 * basic / ctc > 1", f"NOT {_INTERN} AND NOT coalesce(12 * basic / ctc BETWEEN 0.30 AND 0.55, false)"),
    "house rent": ("false", f"NOT {_INTERN} AND coalesce({_rx('work_location', METROS)}, false) AND coalesce(hra, 0) = 0"),
    "provident fund": ("false", f"NOT {_INTERN} AND pf_employee IS NULL AND pf_employer IS NULL AND NOT regexp_matches(full_text, '(?i)\\bprovident fund\\b|\\be?pf\\b')"),
    "gratuity": ("false", f"NOT {_SHORT} AND gratuity IS NULL AND NOT regexp_matches(full_text, '(?i)\\bgratuity\\b')"),
    "salary sum": ("12 * parts / ctc > 1", "NOT coalesce(12 * parts / ctc >= 0.40, false)"), "terms": (f"{_TERMS} = 0", f"{_TERMS} < 3"), "placeholders": (f"artifact OR {_HELD}", "false"),
}
_JOINED = " || '|' || ".join(f"'{name}:' || CASE WHEN {red} THEN 'red' WHEN {yellow} THEN 'yellow' ELSE 'green' END" for name, (red, yellow) in _CHECKS.items())
_POINTS = "11 - CASE WHEN offer_date IS NULL THEN 3 ELSE 0 END - CASE WHEN joining_date IS NULL THEN 2 ELSE 0 END"


@query("letter_checks", f"{EXTRACTED} SELECT letter_id, {_JOINED} AS checks, CASE WHEN joining_date < offer_date THEN least(2, {_POINTS}) ELSE {_POINTS} END AS date_points FROM x")
def _(spark, sf_dir):
    df = extract.extract(src.letters(spark, sf_dir), SUITED)
    return df.select("letter_id", F.array_join(F.transform(checks.checks(), lambda c: F.concat(c["check"], F.lit(":"), c["severity"])), "|").alias("checks"), checks.date_score().alias("date_points"))


_LISTED = ", ".join(f"CASE WHEN regexp_matches(text, {_quote(r)}) THEN '{name}' END" for name, r in checks.CLAUSES.items())


@query("clause_scan", f"SELECT doc_id, array_to_string(list_filter([{_LISTED}], lambda c: c IS NOT NULL), '|') AS clauses FROM documents WHERE text IS NOT NULL")
def _(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").filter("text is not null")
    return docs.select("doc_id", F.array_join(checks.clauses(F.col("text")), "|").alias("clauses"))


# ---------------------------------------------------------------- requests and reports


@query("scoring_requests", f"{EXTRACTED} SELECT letter_id, company_name AS company, candidate_name AS candidate, round(ctc, 2) AS ctc, CAST(offer_date AS VARCHAR) AS offered, gross IS NOT NULL AS has_gross, length(substr(full_text, 1, 200)) AS n_text FROM x")
def _(spark, sf_dir):
    """Each letter's request as JSON, read back."""
    df = extract.extract(src.letters(spark, sf_dir), SUITED).select("letter_id", report.request(snippet=200).alias("r"))
    get = lambda path: F.get_json_object("r", path)
    return df.select("letter_id", get("$.company.name").alias("company"), get("$.candidate.name").alias("candidate"), F.round(get("$.salary.ctc").cast("double"), 2).alias("ctc"), get("$.dates.offer").alias("offered"), get("$.salary.gross").isNotNull().alias("has_gross"), F.length(get("$.document.text")).cast("long").alias("n_text"))


@query("scoring_requests_full", f"{EXTRACTED} SELECT letter_id, company_name AS company, candidate_name AS candidate, round(ctc, 2) AS ctc, CAST(offer_date AS VARCHAR) AS offered, gross IS NOT NULL AS has_gross, length(substr(full_text, 1, 4000)) AS n_text, md5(substr(full_text, 1, 4000)) AS text_digest FROM x")
def _(spark, sf_dir):
    """The same with the text that production sends, and its digest."""
    df = extract.extract(src.letters(spark, sf_dir), SUITED).select("letter_id", report.request().alias("r"))
    get = lambda path: F.get_json_object("r", path)
    fields = [get("$.company.name").alias("company"), get("$.candidate.name").alias("candidate"), F.round(get("$.salary.ctc").cast("double"), 2).alias("ctc"), get("$.dates.offer").alias("offered"), get("$.salary.gross").isNotNull().alias("has_gross")]
    return df.select("letter_id", *fields, F.length(get("$.document.text")).cast("long").alias("n_text"), F.md5(get("$.document.text")).alias("text_digest"))


_PAGE = """'<html><h1>Nova &amp; Sons &lt;' || coalesce(domain, '') || '&gt;</h1><p class="score">' || final_score || '</p><table><tr><th>Verdict</th><td>' || verdict || '</td></tr><tr><th>Gate</th><td>' || coalesce(gate, '') || '</td></tr></table><ul>'
|| array_to_string(list_concat(list_transform(red, lambda f: '<li class="red">' || f || '</li>'), list_transform(yellow, lambda f: '<li class="yellow">' || f || '</li>')), '') || '</ul></html>'"""


@query("report_html", f"{CHAIN} SELECT letter_id, final_score AS score, md5({_PAGE}) AS page FROM j")
def _(spark, sf_dir):
    """Reports as pages, with the score read back from them."""
    title = F.concat(F.lit("Nova & Sons <"), F.coalesce("domain", F.lit("")), F.lit(">"))
    df = rules.analyze(_facts(spark, sf_dir), SUITED)
    page = report.html(title, [("Verdict", F.col("verdict")), ("Gate", F.col("gate"))], F.col("final_score"), F.col("flags"))
    return df.select("letter_id", page.alias("page")).select("letter_id", report.score_of(F.col("page")).alias("score"), F.md5("page").alias("page"))
