"""Queries of written dates, names over pages and lookups that are decided from stored answers, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from parchment.functions.names import agreement
from parchment.functions.text import parse_date
from parchment.operators import checks, extract, lookups
from parchment.plans.catalog import query
from parchment.plans.letters_sql import PROBLEMS
from parchment.plans.settings import SUITED
from parchment.sources import letters as src

# ---------------------------------------------------------------- dates in many forms

_MON = "CASE month(d) WHEN 1 THEN 'January' WHEN 2 THEN 'February' WHEN 3 THEN 'March' WHEN 4 THEN 'April' WHEN 5 THEN 'May' WHEN 6 THEN 'June' WHEN 7 THEN 'July' WHEN 8 THEN 'August' WHEN 9 THEN 'September' WHEN 10 THEN 'October' WHEN 11 THEN 'November' ELSE 'December' END"
_D, _M, _Y = (f"CAST({f}(d) AS STRING)" for f in ("day", "month", "year"))
_P = lambda f: f"lpad(CAST({f}(d) AS STRING), 2, '0')"
_SPELLED = f"""SELECT o_orderkey AS letter_id, d, CASE CAST(o_orderkey % 20 AS INT) WHEN 0 THEN concat({_D}, 'th of ', {_MON}, ' ', {_Y}) WHEN 1 THEN concat({_Y}, {_P('month')}, {_P('day')}) WHEN 2 THEN concat({_D}, '-', substring({_MON}, 1, 3), '-', {_Y}, ' 10:30 AM IST') WHEN 3 THEN concat('Monday, the ', {_D}, ' day of ', {_MON}, ', ', {_Y})
  WHEN 4 THEN concat({_Y}, '-', {_P('month')}, '-', {_P('day')}, 'T10:15:30.250+05:30') WHEN 5 THEN concat({_MON}, ' ', {_D}, ', ', {_Y}, ' at 9:05 p.m. (GMT)') WHEN 6 THEN concat({_D}, '/', {_M}, '/', {_Y}) WHEN 7 THEN concat({_P('day')}, '.', {_P('month')}, '.', substring({_Y}, 3, 2)) WHEN 8 THEN concat('10:30 ', {_D}, ' ', {_MON}, ' ', {_Y})
  WHEN 9 THEN concat({_Y}, ' ', {_MON}, ' ', {_D}) WHEN 10 THEN concat({_MON}, ' of ', {_Y}) WHEN 11 THEN concat('31 February ', {_Y}) WHEN 12 THEN concat({_D}, ' ', {_MON}, ' ', {_MON}, ' ', {_Y}) WHEN 13 THEN concat('on ', {_D}, ' ', {_MON}, ' ', {_Y}, ' in Pune') WHEN 14 THEN NULL WHEN 15 THEN '' WHEN 16 THEN concat('Sat. ', {_D}, ' ', substring({_MON}, 1, 3), '. ', {_Y})
  WHEN 17 THEN concat({_M}, '/', CAST(13 + o_orderkey % 15 AS STRING), '/', {_Y}) WHEN 18 THEN concat({_D}, ' ', substring({_MON}, 1, 3), ' ', chr(39), substring({_Y}, 3, 2)) ELSE '20250230' END AS written FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d FROM {{orders}}) AS o"""


@query("written_dates", f"SELECT letter_id, CAST(CASE WHEN letter_id % 20 IN (10, 11, 12, 13, 14, 15, 19) THEN NULL WHEN letter_id % 20 = 17 THEN make_date(year(d), month(d), 13 + letter_id % 15) ELSE d END AS VARCHAR) AS day FROM ({src.plain(_SPELLED)}) AS x")
def _(spark, sf_dir):
    """Dates as people and programs write them; the SQL knows the day that each was written for."""
    return src.build(spark, sf_dir, _SPELLED).select("letter_id", parse_date(F.col("written")).cast("string").alias("day"))


# ---------------------------------------------------------------- names over pages

#: Forms of a name, and how each agrees with the first one.
_FORMS = ["Rahul Kumar Singh", "Mr. Rahul Kumar Singh", "SINGH, Rahul Kumar", "R. K. Singh", "Rahul Singh", "Rahul Kumra Singh", "Rahul", "Priya Nair", "Rahul Mehta", "K Singh Rahull"]
_HOW = ["same", "same", "same", "form", "form", "other", "form", "other", "other", "form"]
_FORM = f"CASE CAST(l_partkey % 11 AS INT) {' '.join(f'WHEN {k} THEN {chr(39)}{f}{chr(39)}' for k, f in enumerate(_FORMS))} END"
_MENTIONS = f"SELECT l_orderkey AS letter_id, l_linenumber * 1000000 + l_suppkey AS page_no, CASE WHEN l_suppkey % 2 = 0 THEN 'candidate' ELSE 'signatory' END AS kind, {_FORM} AS name, CAST(l_partkey % 11 AS INT) AS form FROM {{lineitem}} UNION ALL SELECT o_orderkey, CAST(-1 AS BIGINT), k, 'Rahul Kumar Singh', 0 FROM {{orders}} CROSS JOIN (SELECT 'candidate' AS k UNION ALL SELECT 'signatory') AS z WHERE o_orderkey % 5 > 0"
_AGREES = f"CASE form {' '.join(f'WHEN {k} THEN {chr(39)}{h}{chr(39)}' for k, h in enumerate(_HOW))} END"


@query("name_agreement", f"SELECT letter_id, page_no, kind, form, {_AGREES} AS how FROM ({src.plain(_MENTIONS)}) AS x WHERE letter_id % 5 > 0 AND name IS NOT NULL")
def _(spark, sf_dir):
    """How each name on a letter's pages agrees with the one that it addresses; the SQL knows how each form was made."""
    df = src.build(spark, sf_dir, _MENTIONS).filter("letter_id % 5 > 0 AND name IS NOT NULL")
    return df.select("letter_id", "page_no", "kind", "form", agreement(F.col("name"), F.lit(_FORMS[0])).alias("how"))


@query("name_checks", f"""WITH m AS (SELECT *, {_AGREES} AS how, row_number() OVER (PARTITION BY letter_id, kind ORDER BY page_no) AS k FROM ({src.plain(_MENTIONS)}) AS x WHERE letter_id % 5 > 0 AND name IS NOT NULL),
b AS (SELECT letter_id, count(*) FILTER (k > 1 AND kind = 'candidate') AS n, count(*) FILTER (k > 1 AND kind = 'candidate' AND how = 'other') AS others, count(*) FILTER (kind = 'signatory' AND how = 'other') AS strange, count(*) FILTER (kind = 'signatory' AND form > 0) AS forms FROM m GROUP BY letter_id)
SELECT letter_id, CASE WHEN others = 0 THEN 'green' WHEN others >= 2 AND others = n THEN 'red' ELSE 'yellow' END AS candidate, others, CASE WHEN strange > 0 THEN 'other' WHEN forms > 0 THEN 'form' ELSE 'consistent' END AS signatory, CASE WHEN strange + forms > 0 THEN 2 ELSE 0 END AS signatory_off FROM b""")
def _(spark, sf_dir):
    """Whether a letter's pages name one candidate and one signatory."""
    return checks.name_checks(src.build(spark, sf_dir, _MENTIONS).filter("letter_id % 5 > 0"))


# ---------------------------------------------------------------- lookups from stored answers

_COMPANIES = "SELECT c_custkey AS key, CASE WHEN c_custkey % 9 = 0 THEN NULL ELSE concat('Nova Works ', CAST(c_custkey % 60 AS STRING)) END AS company_name, CASE CAST(c_custkey % 7 AS INT) WHEN 0 THEN NULL WHEN 1 THEN 'gmail.com' WHEN 2 THEN concat('WWW.nova', CAST(c_custkey % 60 AS STRING), '.in') ELSE concat('nova', CAST(c_custkey % 60 AS STRING), '.in') END AS domain FROM {customer}"
_ATTEMPTS = """SELECT concat('nova', CAST(k AS STRING), '.in') AS domain, r AS rank, concat(CASE r WHEN 1 THEN 'https://' WHEN 2 THEN 'https://www.' ELSE 'http://' END, 'nova', CAST(k AS STRING), '.in') AS url,
  CASE WHEN k % 4 = 0 OR (k + r) % 5 = 0 THEN NULL ELSE CASE WHEN (k * r) % 3 = 0 THEN 404 ELSE 200 END END AS status, CAST(k * r * 37 % 4000 + 800 + CASE WHEN k % 10 = 1 THEN 701 - (k * r * 37 % 4000 + 800) + 799 + r % 2 ELSE 0 END AS BIGINT) AS n_chars, CASE WHEN k % 4 = 0 THEN CASE WHEN k % 8 = 0 AND r = 2 THEN 'tls' ELSE 'timeout' END WHEN (k + r) % 5 = 0 THEN 'tls' END AS failure
FROM (SELECT DISTINCT CAST(c_custkey % 55 AS INT) AS k FROM {customer}) AS c CROSS JOIN (SELECT 1 AS r UNION ALL SELECT 2 UNION ALL SELECT 3) AS a"""
_SUMMARIES = "SELECT concat('Nova Works ', CAST(k AS STRING)) AS company_name, CASE CAST(k % 6 AS INT) WHEN 0 THEN 'standard' WHEN 1 THEN 'disambiguation' END AS type, concat('Nova ', CAST(k AS STRING)) AS title, k % 6 = 2 AS failed FROM (SELECT DISTINCT CAST(c_custkey % 58 AS INT) AS k FROM {customer}) AS c"
_TITLES = "SELECT concat('Nova Works ', CAST(k AS STRING)) AS company_name, r AS rank, CASE CAST((k + r) % 8 AS INT) WHEN 0 THEN concat('NOVA WORKS ', CAST(k AS STRING), ' (firm)') WHEN 1 THEN 'Nova' WHEN 2 THEN NULL WHEN 3 THEN 'Nova Workshop' ELSE 'Supernova' END AS title FROM (SELECT DISTINCT CAST(c_custkey % 60 AS INT) AS k FROM {customer}) AS c CROSS JOIN (SELECT 1 AS r UNION ALL SELECT 2 UNION ALL SELECT 3 UNION ALL SELECT 4) AS a WHERE k % 5 > 0"


@query("stored_lookups", f"""WITH c AS (SELECT key, company_name, nullif(regexp_replace(lower(trim(domain)), '^www[.]', ''), '') AS domain FROM ({src.plain(_COMPANIES)}) AS x), a AS ({src.plain(_ATTEMPTS)}),
w AS (SELECT domain, arg_min(url || ' (HTTP 200, ' || (n_chars // 1024) || ' KB)', rank) FILTER (failure IS NULL AND status = 200 AND n_chars > 1500) AS live, bool_or(failure IS NULL OR failure = 'tls') AS reached FROM a GROUP BY domain),
t AS (SELECT company_name, arg_min(coalesce(title, 'None'), rank) AS found FROM ({src.plain(_TITLES)}) AS x WHERE rank <= 3 AND (contains(lower(coalesce(title, '')), lower(company_name)) OR contains(lower(company_name), lower(coalesce(title, '')))) GROUP BY company_name),
s AS (SELECT * FROM ({src.plain(_SUMMARIES)}) AS x), j AS (SELECT c.*, w.live, w.reached, CASE WHEN s.type = 'standard' THEN 'Wikipedia entry: ' || s.title WHEN t.found IS NOT NULL THEN 'Wikipedia search match: ' || t.found END AS entry, coalesce(s.failed, false) AS failed,
  c.domain IS NOT NULL AND c.domain <> 'gmail.com' AS by_site, c.company_name IS NOT NULL AS by_name FROM c LEFT JOIN w ON c.domain = w.domain LEFT JOIN s ON c.company_name = s.company_name LEFT JOIN t ON c.company_name = t.company_name),
k AS (SELECT *, by_site AND live IS NOT NULL AS site_hit, by_name AND entry IS NOT NULL AS name_hit, by_site AND live IS NULL AND coalesce(NOT reached, false) AS site_error, by_name AND entry IS NULL AND failed AS name_error FROM j),
l AS (SELECT *, CAST(by_site AS INT) + CAST(by_name AS INT) AS n, CAST(site_error AS INT) + CAST(name_error AS INT) AS bad FROM k)
SELECT key, site_hit OR name_hit AS found, CASE WHEN site_hit THEN 'website' WHEN name_hit THEN 'encyclopedia' END AS method, (company_name IS NULL AND domain IS NULL) OR site_hit OR name_hit OR n > bad AS checked,
  CASE WHEN company_name IS NULL AND domain IS NULL THEN 'No company name or domain to check' WHEN site_hit THEN 'Live website at ' || live WHEN name_hit THEN entry
  WHEN n > 0 AND n = bad THEN 'Online check could NOT complete for ' || chr(39) || coalesce(company_name, domain) || chr(39) || ' — all ' || n || ' attempt(s) hit network/system errors: ' || concat_ws('; ', CASE WHEN site_error THEN domain || ' unreachable' END, CASE WHEN name_error THEN 'Wikipedia request error' END)
  ELSE 'No online presence for ' || chr(39) || coalesce(company_name, domain) || chr(39) || ' — tried: ' || coalesce(nullif(concat_ws(', ', CASE WHEN by_site THEN 'direct fetch of ' || domain END, CASE WHEN by_name THEN 'Wikipedia' END), ''), 'nothing') END AS note FROM l""")
def _(spark, sf_dir):
    """What is found of companies online, decided from stored answers: attempts at sites in order, summaries, titles of a search."""
    return lookups.decide(*[src.build(spark, sf_dir, q) for q in (_COMPANIES, _ATTEMPTS, _SUMMARIES, _TITLES)])


# ---------------------------------------------------------------- stored extractions

_STORED = "coalesce(basic, 0) + coalesce(hra, 0) + coalesce(special, 0) + coalesce(pf_employer, 0) + coalesce(gratuity, 0)"


@query("stored_silent", f"WITH f AS (SELECT *, {_STORED} AS parts FROM ({src.plain(src.FACTS)}) AS x), p AS (SELECT letter_id, letter_id % 3 = 0 AS low, {PROBLEMS} AS problems FROM f) SELECT letter_id, array_to_string(problems, '|') AS problems FROM p WHERE len(problems) > 0 AND NOT low ORDER BY letter_id LIMIT 60")
def _(spark, sf_dir):
    """The report's first 60 letters of an earlier extraction whose implausible values were kept as confident."""
    df = src.build(spark, sf_dir, src.FACTS).withColumn("problems", extract.plausibility_problems(SUITED)).withColumn("low", F.col("letter_id") % 3 == 0)
    return df.filter((F.size("problems") > 0) & ~F.col("low")).orderBy("letter_id").limit(60).select("letter_id", F.concat_ws("|", "problems").alias("problems"))
