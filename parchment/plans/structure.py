"""Queries of page structure, lookups, the inbox, provider rows and corpus audits, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from parchment.operators import audit, checks, extract, forensic, lookups, queue, rules
from parchment.plans.catalog import _DNS, _FOUND, audited, query  # noqa: F401
from parchment.plans.letters_sql import EXTRACTED, lines  # noqa: F401
from parchment.plans.review import _audited
from parchment.plans.verdicts import ANSWERS
from parchment.plans.settings import SUITED
from parchment.sources import letters as src

# ---------------------------------------------------------------- pages

_PAGES = "SELECT l_orderkey AS letter_id, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) - 1 AS INT) AS page_no, CASE CAST(l_partkey % 9 AS INT) WHEN 0 THEN 'Annual CTC and HRA' WHEN 1 THEN 'AUTHORISED Signatory' WHEN 2 THEN NULL WHEN 3 THEN '' WHEN 4 THEN '  ' WHEN 5 THEN 'Salary Breakup, for acceptance' ELSE concat('terms ', CAST(l_suppkey AS STRING)) END AS text FROM {lineitem}"


@query("letter_texts", f"SELECT letter_id, coalesce(string_agg(text, chr(10) ORDER BY page_no) FILTER (text <> ''), '') AS text, coalesce(trim(string_agg(text, ' ') FILTER (text <> '')), '') = '' AS needs_ocr, count(*) AS n_pages FROM ({src.plain(_PAGES)}) AS x GROUP BY letter_id")
def _(spark, sf_dir):
    """Pages' texts put together, empty pages left out; letters without any go to text recognition."""
    return forensic.letter_text(src.build(spark, sf_dir, _PAGES))


@query("letter_texts_whole", f"SELECT letter_id, string_agg(coalesce(text, ''), chr(10) ORDER BY page_no) AS text, count(*) AS n_pages FROM ({src.plain(_PAGES)}) AS x GROUP BY letter_id")
def _(spark, sf_dir):
    """The audits' texts: a page without text is an empty one."""
    return forensic.letter_text(src.build(spark, sf_dir, _PAGES), keep_empty=True).drop("needs_ocr")


_SAL = "contains(lower(text), 'ctc') OR contains(lower(text), 'salary breakup')"
_SIG = "contains(lower(text), 'authorised signatory') OR contains(lower(text), 'acceptance')"


@query("key_pages", f"SELECT letter_id, coalesce(string_agg(CAST(page_no AS VARCHAR), ',' ORDER BY page_no) FILTER ({_SAL}), '') AS salary, coalesce(string_agg(CAST(page_no AS VARCHAR), ',' ORDER BY page_no) FILTER ({_SIG}), '') AS signature FROM ({src.plain(_PAGES)}) AS x GROUP BY letter_id")
def _(spark, sf_dir):
    text = lambda c: F.array_join(F.col(c).cast("array<string>"), ",")
    return forensic.key_pages(src.build(spark, sf_dir, _PAGES)).select("letter_id", text("salary_pages").alias("salary"), text("signature_pages").alias("signature"))


_TWO = lambda c: f"lpad(CAST({c} AS STRING), 2, '0')"
_STAMP = f"concat(CAST(year(o_orderdate) AS STRING), {_TWO('month(o_orderdate)')}, {_TWO('day(o_orderdate)')}, '101533')"
_RAW = f"""SELECT o_orderkey AS letter_id, CAST(o_orderdate AS DATE) AS day, CASE CAST(o_orderkey % 7 AS INT) WHEN 0 THEN NULL WHEN 1 THEN concat('D:', {_STAMP}, 'Z') WHEN 2 THEN concat('D:', {_STAMP}, '+05', chr(39), '30', chr(39)) WHEN 3 THEN {_STAMP} WHEN 4 THEN CAST(CAST(o_orderdate AS DATE) AS STRING)
  WHEN 5 THEN 'D:20250230101500' ELSE 'no date' END AS raw FROM {{orders}}"""


@query("pdf_dates", f"SELECT letter_id, CASE WHEN letter_id % 7 IN (1, 2, 3) THEN CAST(day AS VARCHAR) || ' 10:15:33' WHEN letter_id % 7 = 4 THEN CAST(day AS VARCHAR) || ' 00:00:00' END AS stamp FROM ({src.plain(_RAW)}) AS x")
def _(spark, sf_dir):
    return src.build(spark, sf_dir, _RAW).select("letter_id", forensic.pdf_date(F.col("raw")).cast("string").alias("stamp"))


# ---------------------------------------------------------------- lookups

_ASKED = """SELECT o_orderkey AS letter_id, CASE CAST(o_orderkey % 8 AS INT) WHEN 0 THEN NULL WHEN 1 THEN '  ' WHEN 2 THEN concat(' HTTPS://www.Nova', CAST(o_custkey AS STRING), '.co.in/ ') WHEN 3 THEN 'no domain' WHEN 4 THEN concat('http://nova', CAST(o_custkey AS STRING), '.in//') WHEN 5 THEN '-nova.in' ELSE concat('nova', CAST(o_custkey AS STRING), '.org') END AS domain,
  CASE CAST(o_custkey % 5 AS INT) WHEN 0 THEN 'ok' WHEN 1 THEN 'nxdomain' WHEN 2 THEN 'noanswer' WHEN 3 THEN 'error' ELSE 'ok' END AS a_answer, CASE CAST(o_custkey % 4 AS INT) WHEN 0 THEN 'ok' WHEN 1 THEN 'nxdomain' WHEN 2 THEN 'noanswer' ELSE 'error' END AS mx_answer, CAST(o_custkey % 3 AS INT) AS n_mx, repeat('timed out ', 12) AS message FROM {orders}"""
_CLEAN = "nullif(regexp_replace(regexp_replace(regexp_replace(lower(trim(domain)), '^https?://', ''), '^www[.]', ''), '/+$', ''), '')"
_GOOD = "coalesce(regexp_matches(d, '^[a-z0-9][a-z0-9.-]*[.][a-z]{2,}$'), false)"


@query("dns_notes", f"""SELECT letter_id, d AS domain, {_GOOD} AND a_answer IN ('ok', 'noanswer') AS dns_valid, {_GOOD} AND mx_answer = 'ok' AND n_mx > 0 AS mx, {_GOOD} AND a_answer = 'error' AS lookup_error, CASE WHEN d IS NULL THEN 'No domain provided' WHEN NOT {_GOOD} THEN 'Invalid domain format: ' || d ELSE
  CASE a_answer WHEN 'ok' THEN 'domain resolves (A record OK)' WHEN 'nxdomain' THEN 'domain does not exist (NXDOMAIN)' WHEN 'noanswer' THEN 'domain exists (no A record, but not NXDOMAIN)' ELSE 'A record lookup failed (system error): ' || substr(message, 1, 80) END || ' | ' ||
  CASE WHEN mx_answer = 'ok' AND n_mx > 0 THEN n_mx || ' MX record(s) found' WHEN mx_answer = 'ok' THEN 'no MX records' WHEN mx_answer = 'nxdomain' THEN 'domain does not exist (MX NXDOMAIN)' WHEN mx_answer = 'noanswer' THEN 'no MX records — company likely uses Gmail/Office365' ELSE 'MX lookup failed (may use Gmail/Office365)' END END AS note
FROM (SELECT *, {_CLEAN} AS d FROM ({src.plain(_ASKED)}) AS y) AS x""")
def _(spark, sf_dir):
    """Domains as letters write them, with the answers of both lookups."""
    return lookups.dns_note(src.build(spark, sf_dir, _ASKED)).select("letter_id", "domain", "dns_valid", "mx", "lookup_error", "note")


_FOUND_PAGE = "repeat('<a CLASS=\"result__a\">x</a>', CAST(page_id % 4 AS INT)) || repeat('<i class=\"result__url\">', CAST(page_id % 3 AS INT)) || CASE WHEN page_id % 5 > 0 THEN repeat('Nova Works ', 300) ELSE '' END"


@query("search_results", f"SELECT page_id, length(h) > 3000 AND contains(lower(h), lower(n)) AND links >= 2 AS found, links AS n_results FROM (SELECT *, CAST((length(lower(h)) - length(replace(lower(h), 'class=\"result__a\"', ''))) / 17 + (length(lower(h)) - length(replace(lower(h), 'result__url', ''))) / 11 AS INT) AS links FROM (SELECT page_id, coalesce(html, '') || {_FOUND_PAGE} AS h, CASE WHEN page_id % 7 = 0 THEN 'Other Firm' ELSE 'NOVA works' END AS n FROM pages) AS y) AS x")
def _(spark, sf_dir):
    """Result pages of a web search: pages with links and names put in."""
    df = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", F.expr(f"coalesce(html, '') || {_FOUND_PAGE}").alias("h"), F.when(F.col("page_id") % 7 == 0, "Other Firm").otherwise("NOVA works").alias("n"))
    return df.withColumn("r", lookups.search_hit(F.col("h"), F.col("n"))).select("page_id", "r.found", "r.n_results")


# ---------------------------------------------------------------- inbox

_FILES = "SELECT o_orderkey AS letter_id, concat('letter_', CAST(o_orderkey AS STRING), '.pdf') AS file_name FROM {orders}"
_REPORTS = "SELECT concat('letter_', CAST(o_orderkey AS STRING), '.pdf') AS file_name, CASE CAST((o_orderkey + r) % 4 AS INT) WHEN 0 THEN 'SUSPICIOUS' WHEN 1 THEN 'LEGITIMATE' WHEN 2 THEN 'MANUAL REVIEW' ELSE 'OLD' END AS verdict, CAST(o_orderkey % 101 AS INT) - r AS score, CAST(o_orderdate AS DATE) + r AS saved_at FROM {orders} CROSS JOIN (SELECT 0 AS r UNION ALL SELECT 1 UNION ALL SELECT 4) AS x WHERE o_orderkey % 3 = 0"


@query("report_lookup", f"""WITH r AS (SELECT *, row_number() OVER (PARTITION BY file_name ORDER BY coalesce(list_position(['LEGITIMATE', 'MANUAL REVIEW', 'SUSPICIOUS'], verdict), 99), saved_at DESC, score) AS n FROM ({src.plain(_REPORTS)}) AS x)
SELECT f.letter_id, r.verdict AS report_verdict, r.score AS report_score, CAST(r.saved_at AS VARCHAR) AS processed_at FROM ({src.plain(_FILES)}) AS f LEFT JOIN r ON f.file_name = r.file_name AND r.n = 1""")
def _(spark, sf_dir):
    """Finished letters with their reports, by file name."""
    out = queue.with_reports(src.build(spark, sf_dir, _FILES), src.build(spark, sf_dir, _REPORTS))
    return out.select("letter_id", "report_verdict", "report_score", F.col("processed_at").cast("string").alias("processed_at"))


@query("unprocessed_letters", f"SELECT letter_id, file_name FROM ({src.plain(_FILES)}) AS f WHERE letter_id % 3 <> 0")
def _(spark, sf_dir):
    return queue.unprocessed(src.build(spark, sf_dir, _FILES), src.build(spark, sf_dir, _REPORTS)).select("letter_id", "file_name")


@query("next_batch", f"SELECT letter_id, file_name FROM ({src.plain(_FILES)}) AS f WHERE letter_id % 3 <> 0 ORDER BY file_name LIMIT 25")
def _(spark, sf_dir):
    """The first 25 letters by name that have no report yet: a batch's size is its feature."""
    return queue.unprocessed(src.build(spark, sf_dir, _FILES), src.build(spark, sf_dir, _REPORTS), 25).select("letter_id", "file_name")


_REQUESTS = "SELECT concat('letter-', CAST(o_orderkey AS STRING)) AS custom_id, o_orderkey AS letter_id FROM {orders} WHERE o_orderkey % 2 = 0"


@query("batch_answers", f"WITH {ANSWERS} SELECT 'letter-' || letter_id AS custom_id, image_score, text_score, company_score, len(model_flags) AS n_flags, advice, failed FROM a2 WHERE letter_id % 2 = 0 AND letter_id % 5 > 0")
def _(spark, sf_dir):
    """Results of a batch meet the requests that they answer, and are read with what was sent along."""
    results = src.build(spark, sf_dir, src.DETAILS).filter("letter_id % 5 > 0").select(F.concat(F.lit("letter-"), F.col("letter_id").cast("string")).alias("custom_id"), "response", (F.col("n_rendered") > 0).alias("images"))
    df = queue.answered(src.build(spark, sf_dir, _REQUESTS), results).withColumn("a", rules.parse_scores(F.col("response"), F.col("images")))
    return df.select("custom_id", "a.image_score", "a.text_score", "a.company_score", F.size("a.flags").cast("long").alias("n_flags"), "a.advice", "a.failed")


# ---------------------------------------------------------------- provider rows

_PROVIDED = "SELECT o_orderkey AS letter_id, 'Provider Works' AS company_name, CASE WHEN o_orderkey % 2 = 0 THEN 'Meera Sen' END AS candidate_name, CAST(o_totalprice AS DOUBLE) AS ctc FROM {orders} WHERE o_orderkey % 3 = 0"


@query("provider_fields", f"""{EXTRACTED} SELECT x.letter_id, CASE WHEN NOT low_confidence THEN 'rules' WHEN p.letter_id IS NULL THEN 'rules (low)' ELSE 'provider' END AS source, CASE WHEN low_confidence AND p.letter_id IS NOT NULL THEN p.company_name ELSE x.company_name END AS company_name,
  CASE WHEN low_confidence AND p.letter_id IS NOT NULL THEN p.candidate_name ELSE x.candidate_name END AS candidate_name, round(CASE WHEN low_confidence AND p.letter_id IS NOT NULL THEN p.ctc ELSE x.ctc END, 2) AS ctc FROM x LEFT JOIN ({src.plain(_PROVIDED)}) AS p ON x.letter_id = p.letter_id""")
def _(spark, sf_dir):
    """Letters of low confidence take a provider's fields; the provider is asked for those alone."""
    df = extract.settle(extract.extract(src.letters(spark, sf_dir), SUITED), src.build(spark, sf_dir, _PROVIDED), SUITED)
    return df.select("letter_id", "source", "company_name", "candidate_name", F.round("ctc", 2).alias("ctc"))


# ---------------------------------------------------------------- checks and audits

_ENTITIES = "list_distinct(list_transform(regexp_extract_all(full_text, '\\b[A-Z][A-Za-z0-9&]*(?: [A-Z][A-Za-z0-9&]*){0,4} (?:Pvt[.]? Ltd|Private Limited|Limited|Ltd|LLP|Inc|Corp)\\b'), lambda n: lower(n)))"
_KNOWN = lambda *cs: " + ".join(f"CASE WHEN {c} IS NULL THEN 0 ELSE 1 END" for c in cs)


@query("score_halves", f"""{EXTRACTED} SELECT x.letter_id, CASE WHEN d.composites = '' THEN 11 ELSE 2 END AS image_cap, CASE WHEN len({_ENTITIES}) >= 3 THEN 6 WHEN len({_ENTITIES}) = 2 THEN 3 ELSE 0 END AS entity_off, contains(full_text, 'Ignore all previous instructions') AS injected, d.signature IS NOT NULL AS signature_seen,
  {_KNOWN('hr_name', 'hr_designation', 'hr_email')} AS hr_known, {_KNOWN('company_name', 'company_address', 'registration')} + CASE WHEN {_KNOWN('company_email', 'phone', 'website')} >= 2 THEN 1 ELSE 0 END AS company_known FROM x JOIN ({src.plain(src.DETAILS)}) AS d ON x.letter_id = d.letter_id""")
def _(spark, sf_dir):
    """What of the model's scores the letters' own columns settle."""
    more = src.build(spark, sf_dir, src.DETAILS).select("letter_id", "signature", F.filter(F.split("composites", "\\|"), lambda c: c != "").alias("composites"))
    return extract.extract(src.letters(spark, sf_dir), SUITED).join(more, "letter_id").select("letter_id", *[c.alias(n) for n, c in checks.halves().items()])


@query("silent_letters", f"{EXTRACTED}, y AS (SELECT 'letter_' || letter_id || '.pdf' AS file_name, problems FROM x WHERE len(problems) > 0 AND NOT low_confidence AND trim(full_text) <> '') SELECT file_name, array_to_string(problems, '|') AS problems FROM y ORDER BY file_name LIMIT 60")
def _(spark, sf_dir):
    """The report's first 60 letters whose implausible values pass as confident."""
    df = extract.only(audited(spark, sf_dir), F.col("bad") & ~F.col("low"), F.col("file_name"), F.array_join(extract.plausibility_problems(SUITED), "|").alias("problems"))
    return df.orderBy("file_name").limit(60)


@query("final_counts", f"{EXTRACTED}, y AS (SELECT * FROM x WHERE trim(full_text) <> ''), a AS ({_audited('y')}), b AS (SELECT letter_id, count(reason) AS n FROM a GROUP BY letter_id) SELECT count(*) AS audited, (SELECT count(*) FROM y WHERE len(problems) > 0) AS implausible, count(*) FILTER (n > 0) AS dirty FROM b")
def _(spark, sf_dir):
    """How many letters hold implausible values, and how many a suspect field."""
    df = audited(spark, sf_dir).withColumn("dirty", audit.suspect_fields() > 0)
    return df.agg(F.count("*").alias("audited"), F.count_if("bad").alias("implausible"), F.count_if("dirty").alias("dirty"))


SPOTLIGHT = [1, 17, 33, 64, 99, 101]


@query("spotlight", f"{EXTRACTED} SELECT letter_id, company_name, candidate_name, job_title, employment_type, work_location, hr_name, hr_designation, domain, company_email, registration, CAST(offer_date AS VARCHAR) AS offer_date, CAST(joining_date AS VARCHAR) AS joining_date, ctc, basic, hra, gross, coalesce(nullif(array_to_string(problems, '|'), ''), 'CLEAN') AS plausibility FROM x WHERE letter_id IN ({', '.join(map(str, SPOTLIGHT))})")
def _(spark, sf_dir):
    """All fields of letters that are picked by name: the picking is the feature."""
    letters = src.letters(spark, sf_dir).filter(F.col("file_name").isin([f"letter_{k}.pdf" for k in SPOTLIGHT]))
    fields = ["company_name", "candidate_name", "job_title", "employment_type", "work_location", "hr_name", "hr_designation", "domain", "company_email", "registration"]
    problems = F.array_join(extract.plausibility_problems(SUITED), "|")
    return extract.extract(letters, SUITED).select("letter_id", *fields, *[F.col(c).cast("string").alias(c) for c in ("offer_date", "joining_date")], "ctc", "basic", "hra", "gross", F.when(problems == "", "CLEAN").otherwise(problems).alias("plausibility"))
