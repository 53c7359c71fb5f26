"""The registered queries: each runs an operator over whole tables, with plain SQL for the same rows beside it."""

from __future__ import annotations

from pyspark.sql import functions as F

from parchment.config import DESIGN_TOOLS, EDITING_SUITES, FREE_MAIL, ONLINE_TOOLS, PILLARS, PLACEHOLDERS, RED_PHRASES, TEMPLATE_ARTIFACTS
from parchment.functions.text import ascii_text, slug
from parchment.operators import extract, forensic, lookups, queue, rules
from parchment.plans import letters_sql
from parchment.plans.letters_sql import DOMAIN, FIELDS, JOINING, LETTERS, OFFER, RAW, SALARY
from parchment.plans.settings import SUITED
from parchment.sources import letters as src
from parchment.streaming.inbox import screen

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return put


def _quote(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _list(items) -> str:
    return "[" + ", ".join(map(_quote, items)) + "]"


PAGES = "documents"
DATE_ISO = "[0-9]{4}-[0-9]{2}-[0-9]{2}"


def _letters(spark, sf_dir):
    return src.letters(spark, sf_dir).withColumn("t", ascii_text(F.col("full_text")))


def _documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")


# ---------------------------------------------------------------- text signals


@query("red_phrase_scan", f"{LETTERS} SELECT letter_id, array_to_string(list_filter({_list(RED_PHRASES)}, lambda p: contains(lower(full_text), lower(p))), '|') AS phrases FROM letters")
def _(spark, sf_dir):
    return _letters(spark, sf_dir).select("letter_id", F.concat_ws("|", forensic.red_phrases(F.col("full_text"))).alias("phrases"))


@query("template_artifacts", f"{LETTERS} SELECT letter_id, array_to_string(list_concat(list_filter({_list(TEMPLATE_ARTIFACTS)}, lambda p: contains(lower(full_text), lower(p))), regexp_extract_all(full_text, '\\[[A-Z][A-Z\\s]{{2,}}\\]')), '|') AS artifacts FROM letters")
def _(spark, sf_dir):
    return _letters(spark, sf_dir).select("letter_id", F.concat_ws("|", forensic.template_artifacts(F.col("full_text"))).alias("artifacts"))


_HOLDERS = " || ".join(f"CASE WHEN regexp_matches(full_text, {_quote(p)}) THEN {_quote(n + '=')} || array_to_string(list_slice(regexp_extract_all(full_text, {_quote(p)}), 1, 3), ',') || ';' ELSE '' END" for n, p in PLACEHOLDERS)


@query("placeholder_scan", f"{LETTERS} SELECT letter_id, {_HOLDERS} AS found FROM letters")
def _(spark, sf_dir):
    found = F.transform(forensic.placeholders(F.col("full_text")), lambda x: F.concat(x["type"], F.lit("="), F.array_join(x["examples"], ","), F.lit(";")))
    return _letters(spark, sf_dir).select("letter_id", F.array_join(found, "").alias("found"))


@query("ascii_normalise", "SELECT doc_id, md5(regexp_replace(text, '[^\\x00-\\x7F]', ' ', 'g')) AS digest, length(text) AS n FROM documents")
def _(spark, sf_dir):
    return _documents(spark, sf_dir).select("doc_id", F.md5(ascii_text(F.col("text"))).alias("digest"), F.length("text").cast("long").alias("n"))


# ---------------------------------------------------------------- fields



def _field(name, column, of=None):
    """A query of one extracted column over the letters."""

    @query(name, f"{LETTERS} SELECT letter_id, {FIELDS[name]} AS {of or name} FROM letters")
    def run(spark, sf_dir):
        return _letters(spark, sf_dir).select("letter_id", column(F.col("t")).cast("string").alias(of or name))


_field("company_email", extract.company_email)
_field("candidate_email", extract.candidate_email)
_field("website", extract.website)
_field("phone", extract.phone)
_field("cin_gst_udyam", extract.registration)
_field("employment_type", extract.employment_type)
_field("work_location", extract.work_location)
_field("company_name", extract.company_name)
_field("candidate_name", extract.candidate_name)
_field("job_title", extract.job_title)
_field("offer_date", extract.offer_date)


def _signed(name):
    @query(name, f"{LETTERS} SELECT letter_id, {name} FROM letters")
    def run(spark, sf_dir):
        return extract.hr_contact(_letters(spark, sf_dir), F.col("t")).select("letter_id", name)


for _name in ("hr_name", "hr_designation", "hr_email"):
    _signed(_name)


@query("company_domain", f"{LETTERS}, e AS (SELECT letter_id, t, {FIELDS['company_email']} AS company_email, {FIELDS['website']} AS website FROM letters) SELECT letter_id, by_mail, list_contains({_list(FREE_MAIL)}, by_mail) AS is_generic FROM (SELECT letter_id, {DOMAIN} AS by_mail FROM e) AS x")
def _(spark, sf_dir):
    df = _letters(spark, sf_dir).withColumn("mail", extract.company_email(F.col("t"))).withColumn("site", extract.website(F.col("t")))
    return df.withColumn("by_mail", extract.company_domain(F.col("t"), F.col("mail"), F.col("site"))).select("letter_id", "by_mail", F.col("by_mail").isin(FREE_MAIL).alias("is_generic"))


@query("joining_date", f"{LETTERS}, e AS (SELECT *, {OFFER} AS offer_date FROM letters) SELECT letter_id, CAST({JOINING} AS VARCHAR) AS joining_date FROM e")
def _(spark, sf_dir):
    df = _letters(spark, sf_dir).withColumn("o", extract.offer_date(F.col("t")))
    return df.select("letter_id", extract.joining_date(F.col("t"), F.col("o"), SUITED.as_of).cast("string").alias("joining_date"))


@query("salary_components", f"{LETTERS}, e AS (SELECT letter_id, {RAW} FROM letters) SELECT letter_id, {', '.join(f'round({sql}, 2) AS {n}' for n, sql in SALARY.items())} FROM e")
def _(spark, sf_dir):
    pay = extract.salary(F.col("t"), F.col("low"))
    return _letters(spark, sf_dir).withColumn("low", F.lower("t")).select("letter_id", *[F.round(v, 2).alias(n) for n, v in pay.items()])


@query("field_repair")
def _(spark, sf_dir):
    return extract.extract(src.letters(spark, sf_dir), SUITED).select("letter_id", *[F.col(c).cast("string").alias(c) for c in extract.FIELDS])


@query("low_confidence")
def _(spark, sf_dir):
    df = extract.extract(src.letters(spark, sf_dir), SUITED)
    return df.select("letter_id", F.concat_ws("|", extract.plausibility_problems(SUITED)).alias("problems"), extract.low_confidence(SUITED).alias("low_confidence"))


_MAIL_HITS = "regexp_extract_all(regexp_replace(text, '[^\\x00-\\x7F]', ' ', 'g'), '[A-Za-z0-9._%+\\-]+@[A-Za-z0-9.\\-]+\\.[A-Za-z]{2,}')"


@query("document_emails", f"SELECT doc_id, lower({_MAIL_HITS}[1]) AS mail, CAST(len({_MAIL_HITS}) AS BIGINT) AS n FROM documents WHERE len({_MAIL_HITS}) > 0")
def _(spark, sf_dir):
    mails = F.regexp_extract_all(ascii_text(F.col("text")), F.lit(extract.EMAIL), F.lit(0))
    df = _documents(spark, sf_dir).withColumn("mails", mails).filter(F.size("mails") > 0)
    return df.select("doc_id", F.lower(F.element_at("mails", 1)).alias("mail"), F.size("mails").cast("long").alias("n"))


# ---------------------------------------------------------------- structure

_ZONE = "CASE WHEN y0 < 0.25 * page_h THEN 'top' WHEN y0 > 0.75 * page_h THEN 'bottom' ELSE 'middle' END"
_SIDE = "CASE WHEN x0 < 0.33 * page_w THEN 'left' WHEN x0 > 0.66 * page_w THEN 'right' ELSE 'center' END"


@query("image_classify", f"""WITH i AS (SELECT *, {_ZONE} AS zone, {_ZONE} || '-' || {_SIDE} AS place, w >= 30 AND h >= 30 AS usable FROM ({src.plain(src.IMAGES)}) AS x),
r AS (SELECT *, row_number() OVER (PARTITION BY letter_id, zone, usable ORDER BY page_no, img_no, x0, y0, w, h) = 1 AND usable AND zone <> 'middle' AS taken FROM i)
SELECT letter_id, count(*) AS n_images, max(place) FILTER (taken AND zone = 'top') AS logo, max(place) FILTER (taken AND zone = 'bottom') AS signature, coalesce(bool_or(usable AND NOT taken AND abs(w - h) < 20), false) AS has_stamp FROM r GROUP BY letter_id""")
def _(spark, sf_dir):
    return forensic.image_summary(src.build(spark, sf_dir, src.IMAGES))


_MADE = "coalesce(nullif(creator, ''), nullif(producer, ''))"
_GAP = "CAST(floor((epoch(modified) - epoch(created)) / 86400) AS INTEGER)"
_REASONS = f"list_concat([CASE WHEN author IS NULL AND created IS NULL AND {_MADE} IS NULL THEN 'no metadata' END, CASE WHEN created > DATE '{SUITED.as_of}' + 1 THEN 'created in the future' END, CASE WHEN {_GAP} > 1 THEN 'modified ' || {_GAP} || ' days after creation' END], list_transform(list_filter({_list(DESIGN_TOOLS + EDITING_SUITES)}, lambda x: contains(lower({_MADE}), lower(x))), lambda x: 'made with ' || x))"


@query("metadata_suspicion", f"SELECT letter_id, coalesce(array_to_string(list_filter({_REASONS}, lambda x: x IS NOT NULL), '; '), '') AS reasons, list_filter({_list(ONLINE_TOOLS)}, lambda x: contains(lower({_MADE}), lower(x)))[1] AS online_tool FROM ({src.plain(src.META)}) AS x")
def _(spark, sf_dir):
    return forensic.metadata_reasons(src.build(spark, sf_dir, src.META), SUITED.as_of).select("letter_id", "reasons", "online_tool")


FEATURES = "SELECT letter_id, page_no, CASE WHEN letter_id % 3 = 0 THEN 'short' ELSE 'a page with enough text on it' END AS text, CAST(100 + letter_id % 100 AS INT) AS n_drawings, CAST(letter_id % 2 AS INT) AS n_fonts"


@query("composite_forgery", f"""WITH i AS ({src.plain(src.IMAGES)}), p AS ({FEATURES} FROM (SELECT DISTINCT letter_id, page_no FROM i)),
b AS (SELECT letter_id, page_no, count(*) FILTER (CAST(px_w AS BIGINT) * px_h > 1000000) AS lg, count(*) FILTER (CAST(px_w AS BIGINT) * px_h < 80000) AS sm FROM i GROUP BY ALL)
SELECT p.letter_id, p.page_no FROM p JOIN b USING (letter_id, page_no) WHERE length(trim(text)) < 20 AND lg >= 1 AND sm >= 1 AND n_drawings > 150 AND n_fonts = 0""")
def _(spark, sf_dir):
    images = src.build(spark, sf_dir, src.IMAGES)
    pages = spark.sql(FEATURES + " FROM (SELECT DISTINCT letter_id, page_no FROM {images})", images=images)
    return forensic.composite_pages(images, pages)


# ---------------------------------------------------------------- rules, one chain of staged SQL for all of them

_SUM = "coalesce(basic, 0) + coalesce(hra, 0) + coalesce(special, 0) + coalesce(pf_employer, 0) + coalesce(gratuity, 0)"
_YEAR = f"(CASE WHEN {_SUM} < ctc / 6 THEN ({_SUM}) * 12 ELSE {_SUM} END)"
_DAYS = f"(DATE '{SUITED.as_of}' - offer_date)"
_TEN = ["domain", "offer_date", "joining_date", "ctc", "basic", "hra", "special", "pf_employer", "image_score", "text_score"]
_FULL = " + ".join(f"CASE WHEN coalesce(CAST({c} AS VARCHAR), '') IN ('', '0', '0.0') THEN 0 ELSE 1 END" for c in _TEN)
_ONLINE = "CASE WHEN NOT (dns_error OR NOT checked) THEN least(11, 4 * CAST(dns_valid AS INT) + 7 * CAST(found AS INT)) END"
_TOTAL = " + ".join(f"coalesce(CAST({n}_score AS DOUBLE), {w / 2})" for n, w in PILLARS.items())
_MISSING = " OR ".join(f"{n}_score IS NULL" for n in PILLARS)


def chain(facts: str, completeness: str) -> str:
    """The rules as CTEs f to j over facts (SQL), completeness being an expression over them."""
    return f"""f AS ({facts}),
a AS (SELECT *, joining_date - offer_date AS gap_days, {_DAYS} AS age_days, CASE WHEN ctc IS NOT NULL AND ctc > 0 AND {_SUM} > 100 THEN {_YEAR} / ctc <= 1.05 AND {_YEAR} / ctc >= 0.40 END AS salary_ok,
  CASE WHEN ctc IS NOT NULL AND ctc > 0 AND {_SUM} > 100 THEN CAST(trunc({_YEAR} / ctc * 100) AS INT) END AS salary_percent, {completeness} AS completeness, {_ONLINE} AS online_score FROM f),
b AS (SELECT *, CASE WHEN gap_days IS NULL THEN NULL WHEN gap_days < 0 THEN 'impossible' WHEN gap_days > 90 THEN 'too long' WHEN gap_days < 3 THEN 'short' ELSE 'valid' END AS gap_state,
  CASE WHEN age_days < 0 OR age_days > 365 THEN 'red' WHEN age_days > 90 THEN 'yellow' ELSE 'green' END AS age_level, {_TOTAL} AS total, {_MISSING} AS unverified FROM a),
c AS (SELECT *, greatest(0, CAST(round_even(total, 0) AS INT)) AS score FROM b),
d AS (SELECT *, CASE WHEN score >= 80 THEN 'LEGITIMATE' WHEN score >= 51 THEN 'MANUAL REVIEW' ELSE 'SUSPICIOUS' END AS v0, checked AND NOT found AND NOT dns_valid AND NOT dns_error AS c2,
  n_red > 0 OR template OR coalesce(gap_state = 'impossible', false) OR age_days < 0 AS c3, floating_date AND online_edit AS c4 FROM c),
e AS (SELECT *, unverified AND v0 <> 'SUSPICIOUS' AS g1, CASE WHEN unverified AND v0 <> 'SUSPICIOUS' THEN 'MANUAL REVIEW' ELSE v0 END AS v1 FROM d),
g AS (SELECT *, v1 = 'LEGITIMATE' AND c2 AS g2, v1 = 'LEGITIMATE' AND c3 AND NOT c2 AS g3, CASE WHEN v1 = 'LEGITIMATE' AND (c2 OR c3) THEN 'MANUAL REVIEW' ELSE v1 END AS v3 FROM e),
h AS (SELECT *, c4 AND v3 <> 'SUSPICIOUS' AS g4, composite AND v3 <> 'SUSPICIOUS' AND NOT c4 AS g5, CASE WHEN c4 OR composite THEN 'SUSPICIOUS' ELSE v3 END AS verdict FROM g),
i AS (SELECT *, CASE WHEN g5 THEN 'composite forgery' WHEN g4 THEN 'edited date' WHEN g3 THEN 'fraud signal' WHEN g2 THEN 'company not found' WHEN g1 THEN 'unverified pillar' END AS gate,
  CASE WHEN c2 OR c3 OR c4 OR composite THEN least(score, CASE verdict WHEN 'SUSPICIOUS' THEN 50 WHEN 'MANUAL REVIEW' THEN 79 ELSE 100 END) ELSE score END AS final_score,
  list_filter([CASE WHEN template THEN {{'reason': 'template', 'points': -15}} END, CASE WHEN n_red > 0 THEN {{'reason': 'red phrases', 'points': -least(10 * n_red, 30)}} END, CASE WHEN gap_state = 'impossible' THEN {{'reason': 'impossible date', 'points': -15}} END,
    CASE WHEN NOT salary_ok THEN {{'reason': 'salary math', 'points': -12}} END, CASE WHEN suspicious_metadata THEN {{'reason': 'metadata', 'points': -8}} END, CASE WHEN online_edit THEN {{'reason': 'online edit', 'points': -2}} END, CASE WHEN completeness < 0.6 THEN {{'reason': 'incomplete', 'points': -10}} END,
    CASE WHEN age_days < 0 THEN {{'reason': 'future offer', 'points': -15}} END, CASE WHEN age_days > 365 THEN {{'reason': 'very old offer', 'points': -20}} END, CASE WHEN age_days BETWEEN 181 AND 365 THEN {{'reason': 'old offer', 'points': -10}} END], lambda x: x IS NOT NULL) AS penalties FROM h),
j AS (SELECT *, CASE WHEN template AND final_score < 40 THEN 'REJECT' WHEN n_red > 0 AND final_score < 50 THEN 'REJECT' WHEN gate IS NOT NULL AND advice = 'APPROVE' THEN 'REVIEW' ELSE advice END AS action,
  list_concat(list_filter([CASE WHEN gate IS NOT NULL THEN 'Visual Analysis Incomplete' END, CASE WHEN domain IS NOT NULL AND NOT dns_valid THEN 'Domain Does Not Resolve' END, CASE WHEN domain IS NOT NULL AND dns_valid AND NOT mx THEN 'No Mail Server Found' END, CASE WHEN gap_days BETWEEN 0 AND 2 THEN 'Very Short Joining Gap' END], lambda x: x IS NOT NULL),
    list_transform(list_filter(penalties, lambda p: abs(p.points) < 10), lambda p: 'Risk Signal Detected: ' || p.reason)) AS yellow, list_transform(list_filter(penalties, lambda p: abs(p.points) >= 10), lambda p: 'Risk Signal Detected: ' || p.reason) AS red FROM i)"""


CHAIN = f"WITH {chain(src.plain(src.FACTS), f'round(({_FULL}) / 10.0, 2)')}"


def _facts(spark, sf_dir):
    df = src.build(spark, sf_dir, src.FACTS)
    return df.withColumn("completeness", rules.completeness([F.col(c) for c in _TEN]))


def _rule(name, columns, sql=None):
    """A query over the chain of rules. columns: of the analysed letters, with expressions by alias."""

    @query(name, f"{CHAIN} SELECT letter_id, {sql or ', '.join(columns)} FROM j")
    def run(spark, sf_dir):
        return rules.analyze(_facts(spark, sf_dir), SUITED).select("letter_id", *[F.expr(c) for c in columns])


_rule("date_logic", ["CAST(gap_days AS LONG) AS gap_days", "gap_state"], "gap_days, gap_state")
_rule("offer_age", ["CAST(age_days AS LONG) AS age_days", "age_level"], "age_days, age_level")
_rule("salary_math", ["salary_ok", "salary_percent"])
_rule("completeness", ["completeness"])
_rule("online_pillar", ["CAST(online_score AS INT) AS online_score"], "CAST(online_score AS INT) AS online_score")
_rule("pillar_scores", ["total", "score", "unverified"])
_rule("penalties", ["array_join(transform(penalties, p -> concat(p.reason, ':', p.points)), '|') AS penalties"], "array_to_string(list_transform(penalties, lambda p: p.reason || ':' || p.points), '|') AS penalties")
_rule("verdict_gates", ["verdict", "gate"])
_rule("score_clamp", ["score", "final_score"])
_rule("recommended_action", ["action"])
_rule("flag_sort", ["array_join(flags.title, '|') AS flags"], "array_to_string(list_concat(red, yellow), '|') AS flags")
_rule("end_to_end", ["verdict", "gate", "final_score", "action", "array_join(flags.title, '|') AS flags"], "verdict, gate, final_score, action, array_to_string(list_concat(red, yellow), '|') AS flags")

_BANDS = " UNION ALL ".join(f"SELECT letter_id, '{n}' AS pillar, CASE WHEN {n}_score IS NULL THEN 'medium' WHEN {n}_score * 100.0 / {w} >= 66 THEN 'high' WHEN {n}_score * 100.0 / {w} >= 33 THEN 'medium' ELSE 'low' END AS band FROM j" for n, w in PILLARS.items())


@query("report_pillar_bands", f"{CHAIN}, k AS ({_BANDS}) SELECT pillar, band, count(*) AS n FROM k GROUP BY pillar, band")
def _(spark, sf_dir):
    df = rules.pillars(_facts(spark, sf_dir))
    rows = F.explode(F.array(*[F.struct(F.lit(n).alias("pillar"), rules.band(F.col(f"p_{n}.score"), F.col(f"p_{n}.max"), F.col(f"p_{n}.kind")).alias("band")) for n in PILLARS]))
    return df.select(rows.alias("x")).groupBy("x.pillar", "x.band").agg(F.count("*").alias("n"))


@query("report_overview", f"{CHAIN} SELECT verdict, count(*) AS n, round(avg(final_score), 4) AS mean_score, min(final_score) AS lowest, max(final_score) AS highest, count(gate) AS gated FROM j GROUP BY verdict")
def _(spark, sf_dir):
    df = rules.analyze(_facts(spark, sf_dir), SUITED)
    return df.groupBy("verdict").agg(F.count("*").alias("n"), F.round(F.avg("final_score"), 4).alias("mean_score"), F.min("final_score").alias("lowest"), F.max("final_score").alias("highest"), F.count("gate").alias("gated"))


@query("report_filename", f"{LETTERS} SELECT letter_id, trim(regexp_replace(nation, '[^a-zA-Z0-9]+', '_', 'g'), '_') || '_{SUITED.as_of}_' || substr(md5(file_name), 1, 4) AS report FROM letters")
def _(spark, sf_dir):
    return src.letters(spark, sf_dir).select("letter_id", F.concat(slug(F.col("nation")), F.lit(f"_{SUITED.as_of}_"), F.substring(F.md5("file_name"), 1, 4)).alias("report"))


_ANSWER = "CASE CAST(o_orderkey % 5 AS INT) WHEN 0 THEN 'no json' WHEN 1 THEN concat('```json', chr(10), '{{\"text_tampering_score\": ', CAST(o_orderkey % 12 AS STRING), '}}', chr(10), '```') WHEN 2 THEN concat('Here: {{\"text_tampering_score\": \"', CAST(o_orderkey % 12 AS STRING), '\", \"recommended_action\": \"APPROVE\"}} done') ELSE concat('{{\"text_tampering_score\": ', CAST(o_orderkey % 12 AS STRING), ', \"image_tampering_score\": 7, \"recommended_action\": \"REJECT\"}}') END"
_ANSWERS = f"SELECT o_orderkey AS letter_id, {_ANSWER} AS response, o_orderkey % 2 = 0 AS images FROM {{orders}}"


@query("llm_response_parse", f"SELECT letter_id, CASE WHEN letter_id % 5 <> 0 THEN CAST(letter_id % 12 AS INT) END AS text_score, CASE WHEN letter_id % 5 > 2 AND images THEN 7 END AS image_score, CASE WHEN letter_id % 5 < 2 THEN 'REVIEW' WHEN letter_id % 5 = 2 THEN 'APPROVE' ELSE 'REJECT' END AS advice, letter_id % 5 = 0 AS failed FROM ({src.plain(_ANSWERS)}) AS x")
def _(spark, sf_dir):
    df = src.build(spark, sf_dir, _ANSWERS).withColumn("s", rules.parse_scores(F.col("response"), F.col("images")))
    return df.select("letter_id", "s.text_score", "s.image_score", "s.advice", "s.failed")


# ---------------------------------------------------------------- lookups and relational steps

_DOMAIN = "regexp_extract(lower(url), '^[a-z]+://(?:www\\.)?([^/?#:]+)', 1)"


@query("domain_normalise", f"SELECT page_id, {_DOMAIN} AS domain FROM pages")
def _(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", lookups.normal_domain(F.col("url")).alias("domain"))


_DNS = "SELECT DISTINCT concat('nova', CAST(o_custkey % 400 AS STRING), '.co.in') AS domain, o_custkey % 400 % 3 > 0 AS dns_valid, o_custkey % 400 % 7 = 0 AS lookup_error FROM {orders}"


@query("dns_join", f"WITH f AS ({src.plain(src.FACTS)}), d AS ({src.plain(_DNS)}) SELECT letter_id, f.domain, coalesce(d.dns_valid, false) AS dns_valid, CASE WHEN f.domain IS NULL THEN false ELSE coalesce(d.lookup_error, true) END AS lookup_error FROM f LEFT JOIN d ON f.domain = d.domain")
def _(spark, sf_dir):
    letters = src.build(spark, sf_dir, src.FACTS).select("letter_id", "domain")
    return lookups.join_dns(letters, src.build(spark, sf_dir, _DNS)).select("letter_id", "domain", "dns_valid", "lookup_error")


@query("missing_domains", f"WITH f AS ({src.plain(src.FACTS)}), d AS ({src.plain(_DNS)}) SELECT DISTINCT domain FROM f WHERE domain IS NOT NULL AND domain NOT IN (SELECT domain FROM d)")
def _(spark, sf_dir):
    return lookups.missing(src.build(spark, sf_dir, src.FACTS), src.build(spark, sf_dir, _DNS))


_EVIDENCE = """SELECT o_custkey AS key, CASE WHEN o_custkey % 7 = 0 THEN NULL ELSE concat('Nova', CAST(o_custkey % 50 AS STRING)) END AS company_name, CASE CAST(o_custkey % 5 AS INT) WHEN 0 THEN NULL WHEN 1 THEN 'gmail.com' ELSE concat('nova', CAST(o_custkey % 50 AS STRING), '.in') END AS domain,
  m.method AS method, (o_custkey * m.p + m.p) % 9 = 0 AS hit, (o_custkey + m.p) % 3 <> 0 AS error, concat(m.method, ' says ', CAST(o_custkey % 4 AS STRING)) AS note
FROM (SELECT DISTINCT o_custkey FROM {orders}) AS o CROSS JOIN (SELECT 'website' AS method, 1 AS p UNION ALL SELECT 'encyclopedia', 2 UNION ALL SELECT 'search', 3 UNION ALL SELECT 'guess', 4) AS m"""
_TRIED = "list_sort(list_filter(list({'p': CASE method WHEN 'website' THEN 1 WHEN 'encyclopedia' THEN 2 WHEN 'search' THEN 3 ELSE 4 END, 'm': method, 'hit': hit, 'error': error, 'note': note}), lambda t: CASE WHEN t.p = 1 THEN d IS NOT NULL AND d <> 'gmail.com' ELSE c IS NOT NULL END))"
_ONLINE_SQL = f"""WITH e AS (SELECT *, max(company_name) OVER (PARTITION BY key) AS c, max(domain) OVER (PARTITION BY key) AS d FROM ({src.plain(_EVIDENCE)}) AS x), g AS (SELECT key, c, d, {_TRIED} AS tried FROM e GROUP BY key, c, d),
h AS (SELECT *, list_filter(tried, lambda t: t.hit)[1] AS h, list_filter(tried, lambda t: t.p < 4) AS sound, list_filter(tried, lambda t: t.p < 4 AND t.error) AS bad FROM g), i AS (SELECT *, (c IS NULL AND d IS NULL) OR h IS NOT NULL OR len(sound) > len(bad) AS checked FROM h)
SELECT key, h IS NOT NULL AS found, h.m AS method, checked, CASE WHEN c IS NULL AND d IS NULL THEN 'No company name or domain to check' WHEN h IS NOT NULL THEN h.note
  WHEN NOT checked AND len(tried) > 0 THEN 'Online check could NOT complete for ' || chr(39) || coalesce(c, d) || chr(39) || ' — all ' || len(tried) || ' attempt(s) hit network/system errors: ' || array_to_string(list_transform(bad, lambda t: t.note)[1:3], '; ')
  ELSE 'No online presence for ' || chr(39) || coalesce(c, d) || chr(39) || ' — tried: ' || coalesce(nullif(array_to_string(list_transform(tried, lambda t: CASE t.p WHEN 1 THEN 'direct fetch of ' || d WHEN 2 THEN 'Wikipedia' WHEN 3 THEN 'DuckDuckGo' ELSE 'DNS-guess' END), ', '), ''), 'nothing') END AS note FROM i"""


@query("online_evidence", _ONLINE_SQL)
def _(spark, sf_dir):
    return lookups.online(src.build(spark, sf_dir, _EVIDENCE))


_GUESS = "SELECT DISTINCT concat('nova', CAST(o_custkey % 500 AS STRING), CASE CAST(o_custkey % 3 AS INT) WHEN 0 THEN '.com' WHEN 1 THEN '.co.in' ELSE '.net' END) AS domain, o_custkey % 5 > 0 AS dns_valid FROM {orders}"
_NAMES = "SELECT DISTINCT concat('Nova', CAST(o_custkey % 500 AS STRING), CASE CAST(o_custkey % 3 AS INT) WHEN 0 THEN ' Solutions Pvt Ltd' WHEN 1 THEN ' Software & Tech Foundation' ELSE '-India Global Systems' END) AS company_name FROM {orders}"


@query("dns_guess", f"""WITH n AS ({src.plain(_NAMES)}), d AS (SELECT domain FROM ({src.plain(_GUESS)}) AS x WHERE dns_valid),
g AS (SELECT company_name, regexp_replace(regexp_replace(lower(company_name), ' (solutions|software|tech|foundation|pvt|ltd|global)|-india', '', 'g'), '[^a-z0-9]', '', 'g') || t.tld AS domain, t.rank FROM n, (VALUES (0, '.com'), (1, '.in'), (2, '.co.in'), (3, '.org'), (4, '.net')) AS t(rank, tld))
SELECT company_name, arg_min(g.domain, rank) AS domain FROM g JOIN (SELECT DISTINCT domain FROM d) AS d ON g.domain = d.domain GROUP BY company_name""")
def _(spark, sf_dir):
    facts = src.build(spark, sf_dir, _GUESS).filter("dns_valid").select("domain").distinct().withColumn("dns_valid", F.lit(True))
    return lookups.guesses(src.build(spark, sf_dir, _NAMES), facts)


@query("batch_result_join", "SELECT o_orderkey AS custom_id, count(*) AS n_results, max(l_linenumber) AS last FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE o_orderstatus = 'F' GROUP BY o_orderkey")
def _(spark, sf_dir):
    """Results meet the requests that they answer; those of other requests are dropped."""
    requests = spark.read.parquet(f"{sf_dir}/orders.parquet").filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("custom_id"))
    results = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_orderkey").alias("custom_id"), "l_linenumber")
    return requests.join(results, "custom_id").groupBy("custom_id").agg(F.count("*").alias("n_results"), F.max("l_linenumber").alias("last"))


@query("inbox_listing", "SELECT o_orderkey AS letter_id, status, row_number() OVER (PARTITION BY status ORDER BY CASE WHEN status = 'processed' THEN -epoch(o_orderdate) ELSE 0 END, o_orderkey) AS place FROM (SELECT *, CASE o_orderstatus WHEN 'F' THEN 'processed' WHEN 'P' THEN 'processing' ELSE 'unprocessed' END AS status FROM orders) AS x")
def _(spark, sf_dir):
    """Waiting and running letters by key, finished ones by time, the latest first; places are within a status."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_orderstatus", "o_orderdate")
    df = o.withColumn("status", F.when(F.col("o_orderstatus") == "F", "processed").when(F.col("o_orderstatus") == "P", "processing").otherwise("unprocessed"))
    when = F.when(F.col("status") == "processed", -F.unix_seconds(F.col("o_orderdate").cast("timestamp"))).otherwise(F.col("o_orderkey"))
    return queue.places(df, "status", when, "o_orderkey").select(F.col("o_orderkey").alias("letter_id"), "status", F.col("place").cast("long").alias("place"))


# ---------------------------------------------------------------- audits


def audited(spark, sf_dir):
    """Extracted letters that have a text, with bad (implausible) and low (not confident)."""
    letters = src.letters(spark, sf_dir).filter(F.trim("full_text") != "")
    return extract.extract(letters, SUITED).withColumn("low", extract.low_confidence(SUITED)).withColumn("bad", F.size(extract.plausibility_problems(SUITED)) > 0)


@query("audit_extraction")
def _(spark, sf_dir):
    silent = F.count_if(F.col("bad") & ~F.col("low"))
    counts = audited(spark, sf_dir).agg(F.count("*").alias("audited"), F.count_if("low").alias("low_confidence"), F.count_if("bad").alias("implausible"), silent.alias("silent_bad"), F.round(F.try_divide(silent * 100, F.count("*")), 1).alias("silent_percent"))
    total = src.letters(spark, sf_dir).agg(F.count("*").alias("total"), F.count_if(F.trim("full_text") == "").alias("no_text"))
    return total.join(counts, F.lit(True))  # one row each


@query("audit_final")
def _(spark, sf_dir):
    df = screen(src.letters(spark, sf_dir), SUITED)
    return df.groupBy("screen", "employment_type").agg(F.count("*").alias("n"), F.count_if(F.size("red_phrases") > 0).alias("red"), F.count_if(F.size("artifacts") > 0).alias("templates"))


# ---------------------------------------------------------------- pages, model input, rescue

_LINES = "SELECT l_orderkey AS letter_id, 1 + CAST(l_linenumber % 2 AS INT) AS page_no, l_linenumber AS line_no, CASE CAST(l_partkey % 6 AS INT) WHEN 0 THEN concat(CAST(1 + l_suppkey % 28 AS STRING), ' March 2025') WHEN 1 THEN ' april 2025 ' WHEN 2 THEN '3rd May 2025' WHEN 3 THEN 'on 3 May 2025' ELSE 'other text' END AS text, CAST(l_suppkey * 13 % 850 AS DOUBLE) AS y0, 842.0 AS page_h FROM {lineitem}"
_ALONE = "regexp_matches(trim(text), '(?i)^([0-9]{1,2}(st|nd|rd|th)?\\s+)?(mar|apr|may)[a-z]*\\s+[0-9]{4}$')"


@query("floating_dates", f"SELECT letter_id, page_no, line_no, 'page ' || page_no || ': floating date ' || chr(39) || trim(text) || chr(39) AS finding FROM ({src.plain(_LINES)}) AS x WHERE {_ALONE} AND y0 / page_h > 0.15 AND y0 / page_h < 0.85")
def _(spark, sf_dir):
    return forensic.floating_dates(src.build(spark, sf_dir, _LINES))


_SHEETS = "SELECT l_orderkey AS letter_id, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) - 1 AS INT) AS page_no, CASE CAST(l_partkey % 9 AS INT) WHEN 0 THEN 'Annual CTC and HRA' WHEN 1 THEN 'Authorised Signatory' ELSE 'terms' END AS text FROM {lineitem}"
_ORDERED = "list_filter([0, 1, sal, sig, CASE WHEN sal IS NULL AND sig IS NULL THEN n - 1 END], lambda x: x IS NOT NULL)"


@query("page_selection", f"""WITH p AS (SELECT letter_id, CAST(count(*) AS INT) AS n, max(page_no) FILTER (contains(text, 'CTC')) AS sal, max(page_no) FILTER (contains(text, 'Signatory')) AS sig FROM ({src.plain(_SHEETS)}) AS x GROUP BY letter_id)
SELECT letter_id, array_to_string(CASE WHEN n <= 4 THEN range(n) ELSE list_filter({_ORDERED}, lambda x, i: list_position({_ORDERED}, x) = i) END, ',') AS pages, coalesce(sig, n - 1) AS signature_page FROM p""")
def _(spark, sf_dir):
    df = forensic.page_selection(src.build(spark, sf_dir, _SHEETS))
    return df.select("letter_id", F.array_join(F.col("pages").cast("array<string>"), ",").alias("pages"), "signature_page")


_field("pin_address", extract.pin_address)


@query("model_text", "SELECT doc_id, length(m) AS n, md5(m) AS digest FROM (SELECT doc_id, CASE WHEN length(text) <= 4000 THEN text ELSE substr(text, 1, 2000) || chr(10) || '[...]' || chr(10) || right(text, 1000) END AS m FROM documents) AS x")
def _(spark, sf_dir):
    df = _documents(spark, sf_dir).withColumn("m", extract.model_text(F.col("text"), 4000, 2000, 1000))
    return df.select("doc_id", F.length("m").cast("long").alias("n"), F.md5("m").alias("digest"))


@query("model_text_full", "SELECT doc_id, length(m) AS n, md5(m) AS digest FROM (SELECT doc_id, CASE WHEN length(text) <= 40000 THEN text ELSE substr(text, 1, 20000) || chr(10) || '[...]' || chr(10) || right(text, 10000) END AS m FROM documents) AS x")
def _(spark, sf_dir):
    """With the limits of production."""
    return _documents(spark, sf_dir).select("doc_id", extract.model_text(F.col("text")).alias("m")).select("doc_id", F.length("m").cast("long").alias("n"), F.md5("m").alias("digest"))


_FOUND = "SELECT o_orderkey AS letter_id, CASE WHEN o_orderkey % 20 = 0 THEN concat('nova', CAST(o_orderkey % 400 AS STRING), '.co.in') END AS found_domain FROM {orders}"


@query("rescue_rejoin", f"""WITH f AS ({src.plain(src.FACTS)}), r AS ({src.plain(_FOUND)}), d AS ({src.plain(_DNS)}),
j AS (SELECT f.letter_id, coalesce(f.domain, r.found_domain) AS domain, f.domain IS NULL AND r.found_domain IS NOT NULL AS rescued FROM f LEFT JOIN r ON f.letter_id = r.letter_id)
SELECT letter_id, j.domain, rescued, coalesce(d.dns_valid, false) AS dns_valid, CASE WHEN j.domain IS NULL THEN false ELSE coalesce(d.lookup_error, true) END AS lookup_error FROM j LEFT JOIN d ON j.domain = d.domain""")
def _(spark, sf_dir):
    letters = src.build(spark, sf_dir, src.FACTS).select("letter_id", "domain")
    return lookups.rescue(letters, src.build(spark, sf_dir, _FOUND), src.build(spark, sf_dir, _DNS)).select("letter_id", "domain", "rescued", "dns_valid", "lookup_error")


@query("audit_problems")
def _(spark, sf_dir):
    """The problems of implausible letters, with those whose extraction was confident all the same."""
    df = extract.extract(src.letters(spark, sf_dir), SUITED).withColumn("low", extract.low_confidence(SUITED)).withColumn("problem", F.explode(extract.plausibility_problems(SUITED)))
    return df.groupBy("problem").agg(F.count("*").alias("n"), F.count_if(~F.col("low")).alias("silent"), F.min("letter_id").alias("first_letter"))
