"""The field audit, the checks and the report columns on small tables."""

import datetime as dt
import hashlib

from pyspark.sql import functions as F

from parchment.operators import audit, checks, extract, report
from parchment.plans import catalog, review
from parchment.sources import letters as src

NAMES = list(audit.RULES)


def fields(spark, *rows):
    full = [tuple([k, *(r.get(f) for f in NAMES)]) for k, r in enumerate(rows)]
    return spark.createDataFrame(full, "letter_id long, " + ", ".join(f"{f} string" for f in NAMES))


def test_every_reason_is_met(spark, sf):
    met = {(r.field, r.reason) for r in audit.audited(src.build(spark, sf, review.ODD)).filter("reason is not null").select("field", "reason").distinct().collect()}
    assert met == {(f, reason) for f, rules in audit.RULES.items() for reason, _ in rules}


def test_first_reason_wins_and_nothing_is_no_problem(spark):
    df = fields(spark, {}, {f: "" for f in NAMES}, {"hr_name": "HR Asha 1", "candidate_name": "Asha"}, {"job_title": "Clerk", "company_name": None, "candidate_name": ""})
    rows = audit.audited(df).collect()
    assert len(rows) == 4 * len(NAMES)
    assert [(r.letter_id, r.field, r.reason) for r in rows if r.reason] == [(2, "hr_name", "designation")]
    assert all(r.value is None for r in rows if r.letter_id < 2)


def test_examples_are_the_first_four(spark):
    df = fields(spark, *[{"phone": "1"} for _ in range(9)])
    assert sorted((r.field, r.nth, r.letter_id) for r in audit.examples(audit.audited(df)).collect()) == [("phone", k + 1, k) for k in range(4)]
    total = {r.field: (r.missing, r.suspect) for r in audit.summary(audit.audited(df)).collect()}
    assert total["phone"] == (0, 9) and total["domain"] == (9, 0)
    assert audit.summary(audit.audited(df.limit(0))).count() == 0


LETTER = {
    "full_text": "probation of 3 months, notice period 30 days, provident fund and gratuity apply", "offer_date": dt.date(2025, 1, 1), "joining_date": dt.date(2025, 1, 20), "company_email": "hr@a.in", "phone": "9", "website": None,
    "registration": "U1", "hr_name": "Asha", "hr_designation": "HR Head", "ctc": 120000.0, "gross": None, "basic": 4000.0, "hra": 1000.0, "special": 1000.0, "pf_employee": None, "pf_employer": None, "gratuity": None,
    "employment_type": "Full-time", "work_location": "Pune",
}
TYPES = {"offer_date": "date", "joining_date": "date"} | dict.fromkeys(["ctc", "gross", "basic", "hra", "special", "pf_employee", "pf_employer", "gratuity"], "double")


def judged(spark, *changes):
    df = spark.createDataFrame([tuple((LETTER | c).values()) for c in changes], ", ".join(f"{k} {TYPES.get(k, 'string')}" for k in LETTER))
    return [({x.check: x.severity for x in r.c}, r.points) for r in df.coalesce(1).select(checks.checks().alias("c"), checks.date_score(F.lit(3)).alias("points")).collect()]


def test_checks(spark):
    good, early, same, bare, none = judged(
        spark, {}, {"joining_date": dt.date(2024, 12, 31)}, {"joining_date": dt.date(2025, 1, 1), "website": "x", "basic": 11000.0, "full_text": "____"}, {"full_text": "stipend", "employment_type": "Internship", "ctc": None, "phone": None},
        dict.fromkeys(LETTER),
    )
    assert set(good[0].values()) == {"green"} and good[1] == 9
    assert early[0]["joining date"] == "red" and early[1] == 2
    assert (same[0]["joining date"], same[0]["basic share"], same[0]["salary sum"], same[0]["placeholders"], same[0]["terms"], same[0]["gratuity"]) == ("yellow", "red", "red", "red", "yellow", "yellow")
    assert (bare[0]["salary stated"], bare[0]["basic share"], bare[0]["provident fund"], bare[0]["contacts"]) == ("yellow", "green", "green", "yellow")
    assert [k for k, v in none[0].items() if v == "red"] == ["contacts", "signatory", "salary stated", "terms"] and none[1] == 4


def test_clauses(spark):
    df = spark.createDataFrame([("Bond of 1 year; may be terminated with 30 days notice",), ("",), (None,)], "t string")
    assert [r[0] for r in df.coalesce(1).select(checks.clauses(F.col("t"))).collect()] == [["notice", "termination", "bond"], [], []]


def test_reports(spark, tmp_path):
    rows = [("a<b>&\"'", "SUSPICIOUS", 7), (None, "ODD", 100)]
    df = spark.createDataFrame(rows, "file_name string, verdict string, score int").withColumn("flags", F.array(F.struct(F.lit("red").alias("severity"), F.lit("x & y").alias("title"))))
    df = df.withColumn("html", report.html(F.col("file_name"), [("Verdict", F.col("verdict"))], F.col("score"), F.col("flags")))
    first = df.filter("score = 7").first().html
    assert "a&lt;b&gt;&amp;&quot;&#x27;" in first and '<li class="red">x &amp; y</li>' in first
    report.write_reports(df, str(tmp_path / "r"), 0)
    back = spark.read.parquet(str(tmp_path / "r")).select("verdict", report.score_of(F.col("html")).alias("score"))
    assert sorted(map(tuple, back.collect())) == [("MANUAL_REVIEW", 100), ("SUSPICIOUS", 7)]
    assert spark.range(1).select(report.score_of(F.lit("none"))).first()[0] is None


def test_requests_of_empty_letters(spark):
    df = extract.extract(spark.createDataFrame([(1, None), (2, "")], "letter_id long, full_text string"))
    assert all(r[0].startswith("{") for r in df.select(report.request()).collect())


def test_model_text_is_whole_up_to_production_limits(spark, tmp_path):
    texts = {1: "a" * 4001, 2: "b" * 40_000, 3: "".join(chr(97 + k % 26) for k in range(40_001)), 4: None}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want = texts | {3: texts[3][:20_000] + "\n[...]\n" + texts[3][-10_000:]}
    got = {r.doc_id: (r.n, r.digest) for r in catalog.QUERIES["model_text_full"](spark, str(tmp_path)).collect()}
    assert got == {k: (t and len(t), t and hashlib.md5(t.encode()).hexdigest()) for k, t in want.items()}


def test_scoring_requests_hold_whole_letters(spark, sf):
    want = {r.letter_id: r.full_text for r in src.letters(spark, sf).collect()}
    got = {r.letter_id: (r.n_text, r.text_digest) for r in catalog.QUERIES["scoring_requests_full"](spark, sf).collect()}
    assert min(len(t) for t in want.values() if t.strip()) > 200
    assert got == {k: (len(t[:4000]), hashlib.md5(t[:4000].encode()).hexdigest()) for k, t in want.items()}
