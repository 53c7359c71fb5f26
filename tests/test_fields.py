"""Cases of the field extraction, one for each strategy and each rule that rejects a value, and of the tables around it."""

import datetime as dt

import duckdb
import pytest
from pyspark.sql import functions as F

from parchment.config import Settings
from parchment.functions.text import parse_date
from parchment.operators import extract, forensic, lookups, queue, rules
from parchment.operators.report import file_name
from parchment.plans.letters_sql import FIELDS



def column(spark, texts, expr):
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").coalesce(1)
    return [r[1] for r in df.select("k", expr.alias("v")).orderBy("k").collect()]


def check(spark, cases, expr):
    got = column(spark, [t for t, _ in cases], expr)
    assert got == [w for _, w in cases], [(c, g) for c, g in zip(cases, got, strict=True) if c[1] != g]


def test_written_dates(spark):
    cases = [
        ("2026-02-03", "2026-02-03"), ("16-Feb-26", "2026-02-16"), ("16th February 2026", "2026-02-16"), ("February 16, 2026", "2026-02-16"), ("Feb 3rd, 26", "2026-02-03"), ("Monday, 16 February 2026", "2026-02-16"),
        ("16.02.2026 10:30", "2026-02-16"), ("2026 Feb 16", "2026-02-16"), ("12/25/2025", "2025-12-25"), ("1/2/98", "1998-02-01"), ("16 Februar 2026", None), ("April 2026", None), ("31-02-2026", None), ("", None), (None, None),
    ]
    check(spark, cases, parse_date(F.col("t")).cast("string"))


def test_company_strategies_and_rejections(spark):
    check(spark, [
        ("x\nFor Acme  Works Pvt. Ltd.\nAsha Rao", "Acme Works Pvt. Ltd"), ("Dear A\niEnergizer Solutions\nbody", "iEnergizer Solutions"), ("Offer Letter\nCompany Name: Bharat Ventures.\nx", "Bharat Ventures"),
        ("Confidential\nShree Traders\nTel: 1\nCIN: U72200KA2015PTC123456", "Shree Traders"), ("Bluewater Bay\nDear X", "Bluewater Bay"), ("During Employment With Services", None), ("REF 2025 LTD\nPRIVATE LIMITED", None), ("associate data processing\nAssociate Data Processing", None),
        ("One Two Three Four Five Six Services", None), ("New Delhi 110049 Services", None), ("Phone Desk Services", None), ("lower services", None), ("", None), (None, None),
    ], extract.company_name(F.col("t")))


def test_names_and_designations(spark):
    check(spark, [
        ("Dear Mr. NAVEEN A,", "NAVEEN A"), ("Dear Ms Asha Rao Designation", "Asha Rao"), ("Dear HR Team\nName: Asha Rao", "Asha Rao"), ("Employee Name - Manasa Kateer R\nDesignation", "Manasa Kateer R"), ("To,\nRahul Singh\n4 Road", "Rahul Singh"),
        ("Dear Candidate,", None), ("Dear Acme Solutions,", None), ("Dear Operations,", None), ("Dear Al", None), ("dear Asha", None),
    ], extract.candidate_name(F.col("t")))
    check(spark, [("HR Manager  date: 3", "HR Manager"), ("Head, ref 7", "Head"), ("shall report", None), ("Acme Ltd", None), ("a b c d e f g", None), ("Chief of a very long and quite unusual kind of an office", None), (" ", None), (None, None)], extract.designation(F.col("t")))


def test_titles(spark):
    check(spark, [
        ('position of "AI & Automation Associate" here', "AI & Automation Associate"), ("Designation: Clerk, Pune", "Clerk"), ("Post-graduation needed", None), ("You are appointed as a Senior Engineer. Hi", "Senior Engineer"), ("position of Steward (trial)", "Steward"),
        ("offer you the role of Analyst subject to terms", "Analyst"), ("hired as an Analyst in town", "Analyst"), ("Position: result of breach", None), ("Role: head of care and of needs", None), ("Position: Background. Tech", None), ("Job Title: Clerk w.e.f now", "Clerk"),
    ], extract.job_title(F.col("t")))


def test_types_and_places(spark):
    check(spark, [("our internal and international rules", None), ("an internship", "Internship"), ("trainee on contract", "Trainee"), ("contractual", "Contract"), ("part time", "Part-time"), ("freelance", "Consultant"), ("permanent", "Full-time"), ("regular  employment", "Full-time")], extract.employment_type(F.col("t")))
    check(spark, [("Work Location: Pune, India", "Pune"), ("Based at - Navi Mumbai.", "Navi Mumbai"), ("Location: ____", None), ("Location: you will be told", None), ("Location: a b c d e f g h", None)], extract.work_location(F.col("t")))


def test_addresses_end_where_the_digits_stand_first(spark):
    texts = ["a\nb\nNo. 1, Main Road\nPune 411001 x", "Ref: HR/1560123\nfirst\nsecond\nthird\nPune 560123", "no 1234567 token", "", None]
    sql = FIELDS["pin_address"]
    want = [duckdb.execute(f"SELECT {sql} FROM (SELECT ?::VARCHAR AS t)", [t]).fetchone()[0] for t in texts]
    assert want[1] == "Ref: HR/1560123, fir"
    check(spark, list(zip(texts, want, strict=True)), extract.pin_address(F.col("t")))


@pytest.mark.parametrize(("text", "want"), [("CTC 5 lack of it", None), ("CTC: 5 lakhs", 5e5), ("CTC 7 crore", None), ("CTC 4 cr.", 4e7), ("CTC 600 credited", 7200.0), ("CTC, of Rs 500000", None), ("CTC 12% and annual package 3 LPA", 3e5)])
def test_amounts(spark, text, want):
    assert column(spark, [text], extract.salary(F.col("t"))["ctc"])[0] == want


def test_sign_offs(spark):
    texts = [
        "For Acme Pvt Ltd\nAsha Rao\nHR Manager", "For Acme Pvt Ltd\nAuthorised Signatory\nPune office", "Yours sincerely,\nMeera Sen\nHead of HR\nMail: A@b.in", "Regards\nthe team\nVikram Das\nAuthorized Signatory", "Regards", None,
        "For Acme Pvt Ltd\nAsha Rao\nI have gone through this\nWarm regards\nVikram Das\nCHRO",
    ]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").coalesce(1)
    got = [tuple(r) for r in extract.hr_contact(df, F.col("t")).orderBy("k").select("hr_name", "hr_designation", "hr_email").collect()]
    assert got[:6] == [("Asha Rao", "HR Manager", None), (None, "Authorised Signatory", None), ("Meera Sen", "Head of HR", "a@b.in"), ("Vikram Das", "Authorized Signatory", None), (None, None, None), (None, None, None)]
    assert got[6] == ("Asha Rao", "CHRO", None)


def test_domains(spark):
    df = spark.createDataFrame([("x", "hr@Acme.in", None), ("x", None, "https://www.Acme.org/a"), ("see acme-labs.co.in now", None, None), ("or gmail.com then acme.com", None, None), (None, None, None)], "t string, m string, s string").coalesce(1)
    assert [r[0] for r in df.select(extract.company_domain(F.col("t"), F.col("m"), F.col("s"))).collect()] == ["acme.in", "acme.org", "acme-labs.co.in", None, None]


def test_repair_and_confidence(spark):
    names = ["company_name", "candidate_name", "job_title", "hr_name"]
    df = spark.createDataFrame([("Asha", "Asha Rao", "asha rao ", "Puneet asha RAO"), ("Acme Ltd", "Asha Rao", "ACME ltd", "Asha Rao"), (None, None, "Clerk", "Meera")], ", ".join(f"{n} string" for n in names)).coalesce(1)
    assert [tuple(r) for r in extract.repair(df).select(*names).collect()] == [(None, "Asha Rao", None, "Puneet"), ("Acme Ltd", "Asha Rao", None, None), (None, None, "Clerk", "Meera")]
    kinds = {"offer_date": "date", "joining_date": "date"} | dict.fromkeys(["ctc", "basic", "hra", "special", "pf_employer", "gratuity"], "double")
    row = {"domain": "a.in", "company_email": None, "website": None, "company_name": "Acme Ltd", "candidate_name": "Asha", "offer_date": dt.date(2025, 1, 1), "joining_date": None, "ctc": 3e5, "basic": 1e4, "hra": None, "special": None, "pf_employer": None, "gratuity": None}
    cases = [({}, False, []), ({"domain": None}, True, []), ({"company_name": "the and of", "candidate_name": None}, True, []), ({"offer_date": dt.date(2017, 1, 1), "joining_date": dt.date(2030, 1, 1)}, True, ["offer year out of range", "joining year out of range"]), ({"ctc": 100.0}, True, ["ctc too low", "basic above ctc", "components above ctc"])]
    df = spark.createDataFrame([tuple((row | c).values()) for c, _, _ in cases], ", ".join(f"{n} {kinds.get(n, 'string')}" for n in row)).coalesce(1)
    s = Settings(as_of="2026-06-01")
    assert s.first_year == 2018
    assert [(r[0], r[1]) for r in df.select(extract.low_confidence(s), extract.plausibility_problems(s)).collect()] == [(low, p) for _, low, p in cases]


def test_whole_numbers_and_answers(spark):
    values = {"9": 9, "9.7": 9, '"9"': 9, '"9.7"': None, "null": None, '"x"': None, "true": 1, "[1]": None, "-2": -2}
    assert column(spark, list(values), rules.whole_number(F.col("t"))) == list(values.values())
    answers = ['{"text_tampering_score": 7, "flags": 3}', "no {json", "{}", None, '```json\n{"flags": [{"title": "a"}, 5]}\n```']
    got = column(spark, answers, rules.parse_scores(F.col("t"), F.lit(True)))
    assert [r.failed for r in got] == [False, True, True, True, False] and got[0].text_score == 7 and got[0].flags == [] and [r.advice for r in got] == ["REVIEW"] * 5
    assert [tuple(f) for f in got[4].flags] == [("yellow", "a", ""), ("yellow", "", "")]


def test_raw_dates_and_texts(spark):
    check(spark, [("D:20250203101500+05'30'", "2025-02-03 10:15:00"), ("D:20250203101500Z", "2025-02-03 10:15:00"), ("3 Feb 2025", "2025-02-03 00:00:00"), ("D:2025", None), (None, None)], forensic.pdf_date(F.col("t")).cast("string"))
    pages = spark.createDataFrame([(1, 2, "b"), (1, 0, "a"), (1, 1, None), (2, 0, " "), (2, 1, "")], "letter_id int, page_no int, text string")
    assert sorted(map(tuple, forensic.letter_text(pages).collect())) == [(1, "a\nb", False, 3), (2, " ", True, 2)]
    assert sorted(map(tuple, forensic.letter_text(pages, True).select("letter_id", "text").collect())) == [(1, "a\n\nb"), (2, " \n")]
    assert forensic.letter_text(pages.limit(0)).count() == 0


def test_online_evidence_stops_at_the_first_hit(spark):
    rows = [(1, "Acme", "acme.in", "search", True, False, "s"), (1, "Acme", "acme.in", "encyclopedia", True, False, "w"), (2, "Acme", "gmail.com", "website", True, False, "free"), (2, "Acme", "gmail.com", "guess", False, False, "g"), (3, None, "acme.in", "website", False, True, "down"), (3, None, "acme.in", "search", True, False, "no name"), (4, None, None, "guess", True, False, "x")]
    got = {r.key: (r.found, r.method, r.checked, r.note) for r in lookups.online(spark.createDataFrame(rows, "key int, company_name string, domain string, method string, hit boolean, error boolean, note string")).collect()}
    assert got[1] == (True, "encyclopedia", True, "w") and got[2][:3] == (False, None, False) and got[3][:3] == (False, None, False)
    assert "all 1 attempt(s)" in got[3][3] and got[4] == (False, None, True, "No company name or domain to check")


def test_places_are_those_of_one_sorted_list(spark):
    rows = [(k, "ab"[k % 2] if k % 7 else None, k * 31 % 97 // 5) for k in range(500)]
    got = {r.k: r.place for r in queue.places(spark.createDataFrame(rows, "k int, g string, v int"), "g", F.col("v"), "k", 8).collect()}
    for g in ("a", "b", None):
        mine = sorted((v, k) for k, h, v in rows if h == g)
        assert [got[k] for _, k in mine] == list(range(1, len(mine) + 1))
    assert queue.places(spark.createDataFrame([], "k int, g string, v int"), "g", F.col("v"), "k").count() == 0


def test_queue_tables(spark):
    letters = spark.createDataFrame([("b.pdf",), ("a.pdf",), ("c.pdf",)], "file_name string")
    reports = spark.createDataFrame([("a.pdf", "SUSPICIOUS", 4, dt.datetime(2025, 1, 2)), ("a.pdf", "MANUAL REVIEW", 60, dt.datetime(2025, 1, 1)), ("a.pdf", "ODD", 1, dt.datetime(2025, 1, 3))], "file_name string, verdict string, score int, saved_at timestamp")
    assert [r.file_name for r in queue.unprocessed(letters, reports).collect()] == ["b.pdf", "c.pdf"] and queue.unprocessed(letters, reports, 1).count() == 1
    assert {r.file_name: (r.report_verdict, r.report_score) for r in queue.with_reports(letters, reports).collect()} == {"a.pdf": ("MANUAL REVIEW", 60), "b.pdf": (None, None), "c.pdf": (None, None)}


def test_report_names(spark):
    df = spark.createDataFrame([("in/A.Sai offer  letter.pdf", None, "Asha Rao", 80), ("x", "N&V " * 9, None, 7)], "f string, c string, p string, s int").coalesce(1)
    got = [r[0] for r in df.select(file_name(F.col("f"), F.col("c"), F.col("p"), F.lit("2026-01-02"), F.col("s"))).collect()]
    assert got[0].startswith("A_Sai_offer_letter_Unknown_Asha_Rao_2026-01-02_s80_") and got[1].startswith("x_N_V_N_V_N_V_N_V_N_V__Unknown_2026-01-02_s7_") and all(len(g.rsplit("_", 1)[1]) == 9 for g in got)
