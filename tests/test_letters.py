"""Table-driven cases of the letter rules."""

import datetime as dt

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from parchment.functions.text import parse_date
from parchment.functions.names import agreement
from parchment.operators import checks, extract, forensic, lookups, rules
from parchment.plans.settings import SUITED
from parchment.sources import letters as src
from parchment.streaming import inbox


def one(spark, text, *columns):
    df = spark.createDataFrame([(text,)], "t string")
    return df.select(*[c.alias(f"c{k}") for k, c in enumerate(columns)]).first()


@pytest.mark.parametrize(
    ("token", "want"),
    [
        ("2026-02-03", "2026-02-03"), ("16-Feb-26", "2026-02-16"), ("16th February 2026", "2026-02-16"), ("February 16, 2026", "2026-02-16"), ("03/02/2026", "2026-02-03"),
        ("01.07.2017", "2017-07-01"), ("5 Sept 2025", "2025-09-05"), ("April 2026", None), ("31-02-2026", None), ("soon", None), ("", None), (None, None),
    ],
)
def test_dates(spark, token, want):
    got = one(spark, token, parse_date(F.col("t")))[0]
    assert (got and got.isoformat()) == want


@pytest.mark.parametrize(
    ("text", "want"),
    [("CTC: 3.43 Lakh", 343000.0), ("annual package 1.2 crore", 1.2e7), ("CTC 12% of 500000", None), ("CTC, of Rs 500000", None), ("CTC Rs. 6,00,000", 600000.0), ("CTC 45,000", 540000.0), ("nothing", None), ("Gross salary 40000", 480000.0)],
)
def test_ctc(spark, text, want):
    assert one(spark, text, extract.salary(F.col("t"))["ctc"])[0] == want


def test_mail_domain_phone(spark):
    t = F.col("t")
    assert one(spark, "a@gmail.com hr @ acme.co.in", extract.company_email(t))[0] == "hr@acme.co.in"
    assert one(spark, "only a@gmail.com", extract.company_email(t))[0] == "a@gmail.com"
    assert one(spark, "Dear X a@gmail.com b@acme.com", extract.candidate_email(t))[0] == "a@gmail.com"
    assert one(spark, "Website: www.acme.in.", extract.website(t))[0] == "www.acme.in"
    assert one(spark, "call 98765 43210", extract.phone(t))[0] == "98765 43210"
    assert one(spark, "udyam-KR-03-0123456", extract.registration(t))[0] == "UDYAM-KR-03-0123456"
    assert one(spark, "https://www.Acme.CO.in/x?y", lookups.normal_domain(t))[0] == "acme.co.in"


def test_joining_is_not_a_statute_date(spark):
    text = "Date: 10.08.2025\nYou are expected to report on 01.09.2025 under the act effective from 01.07.2017"
    got = one(spark, text, extract.joining_date(F.col("t"), extract.offer_date(F.col("t")), "2025-12-31"))
    assert got[0] == dt.date(2025, 9, 1)


def test_template_artifacts_give_both_spellings(spark):
    assert one(spark, "x [CANDIDATE NAME] y [CANDIDATE NAME]", forensic.template_artifacts(F.col("t")))[0] == ["[candidate name]", "[CANDIDATE NAME]"]


BASE = {
    "domain": "a.in", "offer_date": dt.date(1998, 12, 1), "joining_date": dt.date(1998, 12, 20), "ctc": 600000.0, "basic": 25000.0, "hra": 10000.0, "special": 10000.0, "pf_employer": 0.0, "gratuity": 0.0, "image_score": 11, "text_score": 11,
    "signature_score": 11, "date_score": 11, "salary_score": 11, "grammar_score": 12, "hr_score": 11, "company_score": 11, "dns_valid": True, "dns_error": False, "mx": True, "found": True, "checked": True, "n_red": 0, "template": False,
    "suspicious_metadata": False, "online_edit": False, "floating_date": False, "composite": False, "advice": "APPROVE", "completeness": 1.0,
}
SCHEMA = "domain string, offer_date date, joining_date date, ctc double, basic double, hra double, special double, pf_employer double, gratuity double, image_score int, text_score int, signature_score int, date_score int, salary_score int, grammar_score int, hr_score int, company_score int, dns_valid boolean, dns_error boolean, mx boolean, found boolean, checked boolean, n_red int, template boolean, suspicious_metadata boolean, online_edit boolean, floating_date boolean, composite boolean, advice string, completeness double"


def judged(spark, *changes):
    rows = [tuple((BASE | c)[k.split()[0]] for k in SCHEMA.split(", ")) for c in changes]
    return rules.analyze(spark.createDataFrame(rows, SCHEMA).coalesce(1), SUITED).collect()


def test_gates(spark):
    scores = dict.fromkeys(["image_score", "text_score", "signature_score", "date_score", "salary_score", "grammar_score", "hr_score", "company_score"])
    clean, red, edited, composite, unverified, absent, outage, offline = judged(
        spark, {}, {"n_red": 4}, {"floating_date": True, "online_edit": True}, {"composite": True}, {"image_score": None}, {"found": False, "dns_valid": False}, scores | {"dns_error": True}, scores | {"dns_valid": False, "found": False}
    )
    assert (clean.score, clean.verdict, clean.gate, clean.action) == (100, "LEGITIMATE", None, "APPROVE")
    assert (red.verdict, red.final_score, red.gate, red.action) == ("MANUAL REVIEW", 79, "fraud signal", "REVIEW") and red.penalties[0].points == -30
    assert (edited.verdict, edited.final_score) == ("SUSPICIOUS", 50) and (composite.verdict, composite.final_score) == ("SUSPICIOUS", 50)
    assert (unverified.verdict, unverified.final_score, unverified.gate) == ("MANUAL REVIEW", 94, "unverified pillar")
    assert (absent.score, absent.verdict, absent.final_score) == (89, "MANUAL REVIEW", 79)
    assert (outage.total, outage.score, outage.verdict, outage.gate) == (50.0, 50, "SUSPICIOUS", None)
    assert (offline.total, offline.score) == (44.5, 44)


def test_dates_and_ages(spark):
    day = lambda n: dt.date(1998, 12, 31) - dt.timedelta(days=n)
    gaps = judged(spark, *[{"joining_date": BASE["offer_date"] + dt.timedelta(days=g)} for g in (-1, 0, 2, 3, 90, 91)])
    assert [r.gap_state for r in gaps] == ["impossible", "short", "short", "valid", "valid", "too long"]
    ages = judged(spark, *[{"offer_date": day(a), "joining_date": None} for a in (-1, 0, 90, 91, 180, 181, 365, 366)])
    assert [r.age_level for r in ages] == ["red", "green", "green", "yellow", "yellow", "yellow", "yellow", "red"]
    assert [r.is_old for r in ages] == [False] * 5 + [True] * 3
    pay = judged(spark, *[{"ctc": 100000.0, "basic": b, "hra": None, "special": None} for b in (39000.0, 40000.0, 105000.0, 106000.0, 100.0)], {"ctc": None})
    assert [r.salary_ok for r in pay] == [False, True, True, False, None, None]


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.fixed_dictionaries({"image_score": st.one_of(st.none(), st.integers(0, 11)), "hr_score": st.integers(0, 11), "n_red": st.integers(0, 4), "template": st.booleans(), "composite": st.booleans(), "floating_date": st.booleans(), "online_edit": st.booleans(), "found": st.booleans(), "checked": st.booleans(), "dns_valid": st.booleans()}), min_size=20, max_size=20))
def test_gates_never_raise_a_verdict(spark, changes):
    order = ["SUSPICIOUS", "MANUAL REVIEW", "LEGITIMATE"]
    for r in judged(spark, *changes):
        assert r.final_score <= r.score and order.index(r.verdict) <= (2 if r.score >= 80 else 1 if r.score >= 51 else 0)
        ranks = [{"red": 0, "green": 2}.get(f.severity, 1) for f in r.flags]
        assert ranks == sorted(ranks)


def test_flag_order_is_stable(spark):
    flags = [("yellow", "a"), ("green", "b"), ("red", "c"), ("odd", "d"), ("red", "e")]
    df = spark.createDataFrame([(flags,)], "f array<struct<severity:string,title:string>>")
    assert [x.title for x in df.select(rules.sort_flags(F.col("f"))).first()[0]] == ["c", "e", "a", "d", "b"]


def test_image_limits(spark):
    rows = [(1, 1, 1, 0.0, 100.0, 29.0, 40.0), (1, 1, 2, 0.0, 210.0, 30.0, 60.0), (1, 1, 3, 0.0, 209.0, 60.0, 30.0), (1, 2, 1, 500.0, 631.0, 60.0, 30.0), (1, 2, 2, 300.0, 630.0, 60.0, 45.0)]
    df = spark.createDataFrame(rows, "letter_id int, page_no int, img_no int, x0 double, y0 double, w double, h double").withColumn("page_w", F.lit(595.0)).withColumn("page_h", F.lit(840.0))
    r = forensic.image_summary(df).first()
    assert (r.n_images, r.logo, r.signature, r.has_stamp) == (5, "top-left", "bottom-right", True)


def test_stream_gives_what_batch_gives(spark, sf, tmp_path):
    letters = src.letters(spark, sf).select("letter_id", "file_name", "full_text").limit(200)
    letters.write.parquet(str(tmp_path / "in"))
    inbox.start(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).select("letter_id", "screen", "company_name")
    want = inbox.screen(spark.read.parquet(str(tmp_path / "in")), SUITED).select("letter_id", "screen", "company_name")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("Date: 2025-01-02")
    (tmp_path / "b.txt").write_text("")
    (tmp_path / "c.txt").write_text("x" * 2000)
    good, bad = src.read_letters(spark, str(tmp_path), max_bytes=1000)
    (tmp_path / "d.docx").write_text("x")
    (tmp_path / "e.txt").write_bytes(b"\xff\xfe\x00")
    assert [r.file_name for r in good.collect()] == ["a.txt"] and good.first().full_text == "Date: 2025-01-02"
    manifest = spark.createDataFrame([(f.name,) for f in tmp_path.iterdir()], "file_name string")
    good, bad = src.read_letters(spark, str(tmp_path), 1000, manifest)
    assert {(r.file_name, r.reason) for r in bad.collect()} == {("b.txt", "empty file"), ("c.txt", "too large"), ("d.docx", "not a letter file"), ("e.txt", "not text")} and good.count() == 1


@pytest.mark.parametrize(
    ("token", "want"),
    [
        ("16th of February 2026", "2026-02-16"), ("20250203", "2025-02-03"), ("3-Feb-2025 10:30 AM IST", "2025-02-03"), ("Monday, 3rd day of February, 2025", "2025-02-03"), ("2025-02-03T10:15:30Z", "2025-02-03"), ("2025-02-03 10:15:30.5 +05:30", "2025-02-03"),
        ("02/13/2025", "2025-02-13"), ("13/02/2025", "2025-02-13"), ("03/02/2025", "2025-02-03"), ("3 Feb '25", "2025-02-03"), ("Feb 3 75", "2075-02-03"), ("Feb 3 76", "1976-02-03"), ("3 Feb Mar 2025", None), ("3 Feb 2025 in Pune", None), ("20250230", None),
        ("February of 2025", None), ("1 2", None), ("1 2 3 4", None), ("99 99 99", None), ("20250203 Feb", None), ("2025 3", None), ("tuesday", None), ("3 Marble 2025", None), ("1" * 5000, None), ("10:30", None),
    ],
)
def test_spelled_dates(spark, token, want):
    got = one(spark, token, parse_date(F.col("t")))[0]
    assert (got and got.isoformat()) == want


@pytest.mark.parametrize(
    ("a", "b", "want"),
    [
        ("Rahul Kumar Singh", "singh  RAHUL, Kumar", "same"), ("R K Singh", "Rahul Kumar Singh", "form"), ("Rahul", "Rahul Kumar", "form"), ("Rahul", "Rahull", "form"), ("Rahul", "Rahil Khan", "form"), ("Rahul", "Rohil", "other"), ("R R", "Rahul Singh", "other"),
        ("Asha", "Usha", "form"), ("Ann", "Anna", "other"), ("Dr. Asha Rao", "Asha Rao", "same"), ("", "Asha", "other"), ("Mr.", None, None), (None, None, None), ("é ñ", "É Ñ", "same"), ("A B", "A A", "other"),
    ],
)
def test_names(spark, a, b, want):
    df = spark.createDataFrame([(a, b)], "a string, b string")
    assert [df.select(agreement(F.col(x), F.col(y))).first()[0] for x, y in ("ab", "ba")] == [want, want]


def test_consistency_check(spark):
    rows = [([], [], None, "consistent"), (["c"], [], None, "consistent"), ([], ["t"], None, "form"), ([], ["t"], "Sejda", "consistent"), ([], [], "Sejda", "other"), (None, None, None, None)]
    df = spark.createDataFrame(rows, "composites array<string>, tampering array<string>, online_tool string, signatory string").coalesce(1)
    assert [r[0] for r in df.select(checks.consistency()).collect()] == ["green", "red", "yellow", "red", "yellow", "green"]
