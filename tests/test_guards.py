"""What is looked at before a pattern is searched for leaves out none of its hits."""

import pytest
from pyspark.sql import functions as F

from parchment import patterns as p
from parchment.functions.text import ascii_text, every, first, lines
from parchment.operators import extract

TEXTS = [
    "Date of Joining: 3rd May 2025\nWebsite: www.a.in\nMY SITE: b.org\ncall +91 98765-43210 or (0431) 9876543210, 1234567890123", "x1/2/2025 on 12-Jan-25, 2025-02-03 MAY 4, 26 9Sep 2024 1DEC1999", "JOINING ON|2025-01-02 w.e.f 3.4.25 Expected to Join - 1 June 2025",
    "For Acme Pvt. Ltd\nAsha Rao\nHR Manager here\nYOURS  Truly\nWarm regards", "for acme Limited for Beta  LLP. xfor Gamma Inc", "CIN: U72200KA2015PTC123456 gst # 29ABCDE1234F1Z5 GSTIN 29ABCDE1234F1Z5 110001 1234567 x110001", "Duty Station - Goa, Based At: Pune; place of duty: Agra\nPosting Location: x y z",
    "Rs. 5,00,000 lakhs of INR 12.50 cr ₹7", "Dear Mr. ASHA Rao,\nDEAR x", "a@b.in, c @ d.org\ne@\nf.com -_%@x.yy.zz1@q.rs", "é@b.in x\x0by@z.com\x1cw@v.net", "", None,
]
PAIRS = [
    (p.DATE, extract.DATE), (p.JOINING_LABEL, extract.JOINING_LABEL), (p.AMOUNT, extract.AMOUNT), (p.PHONE, extract.PHONE), (p.COMPANY_NUMBER, extract.COMPANY_NUMBER), (p.TAX_NUMBER, extract.TAX_NUMBER), (p.PIN, extract.PIN), (p.WEBSITE_LABELLED, extract.WEBSITE_LABELLED), (p.LOCATION, extract.LOCATION),
    (p.SIGN_OFF, extract.SIGN_OFF), (p.COMPANY_SIGNED, extract.COMPANY_SIGNED), (p.FOR_COMPANY, extract.FOR_COMPANY), (p.COMPANY_BEFORE_NUMBER, extract.BEFORE_NUMBER), (p.NAME_AFTER_DEAR, extract.NAME_AFTER_DEAR),
]


@pytest.fixture(scope="module")
def texts(spark):
    return spark.createDataFrame([(t,) for t in TEXTS], "t string").coalesce(1).cache()


def same(df, a, b):
    got = df.select(F.to_json(F.struct(a.alias("x"))).alias("a"), F.to_json(F.struct(b.alias("x"))).alias("b")).collect()
    assert [r.a for r in got] == [r.b for r in got]
    return got


def test_guarded_patterns_find_what_the_plain_ones_find(texts):
    t = F.col("t")
    same(texts, F.array(*[every(t, plain) for plain, _ in PAIRS]), F.array(*[every(t, guarded) for _, guarded in PAIRS]))


def test_addresses_by_lines_are_those_of_the_text(texts):
    got = same(texts, every(F.col("t"), extract.EMAIL), extract.addresses(lines(F.col("t"))))
    assert sum("@" in r.a for r in got) == 2


def test_names_after_a_company_are_read_from_its_own_text(texts):
    whole = first(F.col("t"), extract.FOR_COMPANY)
    same(texts, F.array(*[first(F.col("t"), p.FOR_COMPANY, k) for k in (1, 2)]), F.array(*[first(whole, extract.FOR_COMPANY, k) for k in (1, 2)]))


def test_company_lines(texts):
    rows = F.split(F.col("t"), "\n")
    same(texts, F.transform(rows, lambda l: l.rlike(p.COMPANY_LINE)), F.transform(rows, lambda l: l.rlike(extract.COMPANY_LINE)))


def test_titles_and_types_begin_as_told(spark):
    texts = ['ROLE of “Clerk A” x', 'post of "Clerk B"', "Job  Profile: Clerk", "Designation - Clerk", "you are\rengaged\x0bas\ta Clerk in x", "You Will Be hired as an Clerk", "post of Clerk (x", "OFFERED post of Clerk", "offer you the role of Clerk", "joining as A Clerk at x", "full-time", "freelance", "fixed term", "Graduate  Trainee", "consultancy"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").coalesce(1)
    low = F.lower("t")
    for w, (signs, *parts) in zip(p.TITLES, extract.TITLE_STARTS, strict=True):
        same(df, first(F.col("t"), f"(?i){w}", 1), F.when(extract.holds(low, *parts), first(F.col("t"), extract._ahead(signs, f"(?i){w}"), 1)))
    for (w, _), parts in zip(p.EMPLOYMENT_TYPES, extract.TYPE_PARTS, strict=True):
        same(df, low.rlike(w), extract.holds(low, *parts) & low.rlike(w))


def test_ascii_texts(texts):
    same(texts, F.regexp_replace("t", r"[^\x00-\x7F]", " "), ascii_text(F.col("t")))
