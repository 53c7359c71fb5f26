"""Checks of a letter that need no model: each is green, yellow or red from the letter's own columns.

What a scoring model answers is taken from its table of responses; these rules stand in where there is none. checks() has the
thirteen of a letter's own text; name_checks() and consistency() the two that look over its pages. Fonts are not looked at,
and the halves of scores that judge language are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from parchment.config import METROS, SALARY_KEYWORDS
from parchment.functions.names import agreement
from parchment.functions.text import any_of, one_of
from parchment.operators.forensic import placeholders, template_artifacts

#: The four clauses that a letter should hold, by what names them.
CLAUSES = {"notice": r"(?i)\bnotice period\b|\b[0-9]+ days'? notice", "probation": r"(?i)\bprobation", "termination": r"(?i)\bterminat", "bond": r"(?i)\bbond\b|\block-?in\b"}
ENTITY_SUFFIXES = [r"Pvt\.? Ltd", "Private Limited", "Limited", "Ltd", "LLP", "Inc", "Corp"]
#: Words that are meant for a model and not for a candidate.
INJECTION = r"(?i)\b(?:ignore (?:all |the )?(?:previous|above) instructions|you are an? (?:ai|language model)|give (?:this letter )?full (?:marks|score))\b"
EXEMPT = ["Internship", "Trainee", "Apprentice"]


def _known(*columns: str) -> Column:
    """How many of the columns hold a value."""
    return sum((F.col(c).isNotNull().cast("int") for c in columns), F.lit(0))


def _pick(red: Column | None, yellow: Column) -> Column:
    """red before yellow before green; a condition that is null does not hold."""
    mild = F.when(yellow, "yellow").otherwise("green")
    return mild if red is None else F.when(red, "red").otherwise(mild)


def checks(text: str = "full_text") -> Column:
    """array<struct<check, severity>> in the checks' order, over the columns of extract() and the text."""
    t = F.col(text)
    intern = F.coalesce(F.col("employment_type").isin(EXEMPT), F.lit(False))
    short = intern | F.coalesce(F.col("employment_type").isin("Contract", "Part-time", "Consultant"), F.lit(False))
    contacts = _known("company_email", "phone", "website")
    signed = F.coalesce(F.col("hr_designation").rlike(r"(?i)authori[sz]ed signatory"), F.lit(False)) | (_known("hr_name", "hr_designation") == 2)
    money = any_of([F.contains(F.lower(t), F.lit(k)) for k in [*SALARY_KEYWORDS["ctc"], *SALARY_KEYWORDS["gross"], "stipend"]])
    share = 12 * F.col("basic") / F.col("ctc")
    parts = 12 * sum((F.coalesce(F.col(c), F.lit(0.0)) for c in ("hra", "special", "pf_employer", "gratuity")), F.coalesce(F.col("basic"), F.lit(0.0))) / F.col("ctc")
    metro = F.coalesce(F.col("work_location").rlike(f"(?i)\\b({'|'.join(METROS)})\\b"), F.lit(False))
    terms = F.col("employment_type").isNotNull().cast("int") + F.coalesce(t.rlike(CLAUSES["probation"]), F.lit(False)).cast("int") + F.coalesce(t.rlike(CLAUSES["notice"]), F.lit(False)).cast("int")
    known = {
        "offer date": _pick(None, F.col("offer_date").isNull()),
        "joining date": _pick(F.col("joining_date") < F.col("offer_date"), F.col("joining_date").isNull() | (F.col("joining_date") == F.col("offer_date"))),
        "contacts": _pick(contacts == 0, contacts == 1),
        "registration": _pick(None, F.col("registration").isNull()),
        "signatory": _pick(_known("hr_name", "hr_designation") == 0, ~signed),
        "salary stated": _pick((_known("ctc", "gross") == 0) & ~F.coalesce(money, F.lit(False)), _known("ctc", "gross") == 0),
        "basic share": _pick(~intern & (share > 1), ~intern & ~F.coalesce(share.between(0.30, 0.55), F.lit(False))),
        "house rent": _pick(None, ~intern & metro & (F.coalesce("hra", F.lit(0.0)) == 0)),
        "provident fund": _pick(None, ~intern & (_known("pf_employee", "pf_employer") == 0) & ~F.coalesce(t.rlike(r"(?i)\bprovident fund\b|\be?pf\b"), F.lit(False))),
        "gratuity": _pick(None, ~short & F.col("gratuity").isNull() & ~F.coalesce(t.rlike(r"(?i)\bgratuity\b"), F.lit(False))),
        "salary sum": _pick(parts > 1, ~F.coalesce(parts >= 0.40, F.lit(False))),
        "terms": _pick(terms == 0, terms < 3),
        "placeholders": _pick((F.size(placeholders(t)) > 0) | (F.size(template_artifacts(t)) > 0), F.lit(False)),
    }
    return F.array(*[F.struct(F.lit(name).alias("check"), severity.alias("severity")) for name, severity in known.items()])


def name_checks(mentions: DataFrame) -> DataFrame:
    """(letter_id, candidate, others, signatory, signatory_off) from (letter_id, page_no, kind, name): names over a letter's pages.

    candidate: green if all pages name the one that the first page addresses, in whatever form; red if there are two others or
    more and none is that one; else yellow. others: mentions of another name. signatory: consistent, form (the same name in
    another form on some page) or other; signatory_off: 2 points where it isn't consistent. A letter that names nobody of a kind
    is green, or consistent; mentions without a name are none.
    """
    first = W.partitionBy("letter_id", "kind").orderBy("page_no", "name")
    m = mentions.filter("name IS NOT NULL").withColumns({"k": F.row_number().over(first), "base": F.first("name").over(first)})
    m = m.filter("k > 1").withColumn("how", agreement(F.col("name"), F.col("base")))
    is_, count = lambda kind: F.col("kind") == kind, lambda c: F.count_if(c)
    by = m.groupBy("letter_id").agg(count(is_("candidate")).alias("n"), count(is_("candidate") & (F.col("how") == "other")).alias("others"), count(is_("signatory") & (F.col("how") == "other")).alias("strange"), count(is_("signatory") & (F.lower(F.trim("name")) != F.lower(F.trim("base")))).alias("forms"))
    every = mentions.select("letter_id").distinct().join(by, "letter_id", "left").na.fill(0, ["n", "others", "strange", "forms"])
    candidate = F.when(F.col("others") == 0, "green").when((F.col("others") >= 2) & (F.col("others") == F.col("n")), "red").otherwise("yellow")
    signatory = F.when(F.col("strange") > 0, "other").when(F.col("forms") > 0, "form").otherwise("consistent")
    return every.select("letter_id", candidate.alias("candidate"), "others", signatory.alias("signatory"), F.when(signatory == "consistent", 0).otherwise(2).alias("signatory_off"))


def consistency() -> Column:
    """The last check, of the document's consistency, from composites, tampering, online_tool and signatory: red for what was
    put together or edited online beside a floating date, yellow for a floating date or a signatory in two forms."""
    some = lambda c: F.coalesce(F.size(c) > 0, F.lit(False))
    return _pick(some("composites") | (some("tampering") & F.col("online_tool").isNotNull()), some("tampering") | (F.col("signatory") != "consistent"))


def clauses(text: Column) -> Column:
    """Which of the four clauses the text holds, in their order."""
    return F.array_compact(F.array(*[F.when(text.rlike(regex), F.lit(name)) for name, regex in CLAUSES.items()]))


def date_score(modified_days: Column | None = None, most: int = 11) -> Column:
    """Points for the dates: 3 off without an offer date, 2 off without a joining date or with a late change, 2 at most when impossible."""
    off = F.when(F.col("offer_date").isNull(), 3).otherwise(0) + F.when(F.col("joining_date").isNull(), 2).otherwise(0)
    if modified_days is not None:
        off = off + F.when(modified_days > 2, 2).otherwise(0)
    return F.when(F.col("joining_date") < F.col("offer_date"), F.least(F.lit(2), most - off)).otherwise(most - off)


def entity_names(text: Column) -> Column:
    """The distinct company names in a text, by their suffixes, in their order."""
    found = F.transform(F.regexp_extract_all(text, F.lit(rf"\b[A-Z][A-Za-z0-9&]*(?: [A-Z][A-Za-z0-9&]*){{0,4}} {one_of(ENTITY_SUFFIXES)}\b"), F.lit(0)), lambda n: F.lower(F.regexp_replace(n, r"\s+", " ")))
    return F.array_distinct(found)


def halves(text: str = "full_text") -> dict[str, Column]:
    """The parts of the model's scores that a letter's own columns settle.

    image_cap: the most that a composited page may get. entity_off: points off for two names, or more, of companies.
    injected: text that speaks to a model. signature_seen. hr_known and company_known: how much of what should be there is.
    """
    names = F.size(entity_names(F.col(text)))
    contacts = _known("company_email", "phone", "website") >= 2
    return {
        "image_cap": F.when(F.coalesce(F.size("composites") > 0, F.lit(False)), 2).otherwise(11), "entity_off": F.when(names >= 3, 6).when(names == 2, 3).otherwise(0),
        "injected": F.coalesce(F.col(text).rlike(INJECTION), F.lit(False)), "signature_seen": F.col("signature").isNotNull(), "hr_known": _known("hr_name", "hr_designation", "hr_email"),
        "company_known": _known("company_name", "company_address", "registration") + contacts.cast("int"),
    }
