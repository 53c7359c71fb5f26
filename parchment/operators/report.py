"""What leaves the rules: requests to a scoring model and reports by verdict, both as columns of a letter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parchment.config import REPORT_PILLARS
from parchment.functions.text import slug
from parchment.operators.forensic import placeholders

VERDICTS = ["LEGITIMATE", "MANUAL REVIEW", "SUSPICIOUS"]
ENTITIES = {"&": "&amp;", "<": "&lt;", ">": "&gt;", '"': "&quot;", "'": "&#x27;"}
SCORE = 'class="score">'


def request(text: str = "full_text", snippet: int = 4000) -> Column:
    """The JSON of a letter's fields and the head of its text; fields without a value are left out."""
    group = lambda **names: F.struct(*[F.col(c).alias(k) for k, c in names.items()])
    return F.to_json(F.struct(
        group(name="company_name", address="company_address", email="company_email", domain="domain", phone="phone", website="website", registration="registration").alias("company"),
        group(name="candidate_name", email="candidate_email").alias("candidate"), group(title="job_title", employment_type="employment_type", location="work_location").alias("role"),
        group(name="hr_name", designation="hr_designation", email="hr_email").alias("hr"), F.struct(F.col("offer_date").cast("string").alias("offer"), F.col("joining_date").cast("string").alias("joining")).alias("dates"),
        group(ctc="ctc", gross="gross", basic="basic", hra="hra", pf="pf_employee", gratuity="gratuity", special="special").alias("salary"), F.struct(F.substring(text, 1, snippet).alias("text")).alias("document"),
    ))


def context(text: str = "full_text", snippet: int = 4000) -> Column:
    """The JSON that a scorer is given of an assessed letter: fields, date and salary notes, and all that the document shows. Absent values are null."""
    group = lambda **names: F.struct(*[(F.col(c) if c else F.lit(None).cast("string")).alias(k) for k, c in names.items()])
    source = F.coalesce("source", F.lit("unknown"))
    told = F.concat(F.lit("Fields were extracted by: "), source, F.lit(". Trust them; the text is there to show template fields, copying errors and odd formatting."))
    changed = F.datediff("modified_on", "created_on")
    dates = F.struct(F.col("offer_date").cast("string").alias("offer_date"), F.col("joining_date").cast("string").alias("joining_date"), "gap_days", "gap_valid", F.coalesce(F.col("gap_days") < 0, F.lit(False)).alias("gap_impossible"), "gap_note")
    pay = group(ctc_annual="ctc", gross_monthly="gross", basic="basic", hra="hra", pf="pf_employee", gratuity="gratuity", special_allowance="special")
    document = F.struct(
        F.col("completeness").alias("completeness_score"), F.col("red_phrases").alias("red_phrases_found"), placeholders(F.col(text)).alias("placeholder_scan"), F.col("tampering").alias("tamper_artifacts"), F.col("composites").alias("composite_artifacts"),
        F.col("suspicious").alias("metadata_suspicious"), F.col("metadata_reasons").alias("metadata_reason"), "created_with", F.col("online_edit").alias("online_edit_detected"), F.col("online_tool").alias("online_edit_tool"), "author",
        F.coalesce(changed > 0, F.lit(False)).alias("pdf_modified_after_creation"), F.when(changed > 0, changed).alias("pdf_modification_gap_days"), F.substring(text, 1, snippet).alias("full_text_snippet"),
    )
    whole = F.struct(
        told.alias("_instructions"), group(name="company_name", address="company_address", email="company_email", domain="domain", phone="phone", website="website", cin="registration").alias("company"),
        group(name="candidate_name", email="candidate_email").alias("candidate"), group(title="job_title", department=None, reporting_to=None, employment_type="employment_type", location="work_location").alias("role"),
        group(name="hr_name", designation="hr_designation", email="hr_email").alias("hr"), dates.alias("dates"), pay.withField("math_check", F.struct(F.col("salary_ok").alias("math_consistent"), F.col("salary_note").alias("discrepancy_note"))).alias("salary"),
        document.alias("document"), source.alias("extraction_notes"),
    )
    return F.to_json(whole, {"ignoreNullFields": "false"})


def images_sent(images: Column, most: int = 5 * 1024 * 1024) -> Column:
    """The base64 images (bare, or as data URLs) that are not too large to be sent, bare; available tells whether there is one."""
    bare = F.transform(images, lambda i: F.element_at(F.split(i, ","), -1))
    return F.filter(bare, lambda b: F.coalesce(F.octet_length(F.try_to_binary(b, F.lit("base64"))) <= most, F.lit(False)))


def escape(c: Column) -> Column:
    """Text as HTML shows it; null is empty."""
    c = F.coalesce(c.cast("string"), F.lit(""))
    for sign, entity in ENTITIES.items():  # the ampersand first
        c = F.replace(c, F.lit(sign), F.lit(entity))
    return c


def html(title: Column, rows: list[tuple[str, Column]], score: Column, flags: Column) -> Column:
    """A page with the score, a table of named values and the flags (array<struct<severity, title>>) in their order."""
    cells = [F.concat(F.lit(f"<tr><th>{name}</th><td>"), escape(value), F.lit("</td></tr>")) for name, value in rows]
    items = F.transform(flags, lambda f: F.concat(F.lit('<li class="'), escape(f["severity"]), F.lit('">'), escape(f["title"]), F.lit("</li>")))
    return F.concat(F.lit("<html><h1>"), escape(title), F.lit(f"</h1><p {SCORE}"), score.cast("string"), F.lit("</p><table>"), *cells, F.lit("</table><ul>"), F.array_join(items, ""), F.lit("</ul></html>"))


def file_name(pdf: Column, company: Column, candidate: Column, day: Column, score: Column) -> Column:
    """A report's name: slugs of the letter's file (30 signs), company (20) and candidate (18), day, score, and a mark of the file's name."""
    part = lambda c, n: F.substring(slug(c), 1, n)
    stem = F.regexp_replace(F.regexp_extract(pdf, r"([^/]+)$", 1), r"(?<=.)\.[^.]*$", "")
    unknown = lambda c: F.coalesce(F.when(c != "", c), F.lit("Unknown"))
    return F.concat_ws("_", part(stem, 30), part(unknown(company), 20), part(unknown(candidate), 18), day.cast("string"), F.concat(F.lit("s"), score.cast("int").cast("string")), F.concat(F.substring(F.md5(pdf), 1, 4), F.lit(".html")))


def overview() -> Column:
    """array<struct<label, value>> of the overview's nineteen rows, over assess()'s columns; rows without a value are left out."""
    s = F.col("letter_summary")
    money = F.when(F.coalesce(s["ctc_annual"], F.lit(0.0)) != 0, F.concat(F.lit("₹ "), F.format_number(F.bround(s["ctc_annual"], 0), 0)))
    math = F.when(s["salary_math_ok"], "Correct").when(~s["salary_math_ok"], "Mismatch").otherwise("N/A")
    metadata = F.when(s["pdf_metadata_suspicious"], s["pdf_metadata_reason"]).when(s["pdf_created_with"].isNotNull(), "Clean")
    rows = [
        ("Company", s["company_name"]), ("Candidate", s["candidate_name"]), ("Position", s["job_title"]), ("Employment Type", s["employment_type"]), ("Offer Date", s["offer_date"].cast("string")), ("Joining Date", s["joining_date"].cast("string")),
        ("Date Gap", F.concat(s["date_gap_days"].cast("string"), F.lit(" days"))), ("Work Location", s["work_location"]), ("HR Name", s["hr_name"]), ("HR Designation", s["hr_designation"]), ("CTC Annual", money),
        ("Completeness", F.concat(F.bround(s["completeness_score"] * 100, 0).cast("int").cast("string"), F.lit("%"))), ("Red Phrases", F.coalesce(F.nullif(F.array_join(s["red_phrases_found"], ", "), F.lit("")), F.lit("None found"))), ("Salary Math", math),
        ("PDF Created With", s["pdf_created_with"]), ("PDF Author", s["pdf_author"]), ("PDF Created", s["pdf_created_date"].cast("string")), ("PDF Modified", s["pdf_modified_date"].cast("string")), ("Metadata", metadata),
    ]
    return F.filter(F.array(*[F.struct(F.lit(k).alias("label"), v.alias("value")) for k, v in rows]), lambda r: F.coalesce(r["value"], F.lit("")) != "")


def pillar_rows() -> Column:
    """array<struct<name, score, band, percent, reason>> of the nine pillars in a report's order, over assess()'s columns."""
    by = F.map_from_entries(F.transform("pillars", lambda p: F.struct(p["pillar"], p)))

    def row(name: str, title: str) -> Column:
        p = by[name]
        sure = p["kind"] == "verified"
        percent = F.when(sure, F.bround(p["score"] / p["max"] * 100, 0).cast("int")).otherwise(50)
        shown = F.when(p["score"] == F.floor(p["score"]), p["score"].cast("int").cast("string")).otherwise(F.format_number(p["score"], 1))
        band = F.when(~sure, "medium").when(percent >= 66, "high").when(percent >= 33, "medium").otherwise("low")
        reason = F.when(sure, p["reasoning"]).otherwise("⚠ Conservative score applied — manual visual check required")
        return F.struct(F.lit(title).alias("name"), F.concat(shown, F.lit("/"), p["max"].cast("string")).alias("score"), band.alias("band"), percent.alias("percent"), reason.alias("reason"))

    return F.array(*[row(n, t) for n, t in REPORT_PILLARS.items()])


SECTIONS = {"red": "Critical Issues", "yellow": "Warnings", "green": "Passed Checks"}


def page() -> Column:
    """A letter's whole report as HTML: score and verdict, gate, overview, pillars, penalties and flags by severity."""
    tag = lambda name, inner, cls=None: F.concat(F.lit(f'<{name} class="{cls}">' if cls else f"<{name}>"), inner, F.lit(f"</{name}>"))
    rows = F.array_join(F.transform(overview(), lambda r: F.concat(F.lit("<tr><td>"), escape(r["label"]), F.lit("</td><td>"), escape(r["value"]), F.lit("</td></tr>"))), "")
    bars = F.array_join(F.transform(pillar_rows(), lambda p: F.concat(F.lit('<div class="'), p["band"], F.lit('"><b>'), escape(p["name"]), F.lit("</b> "), p["score"], F.lit("<p>"), escape(p["reason"]), F.lit("</p></div>"))), "")
    risks = F.array_join(F.transform("penalty_reasons", lambda p: tag("li", escape(p["reason"]))), "")

    def section(severity: str, title: str) -> Column:
        some = F.filter("flags", lambda f: f["severity"] == severity)
        items = F.array_join(F.transform(some, lambda f: F.concat(F.lit("<li><b>"), escape(f["title"]), F.lit("</b> "), escape(f["detail"]), F.lit("</li>"))), "")
        return F.when(F.size(some) > 0, F.concat(F.lit(f'<h2 class="{severity}">{title} ('), F.size(some).cast("string"), F.lit(")</h2><ul>"), items, F.lit("</ul>"))).otherwise("")

    gate = F.when(F.col("gate_reason").isNotNull(), tag("div", escape(F.col("gate_reason")), "gate")).otherwise("")
    return F.concat(F.lit("<html><h1>"), escape(F.col("verdict")), F.lit(f"</h1><p {SCORE}"), F.col("final_score").cast("string"), F.lit("</p>"), tag("p", escape(F.col("action")), "action"), gate, tag("table", rows), bars, F.when(F.size("penalty_reasons") > 0, tag("ul", risks, "risks")).otherwise(""), *[section(k, v) for k, v in SECTIONS.items()], F.lit("</html>"))


def score_of(page: Column) -> Column:
    """The score that a report shows; null without one."""
    return F.regexp_extract(page, f"{SCORE}([0-9]+)<", 1).try_cast("int")


def write_reports(reports: DataFrame, path: str, batch: int) -> None:
    """(file_name, verdict, html) into path/batch=N, a folder for each verdict there; unknown verdicts go where people look.

    The batch's number is its version: writing it again replaces what it wrote before and touches no other batch.
    """
    verdict = F.when(F.col("verdict").isin(VERDICTS), F.col("verdict")).otherwise("MANUAL REVIEW")
    reports.select("file_name", "html", F.replace(verdict, F.lit(" "), F.lit("_")).alias("verdict")).write.mode("overwrite").partitionBy("verdict").parquet(f"{path}/batch={batch}")


def written_reports(spark: SparkSession, path: str) -> DataFrame:
    """(file_name, verdict, html, batch): each letter's report, of several batches the latest's."""
    found = spark.read.schema("file_name string, html string, batch long, verdict string").parquet(path)
    latest = found.groupBy("file_name").agg(F.max_by(F.struct("verdict", "html", "batch"), F.struct("batch", "verdict", "html")).alias("r"))
    return latest.select("file_name", "r.verdict", "r.html", "r.batch")


def report_sink(*targets: str):
    """A function for foreachBatch that writes each batch to all targets. A batch that is run again, after a crash between two targets also, leaves each report once in each."""

    def write(reports: DataFrame, batch: int) -> None:
        kept = reports.persist()
        for target in targets:
            write_reports(kept, target, batch)
        kept.unpersist()

    return write
