"""The whole assessment of a letter: the rules of `rules`, with the notes, reasons, flags and summaries that people read.

assess() takes one row a letter that already holds the extracted fields and the joined facts:
red_phrases, artifacts, warnings, tampering, composites (arrays of strings), created_with, author, created_on, modified_on,
suspicious, metadata_reasons, online_tool, dns_valid, dns_error, mx, dns_note, found, checked, online_note, logo, signature,
has_stamp, n_rendered, and answer, a struct of parse_scores().
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parchment.config import ANSWER_KEYS, DEFAULT, PILLARS, Settings
from parchment.functions.text import blank_to_null
from parchment.operators import forensic, rules


def _say(*parts) -> Column:
    return F.concat(*[p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts])


def _rupees(c: Column) -> Column:
    """A whole number with commas; halves go to the even neighbour."""
    return F.format_number(F.bround(c, 0), 0)


def gap_note(most: int = DEFAULT.max_gap) -> Column:
    gap = F.col("gap_days")
    return (
        F.when(gap.isNull(), "Could not determine dates").when(gap < 0, _say("Joining date is ", F.abs(gap), " days BEFORE offer date — impossible")).when(gap > most, _say(gap, f" days gap — unusually long (over {most} days)"))
        .when(gap < 3, _say("Only ", gap, " day(s) gap — very short, worth noting")).otherwise(_say("Gap of ", gap, " days is within normal range"))
    )


def age_note() -> Column:
    days = F.col("age_days")
    return (
        F.when(days.isNull(), "Recent offer").when(days < 0, _say("Offer dated ", F.abs(days), " days in the FUTURE — impossible")).when(days > 365, _say("Offer is ", days, " days old (over 1 year) — likely reused/recycled fraud"))
        .when(days > 180, _say("Offer is ", days, " days old (6+ months) — unusually stale, may be resurrected")).when(days > 90, _say("Offer is ", days, " days old (3+ months) — consider verifying with company"))
        .otherwise(_say("Offer is ", days, " days old — recent, normal range"))
    )


def salary_note() -> Column:
    total = sum((F.coalesce(F.col(c), F.lit(0.0)) for c in rules.COMPONENTS[1:]), F.coalesce(F.col(rules.COMPONENTS[0]), F.lit(0.0)))
    parts = F.when(total < F.col("ctc") / 6, total * 12).otherwise(total)
    share = F.concat(F.lit("Salary components account for "), F.col("salary_percent").cast("string"), F.lit("% of CTC — remainder is variable pay / benefits (normal)"))
    few = F.concat(F.lit("Salary components account for only "), F.col("salary_percent").cast("string"), F.lit("% of CTC — too many major components missing or numbers manipulated"))
    over = _say("Salary components (", _rupees(parts), ") exceed stated CTC (", _rupees(F.col("ctc")), ") — impossible")
    return F.when(F.col("salary_ok").isNull(), "Insufficient data to verify salary math").when(F.col("salary_ok"), share).when(parts > 1.05 * F.col("ctc"), over).otherwise(few)


def online_reasoning() -> Column:
    """What the lookups found, for the pillar of the company's presence."""
    dns = F.when(F.col("dns_valid"), "domain resolves (+4)").when(F.col("domain").isNotNull(), _say("domain '", F.col("domain"), "' does not resolve")).otherwise("no domain to verify")
    web = F.when(F.col("found"), _say("online presence confirmed (+7) — ", F.coalesce("online_note", F.lit("")))).otherwise(_say("no online presence — ", F.coalesce("online_note", F.lit(""))))
    return _say(F.col("online_score"), f"/{PILLARS['online']}: ", dns, "; ", web, ".")


_WHY = {"image": "Images not extractable from PDF", "signature": "Images not extractable from PDF", "online": "Online/DNS verification could not complete (network/system error)"}


def pillar_reasoning(name: str) -> Column:
    """A verified pillar's own reasoning, an unverified one's notice."""
    half = PILLARS[name] / 2
    notice = f"{_WHY.get(name, 'AI response incomplete')} — conservative score applied ({half}/{PILLARS[name]}). Manual review required."
    own = online_reasoning() if name == "online" else F.col(f"answer.{name}_reasoning")
    if name in ("image", "signature"):
        own = F.coalesce(blank_to_null(own), F.col("logo_note" if name == "image" else "signature_note"), F.col("images_reasoning"))
    return F.when(F.col(f"p_{name}.kind") == "verified", own).otherwise(notice)


def penalty_reasons(s: Settings = DEFAULT) -> Column:
    """The penalties of rules.penalties() with the reasons that are shown."""
    say = {
        "template": _say("Unfilled placeholders: ", F.array_join(F.slice("artifacts", 1, 4), ", ")), "red phrases": _say("Fraud language: ", F.array_join("red_phrases", ", ")), "impossible date": _say("Date issue: ", F.col("gap_note")),
        "salary math": _say("Salary math: ", F.col("salary_note")), "metadata": _say("Metadata: ", F.coalesce("metadata_reasons", F.lit("None"))), "online edit": _say("PDF processed with ", F.coalesce("online_tool", F.lit("None")), " — verify original source"),
        "incomplete": _say("Document only ", (F.col("completeness").cast("decimal(10,2)") * 100).cast("int"), "% complete — key fields missing"),
    }

    def full(p: Column) -> Column:
        out = None
        for reason, text in say.items():
            out = F.when(p["reason"] == reason, text) if out is None else out.when(p["reason"] == reason, text)
        return F.struct(out.otherwise(_say("Offer age: ", F.col("age_note"))).alias("reason"), p["points"].alias("points"))

    return F.transform("penalties", full)


def gate_reason(s: Settings = DEFAULT) -> Column:
    """Why the gate that fired last did."""
    marks = F.array_compact(F.array(
        F.when(F.size("red_phrases") > 0, _say("fraud language (", F.array_join(F.slice("red_phrases", 1, 3), ", "), ")")), F.when(F.size("artifacts") > 0, _say("unfilled placeholder(s) (", F.array_join(F.slice("artifacts", 1, 3), ", "), ")")),
        F.when(F.col("gap_state") == "impossible", "joining date before offer date (impossible)"), F.when(F.col("future_offer"), "offer dated in the future (impossible)"),
    ))
    gate = F.col("gate")
    blocked = F.when(F.col("score") >= s.legitimate, "Visual analysis incomplete — auto-accept blocked. Human review of signatures and images required.").otherwise("Visual analysis incomplete — conservative scores applied. Human review required.")
    edited = _say("Confirmed edit-laundering: ", F.coalesce("online_tool", F.lit("online editor")), " footprint together with an edit artifact (", F.try_element_at("tampering", F.lit(1)), ") — content was altered and re-saved. Treated as suspicious; manual verification against the original required.")
    layered = _say("Composited document forgery: ", F.try_element_at("composites", F.lit(1)), ". Content was overlaid onto a blank letterhead and flattened — fabricated, not a genuine letter.")
    return (
        F.when(gate == "unverified pillar", blocked).when(gate == "company not found", "Company has no verifiable online presence (DNS + web both failed) — cannot auto-approve.")
        .when(gate == "fraud signal", _say("Deterministic fraud marker(s) detected — ", F.array_join(marks, "; "), " — cannot auto-approve.")).when(gate == "edited date", edited).when(gate == "composite forgery", layered)
    )


def flag_details() -> Column:
    """array<struct<severity, title, detail>>: a failed answer, the gate, the model's own, then what the rules and the document raise; sorted."""
    f = lambda severity, title, detail: F.struct((severity if isinstance(severity, Column) else F.lit(severity)).alias("severity"), F.lit(title).alias("title"), (detail if isinstance(detail, Column) else F.lit(detail)).alias("detail"))
    if_ = lambda when, flag: F.when(when, flag)
    failed = "The AI returned an unreadable response, so all pillar scores fell back to conservative values. This score is NOT reliable — manual review required."
    front = F.array_compact(F.array(if_(F.col("answer.failed"), f("red", "AI Scoring Failed", failed)), if_(F.col("gate").isNotNull(), f("yellow", "Visual Analysis Incomplete", F.col("gate_reason")))))
    domain = F.col("domain")
    own = F.array_compact(F.array(
        if_(domain.isNotNull() & ~F.col("dns_valid"), f("yellow", "Domain Does Not Resolve", _say(domain, " — ", F.coalesce(blank_to_null(F.col("dns_note")), F.lit("could not verify domain"))))),
        if_(domain.isNotNull() & F.col("dns_valid") & ~F.col("mx"), f("yellow", "No Mail Server Found", _say(domain, " has no MX records — company may use Gmail or third-party email"))),
        if_(F.col("gap_days").between(0, 2), f("yellow", "Very Short Joining Gap", F.col("gap_note"))),
    ))
    risks = F.transform("penalty_reasons", lambda p: f(F.when(F.abs(p["points"]) >= 10, "red").otherwise("yellow"), "Risk Signal Detected", p["reason"]))
    issues = F.transform(rules.loud(F.col("warnings")), lambda w: f("yellow", "Document Processing Issue", _say(w, " — some analysis may be based on partial data.")))
    editor = F.coalesce(F.concat(F.lit(" PDF also processed with "), F.col("online_tool"), F.lit(".")), F.lit(""))
    edits = F.transform("tampering", lambda a: f("yellow", "Possible Edit Artifact", _say(a, " — a date appears outside the normal sentence/table flow, which can indicate the date was edited.", editor, " Verify against the original.")))
    return rules.sort_flags(F.concat(front, F.col("answer.flags"), own, risks, issues, edits))


COMPLETE = ["company_name", "company_address", "candidate_name", "job_title", "hr_designation", "offer_date", "joining_date"]
SUMMARY = {
    "company_name": "company_name", "company_domain": "domain", "company_email": "company_email", "company_cin": "registration", "candidate_name": "candidate_name", "job_title": "job_title", "department": None, "hr_name": "hr_name",
    "hr_designation": "hr_designation", "offer_date": "offer_date", "joining_date": "joining_date", "date_gap_days": "gap_days", "date_gap_valid": "gap_valid", "ctc_annual": "ctc", "gross_monthly": "gross", "basic": "basic", "hra": "hra",
    "employment_type": "employment_type", "work_location": "work_location", "completeness_score": "completeness", "red_phrases_found": "red_phrases", "template_artifacts_found": "artifacts", "salary_math_ok": "salary_ok",
    "extraction_notes": "source", "pdf_created_with": "created_with", "pdf_author": "author", "pdf_created_date": "created_on", "pdf_modified_date": "modified_on", "pdf_metadata_suspicious": "suspicious", "pdf_metadata_reason": "metadata_reasons",
}


def letter_summary() -> Column:
    """A struct of what a report's overview shows."""
    return F.struct(*[(F.col(column) if column else F.lit(None).cast("string")).alias(name) for name, column in SUMMARY.items()])


def image_details() -> Column:
    names = {"logo": "logo_assessment", "logo_note": "logo_note", "signature": "signature_assessment", "signature_note": "signature_note", "images_available": "images_available"}
    return F.struct(*[F.col(c).alias(n) for n, c in names.items()], F.col("logo").isNotNull().alias("has_logo"), F.col("signature").isNotNull().alias("has_signature"), F.col("logo").alias("logo_position"))


def completeness() -> Column:
    """The share of ten things that the letter should hold, to two places."""
    pay = F.when((F.coalesce("ctc", F.lit(0.0)) != 0) | (F.coalesce("gross", F.lit(0.0)) != 0), F.lit(1))
    return rules.completeness([*[F.col(c) for c in COMPLETE], pay, F.col("logo"), F.col("signature")])


def rescued(df: DataFrame) -> DataFrame:
    """Names that the model read off a letterhead fill an absent company_name; what was derived before stays as it was."""
    return df.withColumn("company_name", F.coalesce("company_name", "answer.company_name_found"))


def assess(df: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """df with verdict, final_score, action, gate, gate_reason, pillars, penalty_reasons, flags, summary, letter_summary and image_details."""
    df = df.withColumns(forensic.image_notes())
    if "completeness" not in df.columns:
        df = df.withColumn("completeness", completeness())
    df = rescued(df).withColumns({f"{n}_score": F.col(f"answer.{n}_score") for n in ANSWER_KEYS})
    df = df.withColumns({
        "advice": F.col("answer.advice"), "n_red": F.size("red_phrases"), "template": F.size("artifacts") > 0, "floating_date": F.size("tampering") > 0, "composite": F.size("composites") > 0,
        "online_edit": F.col("online_tool").isNotNull(), "suspicious_metadata": F.coalesce("suspicious", F.lit(False)),
    })
    df = rules.analyze(df, s)
    df = df.withColumns({"gap_note": gap_note(s.max_gap), "age_note": age_note(), "salary_note": salary_note(), "gap_valid": F.when(F.col("gap_days").isNotNull(), F.col("gap_days").between(0, s.max_gap))})
    df = df.withColumns({"penalty_reasons": penalty_reasons(s), "gate_reason": gate_reason(s)})
    pillars = [F.struct(F.lit(n).alias("pillar"), F.col(f"p_{n}.score").alias("score"), F.col(f"p_{n}.max").alias("max"), F.col(f"p_{n}.kind").alias("kind"), pillar_reasoning(n).alias("reasoning")) for n in PILLARS]
    return df.withColumns({"flags": flag_details(), "pillars": F.array(*pillars), "summary": F.col("answer.summary"), "letter_summary": letter_summary(), "image_details": image_details()})
