"""Derived checks, pillar scores, gates, penalties and flags, as staged columns over letters joined with their facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parchment.config import ANSWER_KEYS, DEFAULT, INFORMATIONAL, MOST_FLAGS, PILLARS, Settings
from parchment.functions.text import any_of, blank_to_null, first, let

COMPONENTS = ["basic", "hra", "special", "pf_employer", "gratuity"]


def _zero(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(0.0))


def date_logic(df: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    gap = F.datediff("joining_date", "offer_date")
    state = F.when(gap.isNull(), F.lit(None).cast("string")).when(gap < 0, "impossible").when(gap > s.max_gap, "too long").when(gap < s.short_gap, "short").otherwise("valid")
    return df.withColumn("gap_days", gap).withColumn("gap_state", state)


def offer_age(df: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    days = F.datediff(F.lit(s.as_of).cast("date"), "offer_date")
    level = F.when(days.isNull(), F.lit(None).cast("string")).when((days < 0) | (days > 365), "red").when(days > 90, "yellow").otherwise("green")
    return df.withColumn("age_days", days).withColumn("age_level", level).withColumn("is_old", F.coalesce(days > 180, F.lit(False))).withColumn("future_offer", F.coalesce(days < 0, F.lit(False)))


def salary_math(df: DataFrame) -> DataFrame:
    """Whether the components make up the CTC; monthly parts are recognised by their sum and put on a year."""
    total = sum((_zero(c) for c in COMPONENTS[1:]), _zero(COMPONENTS[0]))
    df = df.withColumn("parts", total)
    df = df.withColumn("parts", F.when(F.col("parts") < F.col("ctc") / 6, F.col("parts") * 12).otherwise(F.col("parts")))
    usable = F.col("ctc").isNotNull() & (F.col("ctc") > 0) & (total > 100)
    share = F.col("parts") / F.col("ctc")
    return df.withColumn("salary_ok", F.when(usable, (share <= 1.05) & (share >= 0.40))).withColumn("salary_percent", F.when(usable, (share * 100).cast("int"))).drop("parts")


def completeness(columns: list[Column]) -> Column:
    """The share of columns that are neither null, empty, zero nor false, to two places."""
    filled = [F.when(F.coalesce(c.cast("string"), F.lit("")).isin("", "0", "0.0", "false"), 0).otherwise(1) for c in columns]
    return F.round(sum(filled[1:], filled[0]) / len(filled), 2)


def pillar(score: Column, weight: int) -> Column:
    """struct<score, max, kind>: a missing score counts half of the weight, unverified."""
    return F.struct(F.coalesce(score.cast("double"), F.lit(round(weight / 2, 1))).alias("score"), F.lit(weight).alias("max"), F.when(score.isNull(), "unverified_conservative").otherwise("verified").alias("kind"))


def online_score() -> Column:
    """Null where the lookups failed."""
    failed = F.col("dns_error") | ~F.col("checked")
    return F.when(~failed, F.least(F.lit(11), 4 * F.col("dns_valid").cast("int") + 7 * F.col("found").cast("int")))


def pillars(df: DataFrame) -> DataFrame:
    df = df.withColumn("online_score", online_score())
    for name, weight in PILLARS.items():
        df = df.withColumn(f"p_{name}", pillar(F.col(f"{name}_score"), weight))
    names = [f"p_{n}" for n in PILLARS]
    total = sum((F.col(f"{n}.score") for n in names[1:]), F.col(f"{names[0]}.score"))
    return df.withColumn("total", total).withColumn("score", F.greatest(F.lit(0), F.bround("total").cast("int"))).withColumn("unverified", any_of([F.col(f"{n}.kind") != "verified" for n in names]))


def penalties(s: Settings = DEFAULT) -> Column:
    """array<struct<reason, points>> in a fixed order; they inform and are not subtracted."""
    p = s.penalties
    one = lambda when, reason, points: F.when(when, F.struct(F.lit(reason).alias("reason"), (points if isinstance(points, Column) else F.lit(points)).cast("int").alias("points")))
    return F.array_compact(F.array(
        one(F.col("template"), "template", -p.template), one(F.col("n_red") > 0, "red phrases", -F.least(F.col("n_red") * p.red_phrase, F.lit(p.red_phrase_cap))),
        one(F.col("gap_state") == "impossible", "impossible date", -p.impossible_date), one(~F.col("salary_ok"), "salary math", -p.salary_math),
        one(F.col("suspicious_metadata"), "metadata", -p.metadata), one(F.col("online_edit"), "online edit", -p.online_edit), one(F.col("completeness") < s.complete, "incomplete", -p.completeness),
        one(F.col("age_days") < 0, "future offer", -p.future_offer), one(F.col("age_days") > 365, "very old offer", -p.very_old), one(F.col("age_days").between(181, 365), "old offer", -p.stale),
    ))


def gates(df: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """Adds verdict, gate (the last that fired) and final_score. Each gate sees the verdict that the one before left."""
    df = df.withColumn("v0", F.when(F.col("score") >= s.legitimate, "LEGITIMATE").when(F.col("score") >= s.review, "MANUAL REVIEW").otherwise("SUSPICIOUS"))
    offline = F.col("checked") & ~F.col("found") & ~F.col("dns_valid") & ~F.col("dns_error")
    fraud = (F.col("n_red") > 0) | F.col("template") | F.coalesce(F.col("gap_state") == "impossible", F.lit(False)) | F.col("future_offer")
    edited = F.col("floating_date") & F.col("online_edit")
    df = df.withColumns({"c2": offline, "c3": fraud, "c4": edited, "c5": F.col("composite")})
    df = df.withColumn("g1", F.col("unverified") & (F.col("v0") != "SUSPICIOUS")).withColumn("v1", F.when(F.col("g1"), "MANUAL REVIEW").otherwise(F.col("v0")))
    for k, down_from, to in ((2, ["LEGITIMATE"], "MANUAL REVIEW"), (3, ["LEGITIMATE"], "MANUAL REVIEW"), (4, ["LEGITIMATE", "MANUAL REVIEW"], "SUSPICIOUS"), (5, ["LEGITIMATE", "MANUAL REVIEW"], "SUSPICIOUS")):
        df = df.withColumn(f"g{k}", F.col(f"c{k}") & F.col(f"v{k - 1}").isin(down_from)).withColumn(f"v{k}", F.when(F.col(f"g{k}"), to).otherwise(F.col(f"v{k - 1}")))
    names = {5: "composite forgery", 4: "edited date", 3: "fraud signal", 2: "company not found", 1: "unverified pillar"}
    cap = F.when(F.col("v5") == "SUSPICIOUS", s.review - 1).when(F.col("v5") == "MANUAL REVIEW", s.legitimate - 1).otherwise(100)
    capped = any_of([F.col(f"c{k}") for k in (2, 3, 4, 5)])
    df = df.withColumn("gate", F.coalesce(*[F.when(F.col(f"g{k}"), F.lit(n)) for k, n in names.items()])).withColumn("final_score", F.when(capped, F.least("score", cap)).otherwise(F.col("score")))
    return df.withColumn("verdict", F.col("v5")).drop(*[f"v{k}" for k in range(6)], *[f"g{k}" for k in range(1, 6)], *[f"c{k}" for k in range(2, 6)])


def action() -> Column:
    """The scorer's advice, overridden by gates, red phrases and template fields; the later rule wins."""
    a = F.when(F.col("gate").isNotNull() & (F.col("advice") == "APPROVE"), "REVIEW").otherwise(F.col("advice"))
    a = F.when((F.col("n_red") > 0) & (F.col("final_score") < 50), "REJECT").otherwise(a)
    return F.when(F.col("template") & (F.col("final_score") < 40), "REJECT").otherwise(a)


def sort_flags(flags: Column) -> Column:
    """Red before yellow before green, in their order otherwise; unknown severities rank as yellow."""
    rank = lambda x: F.when(x["severity"] == "red", 0).when(x["severity"] == "green", 2).otherwise(1)
    keyed = F.transform(flags, lambda x, i: F.struct(rank(x).alias("r"), i.alias("i"), x.alias("x")))
    return F.transform(F.array_sort(keyed), lambda k: k["x"])


def flags(model_flags: Column | None = None, warnings: Column | None = None) -> Column:
    """array<struct<severity, title>> in the order in which they are raised, then sorted: the gate's comes before the model's."""
    f = lambda severity, title: F.struct((severity if isinstance(severity, Column) else F.lit(severity)).alias("severity"), (title if isinstance(title, Column) else F.lit(title)).alias("title"))
    rules = F.array_compact(F.array(
        F.when(F.col("domain").isNotNull() & ~F.col("dns_valid"), f("yellow", "Domain Does Not Resolve")),
        F.when(F.col("domain").isNotNull() & F.col("dns_valid") & ~F.col("mx"), f("yellow", "No Mail Server Found")), F.when(F.col("gap_days").between(0, 2), f("yellow", "Very Short Joining Gap")),
    ))
    parts = [F.array_compact(F.array(F.when(F.col("gate").isNotNull(), f("yellow", "Visual Analysis Incomplete"))))]
    parts += [F.slice(model_flags, 1, MOST_FLAGS)] if model_flags is not None else []
    parts += [rules, F.transform("penalties", lambda p: f(F.when(F.abs(p["points"]) >= 10, "red").otherwise("yellow"), F.concat(F.lit("Risk Signal Detected: "), p["reason"])))]
    if warnings is not None:
        parts.append(F.transform(loud(warnings), lambda w: f("yellow", F.concat(F.lit("Document Processing Issue: "), w))))
    return sort_flags(F.concat(*parts))


def loud(warnings: Column) -> Column:
    """The warnings that tell of something that failed."""
    return F.filter(warnings, lambda w: ~any_of([w.startswith(i) for i in INFORMATIONAL]))


def band(score: Column, most: Column, kind: Column) -> Column:
    percent = score / most * 100
    return F.when(kind != "verified", "medium").when(percent >= 66, "high").when(percent >= 33, "medium").otherwise("low")


def whole_number(value: Column) -> Column:
    """A JSON value (as text) as a whole number: fractions are cut, text must be whole digits, all else is null."""

    def of(v: Column) -> Column:
        number = F.when(v == "true", 1.0).when(v == "false", 0.0).otherwise(v.try_cast("double"))
        return F.when(v.startswith('"'), first(v, r'^"\s*([+-]?[0-9]+)\s*"$', 1).try_cast("int")).otherwise(number.try_cast("int"))

    return let(value, of)


def tolerant_float(value: Column) -> Column:
    """A number out of text that may hold a currency, commas and blanks; null for anything else."""
    return blank_to_null(F.regexp_replace(value, r"[₹,\s]|Rs\.?\s*", "")).try_cast("double")


def parse_scores(response: Column, images_available: Column) -> Column:
    """struct of all that a model's answer says: JSON, bare, fenced or inside other text.

    <pillar>_score and <pillar>_reasoning for eight pillars (the visual ones' scores null without images), flags (at most
    MOST_FLAGS, of severity, title, detail), issues, warnings and passed checks, what was found on the letterhead,
    summary, advice, and failed: whether nothing could be read.
    """
    fenced = F.try_parse_json(F.regexp_replace(response, "```json|```", ""))
    inner = F.try_parse_json(first(response, r"(?s)\{.*\}"))
    # An answer is an object that holds something; what it is spelled as tells, once for all that depends on it.
    unread = lambda v: F.coalesce(let(F.to_json(v), lambda s: ~s.startswith("{") | (s == "{}")), F.lit(True))

    def of(v: Column, failed: Column) -> Column:
        get = lambda k, t: F.try_variant_get(v, f"$.{k}", t)
        text = lambda k: F.coalesce(get(k, "string"), F.lit(""))
        number = lambda k: whole_number(F.to_json(F.try_variant_get(v, f"$.{k}", "variant")))
        scores = [(F.when(images_available, number(f"{key}_score")) if n in ("image", "signature") else number(f"{key}_score")).alias(f"{n}_score") for n, key in ANSWER_KEYS.items()]
        reasons = [text(f"{key}_reasoning").alias(f"{n}_reasoning") for n, key in ANSWER_KEYS.items()]
        raw = F.slice(F.coalesce(get("flags", "array<variant>"), F.array().cast("array<variant>")), 1, MOST_FLAGS)
        part = lambda f, k, default: F.coalesce(F.try_variant_get(f, f"$.{k}", "string"), F.lit(default)).alias(k)
        flags = F.transform(raw, lambda f: F.struct(part(f, "severity", "yellow"), part(f, "title", ""), part(f, "detail", "")))
        listed = lambda k: F.coalesce(get(k, "array<string>"), F.array().cast("array<string>")).alias(k)
        summary = F.when(failed, "AI scoring could not be completed (unreadable response) — manual review required").otherwise(text("summary"))
        advice = F.when(failed, "REVIEW").otherwise(F.coalesce(get("recommended_action", "string"), F.lit("REVIEW")))
        found = [let(get(k, "string"), blank_to_null).alias(k) for k in ("company_domain_found", "company_name_found")]
        return F.struct(*scores, *reasons, flags.alias("flags"), listed("critical_issues"), listed("warnings"), listed("passed_checks"), *found, text("company_online_reasoning").alias("online_note"), summary.alias("summary"), advice.alias("advice"), failed.alias("failed"))

    return let(F.coalesce(fenced, inner), lambda v: let(unread(v), lambda failed: of(v, failed)))


def analyze(df: DataFrame, s: Settings = DEFAULT) -> DataFrame:
    """All rules over a table of letters and facts: dates, age, salary, pillars, penalties, gates, action and flags."""
    df = pillars(salary_math(offer_age(date_logic(df, s), s)))
    df = gates(df.withColumn("penalties", penalties(s)), s)
    return df.withColumn("action", action()).withColumn("flags", flags())
