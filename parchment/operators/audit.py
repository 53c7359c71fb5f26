"""The field audit: for each extracted field an ordered table of rules, of which the first that fits names the problem."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from parchment.config import CLAUSE_WORDS, HEADING_WORDS, LABEL_WORDS, ROLE_WORDS, SCHOOL_WORDS
from parchment.functions.text import any_of, blank_to_null, strip
from parchment.patterns import EMPLOYMENT_TYPES

Test = Callable[[Column], Column]


def whole_word(words: list[str]) -> str:
    return rf"(?i)\b({'|'.join(words)})\b"


def _words(c: Column) -> Column:
    return F.filter(F.split(F.lower(c), r"\s+"), lambda w: w != "")


def _longer(n: int) -> Test:
    return lambda c: F.length(c) > n


def _more_words(n: int) -> Test:
    return lambda c: F.size(_words(c)) > n


def _has(words: list[str]) -> Test:
    return lambda c: c.rlike(whole_word(words))


def _has_word(words: list[str], around: str = "") -> Test:
    bare = (lambda w: F.btrim(w, F.lit(around))) if around else (lambda w: w)
    return lambda c: F.arrays_overlap(F.transform(_words(c), bare), F.array(*[F.lit(w) for w in words]))


def _digits(c: Column) -> Column:
    return F.length(F.regexp_replace(c, "[^0-9]", ""))


def _equals(other: str) -> Test:
    return lambda c: F.lower(strip(c)) == F.lower(strip(F.col(other)))


def _either(*tests: Test) -> Test:
    return lambda c: any_of([t(c) for t in tests])


_REGISTRATION = [r"^[A-Z][0-9]{5}[A-Z]{2}[0-9]{4}[A-Z]{3}[0-9]{6}$", r"(?i)^[0-9]{2}[A-Z]{5}[0-9]{4}[A-Z][A-Z0-9]Z[A-Z0-9]$", "(?i)^udyam"]

#: By field, in the order of the report: (reason, test) in order of priority.
RULES: dict[str, list[tuple[str, Test]]] = {
    "company_name": [("too long", _longer(60)), ("clause", _has(CLAUSE_WORDS)), ("mail or digits", lambda c: F.contains(c, F.lit("@")) | (_digits(c) > 4))],
    "candidate_name": [("too long", _either(_more_words(5), _longer(40))), ("role word", _has(ROLE_WORDS)), ("heading", _has(HEADING_WORDS)), ("digits", lambda c: _digits(c) > 0)],
    "job_title": [("too long", _longer(60)), ("equals company", _equals("company_name")), ("equals candidate", _equals("candidate_name")), ("schooling", _has_word(SCHOOL_WORDS, ".,/")), ("clause", _has(CLAUSE_WORDS))],
    "hr_name": [
        ("designation", _has(ROLE_WORDS)), ("clause", _either(_has(CLAUSE_WORDS), _longer(40))), ("digits", lambda c: _digits(c) > 0), ("label", _has_word(LABEL_WORDS)),
        ("holds candidate", lambda c: F.contains(F.lower(c), F.lower(blank_to_null(F.col("candidate_name"))))),
    ],
    "hr_designation": [("too long", _either(_longer(46), _more_words(7))), ("clause", _has(CLAUSE_WORDS))],
    "company_email": [("format", lambda c: ~c.rlike(r"(?i)^[^@\s]+@[^@\s]+\.[a-z]{2,}$"))],
    "domain": [("format", lambda c: ~c.rlike(r"(?i)^[a-z0-9][a-z0-9.\-]*\.[a-z]{2,}$"))],
    "phone": [("digits", lambda c: ~_digits(c).between(10, 13))],
    "registration": [("format", lambda c: ~any_of([c.rlike(r) for r in _REGISTRATION]))],
    "employment_type": [("unknown", lambda c: ~c.isin([name for _, name in EMPLOYMENT_TYPES]))],
    "work_location": [("too long", _longer(50)), ("clause", _has(CLAUSE_WORDS)), ("blank", lambda c: F.length(F.regexp_replace(c, "[^A-Za-z0-9]", "")) < 3)],
}


def problem(field: str) -> Column:
    """The first reason that fits a field's value; null for a sound value and for none."""
    value = blank_to_null(F.col(field))
    return F.coalesce(*[F.when(test(value), F.lit(reason)) for reason, test in RULES[field]])


def audited(letters: DataFrame) -> DataFrame:
    """(letter_id, place, field, value, reason): a row for each field of each letter. The field columns must be there."""
    one = lambda k, f: F.struct(F.lit(k).alias("place"), F.lit(f).alias("field"), blank_to_null(F.col(f)).alias("value"), problem(f).alias("reason"))
    return letters.select("letter_id", F.inline(F.array(*[one(k, f) for k, f in enumerate(RULES)])))


def suspect_fields() -> Column:
    """How many of a letter's fields are suspect."""
    return sum((problem(f).isNotNull().cast("int") for f in list(RULES)[1:]), problem(next(iter(RULES))).isNotNull().cast("int"))


def summary(rows: DataFrame) -> DataFrame:
    """By field: letters without it, with a suspect value, and the suspect value of the smallest letter."""
    return rows.groupBy("place", "field").agg(
        F.count_if(F.col("value").isNull()).alias("missing"), F.count("reason").alias("suspect"), F.min_by("value", F.when(F.col("reason").isNotNull(), F.col("letter_id"))).alias("example")
    )


def examples(rows: DataFrame, most: int = 4) -> DataFrame:
    """The first `most` suspect values of each field. Rows are ranked before the exchange too, so a task gets few of a field."""
    ranked = rows.filter("reason is not null").withColumn("nth", F.row_number().over(W.partitionBy("field").orderBy("letter_id", "value")))
    return ranked.filter(F.col("nth") <= most)
