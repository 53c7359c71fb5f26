"""Column helpers on letter texts. A miss is null, never an empty string."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def one_of(patterns: list[str]) -> str:
    return f"(?:{'|'.join(patterns)})"


def blank_to_null(c: Column) -> Column:
    return F.when(c != "", c)


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(" \t\n\x0b\x0c\r"))


def ascii_text(c: Column) -> Column:
    return F.when(F.octet_length(c) == F.length(c), c).otherwise(F.regexp_replace(c, r"[^\x00-\x7F]", " "))


def lines(c: Column) -> Column:
    """Stripped lines that are not empty; what lies between the two signs of one line's end is empty too."""
    return F.filter(F.transform(F.split(c, r"[\n\r\x0b\x0c\x1c-\x1e]"), strip), lambda x: x != "")


def first(c: Column, regex: str, group: int = 0) -> Column:
    return let(F.regexp_extract(c, regex, group), blank_to_null)


def holds(c: Column, *parts: str) -> Column:
    """Whether c holds one of the parts: a look that costs far less than a search by regex or by place."""
    return any_of([F.contains(c, F.lit(p)) for p in parts])


def found(c: Column, low: Column, regex: str, group: int, *parts: str) -> Column:
    """first() of a regex that finds nothing in c unless c's lower case holds one of the parts."""
    return F.when(holds(low, *parts), first(c, regex, group))


def every(c: Column, regex: str, group: int = 0) -> Column:
    return F.regexp_extract_all(c, F.lit(regex), F.lit(group))


def let(value: Column, body) -> Column:
    """body(value) with value computed once for a row, even where body names it in many branches."""
    return F.element_at(F.transform(F.array(value), body), 1)


def hits(c: Column, phrases: list[str]) -> Column:
    """The phrases that the text holds as substrings, case aside, in the phrases' order."""
    return let(F.lower(c), lambda low: F.array_compact(F.array(*[F.when(F.contains(low, F.lit(p.lower())), F.lit(p)) for p in phrases])))


def window(c: Column, low: Column, keyword: str, size: int) -> Column:
    """size characters of c from a keyword's first occurrence in low, c's lower case; null without one."""
    return F.when(F.contains(low, F.lit(keyword)), F.substring(c, F.locate(keyword, low), F.lit(size)))


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def parse_date(token: Column) -> Column:
    """A date of whole days in a common written form, else in any that spelled_date() reads; null for anything else."""
    return F.coalesce(common_date(token), F.when(token.rlike("[0-9]"), spelled_date(token)))


# Words of a written date. Those of the second list say nothing.
MONTH_WORDS = "jan feb mar apr may jun jul aug sep oct nov dec".split()
DATE_FILLERS = ["of", "the", "day", "on", "at", "and", "ad", "t", "st", "nd", "rd", "th"]
WEEKDAY = r"(?:mon|tue|wed|thu|fri|sat|sun)(?:day|s|sday|nesday|rs|rsday|urday)?"
MONTH_WORD = r"(?:jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?|sept?(?:ember)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?)"
CLOCK = r"[0-9]{1,2}:[0-9]{2}(?::[0-9]{2}(?:\.[0-9]+)?)?\s*(?:[ap]\.?m\b\.?)?\s*(?:\(?(?:utc|gmt|ist|est|edt|cst|cdt|pst|pdt|bst|cet|cest|z)\)?)?(?:\s*[+-][0-9]{2}:?[0-9]{2})?"


def spelled_date(text: Column) -> Column:
    """A date of whole days by a fold over the words and numbers of a text; null if any of them has no place in a date.

    A clock time with its zone, weekdays and words that say nothing are passed over. A named month takes one place; numbers
    take the others in their order. Eight digits alone are year, month and day. A number of four digits, or above 31, is the year,
    wherever it stands; without one the last is. Year first, what follows is month and day, else day and month; a month above
    12 changes places with the day. Years of two digits lie between 1976 and 2075. Without a day, or with more than one month
    by name, there is no date.
    """
    plain = F.regexp_replace(F.lower(strip(text)), rf"(?<![0-9]){CLOCK}", " ")
    words = F.regexp_extract_all(plain, F.lit(r"[a-z]+|[0-9]+|[^a-z0-9\s,./\-'’]"), F.lit(0))
    month = lambda w: F.array_position(F.array(*[F.lit(m) for m in MONTH_WORDS]), F.substring(w, 1, 3)).cast("int")
    start = F.struct(F.array().cast("array<int>").alias("numbers"), F.lit(0).alias("month"), F.lit(False).alias("compact"), F.lit(True).alias("good"))

    def step(held: Column, w: Column) -> Column:
        named, digits, eight = w.rlike(f"^{MONTH_WORD}$"), w.rlike("^[0-9]{1,4}$"), w.rlike("^[0-9]{8}$") & (F.size(held["numbers"]) == 0)
        parts = F.transform(F.array(F.substring(w, 1, 4), F.substring(w, 5, 2), F.substring(w, 7, 2)), lambda x: x.try_cast("int"))
        numbers = F.when(digits, F.concat(held["numbers"], F.array(w.try_cast("int")))).when(eight, parts).otherwise(held["numbers"])
        good = held["good"] & (digits | eight | (named & (held["month"] == 0)) | w.isin(DATE_FILLERS) | w.rlike(f"^{WEEKDAY}$"))
        return F.struct(numbers.alias("numbers"), F.when(named, month(w)).otherwise(held["month"]).alias("month"), (held["compact"] | eight).alias("compact"), good.alias("good"))

    def whole(x: Column) -> Column:
        n, named = x["numbers"], x["month"] > 0
        big = F.array_position(F.transform(n, lambda v: v > 31), F.lit(True)).cast("int")
        at = F.when(big > 0, big).otherwise(F.size(n))
        rest = F.filter(n, lambda v, k: k != at - 1)
        one, two = F.try_element_at(rest, F.lit(1)), F.try_element_at(rest, F.lit(2))
        first_year = at == 1
        m = F.when(named, x["month"]).when(first_year, one).otherwise(two)
        d = F.when(named, one).when(first_year, two).otherwise(one)
        y = F.try_element_at(n, at)
        year = F.when(y < 76, y + 2000).when(y < 100, y + 1900).otherwise(y)
        swap = ~named & (m > 12) & (d <= 12)
        day = F.concat_ws("-", F.lpad(year.cast("string"), 4, "0"), F.when(swap, d).otherwise(m).cast("string"), F.when(swap, m).otherwise(d).cast("string"))
        fits = x["good"] & (F.size(n) == F.when(named, 2).otherwise(3)) & ~(x["compact"] & named)
        return F.when(fits, F.try_to_date(day, "yyyy-M-d"))

    return let(F.aggregate(words, start, step), whole)


def common_date(token: Column) -> Column:
    """A date of whole days in one of many written forms, days before months; null for anything else.

    A weekday in front and a time behind are passed over; signs between the parts may be blanks, points, commas, strokes
    or slashes. Years of two digits lie between 1976 and 2075; 2026-02-03 is ISO. A form without a day is null.
    """
    near = lambda d: F.when(F.year(d) > 2075, F.add_months(d, -1200)).otherwise(d)
    plain = F.regexp_replace(strip(token), r"(?i)(?<=[0-9])(st|nd|rd|th)\b", "")
    plain = F.regexp_replace(plain, r"(?i)^(?:mon|tues?|wed(?:nes)?|thur?s?|fri|sat(?:ur)?|sun)(?:day)?[\s,.]+|[\sT,]+[0-9]{1,2}:[0-9]{2}(?::[0-9]{2})?(?:\s*[ap]m)?$", "")
    joined = F.regexp_replace(F.regexp_replace(plain, r"[\s,./\-]+", "-"), "^-|-$", "")

    def ways(t: Column) -> Column:
        month = F.regexp_replace(t, r"(?i)(?<![a-z])(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*", "$1")
        named = F.initcap(F.lower(F.replace(month, F.lit("-"), F.lit(" "))))
        word = "[A-Z][a-z]{2}"
        known = r"(?i)^(?:.*-)?(?:jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?|sept?(?:ember)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?)(?:-.*)?$"
        numbers = F.when(t.rlike("^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}$"), F.try_to_date(t, "yyyy-M-d")).when(t.rlike("^[0-9]{1,2}-[0-9]{1,2}-[0-9]{4}$"), F.coalesce(F.try_to_date(t, "d-M-yyyy"), F.try_to_date(t, "M-d-yyyy")))
        numbers = numbers.when(t.rlike("^[0-9]{1,2}-[0-9]{1,2}-[0-9]{2}$"), near(F.coalesce(F.try_to_date(t, "d-M-yy"), F.try_to_date(t, "M-d-yy"))))
        out = None
        for shape, form in ((f"^[0-9]{{1,2}} {word} [0-9]{{4}}$", "d MMM yyyy"), (f"^[0-9]{{1,2}} {word} [0-9]{{2}}$", "d MMM yy"), (f"^{word} [0-9]{{1,2}} [0-9]{{4}}$", "MMM d yyyy"), (f"^{word} [0-9]{{1,2}} [0-9]{{2}}$", "MMM d yy"), (f"^[0-9]{{4}} {word} [0-9]{{1,2}}$", "yyyy MMM d")):
            day = F.try_to_date(named, form) if "yyyy" in form else near(F.try_to_date(named, form))
            out = F.when(named.rlike(shape), day) if out is None else out.when(named.rlike(shape), day)
        return F.when(t.rlike("^[0-9-]+$"), numbers).when(t.rlike(known), out)

    return let(joined, ways)


def slug(c: Column) -> Column:
    return F.btrim(F.regexp_replace(c, "[^a-zA-Z0-9]+", "_"), F.lit("_"))
