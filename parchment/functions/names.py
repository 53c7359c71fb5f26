"""Names of people side by side: in another order, by initials, with a letter wrong, or shortened."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from parchment.functions.text import let

TITLES = ["mr", "mrs", "ms", "miss", "dr", "prof", "shri", "smt", "sri"]


def tokens(name: Column) -> Column:
    """The words of a name in small letters, signs and titles left out; none for null."""
    words = F.split(F.regexp_replace(F.lower(F.coalesce(name, F.lit(""))), r"[^\p{L}\p{N}]+", " "), " ")
    return F.filter(words, lambda w: (w != "") & ~w.isin(TITLES))


def _close(a: Column, b: Column) -> Column:
    """Equal, one the other's initial, or up to one letter apart for each four of the shorter word."""
    initial = (F.least(F.length(a), F.length(b)) == 1) & (F.substring(a, 1, 1) == F.substring(b, 1, 1))
    near = F.levenshtein(a, b) <= F.floor(F.least(F.length(a), F.length(b)) / 4)
    return initial | near


def _left(short: Column, long: Column, match) -> Column:
    """struct<missed, rest>: the words of short that no word of long matches, each taken once, and the words of long that are left."""
    start = F.struct(F.array().cast("array<string>").alias("missed"), long.alias("rest"))

    def step(held: Column, word: Column) -> Column:
        at = F.coalesce(F.array_position(F.transform(held["rest"], lambda w: match(word, w)), F.lit(True)).cast("int"), F.lit(0))
        rest = F.filter(held["rest"], lambda w, k: k != at - 1)
        return F.struct(F.when(at > 0, held["missed"]).otherwise(F.concat(held["missed"], F.array(word))).alias("missed"), rest.alias("rest"))

    return F.aggregate(short, start, step)


def agreement(a: Column, b: Column) -> Column:
    """How two names agree: same (the same words in any order), form (each word of the shorter is one of the longer's, its
    initial or nearly it) or other. A name without words agrees with none; null where both lack them.

    Equal words are paired first, then the others in their order, so no word counts twice.
    """
    ta, tb = tokens(a), tokens(b)
    pair = let(F.when(F.size(ta) <= F.size(tb), F.struct(ta.alias("short"), tb.alias("long"))).otherwise(F.struct(tb.alias("short"), ta.alias("long"))), lambda p: F.struct(p["short"].alias("short"), p["long"].alias("long"), _left(p["short"], p["long"], lambda x, y: x == y).alias("exact")))
    return let(
        pair,
        lambda p: F.when(F.size(p["long"]) == 0, F.lit(None).cast("string")).when(F.size(p["short"]) == 0, "other").when((F.size(p["exact"]["missed"]) == 0) & (F.size(p["exact"]["rest"]) == 0), "same")
        .when(F.size(_left(p["exact"]["missed"], p["exact"]["rest"], _close)["missed"]) == 0, "form").otherwise("other"),
    )
