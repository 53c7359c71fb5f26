"""Personal data: format-preserving Feistel pseudonyms, in DataFrame functions alone.

Each kind of value is found by one alternation, validated (Luhn, octet and calendar ranges, mod 97), and permuted under
a key inside its own format: digits stay digits, letters stay letters of their case, check digits are made good again,
dates stay dates. The permutation depends on key, kind and format only, so equal values in any documents stay equal and
different values stay different. Texts without a match are passed through as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 8
#: Fixed patterns, one for each kind, in order of precedence.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+\-])[A-Za-z0-9._%+\-]++@[A-Za-z0-9\-]+(?:\.[A-Za-z0-9\-]+)*\.[A-Za-z]{2,}",
    "secret": r"(?<![0-9A-Za-z])(?=[0-9A-Fa-f]*[0-9])[0-9A-Fa-f]{32,64}(?![0-9A-Za-z])",
    "iban": r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}(?![0-9A-Za-z])",
    "date": r"(?<![0-9.\-/])[0-9]{4}-[0-9]{2}-[0-9]{2}(?![0-9.\-/]?[0-9])",
    "ip": r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?!\.?[0-9])",
    "card": r"(?<![0-9A-Za-z])[0-9]{4}(?:[ \-]?[0-9]{4}){2}[ \-]?[0-9]{1,7}(?![0-9A-Za-z])",
    "ssn": r"(?<![0-9\-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9\-])",
    "phone": r"(?<![0-9A-Za-z])(?:\+[0-9]{1,3}[ \-]?)?(?:\([0-9]{3}\) ?|[0-9]{3}[ .\-])[0-9]{3}[ .\-][0-9]{4}(?![0-9A-Za-z])",
}
#: Dates are permuted inside blocks of 72,900 days (of which one begins on 1900-01-01); the first and the last block end
#: where years of four digits do. Each block: first day (0 is 0001-01-01), and two factors of its number of days.
BLOCK_DAYS, FIRST_DAYS, LAST_DAY, DAYS = 72_900, 37_495, 3_609_595, 3_652_059
BLOCK_SIDES = {"first": (5, 7499), "middle": (270, 270), "last": (32, 1327)}


def _cls(c: Column, letters: int) -> tuple[Column, Column]:
    """The first code point and the size of a character's class; size 1 for characters that stay."""
    digit, lower, upper = c.between("0", "9"), c.between("a", "z"), c.between("A", "Z")
    return F.when(digit, 48).when(lower, 97).when(upper, 65).otherwise(0), F.when(digit, 10).when(lower | upper, letters).otherwise(1)


def _turn(half: Column, other: Column, key: str | Column, n: Column, r: Column, hexadecimal: bool, letters: int) -> Column:
    """half with each character turned inside its class, by keyed hashes of the other half, one for each 32 characters."""
    hashed = lambda part: F.sha2(F.concat_ws("|", key if isinstance(key, Column) else F.lit(key), n.cast("string"), r.cast("string"), part.cast("string"), other), 512)
    stream = F.array_join(F.transform(F.sequence(F.lit(0), F.floor(F.length(half) / 32).cast("int")), hashed), "")

    def one(i: Column) -> Column:
        c = F.substring(half, i, F.lit(1))
        step = F.conv(F.substring(stream, i * 4 - 3, F.lit(4)), 16, 10).cast("int")
        if hexadecimal:
            return F.substring(F.lit("0123456789abcdef"), F.pmod(F.instr(F.lit("0123456789abcdef"), c) - 1 + step, F.lit(16)) + 1, F.lit(1))
        base, size = _cls(c, letters)
        return F.when(size == 1, c).otherwise(F.char(base + F.pmod(F.ascii(c) - base + step, size)))

    return F.when(F.length(half) == 0, half).otherwise(F.array_join(F.transform(F.sequence(F.lit(1), F.greatest(F.length(half), F.lit(1))), one), ""))


def feistel(value: Column, key: str | Column, rounds: int = ROUNDS, hexadecimal: bool = False, letters: int = 26) -> Column:
    """A keyed permutation of the strings that have value's length and classes of characters place by place.

    hexadecimal: 0 to 9 and a to f are one class. letters: so many of the alphabet are in use.
    """
    n = F.length(value)
    middle = F.floor(n / 2).cast("int")
    start = F.struct(F.substring(value, F.lit(1), middle).alias("l"), F.substring(value, middle + 1, n).alias("r"))

    def step(state: Column, r: Column) -> Column:
        return F.when(r % 2 == 0, F.struct(state["l"].alias("l"), _turn(state["r"], state["l"], key, n, r, hexadecimal, letters).alias("r"))).otherwise(
            F.struct(_turn(state["l"], state["r"], key, n, r, hexadecimal, letters).alias("l"), state["r"].alias("r"))
        )

    return F.aggregate(F.sequence(F.lit(0), F.lit(rounds - 1)), start, step, lambda s: F.concat(s["l"], s["r"]))


def feistel_number(value: Column, left: int, right: int, key: str, rounds: int = ROUNDS) -> Column:
    """A keyed permutation of the whole numbers from 0 to left * right - 1."""
    start = F.struct(F.floor(value / right).cast("long").alias("l"), F.pmod(value, F.lit(right)).cast("long").alias("r"))

    def noise(r: Column, other: Column) -> Column:
        return F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(key), r.cast("string"), other.cast("string")), 256), 1, 12), 16, 10).cast("long")

    def step(s: Column, r: Column) -> Column:
        return F.when(r % 2 == 0, F.struct(s["l"].alias("l"), F.pmod(s["r"] + noise(r, s["l"]), F.lit(right)).alias("r"))).otherwise(
            F.struct(F.pmod(s["l"] + noise(r, s["r"]), F.lit(left)).alias("l"), s["r"].alias("r"))
        )

    return F.aggregate(F.sequence(F.lit(0), F.lit(rounds - 1)), start, step, lambda s: s["l"] * right + s["r"])


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn_sum(digits: Column, doubled: int) -> Column:
    """Sum of the digits from the right, those at places of parity `doubled` (0: the last) counted twice."""
    places = F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.struct(c.cast("int").alias("c"), i.alias("i")))
    twice = lambda x: F.when(x["i"] % 2 == doubled, x["c"] * 2 - F.when(x["c"] > 4, 9).otherwise(0)).otherwise(x["c"])
    return F.aggregate(places, F.lit(0), lambda a, x: a + twice(x))


def luhn_valid(value: Column) -> Column:
    return (F.length(_digits(value)).between(13, 19)) & (_luhn_sum(_digits(value), 1) % 10 == 0)


def _refill(value: Column, digits: Column) -> Column:
    """value's format with its digits replaced in order."""
    chars = F.split(value, "")
    before = lambda i: F.length(_digits(F.substring(value, F.lit(1), i)))
    return F.array_join(F.transform(chars, lambda c, i: F.when(c.between("0", "9"), F.substring(digits, before(i) + 1, F.lit(1))).otherwise(c)), "")


def card(value: Column, key: str) -> Column:
    d = _digits(value)
    body = feistel(F.substring(d, F.lit(1), F.length(d) - 1), f"{key}|card")
    check = F.pmod(-_luhn_sum(body, 0), F.lit(10)).cast("string")
    return _refill(value, F.concat(body, check))


def _mod97(bban: Column, head: Column) -> Column:
    """The remainder of an IBAN read as a number, letters as 10 to 35."""
    return F.aggregate(
        F.split(F.concat(bban, head), ""), F.lit(0),
        lambda a, c: F.when(c.between("0", "9"), (a * 10 + c.try_cast("int")) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97),
    )


def iban_valid(value: Column) -> Column:
    return _mod97(F.substring(value, F.lit(5), F.length(value)), F.substring(value, 1, 4)) == 1


def iban(value: Column, key: str) -> Column:
    country, body = F.substring(value, 1, 2), feistel(F.substring(value, F.lit(5), F.length(value)), f"{key}|iban")
    return F.concat(country, F.lpad((98 - _mod97(body, F.concat(country, F.lit("00")))).cast("string"), 2, "0"), body)


def _octets(value: Column) -> Column:
    return F.transform(F.split(value, r"\."), lambda o: o.try_cast("int"))


def ip_valid(value: Column) -> Column:
    return F.forall(_octets(value), lambda o: o <= 255)


def ip(value: Column, key: str) -> Column:
    n = feistel_number(F.aggregate(_octets(value), F.lit(0).cast("long"), lambda a, o: a * 256 + o), 65536, 65536, f"{key}|ip")
    return F.concat_ws(".", *[(F.shiftright(n, s).bitwiseAND(F.lit(255))).cast("string") for s in (24, 16, 8, 0)])


def date_valid(value: Column) -> Column:
    return (F.try_to_date(value, "yyyy-MM-dd") >= F.lit("0001-01-01").cast("date")).eqNullSafe(F.lit(True))


def date(value: Column, key: str) -> Column:
    """Days of one block are permuted among themselves, so years keep four digits and most dates stay within 200 years."""
    start = F.lit("0001-01-01").cast("date")
    day = F.datediff(F.try_to_date(value, "yyyy-MM-dd"), start).cast("long")
    middle = F.floor((day - FIRST_DAYS) / BLOCK_DAYS).cast("long") * BLOCK_DAYS + FIRST_DAYS
    new = lambda at, kind: at + feistel_number(day - at, *BLOCK_SIDES[kind], f"{key}|date|{kind}")
    moved = F.when(day < FIRST_DAYS, new(F.lit(0), "first")).when(day >= LAST_DAY, new(F.lit(LAST_DAY), "last")).otherwise(new(middle, "middle"))
    return F.date_format(F.date_add(start, moved.cast("int")), "yyyy-MM-dd")


def ssn_valid(value: Column) -> Column:
    return value.rlike(r"^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}$")


def ssn(value: Column, key: str) -> Column:
    """Areas 001 to 899 but 666, groups 01 to 99, serials 0001 to 9999."""
    area, group, serial = (F.substring(value, a, n).cast("long") for a, n in ((1, 3), (5, 2), (8, 4)))
    n = feistel_number(((area - F.when(area > 666, 2).otherwise(1)) * 99 + group - 1) * 9999 + serial - 1, 898 * 99, 9999, f"{key}|ssn")
    high = F.floor(n / 9999)
    a = F.floor(high / 99)
    two = lambda x, w: F.lpad(x.cast("long").cast("string"), w, "0")
    return F.concat_ws("-", two(a + F.when(a >= 665, 2).otherwise(1), 3), two(high % 99 + 1, 2), two(n % 9999 + 1, 4))


def phone(value: Column, key: str) -> Column:
    """The country code stays; the national number's digits are permuted."""
    head = F.regexp_extract(value, r"^\+[0-9]{1,3}[ \-]?", 0)
    rest = F.substring(value, F.length(head) + 1, F.length(value))
    return F.concat(head, _refill(rest, feistel(_digits(rest), f"{key}|phone")))


def email(value: Column, key: str) -> Column:
    """The mailbox is permuted; the domain, which links documents of one provider, stays."""
    at = F.instr(value, "@")
    return F.concat(feistel(F.substring(value, F.lit(1), at - 1), f"{key}|email"), F.substring(value, at, F.length(value)))


def secret(value: Column, key: str) -> Column:
    """Hexadecimal signs are permuted among the sixteen of the value's case, under a key for each case, so that values
    that differ in case alone are not linked; where both cases occur, digits stay digits and letters keep their case."""
    upper, lower = value.rlike("[A-F]"), value.rlike("[a-f]")
    one_case = feistel(F.lower(value), F.when(upper, F.lit(f"{key}|SECRET")).otherwise(F.lit(f"{key}|secret")), hexadecimal=True)
    return F.when(upper & lower, feistel(value, f"{key}|secret", letters=6)).when(upper, F.upper(one_case)).otherwise(one_case)


def kind_of(value: Column) -> Column:
    """The kind of a match, or null if its numbers are not valid."""
    whole = {k: F.lit(f"^(?:{p})$") for k, p in PATTERNS.items()}
    good = {"iban": iban_valid, "date": date_valid, "ip": ip_valid, "card": luhn_valid, "ssn": ssn_valid}
    out = None
    for k in PATTERNS:
        test = F.regexp_like(value, whole[k])
        test = test & good[k](value) if k in good else test
        out = F.when(test, F.lit(k)) if out is None else out.when(test, F.lit(k))
    return out


def pseudonym(value: Column, kind: Column, key: str) -> Column:
    ways = {"email": email, "secret": secret, "iban": iban, "date": date, "ip": ip, "card": card, "ssn": ssn, "phone": phone}
    out = F.when(kind.isNull(), value)
    for k, way in ways.items():
        out = out.when(kind == k, way(value, key))
    return F.coalesce(out, value)


def pseudonymise(docs: DataFrame, key: str, text: str = "text", found: str | None = None) -> DataFrame:
    """docs with the personal values in text replaced; with found, a column of that name of array<struct<kind, start, length>>.

    Who knows the key can undo every pseudonym, so it has no default: keep it secret, and one for each corpus.
    Offsets are code points in the original text, from 0. A null text stays null and an empty one empty, found is then
    null or empty. Texts of any length are read whole; repeated rows get equal results. A column called like found is
    replaced; all others are kept.
    """
    some_sign = F.col(f"`{text}`").rlike("[0-9@]")  # every kind holds a digit or an @; a text without is not searched
    any_of = F.lit("|".join(f"(?:{p})" for p in PATTERNS.values()))
    t = F.col(f"`{text}`")
    hits = F.regexp_extract_all(t, any_of, F.lit(0))
    between = F.split(t, "|".join(f"(?:{p})" for p in PATTERNS.values()), -1)
    staged = docs.withColumn("__hits", F.when(some_sign, F.transform(hits, lambda v: F.struct(v.alias("value"), kind_of(v).alias("kind")))))
    some = F.coalesce(F.size("__hits"), F.lit(0)) > 0
    new = F.array_join(F.zip_with(between, F.col("__hits"), lambda gap, h: F.concat(gap, F.coalesce(pseudonym(h["value"], h["kind"], key), F.lit("")))), "")
    out = staged.withColumn("__new", F.when(some, new).otherwise(t))
    if found:
        gaps = F.transform(between, lambda g: F.length(g))
        spans = F.aggregate(
            F.zip_with(gaps, F.col("__hits"), lambda g, h: F.struct(g.alias("gap"), h["kind"].alias("kind"), F.coalesce(F.length(h["value"]), F.lit(0)).alias("length"))),
            F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<kind:string,start:int,length:int>>").alias("spans")),
            lambda s, x: F.struct((s["at"] + x["gap"] + x["length"]).alias("at"), F.when(x["kind"].isNotNull(), F.array_append(s["spans"], F.struct(x["kind"].alias("kind"), (s["at"] + x["gap"]).alias("start"), x["length"].alias("length")))).otherwise(s["spans"]).alias("spans")),
            lambda s: s["spans"],
        )
        out = out.withColumn(found, F.when(some, spans).otherwise(F.when(t.isNotNull(), F.array().cast("array<struct<kind:string,start:int,length:int>>"))))
    return out.withColumn(text, F.col("__new")).drop("__hits", "__new")
