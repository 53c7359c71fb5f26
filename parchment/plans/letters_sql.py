"""The letter fields once more, as DuckDB SQL over a letter's ASCII text t: each rule stated apart from the column expressions, with the same fixed patterns."""

from __future__ import annotations

from parchment import config as c
from parchment import patterns as p
from parchment.plans.settings import SUITED
from parchment.sources import letters as src


def quote(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def listed(items) -> str:
    return "[" + ", ".join(map(quote, items)) + "]"


def rx(value: str, pattern: str) -> str:
    return f"regexp_matches({value}, {quote(pattern)})"


def hit(value: str, pattern: str, group: int = 0) -> str:
    return f"nullif(regexp_extract({value}, {quote(pattern)}, {group}), '')"


def hits(value: str, pattern: str, group: int = 0) -> str:
    return f"regexp_extract_all({value}, {quote(pattern)}, {group})"


def sub(value: str, pattern: str, by: str = "") -> str:
    return f"regexp_replace({value}, {quote(pattern)}, {quote(by)}, 'g')"


def let(value: str, body: str, name: str = "v") -> str:
    """body with name standing for value."""
    return f"list_transform([{value}], lambda {name}: {body})[1]"


def ws(value: str) -> str:
    return f"trim({value}, ' ' || chr(9) || chr(10) || chr(13))"


def lines(value: str) -> str:
    return f"list_filter(list_transform(string_split({value}, chr(10)), lambda l: {ws('l')}), lambda l: l <> '')"


def words(value: str) -> str:
    return f"list_filter(regexp_split_to_array(lower({value}), '\\s+'), lambda w: w <> '')"


_WORDED = lambda xs: "(?i)\\b(?:" + "|".join(xs) + ")\\b"
_CLAUSE, _ROLE = _WORDED(c.CLAUSE_SIGNS), _WORDED(c.ROLE_SIGNS)

# ---------------------------------------------------------------- dates

_LONG_FORMS, _SHORT_FORMS = ["%Y-%m-%d", "%d-%m-%Y", "%d-%B-%Y", "%d-%b-%Y", "%B-%d-%Y", "%b-%d-%Y"], ["%d-%m-%y", "%d-%b-%y"]


def day(token: str) -> str:
    plain = sub(sub(token, r"(?i)([0-9])(?:st|nd|rd|th)\b", r"\1"), r"[-\s,./]+", "-")
    return let(f"trim({plain}, '-')", f"CAST(CASE WHEN regexp_matches(z, '[0-9]{{4}}') THEN try_strptime(z, {listed(_LONG_FORMS)}) ELSE try_strptime(z, {listed(_SHORT_FORMS)}) END AS DATE)", "z")


def near(keyword: str, size: int) -> str:
    return f"CASE WHEN contains(low, {quote(keyword)}) THEN substr(t, instr(low, {quote(keyword)}), {size}) END"


_LABELLED = f"list_filter(list_transform(list_filter(rows[1:20], lambda l: {rx('l', p.DATE_LINE)}), lambda l: {day(hit('l', p.DATE_LINE, 1))}), lambda d: d IS NOT NULL)[1]"
OFFER = f"coalesce({_LABELLED}, {', '.join(day(hit(near(k, 120), p.DATE)) for k in c.OFFER_KEYWORDS)}, {day(hit('substr(t, 1, 500)', p.DATE))})"
_FITS = lambda d: f"({d} IS NOT NULL AND CASE WHEN offer_date IS NOT NULL THEN {d} >= offer_date ELSE year({d}) >= {SUITED.as_of[:4]} - 1 END)"
_NEAR = f"list_min(list_filter(list_transform(flatten([{', '.join(f'coalesce({hits(near(k, 150), p.DATE)}, [])' for k in c.JOINING_KEYWORDS)}]), lambda x: {day('x')}), lambda d: {_FITS('d')}))"
_LABEL = day(hit("t", p.JOINING_LABEL, 1))
JOINING = f"coalesce({let(_LABEL, 'CASE WHEN ' + _FITS('d') + ' THEN d END', 'd')}, {_NEAR})"

# ---------------------------------------------------------------- contacts

_OWN = lambda ms: f"list_filter({ms}, lambda m: NOT list_contains({listed(c.FREE_MAIL)}, lower(split_part(m, '@', 2))))[1]"
_LOOSE = f"list_transform({hits('t', p.EMAIL_PERMISSIVE)}, lambda m: replace(m, ' ', ''))"
FIELDS = {
    "company_email": f"lower(coalesce({_OWN(hits('t', p.EMAIL))}, {_OWN(_LOOSE)}, {hit('t', p.EMAIL)}))",
    "candidate_email": f"lower(coalesce(list_filter({hits('t[1:2000]', p.EMAIL)}, lambda m: list_contains({listed(c.FREE_MAIL)}, lower(split_part(m, '@', 2))))[1], {hit('t[1:500]', p.EMAIL_AFTER_DEAR, 1)}))",
    "website": "coalesce(rtrim(" + hit("t", p.WEBSITE_LABELLED, 1) + ", '.,;'), " + hit("t", p.WEBSITE_BARE) + ", rtrim(" + hit("t", p.WEBSITE_OTHER, 1) + ", '.,;'))",
    "phone": ws(hit("t", p.PHONE)),
    "cin_gst_udyam": f"coalesce({hit('t', p.COMPANY_NUMBER)}, {hit('t', p.TAX_NUMBER)}, upper({hit('t', p.SMALL_FIRM_NUMBER)}))",
}
DOMAIN = (
    f"coalesce(CASE WHEN {rx('split_part(company_email, ' + quote('@') + ', 2)', p.EMAIL_DOMAIN)} THEN split_part(company_email, '@', 2) END, "
    f"{hit('lower(website)', p.SITE_DOMAIN, 1)}, "
    + let("lower(" + hit("t", p.BARE_DOMAIN) + ")", f"CASE WHEN NOT list_contains({listed(c.GENERIC_DOMAINS)}, v) THEN v END") + ")"
)

# ---------------------------------------------------------------- company

_TIDY = lambda x: f"trim({ws(sub(x, r'\s+', ' '))}, '.,;:')"


def is_company(n: str) -> str:
    tests = [
        f"length({n}) BETWEEN 3 AND 80", rx(n, "^[A-Za-z0-9]"), f"{n} <> lower({n})", f"NOT {rx(n, p.COMPANY_SIGNS)}", f"NOT {rx(n, p.COMPANY_STOPS)}", f"NOT {rx(n, p.PIN)}", f"NOT list_contains({listed(c.NOT_COMPANIES)}, lower({n}))",
        f"NOT {rx(n, _WORDED(c.CONTACT_WORDS))}", f"NOT ({rx(n, p.CODE)} AND {rx(n, '[0-9]')})", f"len(list_filter({listed(c.SENTENCE_WORDS)}, lambda s: list_contains({words(n)}, s))) < 2", f"len({words(n)}) <= 6",
        f"NOT (NOT {rx(n, _WORDED(c.SUFFIX_WORDS))} AND list_contains({listed(c.JOB_LEADS)}, {words(n)}[1]))",
    ]
    return "(" + " AND ".join(tests) + ")"


_FIRST = _TIDY(hit("t", p.COMPANY_SIGNED, 1))
_SECOND = f"list_transform(list_filter(rows[1:30], lambda l: {rx('l', p.COMPANY_LINE)} AND NOT {rx('l', p.NOT_COMPANY_LINE)}), lambda l: {_TIDY('l')})"
_THIRD = _TIDY(hit("t", p.COMPANY_LABELLED, 1))
_NUMBER = hit("t", p.COMPANY_BEFORE_NUMBER)
_BEFORE = f"list_reverse({lines(f'substr(t, greatest(instr(t, {_NUMBER}) - 200, 1), least(instr(t, {_NUMBER}) - 1, 200))')})[1:3]"
_FOURTH = f"CASE WHEN {_NUMBER} IS NOT NULL THEN list_filter({_BEFORE}, lambda l: length(l) > 5) ELSE [] END"
_FIFTH = f"list_filter(rows[1:12], lambda l: length(l) BETWEEN 7 AND 69 AND {rx('l', p.COMPANY_TITLE)} AND NOT {rx('l', p.NOT_COMPANY_TITLE)})"
FIELDS["company_name"] = f"{_TIDY(f'list_filter(list_concat([{_FIRST}], {_SECOND}, [{_THIRD}], {_FOURTH}, {_FIFTH}), lambda n: n IS NOT NULL AND {is_company("n")})[1]')}"

# ---------------------------------------------------------------- people and roles


def person(x: str) -> str:
    cut = f"trim({ws(sub(f'split_part({ws(x)}, chr(10), 1)', '(?is)' + _WORDED(c.NAME_LABELS)[4:] + '.*'))}, '.,:-')"
    bad = [rx("p", _ROLE), rx("p", _CLAUSE), rx("p", "[0-9]"), rx("p", _WORDED(c.NAME_SUFFIXES)), f"list_has_any({words('p')}, {listed(c.NOT_NAMES)})"]
    return let(cut, f"CASE WHEN length(p) BETWEEN 3 AND 49 AND NOT ({' OR '.join(bad)}) THEN p END", "p")


def role(x: str) -> str:
    first = f"trim({ws(f'split_part({x}, chr(10), 1)')}, '.,;:')"
    cut = f"trim({ws(sub(first, f'(?is)(?:{p.DESIGNATION_END}).*'))}, '.,;:')"
    return let(cut, f"CASE WHEN length(d) BETWEEN 1 AND 45 AND len({words('d')}) <= 6 AND NOT {rx('d', _CLAUSE)} AND NOT {rx('d', _WORDED(c.ROLE_SUFFIXES))} THEN d END", "d")


_NAMED = [hit("t", p.NAME_AFTER_DEAR, 1), hit("t", p.NAME_LABELLED, 1), hit("t[1:500]", p.NAME_AFTER_TO, 1)]
FIELDS["candidate_name"] = f"coalesce({', '.join(map(person, _NAMED))})"
_CUT = lambda x: f"trim({ws(sub(f'trim({ws(x)}, {quote(".,;:")})', '(?is)' + p.TITLE_END + '.*'))}, '.,;:')"
_TITLE = f"length(v) BETWEEN 3 AND 70 AND NOT list_has_any({words('v')}, {listed(c.NOT_TITLES)}) AND NOT {rx('v', p.TITLE_SIGNS)} AND NOT {rx('v', _CLAUSE)} AND len(list_filter({words('v')}[2:], lambda w: list_contains({listed(c.JOINING_WORDS)}, w))) < 2"
FIELDS["job_title"] = f"list_filter([{', '.join(_CUT(hit('t', '(?i)' + w, 1)) for w in p.TITLES)}], lambda v: v IS NOT NULL AND {_TITLE})[1]"
FIELDS["employment_type"] = "CASE " + " ".join(f"WHEN {rx('lower(t)', w)} THEN {quote(n)}" for w, n in p.EMPLOYMENT_TYPES) + " END"
_PLACE = f"trim({ws(hit('t', p.LOCATION, 1))}, '.,;')"
FIELDS["work_location"] = let(_PLACE, f"CASE WHEN NOT {rx('v', _CLAUSE)} AND len({words('v')}) <= 7 AND length({sub('v', p.NOT_LETTERS)}) >= 3 THEN v END")
_PIN = f"instr(t, regexp_extract(t, {quote(p.PIN)}))"
_PART = lines(f"substr(t, greatest({_PIN} - 250, 1), least({_PIN} - 1, 250) + 10)")
FIELDS["pin_address"] = f"CASE WHEN {rx('t', p.PIN)} THEN array_to_string(list_slice({_PART}, greatest(len({_PART}) - 2, 1), len({_PART})), ', ') END"
FIELDS["offer_date"] = f"CAST({OFFER} AS VARCHAR)"

_TAIL = f"coalesce({hit('t', '(?s)' + p.SIGN_OFF + '.*')}, t[-2500:])"
_TITLED = f"list_filter(list_transform(list_filter(tail_rows[2:10], lambda l: {rx('l', p.SIGNED_NAME)} AND NOT {rx('l', _ROLE)}), lambda l: {person('l')}), lambda x: x IS NOT NULL)[1]"

#: letters with t, its small letters and lines, and the fields of the sign-off, which need several steps.
LETTERS = f"""WITH l0 AS (SELECT *, regexp_replace(full_text, '[^\\x00-\\x7F]', ' ', 'g') AS t FROM ({src.plain(src.LETTERS)}) AS x),
l1 AS (SELECT *, lower(t) AS low, {lines('t')} AS rows, {_TAIL} AS tail, trim({ws(hit('t', p.FOR_COMPANY, 1))}, '.,') AS one, trim({ws(hit('t', p.FOR_COMPANY, 2))}, '.,') AS two FROM l0),
l2 AS (SELECT *, {lines('tail')} AS tail_rows, coalesce({rx('one', _ROLE)}, false) AS is_role FROM l1),
l3 AS (SELECT *, CASE WHEN NOT is_role THEN {person('one')} END AS name1 FROM l2),
l4 AS (SELECT *, CASE WHEN is_role THEN {role('one')} ELSE coalesce({role('two')}, CASE WHEN name1 IS NULL THEN {role('one')} END) END AS role1 FROM l3),
l5 AS (SELECT *, CASE WHEN role1 IS NULL THEN list_position(list_transform(tail_rows, lambda l: {rx('l', p.HR_LABEL)}), true) END AS hr_at FROM l4),
letters AS (SELECT *, coalesce(role1, {role('tail_rows[hr_at]')}, {hit('tail', p.SIGNATORY)}) AS hr_designation, coalesce(name1, CASE WHEN hr_at > 1 THEN {person('tail_rows[hr_at - 1]')} END, {_TITLED}) AS hr_name, lower({hit('tail', p.EMAIL)}) AS hr_email FROM l5)"""
FIELDS |= {n: n for n in ("hr_name", "hr_designation", "hr_email")}

# ---------------------------------------------------------------- salary


def amount(keywords: list[str]) -> str:
    """The first keyword's amount above 100: the first number behind it, times its unit."""
    def one(k: str) -> str:
        value = f"TRY_CAST(replace(regexp_extract(s, {quote(p.AMOUNT)}, 1), ',', '') AS DOUBLE)"
        unit = f"lower(regexp_extract(s, {quote(p.AMOUNT)}, 2))"
        return let(near(k, 180), let(f"{value} * CASE WHEN {unit} LIKE 'l%' THEN 1e5 WHEN {unit} LIKE 'c%' THEN 1e7 ELSE 1 END", "CASE WHEN v > 100 THEN v END"), "s")

    return f"coalesce({', '.join(map(one, keywords))})"


PAY = {n: amount(k) for n, k in c.SALARY_KEYWORDS.items()}
#: Two steps: the amounts as they are found (raw_...), then on their usual periods.
RAW = ", ".join(f"{sql} AS raw_{n}" for n, sql in PAY.items())
_GROSS = "CASE WHEN raw_gross >= 500000 THEN raw_gross / 12 ELSE raw_gross END"
_CTC = f"coalesce(CASE WHEN raw_ctc < 50000 THEN raw_ctc * 12 ELSE raw_ctc END, round(({_GROSS}) * 12, 2))"
SALARY = {"ctc": f"CASE WHEN {_CTC} <= 5e7 THEN {_CTC} END", "gross": f"CASE WHEN {_GROSS} <= 5e7 / 12 THEN {_GROSS} END", "joining_bonus": "raw_joining_bonus"}
SALARY |= {n: f"CASE WHEN raw_{n} >= 500000 THEN raw_{n} / 12 ELSE raw_{n} END" for n in PAY if n not in SALARY}

# ---------------------------------------------------------------- all fields of a letter

_NAMES = {"registration": "cin_gst_udyam", "company_address": "pin_address"}
_PLAIN = ["company_email", "candidate_email", "website", "phone", "registration", "employment_type", "work_location", "company_name", "candidate_name", "job_title", "hr_name", "hr_designation", "hr_email", "company_address"]
_SUM = "coalesce(basic, 0) + coalesce(hra, 0) + coalesce(special, 0) + coalesce(pf_employer, 0) + coalesce(gratuity, 0)"
_LATE = int(SUITED.as_of[:4]) + 2
PROBLEMS = f"""list_filter([CASE WHEN ctc < 20000 THEN 'ctc too low' END, CASE WHEN basic > ctc THEN 'basic above ctc' END, CASE WHEN parts > 100 AND parts > 1.05 * ctc THEN 'components above ctc' END, CASE WHEN joining_date < offer_date THEN 'joining before offer' END,
  CASE WHEN year(offer_date) NOT BETWEEN {SUITED.first_year} AND {_LATE} THEN 'offer year out of range' END, CASE WHEN year(joining_date) NOT BETWEEN {SUITED.first_year} AND {_LATE} THEN 'joining year out of range' END], lambda p: p IS NOT NULL)"""
_HELD = "coalesce(contains(lower(hr_name), lower(candidate_name)), false)"
_WITHOUT = person("regexp_replace(hr_name, '(?i)' || candidate_name, '', 'g')")
EXTRACTED = f"""{LETTERS}, e0 AS (SELECT letter_id, full_text, t, low, {", ".join(f"{FIELDS[_NAMES.get(n, n)]} AS {n}" for n in _PLAIN)}, {OFFER} AS offer_date, {RAW} FROM letters),
e1 AS (SELECT *, {DOMAIN} AS domain, {JOINING} AS joining_date, {", ".join(f"{sql} AS {n}" for n, sql in SALARY.items())} FROM e0),
e2 AS (SELECT * REPLACE (CASE WHEN NOT coalesce(contains(lower(company_name), lower(candidate_name)) OR contains(lower(candidate_name), lower(company_name)), false) THEN company_name END AS company_name, CASE WHEN {_HELD} THEN {_WITHOUT} ELSE hr_name END AS hr_name), {_SUM} AS parts FROM e1),
e3 AS (SELECT * REPLACE (CASE WHEN NOT coalesce(lower(job_title) IN (lower(coalesce(company_name, '')), lower(coalesce(candidate_name, ''))), false) THEN job_title END AS job_title), {PROBLEMS} AS problems FROM e2),
x AS (SELECT *, coalesce(domain, company_email, website) IS NULL OR len(problems) > 0 OR (CASE WHEN company_name IS NOT NULL AND {is_company('company_name')} THEN 1 ELSE 0 END + CASE WHEN candidate_name IS NULL THEN 0 ELSE 1 END
  + CASE WHEN coalesce(offer_date, joining_date) IS NULL THEN 0 ELSE 1 END) < 2 AS low_confidence, low_confidence AS low_,
  len(list_filter({listed(c.RED_PHRASES)}, lambda p: contains(lower(full_text), lower(p)))) > 0 AS red,
  len(list_filter({listed(c.TEMPLATE_ARTIFACTS)}, lambda p: contains(lower(full_text), p))) > 0 OR regexp_matches(full_text, '\\[[A-Z][A-Z\\s]{{2,}}\\]') AS artifact FROM e3)"""
