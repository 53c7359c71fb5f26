"""Facts by domain and company: normalisation, lookup joins, ordered evidence, and what is still to be looked up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from parchment.config import FREE_MAIL, NOT_IN_DOMAINS
from parchment.functions.text import blank_to_null

TLDS = [".com", ".in", ".co.in", ".org", ".net"]


def normal_domain(c: Column) -> Column:
    """Scheme, www and everything after the host removed, lower-cased; null unless it looks like a domain."""
    host = F.regexp_replace(F.regexp_replace(F.lower(F.trim(c)), r"^[a-z]+://", ""), r"^www\.|[/?#:].*$", "")
    return F.when(host.rlike(r"^[a-z0-9]([a-z0-9\-]*[a-z0-9])?(\.[a-z0-9\-]+)+$"), host)


def join_dns(letters: DataFrame, facts: DataFrame) -> DataFrame:
    """letters with the facts of their domain; a domain without facts counts as a failed lookup, no domain as invalid."""
    out = letters.join(facts, "domain", "left")
    none = F.col("domain").isNull()
    return out.withColumn("lookup_error", F.when(none, F.lit(False)).otherwise(F.coalesce("lookup_error", F.lit(True)))).withColumn("dns_valid", F.coalesce("dns_valid", F.lit(False)))


def missing(letters: DataFrame, facts: DataFrame) -> DataFrame:
    """The distinct domains that no fact covers: one lookup for each, however many letters name it."""
    return letters.select("domain").filter("domain is not null").distinct().join(facts.select("domain"), "domain", "left_anti")


METHODS = ["website", "encyclopedia", "search", "guess"]
_SAID = {"website": "direct fetch of ", "encyclopedia": "Wikipedia", "search": "DuckDuckGo", "guess": "DNS-guess"}


def dns_note(df: DataFrame) -> DataFrame:
    """df of (domain as written, a_answer, mx_answer, n_mx, message) with domain, dns_valid, mx, lookup_error and note.

    The answers are ok, nxdomain, noanswer or error. An answer that is not that the domain does not exist makes it valid;
    an error says nothing.
    """
    domain = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.lower(F.trim("domain")), "^https?://", ""), r"^www\.", ""), "/+$", "")
    df = df.withColumn("domain", blank_to_null(domain))
    none, good = F.col("domain").isNull(), F.coalesce(F.col("domain").rlike(r"^[a-z0-9][a-z0-9.\-]*\.[a-z]{2,}$"), F.lit(False))
    a, mx = F.col("a_answer"), F.col("mx_answer")
    first = F.when(a == "ok", "domain resolves (A record OK)").when(a == "nxdomain", "domain does not exist (NXDOMAIN)").when(a == "noanswer", "domain exists (no A record, but not NXDOMAIN)")
    first = first.otherwise(F.concat(F.lit("A record lookup failed (system error): "), F.substring(F.coalesce("message", F.lit("")), 1, 80)))
    second = F.when((mx == "ok") & (F.col("n_mx") > 0), F.concat(F.col("n_mx").cast("string"), F.lit(" MX record(s) found"))).when(mx == "ok", "no MX records").when(mx == "nxdomain", "domain does not exist (MX NXDOMAIN)")
    second = second.when(mx == "noanswer", "no MX records — company likely uses Gmail/Office365").otherwise("MX lookup failed (may use Gmail/Office365)")
    note = F.when(none, "No domain provided").when(~good, F.concat(F.lit("Invalid domain format: "), F.col("domain"))).otherwise(F.concat_ws(" | ", first, second))
    known = good & F.coalesce(a.isin("ok", "noanswer"), F.lit(False))
    failed = good & ~F.coalesce(a.isin("ok", "noanswer", "nxdomain"), F.lit(False))
    return df.withColumns({"dns_valid": known, "mx": good & F.coalesce((mx == "ok") & (F.col("n_mx") > 0), F.lit(False)), "lookup_error": failed, "note": note})


def online(evidence: DataFrame) -> DataFrame:
    """(key, found, method, checked, note) from (key, company_name, domain, method, hit, error, note): one row for each method tried.

    Methods count in the order of METHODS and end at the first hit; a website needs a domain that is no mail provider's,
    the others a company's name. Without a hit, checked tells whether a method other than a guess came to a clean answer.
    """
    place = F.array_position(F.array(*[F.lit(m) for m in METHODS]), F.col("method"))
    name, domain = blank_to_null(F.trim("company_name")), blank_to_null(F.trim("domain"))
    free = F.coalesce(F.lower(domain).isin(FREE_MAIL), F.lit(False))
    runs = F.when(F.col("method") == "website", domain.isNotNull() & ~free).otherwise(name.isNotNull())
    tried = F.when(runs, F.struct(place.alias("place"), "method", F.coalesce("hit", F.lit(False)).alias("hit"), F.coalesce("error", F.lit(False)).alias("error"), "note"))
    by = evidence.withColumn("name", name).withColumn("site", domain).groupBy("key").agg(F.max("name").alias("name"), F.max("site").alias("site"), F.array_sort(F.collect_list(tried)).alias("tried"))
    hit = F.try_element_at(F.filter("tried", lambda t: t["hit"]), F.lit(1))
    real = F.filter("tried", lambda t: t["method"] != "guess")
    errors = F.filter(real, lambda t: t["error"])
    nothing = F.col("name").isNull() & F.col("site").isNull()
    by = by.withColumns({"hit": hit, "clean": F.size(real) - F.size(errors)})
    checked = nothing | F.col("hit").isNotNull() | (F.col("clean") >= 1)
    label = F.coalesce("name", "site", F.lit("unknown"))
    names = F.transform("tried", lambda t: F.when(t["method"] == "website", F.concat(F.lit(_SAID["website"]), F.col("site"))).when(t["method"] == "encyclopedia", _SAID["encyclopedia"]).when(t["method"] == "search", _SAID["search"]).otherwise(_SAID["guess"]))
    blocked = F.concat(F.lit("Online check could NOT complete for '"), label, F.lit("' — all "), F.size("tried").cast("string"), F.lit(" attempt(s) hit network/system errors: "), F.array_join(F.slice(F.transform(errors, lambda t: t["note"]), 1, 3), "; "))
    absent = F.concat(F.lit("No online presence for '"), label, F.lit("' — tried: "), F.coalesce(blank_to_null(F.array_join(names, ", ")), F.lit("nothing")))
    note = F.when(nothing, "No company name or domain to check").when(F.col("hit").isNotNull(), F.col("hit.note")).when(~checked & (F.size("tried") > 0), blocked).otherwise(absent)
    return by.select("key", F.col("hit").isNotNull().alias("found"), F.col("hit.method").alias("method"), checked.alias("checked"), note.alias("note"))


#: A page of more characters than that is a site, and not a parking page; titles of a search that are looked at.
SITE_CHARS, TITLES_TRIED = 1500, 3


def website_decisions(attempts: DataFrame) -> DataFrame:
    """(domain, hit, error, note) from stored attempts (domain, rank, url, status, n_chars, failure).

    failure is null for an answer, tls for a handshake that failed, else whatever kept the server from being reached. Attempts count
    in order of rank: the first that answered 200 with more than SITE_CHARS characters is the hit. A failed handshake shows
    that there is a server; a domain of which no attempt came that far is unreachable, which is an error and no finding.
    """
    live = F.col("failure").isNull() & (F.col("status") == 200) & (F.col("n_chars") > SITE_CHARS)
    reached = F.col("failure").isNull() | (F.col("failure") == "tls")
    by = attempts.filter("domain IS NOT NULL").groupBy("domain").agg(F.min(F.when(live, F.struct("rank", "url", "n_chars"))).alias("live"), F.coalesce(F.bool_or(reached), F.lit(False)).alias("reached"))
    hit = F.col("live").isNotNull()
    said = F.concat(F.lit("Live website at "), F.col("live.url"), F.lit(" (HTTP 200, "), F.floor(F.col("live.n_chars") / 1024).cast("string"), F.lit(" KB)"))
    return by.select("domain", hit.alias("hit"), (~hit & ~F.col("reached")).alias("error"), F.when(hit, said).when(~F.col("reached"), F.concat("domain", F.lit(" unreachable"))).alias("note"))


def encyclopedia_decisions(summaries: DataFrame, titles: DataFrame) -> DataFrame:
    """(company_name, hit, error, note) from stored summaries (company_name, type, title, failed) and found titles (company_name, rank, title).

    A summary of type standard is the hit. Else the first of the TITLES_TRIED best titles that holds the name, or that the
    name holds, case aside. A failed request is an error, without a hit only.
    """
    low, name = F.lower(F.coalesce("title", F.lit(""))), F.lower("company_name")
    both = titles.filter(F.col("rank").between(1, TITLES_TRIED) & (F.contains(low, name) | F.contains(name, low)))
    best = both.groupBy("company_name").agg(F.min_by("title", F.struct("rank", "title")).alias("found"), F.count("*").alias("n"))
    s = summaries.groupBy("company_name").agg(F.min(F.when(F.col("type") == "standard", F.coalesce("title", F.lit("")))).alias("entry"), F.coalesce(F.bool_or("failed"), F.lit(False)).alias("failed"))
    all_ = s.join(best, "company_name", "full")
    hit = F.col("entry").isNotNull() | (F.col("n") > 0)
    note = F.when(F.col("entry").isNotNull(), F.concat(F.lit("Wikipedia entry: "), F.col("entry"))).when(F.col("n") > 0, F.concat(F.lit("Wikipedia search match: "), F.coalesce("found", F.lit("None")))).when(F.col("failed"), "Wikipedia request error")
    return all_.select("company_name", F.coalesce(hit, F.lit(False)).alias("hit"), (~F.coalesce(hit, F.lit(False)) & F.coalesce("failed", F.lit(False))).alias("error"), note.alias("note"))


def decide(companies: DataFrame, attempts: DataFrame, summaries: DataFrame, titles: DataFrame) -> DataFrame:
    """online()'s rows for (key, company_name, domain), decided from what was stored of each request; see the two above."""
    site = blank_to_null(F.regexp_replace(F.lower(F.trim("domain")), r"^www\.", ""))
    c = companies.withColumn("domain", site)
    web = c.join(website_decisions(attempts), "domain", "left").select("key", "company_name", "domain", F.lit("website").alias("method"), "hit", "error", "note")
    wiki = c.join(encyclopedia_decisions(summaries, titles), "company_name", "left").select("key", "company_name", "domain", F.lit("encyclopedia").alias("method"), "hit", "error", "note")
    return online(web.unionByName(wiki))


def search_hit(html: Column, company: Column) -> Column:
    """struct<found, n_results>: whether a page of search results is long enough, names the company and has two result links or more."""
    low = F.lower(html)
    n = F.regexp_count(low, F.lit('class="result__a"')) + F.regexp_count(low, F.lit("result__url"))
    found = (F.length(html) > 3000) & F.contains(low, F.lower(company)) & (n >= 2)
    return F.struct(F.coalesce(found, F.lit(False)).alias("found"), n.alias("n_results"))


def guesses(companies: DataFrame, facts: DataFrame, name: str = "company_name") -> DataFrame:
    """The first guessed domain of each company that resolves, in the order of TLDS."""
    stem = F.regexp_replace(F.regexp_replace(F.lower(name), rf"\b(?:{'|'.join(NOT_IN_DOMAINS)})\b", ""), "[^a-z0-9]", "")
    rows = companies.select(name).distinct().withColumn("stem", blank_to_null(stem)).filter("stem is not null")
    rows = rows.select(name, "stem", F.posexplode(F.array(*[F.lit(t) for t in TLDS])).alias("rank", "tld")).withColumn("domain", F.concat("stem", "tld"))
    found = rows.join(facts.filter("dns_valid").select("domain"), "domain")
    return found.withColumn("n", F.row_number().over(W.partitionBy(name).orderBy("rank"))).filter("n = 1").select(name, "domain")


def rescue(letters: DataFrame, answers: DataFrame, facts: DataFrame) -> DataFrame:
    """Fills a missing domain from the scorer's answer, (letter_id, found_domain), and joins the facts of the domain that results.

    Only the domain and its facts change; what was derived before the rescue stays as it was.
    """
    out = letters.join(answers, "letter_id", "left").withColumn("rescued", F.col("domain").isNull() & F.col("found_domain").isNotNull())
    return join_dns(out.withColumn("domain", F.coalesce("domain", "found_domain")).drop("found_domain"), facts)
