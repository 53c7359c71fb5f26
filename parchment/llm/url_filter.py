"""URL filter: rules first, then the ratio of two character language models, in DataFrame functions alone.

The URLs that a rule decides train the models, one on the accepted and one on the blocked: counts of characters after
contexts of up to ORDER - 1 characters, every context length interpolated with the next shorter one (Witten-Bell: a
context gives the shorter one as much weight as it has had different successors), so a context's length is as much as the
data support. A URL's text is everything after ://; its score is the mean, over its characters, of the difference of the
two log-likelihoods. The limit is a quantile of the scores of accepted URLs under models that have not seen their hosts
(hosts are dealt into folds, and each fold is scored by models of the others), so that a stated share of good URLs passes.
Counts and scores are joins and sums over n-grams; all labelled URLs train the final models, all URLs are scored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parchment.llm.common import ascii_lower, cut, hot_keys, spread_join

ORDER, ALPHABET = 5, 256
#: The share of held-out accepted URLs that may score above the limit; one fold of hosts of FOLDS is held out at a time.
ALLOWED, FOLDS = 0.01, 5
#: Contexts of less than two characters are few and each holds many rows: those are dealt over so many parts.
PARTS = 32
#: Distinct texts in a task that counts their n-grams, about.
TEXTS = 2000
#: The number of the models that all labelled URLs train; others are called by the fold that they leave out.
FINAL = -1


def split_url(url: Column) -> tuple[Column, Column]:
    """Host and path: see op1's contract. Both empty for null and for texts without ://"""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    host = F.coalesce(ascii_lower(F.regexp_extract(rest, r"^[^/?#]*", 0)), F.lit(""))
    return host, F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def decide(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """struct<n, rule, verdict> of the longest rule that fits, or null. rules: (verdict, host followed by path prefix)."""
    if not rules:
        return F.lit(None).cast("struct<n:int,rule:string,verdict:string>")
    fits = []
    for verdict, rule in rules:
        name, slash, prefix = rule.partition("/")
        test = ((host == name) | host.endswith(f".{name}")) & path.startswith(slash + prefix)
        fits.append(F.when(test, F.struct(F.lit(len(rule)).alias("n"), F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))))
    return F.array_max(F.array_compact(F.array(*fits)))


def grams(text: Column, order: int = ORDER) -> Column:
    """One n-gram for each character of the text and its end, the text's start padded."""
    padded = F.concat(F.lit("\x02" * (order - 1)), text, F.lit("\x03"))
    return F.transform(F.sequence(F.lit(1), F.length(text) + 1), lambda i: F.substring(padded, i, F.lit(order)))


def _suffixes(df: DataFrame, order: int) -> DataFrame:
    """One row for each suffix length k of gram: the suffix, and its context without the last character."""
    k = F.explode(F.sequence(F.lit(1), F.lit(order)))
    df = df.withColumn("k", k).withColumn("part", F.substring("gram", order - F.col("k") + 1, F.col("k")))
    return df.withColumn("context", F.substring("part", F.lit(1), F.col("k") - 1))


def models(labelled: DataFrame, order: int = ORDER, by: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """(parts, contexts) of both models from (text, bad): counts by suffix, and by context its count and successors.

    by: columns of labelled; each of their values has models of its own.
    """
    seen = labelled.select(*by, "bad", F.explode(grams(F.col("text"), order)).alias("gram")).groupBy(*by, "bad", "gram").agg(F.count("*").alias("n"))
    of = lambda bad: F.sum(F.when(F.col("bad") == F.lit(bad), F.col("n")).otherwise(0))
    parts = cut(_suffixes(seen, order).groupBy(*by, "k", "part", "context").agg(of(True).alias("n_bad"), of(False).alias("n_good")))
    kinds = lambda c: F.sum(F.when(F.col(c) > 0, 1).otherwise(0))
    contexts = parts.groupBy(*by, "k", "context").agg(F.sum("n_bad").alias("c_bad"), F.sum("n_good").alias("c_good"), kinds("n_bad").alias("t_bad"), kinds("n_good").alias("t_good"))
    return parts.select(*by, "k", "part", "n_bad", "n_good"), contexts


def gram_scores(wanted: DataFrame, parts: DataFrame, contexts: DataFrame, order: int = ORDER, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, gram, ratio): log P(last character | the others) under the model of the blocked, less that of the accepted."""
    dealt = F.when(F.col("k") <= 2, F.pmod(F.xxhash64("gram"), F.lit(PARTS))).otherwise(0).cast("int")
    every = F.explode(F.when(F.col("k") <= 2, F.sequence(F.lit(0), F.lit(PARTS - 1))).otherwise(F.array(F.lit(0))))
    contexts, parts = (df.withColumn("deal", every) for df in (contexts, parts))
    rows = _suffixes(wanted, order).withColumn("deal", dealt).join(contexts, [*by, "k", "context", "deal"], "left").join(parts, [*by, "k", "part", "deal"], "left")
    names = ["n_bad", "n_good", "c_bad", "c_good", "t_bad", "t_good"]
    levels = rows.groupBy(*by, "gram").agg(F.sort_array(F.collect_list(F.struct("k", *[F.coalesce(F.col(c), F.lit(0)).alias(c) for c in names]))).alias("levels"))  # order rows for each gram

    def step(p: Column, x: Column, kind: str) -> Column:
        c, t, n = x[f"c_{kind}"], x[f"t_{kind}"], x[f"n_{kind}"]
        return F.when(c > 0, (n + t * p) / (c + t)).otherwise(p)

    start = F.struct(F.lit(1.0 / ALPHABET).alias("bad"), F.lit(1.0 / ALPHABET).alias("good"))
    both = F.aggregate("levels", start, lambda p, x: F.struct(step(p["bad"], x, "bad").alias("bad"), step(p["good"], x, "good").alias("good")), lambda p: F.log(p["bad"]) - F.log(p["good"]))
    return levels.select(*by, "gram", both.alias("ratio"))


def filter_urls(pages: DataFrame, rules: list[tuple[str, str]], url: str = "url", order: int = ORDER, allowed: float = ALLOWED) -> DataFrame:
    """pages with host, path, rule, verdict, score and limit; columns already called so are replaced.

    verdict is the rule's, else block where score > limit, else allow. score is null without :// or a character after
    it; such URLs are allowed. With no accepted or no blocked URLs to learn from, none is blocked but by rules, and limit
    is null. Folds that hold all accepted or all blocked URLs say nothing about the limit; without others it is 0. Equal
    URLs get equal results, however often they come; URLs of any length are read whole. An empty table gives an empty one.
    """
    pages = pages.drop("host", "path", "rule", "verdict", "score", "limit")
    host, path = split_url(F.col(url))
    known = pages.withColumn("host", host).withColumn("path", path).withColumn("__fit", decide(F.col("host"), F.col("path"), rules))
    rest = F.regexp_extract(F.substring(F.col(url), F.instr(url, "://") + 3, F.length(url)), r"^[^/?#]*((?s:.*))", 1)
    known = known.withColumn("__text", F.concat("host", F.when(F.instr(url, "://") > 0, rest).otherwise("")))
    texts = cut(known.filter("__text <> ''").groupBy("__text").agg(F.first("host").alias("host"), F.max("__fit.verdict").alias("label"), F.count("*").alias("n")).withColumnRenamed("__text", "text"))
    texts = texts.repartition(max(1, -(-texts.count() // TEXTS)), "text")
    fold = F.pmod(F.xxhash64("host"), F.lit(FOLDS)).cast("int")
    labelled = texts.filter("label is not null").select("text", (F.col("label") == "block").alias("bad"), fold.alias("fold"))
    every = F.sequence(F.lit(FINAL), F.lit(FOLDS - 1))
    parts, contexts = models(labelled.withColumn("model", F.explode(F.filter(every, lambda m: m != F.col("fold")))), order, ("model",))
    judged = texts.select("text", F.lit(FINAL).alias("model")).unionByName(labelled.filter("not bad").select("text", F.col("fold").alias("model")))
    all_grams = judged.select("text", "model", F.explode(grams(F.col("text"), order)).alias("gram"))
    counted = cut(all_grams.groupBy("model", "gram").agg(F.count("*").alias("n")))
    ratios = gram_scores(counted.select("model", "gram"), parts, contexts, order, ("model",))
    # Some n-grams, such as the first letters of common hosts, are in a good part of all texts: these are dealt over several tasks.
    key = F.concat(F.col("model").cast("string"), F.lit(":"), F.col("gram")).alias("key")
    hot = hot_keys(counted.select(key, "n"), "key")
    joined = spread_join(all_grams.select("text", "model", key), ratios.select(key, "ratio"), "key", hot, ["text"])
    judged = cut(joined.groupBy("text", "model").agg(F.avg("ratio").alias("score")))
    able = {r["model"] for r in parts.filter("k = 1").groupBy("model").agg(F.sum("n_bad").alias("bad"), F.sum("n_good").alias("good")).filter("bad > 0 and good > 0").collect()}
    held = judged.filter(F.col("model").isin(sorted(able - {FINAL})))
    limit = held.agg(F.percentile_approx("score", 1 - allowed, 100_000)).first()[0] if FINAL in able else None
    limit = None if FINAL not in able else 0.0 if limit is None else max(0.0, float(limit))
    scored = judged.filter(F.col("model") == FINAL).select("text", "score")
    # rows without a text find nothing; a hash of theirs keeps them from sharing one key
    none = F.when(F.col("__text") == "", F.xxhash64(*[F.col(f"`{c}`") for c in pages.columns])).otherwise(0)
    scored = scored.select(F.col("text").alias("__t"), "score", F.lit(0).cast("long").alias("__none"))
    out = known.withColumn("__row", none).join(scored, (F.col("__text") == F.col("__t")) & (F.col("__row") == F.col("__none")), "left").withColumn("limit", F.lit(limit).cast("double"))
    verdict = F.coalesce(F.col("__fit.verdict"), F.when(F.col("score") > F.col("limit"), F.lit("block")).otherwise(F.lit("allow")))
    return out.withColumn("rule", F.col("__fit.rule")).withColumn("verdict", verdict).select(*[F.col(f"`{c}`") for c in pages.columns], "host", "path", "rule", "verdict", "score", "limit")
