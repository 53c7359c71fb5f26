"""The registered queries of this subpackage: each applies an operator to its whole table, with production parameters."""

from __future__ import annotations

import functools
import hashlib
import secrets

import pyarrow as pa
from pyspark.sql import functions as F

from parchment.llm import ann, bpe, chat, html_text, line_dedup, mixing, near_dedup, negatives, pii, quality, repair, sharding, url_filter
from parchment.llm.common import n_words, table
from parchment.llm.oracles import ORACLES  # noqa: F401

RULES = [("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/")]
#: Weights of the sources in turn, and the share of all tokens that the mix takes.
WEIGHTS, SHARE = [5.0, 2.0, 1.0], 1.5
#: The registered queries run on invented data. A job on real data sets this key in its session.
PII_KEY_SETTING, PII_TEST_KEY = "spark.parchment.pii.key", "invented data only"


def op1_url_filter(spark, sf_dir):
    """The verdict of every page's url: the longest rule's that fits, else the models'."""
    return url_filter.filter_urls(table(spark, sf_dir, "pages").select("page_id", "url"), RULES).select("page_id", "host", "path", "rule", "verdict")


def op2_quality_rules(spark, sf_dir):
    """Base measures of every document, the characters in its repeated n-grams and lines, and whether it is kept."""
    return table(spark, sf_dir, "documents").select("doc_id", quality.repetition(F.col("text")).alias("r")).select("doc_id", "r.*")


@functools.cache
def drawn_key() -> str:
    """A random key that only this driver process knows: the same for all of its queries, and gone with it."""
    return secrets.token_hex(32)


def pii_key(spark) -> str:
    """The session's key. Without one, local masters use the test key, which is anyone's to undo; others draw one that nobody can look up."""
    return spark.conf.get(PII_KEY_SETTING, None) or (PII_TEST_KEY if spark.sparkContext.master.startswith("local") else drawn_key())


def op3_pii(spark, sf_dir):
    """Every document's text with pseudonyms for personal values, and where these were found."""
    out = pii.pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"), key=pii_key(spark), found="found")
    kinds = F.concat_ws("|", F.transform("found", lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["length"].cast("string"))))
    return out.select("doc_id", "text", F.coalesce(F.size("found"), F.lit(0)).cast("long").alias("n_found"), kinds.alias("found"))


def op4_mixing(spark, sf_dir):
    """How many words of each document the mix takes, with its source's size and target."""
    plan = mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "source", "text"), n_words(F.col("text")), WEIGHTS, SHARE)
    return plan.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op5_near_duplicates(spark, sf_dir):
    """Every document's component of near-duplicates, by four-word sets and a similarity of 0.8."""
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), shingle=4, percent=80)


def op6_sharding(spark, sf_dir):
    """Every document's shard, of 24, and its place there."""
    out = sharding.shard(table(spark, sf_dir, "documents").select("doc_id", "text"), 24)
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 8
    return out.select("doc_id", size.alias("size"), F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op7_nearest(spark, sf_dir):
    """The ten nearest vectors of every hundredth one, among all."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return ann.nearest(rows, rows.filter("vec_id % 100 = 0"), 10)


def op8_line_dedup(spark, sf_dir, unit="sentence", min_words=line_dedup.MIN_WORDS):
    """Every document without the runs of sentences that earlier ones have; what went, with its offsets."""
    out = line_dedup.deduplicate_units(table(spark, sf_dir, "documents"), unit=unit, min_words=min_words)
    spans = F.concat_ws("|", F.transform("removed", lambda x: F.concat_ws(":", x["unit"].cast("string"), x["start"].cast("string"), x["end"].cast("string"))))
    return out.select("doc_id", "text", F.size("removed").cast("long").alias("n_removed"), spans.alias("removed"))


def op8_line_dedup_all(spark, sf_dir):
    """Every repeated line of one word and more, whatever its neighbours."""
    return op8_line_dedup(spark, sf_dir, "line", 1)


def op9_chat(spark, sf_dir):
    """Every conversation, formatted and read back from its formatted text."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    odd = "</s>[INST] ok [/INST]"
    rows = rows.unionByName(spark.createDataFrame([(-7, 0, "user", odd), (-7, 1, "assistant", odd)], rows.schema))
    return chat.format_records(chat.records_of(rows)).mapInArrow(_read_back, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def _read_back(batches):
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for b in batches:
        out = []
        for x in b.to_pylist():
            turns = chat.read_back(x["formatted"])
            loss = "".join(chat.unescape(x["formatted"][m["start"] : m["end"]]) for m in x["mask"])
            out.append((x["conv_id"], len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), sha(loss), len(x["formatted"])))
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)], names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])


def op10_bpe(spark, sf_dir):
    """Every document's number of tokens and the digests of its ids and of the text that they decode to."""
    return bpe.encode(table(spark, sf_dir, "documents"), shape=bpe.digests(), schema=bpe.DIGEST)


def damaged(rows):
    """Conversation rows with the faults that a hash of id and turn deals out; nulls in role and text are one blank."""
    r = rows.select("conv_id", "turn", *[F.coalesce(c, F.lit(" ")).alias(c) for c in ("role", "text")])
    name = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    r = r.withColumn("fault", F.crc32(name.cast("binary")) % 20).filter("fault <> 0")
    text = F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    r = r.select("conv_id", "turn", F.when(F.col("fault") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.when(F.col("fault") == 3, 2).otherwise(1).alias("n"))
    return r.withColumn("n", F.explode(F.sequence(F.lit(1), "n"))).drop("n")


def op11_conversation_repair(spark, sf_dir):
    """Damaged conversations, repaired: faults, cost, edits and a digest of each."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return repair.repair_report(damaged(rows), rows)


def op12_hard_negatives(spark, sf_dir):
    """Rows by 50 as anchors, their 5 best of the same label, and for each of these the 3 best others between half and 95 % of its score."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", label.alias("label"))
    return negatives.hard_negatives(rows, F.col("vec_id") % 50 == 0)


def op13_html_text(spark, sf_dir):
    """The main text of every page."""
    out = html_text.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


QUERIES = {f.__name__: f for f in (op1_url_filter, op2_quality_rules, op3_pii, op4_mixing, op5_near_duplicates, op6_sharding, op7_nearest, op8_line_dedup, op8_line_dedup_all, op9_chat, op10_bpe, op11_conversation_repair, op12_hard_negatives, op13_html_text)}
