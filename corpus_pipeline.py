"""A training-data pipeline over documents: five stages, each of which reads the rows that the one before it left.

quality rules, near-duplicates (one document of each group stays), pseudonyms for personal data, mixing sources to target
weights, BPE encoding. All but the last return the columns of documents; the last returns ids' counts and digests.

Each stage takes texts of any length whole, hands on columns that it does not know, and gives no rows for none.
"""

from pyspark.sql import functions as F

from parchment.llm import bpe, mixing, near_dedup, pii, quality
from parchment.llm.common import cut, n_words, table
from parchment.llm.queries import SHARE, WEIGHTS, pii_key


def keep_good(spark, docs, sf_dir):
    """Documents that the repetition rules reject go; a null, empty or very short text is one of them. Repeated rows share one verdict."""
    return quality.quality_filter(docs)


def keep_one_of_each(spark, docs, sf_dir):
    """Of documents that are near-duplicates (five words, 0.8) the one with the smallest id stays; of rows equal in id and text, one.

    Rows without an id stay, as do those whose text has no word.
    """
    return near_dedup.deduplicate(docs)


def hide_personal(spark, docs, sf_dir):
    """Personal values become pseudonyms of their format; n_chars follows the text. Null and empty texts stay what they are."""
    out = pii.pseudonymise(docs, key=pii_key(spark))
    return out.withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), F.length("text").cast("long")))


def mix_sources(spark, docs, sf_dir):
    """Each document as many times as the mix takes it; documents without a word are taken by none. A null source is one of its own."""
    return mixing.mixed(docs, n_words(F.col("text")), WEIGHTS, SHARE)


def encode(spark, docs, sf_dir):
    """Per row of the mix: number and digests of its ids. A null text counts as an empty one, which has no ids."""
    return bpe.encode(docs, shape=bpe.digests(), schema=bpe.DIGEST)


STAGES = [("quality rules", keep_good), ("near-duplicates", keep_one_of_each), ("personal data", hide_personal), ("mixing", mix_sources), ("encoding", encode)]

#: Signatures, entropy balancing and BPE are beyond SQL; tests/llm/test_pipeline.py holds run() against plain versions.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs if k == 0 else cut(docs), sf_dir)
    return docs
