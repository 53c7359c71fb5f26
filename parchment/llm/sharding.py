"""Sharding by a hypergeometric communication matrix: a uniform shuffle into shards of exact sizes.

1. Rows fall into partitions by a hash of their content, so that a task that is run again finds the same rows. Rows that
   are equal throughout and very many are counted first and dealt out by copy number, so they fill no partition alone.
2. Given the partitions' counts, the numbers of rows that each sends to each shard are drawn exactly as a uniform shuffle
   has them, from the multivariate hypergeometric law: first for blocks of partitions on the driver (at most BLOCKS rows
   of a matrix), then, one task to a block, for the partitions inside it.
3. A partition permutes its rows by a seeded hash and deals them out by its row of the matrix.
4. A shard permutes what it got by a second hash; the shard's rows are cut into runs, so slots come from the runs' counts
   and no task holds a whole shard.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from parchment.llm.common import HOT, cut

#: Blocks of the first draw; most rows, and bytes of strings, that a partition or a run of a shard holds, about.
BLOCKS, ROWS, BYTES = 256, 10_000, 32 << 20
#: Copies of a frequent row that one task gives out.
COPIES = 1000
_TAILS = 12


def matrix(counts: np.ndarray, totals: np.ndarray, seed) -> np.ndarray:
    """Rows from a multivariate hypergeometric law: row i sums to counts[i], the columns to totals, which have the same sum.

    A count of 0 gives a row of zeros, no counts an array without rows; seed alone decides what is drawn.
    """
    rng, left = np.random.Generator(np.random.PCG64(seed)), totals.astype(np.int64).copy()
    out = np.zeros((len(counts), len(totals)), np.int64)
    for i, n in enumerate(counts):
        rest = int(n)
        for k in range(len(left)):  # column by column, from the conditional law
            behind = int(left[k + 1 :].sum())
            out[i, k] = draw(rng, int(left[k]), behind, rest)
            rest -= int(out[i, k])
        left -= out[i]
    return out


def _small(total: int) -> bool:
    return total < 10**9


def draw(rng, good: int, bad: int, n: int) -> int:
    """The number of good ones among n drawn from good and bad ones, hypergeometric for numbers of any size.

    numpy draws up to 10**9. Beyond, the law is inverted: its probabilities relative to the mode are products of exact
    ratios of neighbours, summed over the whole support or, where that is wider, over _TAILS standard deviations to both
    sides, outside of which lies a mass of less than 1e-30.
    """
    if n == 0 or good == 0:
        return 0
    if bad == 0:
        return n
    if _small(good + bad):
        return int(rng.hypergeometric(good, bad, n))
    total = good + bad
    mode = (n + 1) * (good + 1) // (total + 2)
    spread = int(_TAILS * (n * (good / total) * (bad / total) * ((total - n) / (total - 1))) ** 0.5) + 20
    low, high = max(0, n - bad, mode - spread), min(n, good, mode + spread)
    k = np.arange(low, high, dtype=np.float64)  # from k to k + 1
    ratio = np.log((good - k) / (k + 1)) + np.log((n - k) / (bad - n + k + 1))
    logs = np.concatenate([[0.0], np.cumsum(ratio)])
    mass = np.cumsum(np.exp(logs - logs[mode - low]))
    return low + int(np.searchsorted(mass, rng.random() * mass[-1], side="right"))


def _copies(docs: DataFrame, seed: int, rows: int) -> DataFrame:
    """docs with __h: a hash of the content and, for rows that hold more than 1 / HOT of the table, of a copy number."""
    columns = [F.col(f"`{c}`") for c in docs.columns]
    hashed = docs.withColumn("__h", F.xxhash64(F.lit(seed), *columns))
    many = hashed.groupBy("__h").agg(F.count("*").alias("__n")).filter(F.col("__n") > max(ROWS, rows // HOT)).select(F.col("__h").alias("__hot"))  # fewer than HOT
    if many.isEmpty():
        return hashed
    many = F.broadcast(cut(many))
    apart = hashed.join(many, F.col("__h") == F.col("__hot"), "left_semi").groupBy(*columns, "__h").agg(F.count("*").alias("__n"))
    part = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("__n") - 1) / COPIES)))
    apart = apart.withColumn("__part", part).repartition("__h", "__part")
    copy = F.explode(F.sequence(F.col("__part") * COPIES, F.least(F.col("__part") * COPIES + COPIES, F.col("__n")) - 1))
    apart = apart.withColumn("__copy", copy).withColumn("__h", F.xxhash64(F.lit(seed), "__h", "__copy"))
    return hashed.join(many, F.col("__h") == F.col("__hot"), "left_anti").unionByName(apart.select(*columns, "__h"))


def shard(docs: DataFrame, shards: int, seed: int = 1, names: tuple[str, str] = ("shard", "slot")) -> DataFrame:
    """docs' rows and columns with two more: the shard (0 to shards - 1) and the slot in it, gapless from 0.

    Shards' sizes differ by one row at most, the first ones are the larger. Equal rows are dealt out like any others, as
    are nulls and long texts. The same rows give the same result whatever their partitions, up to the order among rows
    that are equal throughout. Columns that are already called like the new ones are replaced. An empty table gives an
    empty one.
    """
    shard_, slot = names
    docs = docs.drop(shard_, slot)
    strings = [F.coalesce(F.octet_length(F.col(f"`{f.name}`")), F.lit(0)) for f in docs.schema if f.dataType.typeName() in ("string", "binary")]
    rows, size = docs.agg(F.count("*"), F.sum(sum(strings, F.lit(0)).cast("long"))).first()
    parts = max(1, -(-rows // ROWS), -(-(size or 0) // BYTES))
    per_block = -(-parts // BLOCKS)
    keyed = _copies(docs, seed, rows).withColumn("__part", F.pmod(F.xxhash64(F.lit("part"), "__h"), F.lit(parts)))
    counts = cut(keyed.groupBy("__part").agg(F.count("*").alias("n")))
    blocks = {int(b): int(n) for b, n in counts.groupBy(F.floor(F.col("__part") / per_block).alias("b")).agg(F.sum("n")).collect()}  # at most BLOCKS rows
    total = np.full(shards, rows // shards) + (np.arange(shards) < rows % shards)
    order = sorted(blocks)
    drawn = {b: row.tolist() for b, row in zip(order, matrix(np.array([blocks[b] for b in order]), total, (seed, 0)), strict=True)}

    def inside(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("__part")
        block = int(pdf["__part"].iloc[0]) // per_block
        ends = np.cumsum(matrix(pdf["n"].to_numpy(), np.array(drawn[block]), (seed, 1, block)), axis=1)
        return pd.DataFrame({"__p": pdf["__part"].to_numpy(), "__ends": list(ends)})

    dealt = counts.groupBy(F.floor(F.col("__part") / per_block)).applyInPandas(inside, "__p long, __ends array<long>")
    rank = F.row_number().over(W.partitionBy("__part").orderBy(F.xxhash64(F.lit("order"), "__h"), "__h"))
    local = keyed.withColumn("__rank", rank).join(dealt, F.col("__part") == F.col("__p"))
    sent = local.withColumn(shard_, F.size(F.filter("__ends", lambda e: e < F.col("__rank"))))
    runs = max(1, -(-parts // shards))
    again = F.xxhash64(F.lit("slot"), "__h", "__rank", "__part")
    sent = sent.drop("__p", "__ends").withColumn("__again", again).withColumn("__run", F.pmod(F.shiftrightunsigned("__again", 32), F.lit(runs)))
    if runs == 1:
        own = W.partitionBy(shard_).orderBy("__again", "__h")
        return sent.withColumn(slot, (F.row_number().over(own) - 1).cast("long")).drop("__h", "__part", "__rank", "__again", "__run")
    held = sent.groupBy(F.col(shard_).alias("__s"), F.col("__run").alias("__r")).agg(F.count("*").alias("n"))
    before = W.partitionBy("__s").orderBy("__r").rowsBetween(W.unboundedPreceding, -1)
    held = held.select("__s", "__r", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__at"))
    own = W.partitionBy(shard_, "__run").orderBy("__again", "__h")
    out = sent.withColumn("__n", F.row_number().over(own)).join(held, (F.col(shard_) == F.col("__s")) & (F.col("__run") == F.col("__r")))
    return out.withColumn(slot, (F.col("__at") + F.col("__n") - 1).cast("long")).drop("__h", "__part", "__rank", "__again", "__run", "__s", "__r", "__at", "__n")
