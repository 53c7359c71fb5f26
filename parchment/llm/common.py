"""Shared pieces of the training-data operators: lineage cuts, Arrow runs, word hashes, connected components."""

from __future__ import annotations

import re
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: One word of a text, as a Java regular expression: everything but blank and the controls 09 to 0D.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """Materialise df in the shared checkpoint folder that the session names.

    Where it names none, a local session gets a folder of its own; on a cluster that folder would be out of the
    executors' reach, so there it is an error.
    """
    sc = df.sparkSession.sparkContext
    if df.sparkSession.conf.get("spark.checkpoint.dir", None) is None and sc._jsc.sc().getCheckpointDir().isEmpty():
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    return df.checkpoint(eager=True)


# ---------------------------------------------------------------- joins on keys of which one may hold much of the rows

#: A key is hot with more than 1 / HOT of all rows, so there are fewer than HOT hot keys, whatever the input.
HOT = 1000


def hot_keys(counts: DataFrame, key: str, n: str = "n") -> DataFrame:
    """(key, parts) for the keys that hold more than 1 / HOT of the sum of n: so many parts that each is about that size."""
    total = counts.agg(F.sum(n)).first()[0] or 0
    return counts.filter(F.col(n) * HOT > F.lit(total)).select(key, F.ceil(F.col(n) * HOT / F.lit(max(1, total))).cast("int").alias("parts"))


def spread_join(left: DataFrame, right: DataFrame, key: str, hot: DataFrame, by: list[str]) -> DataFrame:
    """left joined with right (one row for each key) on key, where a hot key's rows are dealt over its parts by a hash.

    hot comes from hot_keys() and has fewer than HOT rows, so it may be broadcast.
    """
    small = F.broadcast(hot.withColumnRenamed(key, "__hot"))
    parts = F.coalesce("parts", F.lit(1))
    a = left.join(small, F.col(key) == F.col("__hot"), "left").withColumn("__part", F.pmod(F.xxhash64(*by), parts).cast("int")).drop("__hot", "parts")
    b = right.join(small, F.col(key) == F.col("__hot"), "left").withColumn("__part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("__hot", "parts")
    return a.join(b, [key, "__part"]).drop("__part")


def ascii_lower(col):
    return F.translate(col, UPPER, LOWER)


def n_words(col):
    return F.coalesce(F.regexp_count(col, F.lit(WORD)), F.lit(0)).cast("long")


# ---------------------------------------------------------------- words as hashes, in numpy

_SEED = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _SEED.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C13 | 3
_INVERSE = pow(_BASE, -1, 2**64)
#: Weights of the words of an n-gram by place.
PLACE = _SEED.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) < n:
        size = max(1 << 20, 1 << (n - 1).bit_length())
        for k, base in enumerate((_BASE, _INVERSE)):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _POWERS[k] = np.multiply.accumulate(p)
    return _POWERS[0][:n], _POWERS[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64 bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: Longer texts are hashed in segments of about so many bytes, which end at white space.
SEGMENT = 4 << 20
_BLANK = re.compile(rb"[ \t-\r]")


def _segments(text: bytes) -> Iterator[bytes]:
    at = 0
    while len(text) - at > SEGMENT:
        m = _BLANK.search(text, at + SEGMENT)
        if not m:
            break
        yield text[at : m.end()]
        at = m.end()
    yield text[at:]


def word_hashes(texts: list[bytes], fold: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For the texts' words in order: a 64-bit rolling hash, its text's index, its length in code points.

    fold lower-cases A to Z first. The hash is the same in every process and does not depend on a word's place, so a long
    text is hashed segment by segment: the arrays for each byte stay small, those for each word are what is returned.
    """
    if sum(map(len, texts)) <= SEGMENT:
        return _word_hashes(texts, fold)
    parts = []
    for k, t in enumerate(texts):
        for piece in _segments(t):
            h, _, size = _word_hashes([piece], fold)
            parts.append((h, np.full(len(h), k, np.int64), size))
    h, doc, size = (np.concatenate(x) for x in zip(*parts, strict=True))
    return h, doc, size


def _word_hashes(texts: list[bytes], fold: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    buf = np.frombuffer(b"\n".join([b"", *texts, b""]), np.uint8)
    if fold:
        buf = _FOLD[buf]
    space = _SPACE[buf]
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    starts, ends = edge[::2], edge[1::2]
    if not len(starts):
        z = np.zeros(0, np.uint64)
        return z, np.zeros(0, np.int64), np.zeros(0, np.int64)
    power, inverse = _powers(len(buf))
    sums = np.cumsum(_BYTE[buf] * power, dtype=np.uint64)
    h = mix((sums[ends - 1] - sums[starts - 1]) * inverse[starts] + (ends - starts).astype(np.uint64))
    points = np.cumsum((buf & 0xC0) != 0x80)
    first = np.cumsum([1, *(len(t) + 1 for t in texts)])
    doc = np.searchsorted(first, starts, side="right") - 1
    return h, doc, points[ends - 1] - points[starts - 1]


def slices(texts: list[bytes], limit: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Index ranges of about limit bytes, so that arrays per byte stay small however long a batch is."""
    at = size = 0
    for k, t in enumerate(texts):
        if size and size + len(t) > limit:
            yield at, k
            at, size = k, 0
        size += len(t)
    if at < len(texts):
        yield at, len(texts)


def as_bytes(column: pa.Array) -> list[bytes | None]:
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()


# ---------------------------------------------------------------- whole runs out of sorted Arrow batches


def _changes(t: pa.Table, keys: list[str]) -> np.ndarray:
    out = np.zeros(t.num_rows, bool)
    for k in keys:
        v = t.column(k).to_numpy()
        out[1:] |= v[1:] != v[:-1]
    return out


def run_starts(t: pa.Table, keys: list[str]) -> np.ndarray:
    c = _changes(t, keys)
    c[:1] = True
    return np.flatnonzero(c)


def whole_runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables that never split a run of equal keys. The rows must arrive sorted by the keys."""
    held: list[pa.Table] = []
    for b in batches:
        if not b.num_rows:
            continue
        t = pa.Table.from_batches([b])
        if held and tuple(held[-1].column(k)[-1].as_py() for k in keys) != tuple(t.column(k)[0].as_py() for k in keys):
            yield pa.concat_tables(held).combine_chunks()
            held = []
        last = int(run_starts(t, keys)[-1])
        if last:
            yield pa.concat_tables([*held, t.slice(0, last)]).combine_chunks()
            held = []
        held.append(t.slice(last))
    if held:
        yield pa.concat_tables(held).combine_chunks()


# ---------------------------------------------------------------- connected components

#: Edges of 40 bytes, about, that one task can hold in any case.
MANY = 1_000_000

def connected_components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root) for every node of an undirected edge list; root is the smallest node it reaches.

    Alternating large-star and small-star steps: each is a minimum per node and a join back. With more than MANY edges, a
    hub's are dealt over several tasks there; with fewer, one task can hold them all. Every round is cut in the checkpoint
    folder.
    """
    e = cut(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct())
    mark = e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()

    def with_least(df: DataFrame, least) -> DataFrame:
        found, most = df.groupBy("u").agg(least.alias("m"), F.count("*").alias("n")), F.lit(2 * mark[0])
        if mark[0] <= MANY:
            return df.join(found.select("u", "m"), "u")
        hubs = found.filter(F.col("n") * HOT > most).select("u", F.ceil(F.col("n") * HOT / most).cast("int").alias("parts"))
        return spread_join(df, found.select("u", "m"), "u", hubs, ["v"])

    while mark[0]:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = with_least(both, F.least(F.min("v"), F.col("u"))).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        small = with_least(large, F.min("v")).select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x"))
        e = cut(small.select("x.u", "x.v").filter("u <> v").distinct())
        now = e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == mark:
            break
        mark = now
    roots = e.groupBy("u").agg(F.min("v").alias("root"))
    return roots.select(F.col("u").alias("node"), "root").unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
