"""Hard-negative mining over rotated one-bit codes.

Components become whole numbers, floor(scale * x), and scores are their integer inner products. The index holds for each
row a code, the signs of its randomly rotated vector, besides its norm and its alignment: its inner product with the code's
unit vector c. A vector is alignment * c + rest with rest orthogonal to c, so for an anchor q

    q . x  =  alignment * (q . c)  +  q . rest,    |q . rest| <= sqrt(|q|^2 - (q . c)^2) * sqrt(|x|^2 - alignment^2)

by Cauchy-Schwarz. q . c comes from popcounts: the rotated anchor is cut into PLANES bit planes, each is and-ed with the
code, and what the cutting loses is bounded as well. Every score thus lies in an interval for certain. Rows whose interval
cannot reach an anchor's best are left out, and for all others the integer score decides; nothing is estimated in the end.

Anchors meet all rows in a grid of blocks, twice: first for their positives, then for the negatives that lie within bounds
set by these. A task gives out only the best of its block for each anchor, never a pair that it has merely looked at.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from parchment.llm.common import cut, run_starts, whole_runs

#: Rows and anchors of one block of the grid, about; anchors that are compared at once.
ROWS, ANCHORS, AT_ONCE = 4096, 2048, 64
#: Most tasks of a pass; with more cells than that a task takes several.
MOST_TASKS = 50_000
PLANES = 6
#: Widening of intervals for rounding, as a share of both norms.
SLACK = 1e-9
#: Whole numbers up to this in size are multiplied as 64-bit ones, larger ones as Python's.
LARGE = 1 << 26


@functools.lru_cache(maxsize=64)
def rotation(dim: int) -> np.ndarray:
    """A random orthogonal matrix, the same in every process."""
    rng = np.random.Generator(np.random.PCG64((dim, 31)))
    q, r = np.linalg.qr(rng.normal(size=(dim, dim)))
    return q * np.sign(np.diag(r))


def _packed(bits: np.ndarray) -> np.ndarray:
    """Rows of booleans as rows of 64-bit words."""
    wide = np.zeros((len(bits), -(-bits.shape[1] // 64) * 64), bool)
    wide[:, : bits.shape[1]] = bits
    return np.packbits(wide, axis=1).view(np.uint64)


def encode(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(code, norm, alignment) of each row of x."""
    turned = x @ rotation(x.shape[1])
    return _packed(turned > 0), np.sqrt((turned**2).sum(axis=1)), np.abs(turned).sum(axis=1) / np.sqrt(x.shape[1])


def planes(q: np.ndarray) -> tuple[np.ndarray, ...]:
    """(bits, low, step, total, lost, norm) of anchors: their rotated components as whole steps above low, and what that loses.

    bits: PLANES packed planes. lost: the least and the greatest sum that the losses of any set of components can have.
    """
    turned = q @ rotation(q.shape[1])
    low = turned.min(axis=1)
    step = np.maximum((turned.max(axis=1) - low) / ((1 << PLANES) - 1), 1e-300)
    whole = np.clip(np.rint((turned - low[:, None]) / step[:, None]), 0, (1 << PLANES) - 1).astype(np.int64)
    left = turned - (low[:, None] + step[:, None] * whole)
    bits = np.stack([_packed((whole >> k & 1).astype(bool)) for k in range(PLANES)], axis=1)
    return bits, low, step, turned.sum(axis=1), np.stack([np.minimum(left, 0).sum(axis=1), np.maximum(left, 0).sum(axis=1)]), np.sqrt((turned**2).sum(axis=1))


def intervals(anchors: tuple[np.ndarray, ...], code: np.ndarray, norm: np.ndarray, alignment: np.ndarray, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of the inner product of each anchor (from planes()) with each row (from encode())."""
    bits, low, step, total, lost, size = anchors
    ones = np.zeros((len(bits), len(code)), np.uint16 if code.shape[1] * 64 << PLANES <= 1 << 16 else np.uint32)
    for k in range(PLANES):
        for w in range(code.shape[1]):
            ones += np.left_shift(np.bitwise_count(bits[:, k, w, None] & code[:, w]), k, dtype=ones.dtype)
    picked = low[:, None] * np.bitwise_count(code).sum(axis=1) + step[:, None] * ones
    along = (2 * picked + (lost.sum(axis=0) - total)[:, None]) / np.sqrt(dim)
    wide = (lost[1] - lost[0])[:, None] / np.sqrt(dim)
    least = np.maximum(0, np.abs(along) - wide)
    rest = np.sqrt(np.maximum(0, norm**2 - alignment**2))
    radius = alignment * wide + np.sqrt(np.maximum(0, size[:, None] ** 2 - least**2)) * rest + SLACK * size[:, None] * norm + 1e-6
    middle = alignment * along
    return middle - radius, middle + radius


def _top(best: np.ndarray, k: int) -> np.ndarray:
    """The k-th largest value of each row; minus infinity where there are fewer."""
    return np.partition(best, -k, axis=1)[:, -k] if best.shape[1] >= k else np.full(len(best), -np.inf)


def _scores(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Whole inner products of rows of x with q, a vector or columns; as doubles where these hold them exactly."""
    most = max(np.abs(x).max(initial=0), np.abs(q).max(initial=0))
    if most > LARGE:
        return x.astype(object) @ q.astype(object)
    if int(most) ** 2 * x.shape[1] < 1 << 53:
        return x.astype(np.float64) @ q.astype(np.float64)
    return x @ q


def _first(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Indices of the k best, higher scores first, ties by smaller id."""
    if score.dtype != object and len(score) > 4 * k:
        near = np.flatnonzero(score >= np.partition(score, -k)[-k])
        return near[np.lexsort((ids[near], -score[near]))][:k]
    return np.array(sorted(range(len(score)), key=lambda i: (-score[i], ids[i]))[:k], np.int64)


class _Block:
    """Rows and anchors that meet in one task, as arrays."""

    def __init__(self, t: pa.Table):
        asked = t.column("asked").to_numpy(zero_copy_only=False).astype(bool)
        self.ids, self.labels, self.keys = (t.column(c).to_numpy() for c in ("vec_id", "label", "key"))
        x = np.frombuffer(b"".join(t.column("vector").to_pylist()), np.int64).reshape(t.num_rows, -1)
        self.whole, self.dim = x, x.shape[1]
        # Rows lie by label, so that those of one label are a slice.
        self.rows = np.flatnonzero(~asked)[np.argsort(self.labels[~asked], kind="stable")]
        self.asked = np.flatnonzero(asked)
        self.code = np.frombuffer(b"".join(t.column("code").take(pa.array(self.rows)).to_pylist()), np.uint64).reshape(len(self.rows), -(-self.dim // 64))
        self.norm, self.alignment = (t.column(c).to_numpy()[self.rows] for c in ("norm", "alignment"))
        self.row_ids, self.row_labels = self.ids[self.rows], self.labels[self.rows]

    def bounds(self, anchors: np.ndarray, at: slice = slice(None)) -> tuple[np.ndarray, np.ndarray]:
        return intervals(planes(self.whole[anchors].astype(np.float64)), self.code[at], self.norm[at], self.alignment[at], self.dim)

    def scored(self, anchor: int, some: np.ndarray) -> np.ndarray:
        return _scores(self.whole[self.rows[some]], self.whole[anchor])


def _positives(k: int):
    """The k best rows of each anchor's own label in a block, its own id aside."""

    def rows(batches):
        for t in whole_runs(batches, ["cell"]):
            starts = run_starts(t, ["cell"])
            out = []
            for s, e in zip(starts, np.append(starts[1:], t.num_rows), strict=True):
                b = _Block(t.slice(s, e - s))
                for label in np.unique(b.labels[b.asked]):
                    own = b.asked[b.labels[b.asked] == label]
                    at = slice(*np.searchsorted(b.row_labels, [label, label + 1]))
                    for part in np.array_split(own, -(-len(own) // AT_ONCE)):
                        low, high = b.bounds(part, at)
                        other = b.row_ids[at] != b.ids[part][:, None]
                        limit = _top(np.where(other, low, -np.inf), k)
                        for i, a in enumerate(part):
                            some = np.flatnonzero(other[i] & (high[i] >= limit[i])) + at.start
                            score = b.scored(a, some)
                            for j in _first(score, b.row_ids[some], k):
                                out.append((b.keys[a], b.ids[a], b.row_ids[some[j]], score[j]))
            yield _batch(out, ["key", "anchor_id", "vec_id", "score"])

    return rows


def _negatives(k: int, low_percent: int, high_percent: int):
    """For each positive of an anchor, the k best rows of other labels in a block with a score between the given percentages of its own."""

    def rows(batches):
        for t in whole_runs(batches, ["cell"]):
            starts = run_starts(t, ["cell"])
            out = []
            for s, e in zip(starts, np.append(starts[1:], t.num_rows), strict=True):
                part = t.slice(s, e - s)
                b, given = _Block(part), part.column("positives").to_pylist()
                for some in np.array_split(b.asked, max(1, -(-len(b.asked) // AT_ONCE))):
                    if len(some) and len(b.rows):
                        out.extend(_within(b, some, [given[a] for a in some], k, low_percent, high_percent))
            yield _batch(out, ["key", "anchor_id", "positive_id", "positive_score", "vec_id", "score"])

    return rows


def _within(b: _Block, anchors: np.ndarray, given: list, k: int, low_percent: int, high_percent: int):
    """The k best rows within the bounds of each positive of some anchors.

    A row is scored if its interval meets some positive's bounds and reaches the k-th of those rows that surely lie within.
    Bounds beyond a double's whole numbers are widened by its rounding; what is given out is compared in whole numbers.
    """
    low, high = b.bounds(anchors)
    other = b.row_labels != b.labels[anchors][:, None]
    most = max(map(len, given), default=0)
    wanted = np.zeros(other.shape, bool)
    for p in range(most):
        score = np.array([g[p]["score"] if p < len(g) else -1 for g in given], np.float64)  # a negative score has no bounds
        least, greatest = (np.where(score < 0, np.inf, score * x / 100) for x in (low_percent, high_percent))
        least, greatest = (x * (1 + y * 1e-12) + y for x, y in ((least, -1e-6), (greatest, 1e-6)))
        sure = other & (low >= least[:, None] + 2e-6 * (1 + least[:, None] * 1e-6)) & (high <= greatest[:, None] - 2e-6 * (1 + greatest[:, None] * 1e-6))
        floor = _top(np.where(sure, low, -np.inf), k) if sure.any() else np.full(len(anchors), -np.inf)
        wanted |= other & (high >= np.maximum(least, floor)[:, None]) & (low <= np.where(np.isinf(greatest), -np.inf, greatest)[:, None])
    columns = np.flatnonzero(wanted.any(axis=0))
    if not len(columns):
        return
    scores = _scores(b.whole[b.rows[columns]], b.whole[anchors].T).T
    ids = b.row_ids[columns]
    for i, a in enumerate(anchors):
        mine = np.flatnonzero(wanted[i, columns])
        score = scores[i, mine]
        for x in given[i]:
            at_least, at_most = -(-low_percent * x["score"] // 100), high_percent * x["score"] // 100  # rounded inwards
            fits = mine[(score >= at_least) & (score <= at_most)] if at_least <= at_most else mine[:0]
            for j in fits[_first(scores[i, fits], ids[fits], k)]:
                yield b.keys[a], b.ids[a], x["vec_id"], x["score"], ids[j], scores[i, j]


def _batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    most = (1 << 63) - 1
    columns = [[min(max(int(r[c]), -most - 1), most) for r in rows] for c in range(len(names))]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names)


def _coded(scale: float):
    """(vec_id, label, key, dim, vector, code, norm, alignment) of a batch of (vec_id, label, key, vector of doubles)."""

    def rows(batches):
        for b in batches:
            flat, at = b.column(3).values.to_numpy(zero_copy_only=False), b.column(3).offsets.to_numpy()
            sizes = np.diff(at)
            for dim in np.unique(sizes):
                of = np.flatnonzero(sizes == dim)
                x = np.clip(np.floor(scale * np.stack([flat[at[i] : at[i + 1]] for i in of])), -(2.0**62), 2.0**62)
                code, norm, alignment = encode(x)
                cells = [b.column(k).take(pa.array(of)) for k in range(3)]
                blobs = [pa.array([r.tobytes() for r in m], pa.binary()) for m in (x.astype(np.int64), code)]
                yield pa.RecordBatch.from_arrays([*cells, pa.array(np.full(len(of), dim, np.int32)), *blobs, pa.array(norm), pa.array(alignment)], names=["vec_id", "label", "key", "dim", "vector", "code", "norm", "alignment"])

    return rows


def _met(index: DataFrame, anchors: DataFrame, n_rows: int, n_anchors: int) -> DataFrame:
    """Rows and anchors in the cells of a grid, each cell together. Vectors of different lengths lie in different cells."""
    wide, high = max(1, -(-n_rows // ROWS)), max(1, -(-n_anchors // ANCHORS))
    own = lambda n: F.pmod(F.xxhash64("vec_id", "key"), F.lit(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    a = index.withColumn("row", own(wide)).withColumn("column", every(high)).withColumn("asked", F.lit(False))
    b = anchors.withColumn("column", own(high)).withColumn("row", every(wide)).withColumn("asked", F.lit(True))
    both = a.unionByName(b, allowMissingColumns=True)
    cell = (F.col("dim") * F.lit(wide).cast("long") + F.col("row")) * high + F.col("column")
    return both.withColumn("cell", cell).drop("row", "column").repartition(min(MOST_TASKS, 2 * wide * high), "cell").sortWithinPartitions("cell")


def hard_negatives(
    vectors: DataFrame, anchors, n_positives: int = 5, n_negatives: int = 3, low_percent: int = 50, high_percent: int = 95, scale: float = 256.0,
    vec_id: str = "vec_id", vector: str = "embedding", label: str = "label",
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for each anchor and each of its positives.

    anchors: a condition on the columns vec_id and label. Positives: the anchor's n_positives best other rows of its label.
    Negatives: the n_negatives best rows of other labels with low_percent * positive_score <= 100 * negative_score <=
    high_percent * positive_score. Higher scores come first, ties by smaller id. Where there are fewer, all are returned.

    Rows without an id or a label take no part, nor do vectors that are null, empty or hold a null or a value that isn't
    finite. Repeated rows count once; rows that share an id but not the rest are rows of their own, and none is another
    row to one of its own id. Vectors of different lengths never meet. Components beyond 2**62 / scale count as that, and
    scores beyond a long as the greatest one. An empty table gives an empty one; other columns are not looked at.
    """
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(label).cast("long").alias("label"), F.col(vector).cast("array<double>").alias("vector"))
    finite = F.forall("vector", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf"))) & (F.size("vector") > 0)
    rows = rows.filter(F.coalesce(finite, F.lit(False)) & F.col("vec_id").isNotNull() & F.col("label").isNotNull()).distinct()
    rows = rows.select("vec_id", "label", F.xxhash64("label", "vector").alias("key"), "vector")
    index = cut(rows.mapInArrow(_coded(scale), "vec_id long, label long, key long, dim int, vector binary, code binary, norm double, alignment double"))
    asked = index.filter(anchors)
    n, m = index.count(), asked.count()
    best = W.partitionBy("anchor_id", "key").orderBy(F.desc("score"), "vec_id")
    near = _met(index, asked, n, m).mapInArrow(_positives(n_positives), "key long, anchor_id long, vec_id long, score long")
    near = near.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= n_positives)
    given = near.groupBy("anchor_id", "key").agg(F.collect_list(F.struct("vec_id", "score")).alias("positives"))  # n_positives at most
    second = asked.join(given.withColumnRenamed("anchor_id", "vec_id"), ["vec_id", "key"])
    found = _met(index, second, n, m).mapInArrow(_negatives(n_negatives, low_percent, high_percent), "key long, anchor_id long, positive_id long, positive_score long, vec_id long, score long")
    rank = F.row_number().over(W.partitionBy("anchor_id", "key", "positive_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= n_negatives).select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
