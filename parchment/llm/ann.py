"""Approximate nearest neighbours by multiprobe p-stable hashing, reranked by exact Euclidean distance.

A table hashes a vector to the cell floor((a_i . x + b_i) / w), i < hashes, with Gaussian a_i. A query visits, besides its
own cell, the cells that differ by one step in some of the hashes, in the order of the summed squared distances to the
borders that are crossed: the order of estimated success. Number of hashes, width w, number of tables and number of visited
cells are fitted together, on the driver, on a sample of at most SAMPLE vectors: of all choices under which the sample's
own neighbours are found at RECALL, the one with the least work for the table's size is taken, so that bigger tables get
narrower cells. A sample's neighbours lie further than those in all rows; how much further is estimated from how
distances grow with rank, and its neighbours are drawn nearer by that ratio before they are looked for. Every row is
indexed.

Index rows and probes meet in the tasks that hold their cells, which keep the best k of each query; no pair is emitted.
Cells of more than BLOCK vectors are split, and their probes go to every part. Of vectors that are equal throughout only
the k + 1 smallest ids can be among any query's k nearest, so the index keeps no more of them. Queries that found fewer
than k candidates, although there are as many rows, are held against all rows in blocks.
"""

from __future__ import annotations

import functools
import itertools
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from parchment.llm.common import cut, mix, run_starts, whole_runs

MOST_TABLES, SAMPLE, TESTS, RECALL = 8, 2048, 48, 0.99
#: The choices for the number of hashes, and for the width in distances of the sample's k-th neighbours.
HASHES, WIDTHS = (3, 4, 6, 8, 12), (1.4, 2.2)
#: Most hashes in which a visited cell differs from the query's own.
CHANGED = 3
#: Work of sending a vector to a cell, in comparisons.
SEND = 60
BLOCK = 8192


@dataclass(frozen=True)
class Plan:
    hashes: int = 3
    width: float = 1.0
    tables: int = 4
    probes: int = 27


@functools.cache
def steps(hashes: int) -> np.ndarray:
    """The visited cells relative to the own one, in one row each."""
    out = [[0] * hashes]
    for n in range(1, min(hashes, CHANGED) + 1):
        for at in itertools.combinations(range(hashes), n):
            for signs in itertools.product((-1, 1), repeat=n):
                row = [0] * hashes
                for k, x in zip(at, signs, strict=True):
                    row[k] = x
                out.append(row)
    return np.array(out)


@functools.lru_cache(maxsize=256)
def _functions(dim: int, table: int, hashes: int, width: float) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.Generator(np.random.PCG64((dim, table, hashes, 11)))
    return rng.normal(size=(dim, hashes)), rng.uniform(0, width, hashes)


def places(x: np.ndarray, table: int, hashes: int, width: float) -> np.ndarray:
    a, b = _functions(x.shape[1], table, hashes, width)
    return (x @ a + b) / width


def cells(whole: np.ndarray, table: int, dim: int) -> np.ndarray:
    """Keys of the cells, of 64 bits; tables and dimensions don't share any."""
    h = np.full(whole.shape[:-1], np.uint64(table * 100_003 + dim), np.uint64)
    for k in range(whole.shape[-1]):
        h = mix(h * np.uint64(0x9E3779B97F4A7C15) + whole[..., k].astype(np.int64).view(np.uint64))
    return h.view(np.int64)


def _costs(place: np.ndarray, step: np.ndarray) -> np.ndarray:
    low = place - np.floor(place)
    return (np.where(step == 0, 0.0, np.where(step < 0, low, 1 - low)) ** 2).sum(axis=1)


def probe_order(place: np.ndarray) -> np.ndarray:
    """Indices into the steps, most promising first, for one query's places."""
    return np.argsort(_costs(place, steps(len(place))), kind="stable")


def _ranks(own: np.ndarray, others: np.ndarray) -> np.ndarray:
    """When the query at a place comes to the cell of each of the others' places; beyond the last step if never."""
    step = np.floor(others) - np.floor(own)
    order = np.sort(_costs(own, steps(len(own))))
    never = (np.abs(step) > 1).any(axis=1) | ((step != 0).sum(axis=1) > CHANGED)
    return np.where(never, len(order), np.searchsorted(order, _costs(own, step) - 1e-9))


def _distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0, (x**2).sum(1)[:, None] + (y**2).sum(1) - 2 * x @ y.T))


def shrinkage(d: np.ndarray, n: int) -> float:
    """How much nearer a neighbour of some rank is among n vectors than among the sample, from rows of distances to it.

    Distances to the j-th neighbour grow as j ** (1 / dimension); the dimension is estimated from each row's nearest
    ones, and the upper quartile is taken, which gives the smaller change.
    """
    size = d.shape[1]
    near = np.sort(d, axis=1)[:, : max(20, size // 20)]
    with np.errstate(divide="ignore", invalid="ignore"):
        dimension = -1 / np.log(near / near[:, -1:])[:, :-1].mean(axis=1)
    dimension = dimension[np.isfinite(dimension) & (dimension > 0)]
    return float(min(1.0, (size / n) ** (1 / np.quantile(dimension, 0.75)))) if len(dimension) and n > size else 1.0


def fit(sample: np.ndarray, k: int, n: int, queries: int) -> Plan:
    """The plan of least work for n vectors and so many queries, from a sample of vectors of one dimension."""
    if len(sample) < 2 * k + 2:
        return Plan()
    tests = sample[:TESTS]
    d = _distances(tests, sample)
    d[np.arange(len(tests)), np.arange(len(tests))] = np.inf
    near = np.argsort(d, axis=1)[:, :k]
    ratio = shrinkage(d, n)
    unit = ratio * float(np.median(np.take_along_axis(d, near, 1)[:, -1])) or 1.0
    nearer = tests[:, None, :] + ratio * (sample[near] - tests[:, None, :])
    best, plan = np.inf, None
    for hashes, w in itertools.product(HASHES, WIDTHS):
        width, most = w * unit, len(steps(hashes))
        first = np.full(near.shape, most)
        met = np.zeros(most + 1)  # vectors met at each rank, over all tests and tables
        for tables in range(1, MOST_TABLES + 1):
            p = places(sample, tables - 1, hashes, width)
            q = places(nearer.reshape(-1, sample.shape[1]), tables - 1, hashes, width).reshape(*near.shape, hashes)
            for i in range(len(tests)):
                first[i] = np.minimum(first[i], _ranks(p[i], q[i]))
                met += np.bincount(_ranks(p[i], p), minlength=most + 1)
            probes = int(np.quantile(first, RECALL, method="higher")) + 1
            if probes <= most:
                compared = met[:probes].sum() / (len(tests) * len(sample)) * n
                work = compared + SEND * tables * (probes + n / max(1, queries))
                if work < best:
                    best, plan = work, Plan(hashes, width, tables, probes)
    if plan is None:  # neighbours so far from their queries that it takes more tables, or else wider cells
        plan = _widened(tests, nearer, unit)
    return plan


def _widened(tests: np.ndarray, nearer: np.ndarray, unit: float) -> Plan:
    """With the fewest hashes and all their steps, so many tables, or so wide cells, that the wanted recall is reached."""
    hashes, width = HASHES[0], WIDTHS[-1] * unit
    while True:
        met = np.zeros(nearer.shape[:2], bool)
        for tables in range(1, 4 * MOST_TABLES + 1):
            p = places(tests, tables - 1, hashes, width)
            q = places(nearer.reshape(-1, tests.shape[1]), tables - 1, hashes, width).reshape(*nearer.shape[:2], hashes)
            met |= np.stack([_ranks(p[i], q[i]) for i in range(len(tests))]) < len(steps(hashes))
            if met.mean() >= RECALL:
                return Plan(hashes, width, tables, len(steps(hashes)))
        width *= 2


def _vectors(column: pa.Array) -> list[np.ndarray]:
    flat, at = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    return [flat[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]


def _rows(plan: Plan, probing: bool):
    """(cell, vec_id, vector) of a batch of (vec_id, vector): the cells that a query visits, or a vector's own in each table."""
    probes = plan.probes if probing else 1

    def rows(batches):
        for b in batches:
            vecs, ids = _vectors(b.column(1)), b.column(0).to_numpy()
            for dim in {len(v) for v in vecs}:
                of = np.array([i for i, v in enumerate(vecs) if len(v) == dim])
                for part in np.array_split(of, max(1, len(of) * probes // 20_000)):
                    x = np.stack([vecs[i] for i in part]).astype(np.float64)
                    for t in range(plan.tables):
                        p = places(x, t, plan.hashes, plan.width)
                        own = np.floor(p)
                        if probing:
                            own = np.stack([own[i] + steps(plan.hashes)[probe_order(p[i])[:probes]] for i in range(len(p))]).reshape(-1, plan.hashes)
                        take = np.repeat(np.arange(len(part)), probes)
                        yield pa.RecordBatch.from_arrays([pa.array(cells(own, t, dim)), pa.array(ids[part][take]), b.column(1).take(pa.array(part[take]))], names=["cell", "vec_id", "vector"])

    return rows


class _Best:
    """The k best candidates of each query that a task has met; given out when it holds many queries, and at its end."""

    def __init__(self, k: int, most: int = 100_000):
        self.k, self.most, self.held = k, most, {}

    def add(self, query: int, ids: np.ndarray, score: np.ndarray) -> None:
        if query in self.held:
            ids, score = (np.concatenate(x) for x in zip(self.held[query], (ids, score), strict=True))
            _, first = np.unique(np.stack([ids, score.view(np.int64)]), axis=1, return_index=True)
            ids, score = ids[first], score[first]
        if len(ids) > self.k:
            cut_at = np.partition(score, self.k - 1)[self.k - 1]
            keep = np.flatnonzero(score <= cut_at)
            keep = keep[np.lexsort((ids[keep], score[keep]))][: self.k]
            ids, score = ids[keep], score[keep]
        self.held[query] = (ids, score)

    def out(self, last: bool = False):
        if self.held and (last or len(self.held) > self.most):
            q = np.repeat(np.fromiter(self.held, np.int64), [len(i) for i, _ in self.held.values()])
            ids, score = (np.concatenate(x) for x in zip(*self.held.values(), strict=True))
            self.held = {}
            yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(ids), pa.array(score)], names=["query_id", "vec_id", "score"])


def _meet(k: int):
    def rows(batches):
        best = _Best(k)
        for t in whole_runs(batches, ["cell", "block"]):
            starts = run_starts(t, ["cell", "block"])
            asked, ids = t.column("asked").to_numpy(zero_copy_only=False).astype(bool), t.column("vec_id").to_numpy()
            vectors = t.column("vector").combine_chunks()
            for s, e in zip(starts, np.append(starts[1:], t.num_rows), strict=True):
                q, c = np.flatnonzero(asked[s:e]) + s, np.flatnonzero(~asked[s:e]) + s
                if not len(q) or not len(c):
                    continue
                part = _vectors(vectors.slice(s, e - s))
                x = np.stack([part[i - s] for i in c]).astype(np.float64)
                for i in q:
                    score = np.sqrt(((x - part[i - s].astype(np.float64)) ** 2).sum(axis=1))
                    own = ids[c] != ids[i]
                    best.add(int(ids[i]), ids[c][own], score[own])
            yield from best.out()
        yield from best.out(True)

    return rows


def _top(index: DataFrame, probes: DataFrame, k: int) -> DataFrame:
    """index, probes: (cell, vec_id, vector). The k nearest of each query among the rows of its cells."""
    blocks = index.groupBy("cell").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    mine = index.join(blocks, "cell").withColumn("block", F.pmod(F.xxhash64("vec_id"), "blocks").cast("int")).withColumn("asked", F.lit(False))
    # A query makes many probes, so the size that is guessed for them is far too small: they must not be broadcast by it.
    theirs = probes.join(blocks.hint("merge"), "cell").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks").cast("int") - 1))).withColumn("asked", F.lit(True))
    both = mine.unionByName(theirs).select("cell", "block", "asked", "vec_id", "vector")
    found = both.repartition("cell", "block").sortWithinPartitions("cell", "block").mapInArrow(_meet(k), "query_id long, vec_id long, score double").distinct()
    rank = F.row_number().over(W.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k)


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each query, ties to the smaller id.

    vectors and queries hold (vec_id, vector); a query's own id is no candidate. Vectors that are null, empty, zero or
    hold a null or a value that isn't finite take no part, and vectors of different lengths never meet. Repeated rows
    count once; ids that repeat with other vectors are rows of their own, and query rows that share an id are one query,
    whose neighbours are those nearest to any of them. With k candidates or fewer all are returned. An empty table, or no
    queries, give an empty one; other columns are not looked at.
    """

    def clean(df):
        v = F.col(vector).cast("array<double>")
        ok = F.forall(v, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf"))) & F.exists(v, lambda e: e != 0)
        return df.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).alias("vector")).filter(F.coalesce(ok, F.lit(False)) & F.col("vec_id").isNotNull()).distinct()

    copies = F.row_number().over(W.partitionBy("vector").orderBy("vec_id"))
    rows, asked = clean(vectors).withColumn("n", copies).filter(F.col("n") <= k + 1).drop("n"), clean(queries)
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("vector").collect()  # bounded
    dims = [len(r.vector) for r in sample]
    common = max(set(dims), key=dims.count) if dims else 1
    n = rows.count()
    plan = fit(np.array([r.vector for r in sample if len(r.vector) == common], np.float64).reshape(-1, common), k, n, asked.count())
    kind = rows.schema["vector"].dataType.simpleString()
    schema = f"cell long, vec_id long, vector {kind}"
    found = cut(_top(rows.mapInArrow(_rows(plan, False), schema), asked.mapInArrow(_rows(plan, True), schema), k))
    full = found.groupBy("query_id").agg(F.count("*").alias("n")).filter(F.col("n") >= k)
    few = asked.join(full, asked["vec_id"] == full["query_id"], "left_anti")
    cell = F.pmod(F.xxhash64("vec_id"), F.lit(max(1, -(-n // BLOCK))))
    every = rows.select(cell.alias("cell"), "vec_id", "vector")
    rest = few.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(max(1, -(-n // BLOCK)) - 1).cast("long"))).alias("cell"), "vec_id", "vector")
    lengths = lambda df: df.withColumn("cell", F.col("cell") * 100_003 + F.size("vector"))
    more = _top(lengths(every), lengths(rest), k)
    found = found.join(few.select(F.col("vec_id").alias("query_id")).distinct(), "query_id", "left_anti").unionByName(more)
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
