"""Hard negatives, held against all pairs in plain Python."""

import numpy as np
from pyspark.sql import functions as F

from parchment.llm import negatives, queries

SCHEMA = "vec_id long, embedding array<float>, label int"


def plain(rows, every=50, n_positives=5, n_negatives=3, low=50, high=95):
    good = {(i, y, tuple(int(np.floor(256 * float(e))) for e in v)) for i, v, y in rows if i is not None and y is not None and v and all(e is not None and np.isfinite(e) for e in v)}
    out = []
    for i, y, v in good:
        if i % every:
            continue
        score = lambda w: sum(a * b for a, b in zip(v, w))  # noqa: E731, B023
        best = sorted((-score(w), j, z) for j, z, w in good if j != i and len(w) == len(v))
        for s, p in [(-s, j) for s, j, z in best if z == y][:n_positives]:
            found = [(j, -t) for t, j, z in best if z != y and low * s <= 100 * -t <= high * s][:n_negatives]
            out += [(i, p, k, j, s, t) for k, (j, t) in enumerate(found, 1)]
    return sorted(out)


def test_registered_query_matches_all_pairs(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    moved = [(i, v, (y + 1) % 10 if i % 7 == 0 else y) for i, v, y in rows]
    got = sorted(map(tuple, queries.op12_hard_negatives(spark, sf).collect()))
    assert got == plain(moved) and len(got) > 50


def test_edges(spark, monkeypatch):
    """Nulls, ties, repeated rows and ids, other lengths, zeros, negative scores, small blocks."""
    monkeypatch.setattr(negatives, "ROWS", 16)
    monkeypatch.setattr(negatives, "ANCHORS", 2)
    rng = np.random.Generator(np.random.PCG64(3))
    rows = [(i, [float(x) for x in np.round(rng.normal(size=8), 1)], i % 3) for i in range(120)]
    rows += [(i + 200, v, (y + 1) % 3) for i, v, y in rows[:40]] + rows[:10]
    rows += [(300, None, 1), (350, [], 1), (400, [1.0] * 8, None), (None, [1.0] * 8, 1), (450, [1.0, None] * 4, 1), (500, [float("nan")] * 8, 1), (550, [float("inf")] * 8, 1), (600, [0.0] * 8, 1)]
    rows += [(650 + k, [1.0, 2.0, 3.0], k % 2) for k in range(6)] + [(700, [-1.0] * 8, 7), (701, [1.0] * 8, 7), (702, [-1e6, 1e6] * 4, 7), (703, [0.1] * 8, 2)]
    df = spark.createDataFrame([(*r, "x", 5) for r in rows], SCHEMA + ", key string, rank int")
    got = sorted(map(tuple, negatives.hard_negatives(df, F.col("vec_id") % 50 == 0).collect()))
    assert got == plain(rows)
    assert negatives.hard_negatives(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_huge_components(spark):
    """Scores beyond 64 bits don't wrap."""
    rows = [(50, [1e30, 1.0], 0), (51, [1e30, 1.0], 0), (52, [0.6e30, 0.0], 1), (53, [-1e30, 0.0], 1)]
    out = negatives.hard_negatives(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") == 50).collect()
    assert [(r.negative_id, r.positive_score, r.negative_score) for r in out] == [] or all(r.positive_score == r.negative_score == 2**63 - 1 for r in out)


def test_intervals_hold_every_score():
    rng = np.random.Generator(np.random.PCG64(4))
    for dim in (1, 3, 64, 100):
        x, q = np.floor(256 * rng.normal(size=(500, dim))), np.floor(256 * rng.normal(size=(20, dim)))
        x[0] = 0
        low, high = negatives.intervals(negatives.planes(q), *negatives.encode(x), dim)
        true = q @ x.T
        assert (low <= true).all() and (true <= high).all()
        assert (high - low).mean() < 2 * (np.linalg.norm(q, axis=1)[:, None] * np.linalg.norm(x, axis=1)).mean()
