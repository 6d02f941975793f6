"""The threshold walk against all distances, and the rounds against plain k-means."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pytest

from wiretally.llm.centroids import clustered, fitted, kept_vectors, nearest, sorted_lists

SCHEMA = "vec_id long, embedding array<float>"


@pytest.mark.parametrize("spread", [1, 2, 30, 1 << 27])
@pytest.mark.parametrize("k", [1, 5, 16])
def test_walk_finds_the_nearest(spread, k):
    rng = np.random.default_rng(spread + k)
    x = rng.integers(-spread, spread + 1, (3000, 6))
    centroids = x[rng.integers(0, len(x), k)] // 2
    who, best, n_exact = nearest(x, sorted_lists(centroids))
    apart = ((x[:, None, :] - centroids[None]) ** 2).sum(axis=2)
    assert (who == apart.argmin(axis=1)).all() and (best == apart.min(axis=1)).all()
    assert (n_exact >= 1).all() and (n_exact <= k).all()


def test_walk_ends_early_only_beyond_ties():
    """In one dimension the walk leaves far centroids out, but not one as near as the best."""
    line = sorted_lists(np.array([[10], [-10], [500], [900], [-900]]))
    who, best, n_exact = nearest(np.array([[0], [499], [10]]), line)
    assert who.tolist() == [0, 2, 0] and best.tolist() == [100, 1, 0] and (n_exact < 5).all()


def plain(rows, k=16, rounds=3, seed=1):
    kept = [(i, np.array([math.floor(64 * x) for x in v])) for i, v in rows]
    name = lambda i: hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()
    start = sorted(kept, key=lambda r: (name(r[0]), r[1].tolist()))[:k]
    centroids = np.array([v for _, v in start])
    x = np.array([v for _, v in kept])
    for step in range(rounds + 1):
        apart = ((x[:, None, :] - centroids[None]) ** 2).sum(axis=2)
        own, d = apart.argmin(axis=1), apart.min(axis=1)
        if step < rounds:
            for c in set(own.tolist()):
                centroids[c] = x[own == c].sum(axis=0) // (own == c).sum()
    inertia = {c: int(d[own == c].sum()) for c in set(own.tolist())}
    digest = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centroids]
    return [
        (i, int(c), int(e), inertia[int(c)], sum(inertia.values()), digest[c])
        for (i, _), c, e in zip(kept, own, d, strict=True)
    ]


def check(spark, rows, extra=()):
    found = clustered(spark.createDataFrame([*rows, *extra], SCHEMA).repartition(5))
    got = [(r.id, r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in found.collect()]
    order = lambda r: ((r[0] is None, r[0]), *r[1:])
    assert sorted(got, key=order) == sorted(plain(rows), key=order)


def test_equals_plain_rounds(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(0, 3, (20, 64))
    rows = [(i, [float(x) for x in np.float32(centres[i % 20] + rng.normal(0, 1, 64))]) for i in range(400)]
    bad = [(900, None), (901, [1.0] * 63), (902, [1.0] * 63 + [None]), (903, [math.nan] * 64), (904, [math.inf] * 64),
           (905, [1e30] * 64), (906, [])]
    check(spark, rows, bad)


def test_repeated_rows_ties_and_null_ids(spark):
    rows = [(i % 4, [float(i % 3)] * 64) for i in range(30)] + [(None, [-0.01] * 64)] * 9
    check(spark, rows)


def test_few_or_no_vectors(spark):
    check(spark, [(i, [float(i)] * 64) for i in range(3)])
    empty = spark.createDataFrame([], SCHEMA)
    assert clustered(empty).count() == 0
    assert fitted(kept_vectors(empty)).shape == (0, 64)


def test_clashing_names(spark):
    docs = spark.createDataFrame([(i, [float(i)] * 64, 1, 2, 3, 4) for i in range(20)], SCHEMA + ", id int, v int, cluster int, `a.b` int")
    assert clustered(docs).count() == 20
