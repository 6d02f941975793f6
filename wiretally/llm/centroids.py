"""Centroid clustering in which a threshold algorithm finds each nearest centroid.

For every dimension the centroids stand in a list sorted by their value there.
From a vector's own value all lists are walked outward side by side, nearest
value first; a centroid that is met for the first time gets its exact distance.
The squared distances at which the lists stand add up to a bound below which no
centroid not yet met can lie; once it exceeds the best exact distance, the walk
ends. Vectors are whole numbers, so that distances, sums and means are exact.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wiretally.llm.columns import named
from wiretally.llm.storage import durable

DIMENSIONS = 64
CENTROIDS = 16
ROUNDS = 3
SCALE = 64
SEED = 1
#: Components beyond this bound could carry a squared distance over 64 bits.
MOST = 1 << 27

_BLOCK = 2048
_FAR = 1 << 40


class Lists(NamedTuple):
    """Centroids, and per dimension their values in order and whose they are.

    Both lists have one entry more on either side, which lies far off.
    """

    centroids: np.ndarray
    values: np.ndarray
    owner: np.ndarray


def sorted_lists(centroids: np.ndarray) -> Lists:
    order = np.argsort(centroids, axis=0, kind="stable").T
    values = np.take_along_axis(centroids.T, order, axis=1)
    values = np.pad(values, ((0, 0), (1, 1)), constant_values=((0, 0), (-_FAR, _FAR)))
    return Lists(centroids, values, np.pad(order, ((0, 0), (1, 1))))


def _walk(x: np.ndarray, lists: Lists) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nearest centroid, its squared distance, and how many exact distances that took."""
    n, dims = x.shape
    k = len(lists.centroids)
    dim = np.arange(dims)
    high = np.stack([np.searchsorted(lists.values[d], x[:, d]) for d in range(dims)], axis=1)
    low = high - 1
    best, who = np.full(n, np.iinfo(np.int64).max), np.full(n, k)
    met = np.zeros((n, k), bool)
    on = np.arange(n)
    for _ in range(k):
        own, lo, hi = x[on], low[on], high[on]
        below, above = own - lists.values[dim, lo], lists.values[dim, hi] - own
        down = below <= above
        met_now = np.zeros((len(on), k), bool)
        met_now[np.arange(len(on))[:, None], lists.owner[dim, np.where(down, lo, hi)]] = True
        met_now &= ~met[on]
        row, centroid = np.nonzero(met_now)
        apart = np.full((len(on), k), np.iinfo(np.int64).max)
        apart[row, centroid] = ((own[row] - lists.centroids[centroid]) ** 2).sum(axis=1)
        nearest = apart.argmin(axis=1)  # the first, of equal ones
        distance = apart[np.arange(len(on)), nearest]
        wins = (distance < best[on]) | ((distance == best[on]) & (nearest < who[on]))
        best[on[wins]], who[on[wins]] = distance[wins], nearest[wins]
        met[on] |= met_now
        low[on] -= down
        high[on] += ~down
        bound = (np.where(down, below, above) ** 2).sum(axis=1)
        on = on[(bound <= best[on]) & ~met[on].all(axis=1)]
        if not len(on):
            break
    return who, best, met.sum(axis=1)


def nearest(x: np.ndarray, lists: Lists) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As ``_walk``, over any number of vectors; ties go to the smaller number."""
    parts = [_walk(x[i : i + _BLOCK], lists) for i in range(0, len(x), _BLOCK)]
    if not parts:
        return tuple(np.zeros(0, np.int64) for _ in range(3))
    return tuple(np.concatenate(p) for p in zip(*parts, strict=True))


def kept_vectors(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    dims: int = DIMENSIONS,
    scale: int = SCALE,
) -> DataFrame:
    """``(id, v)``: vectors of ``dims`` finite components, each ``floor(scale * x)``.

    Left out are null vectors, those of another length, with a null, NaN or
    infinite component, or with one beyond 2^27 after scaling, for which
    squared distances would not fit 64 bits.
    """
    v = named(vectors, vector_col)
    scaled = F.transform(v, lambda x: x.cast("double") * scale)
    # NaN is greater than any number.
    fits = F.forall(scaled, lambda x: F.coalesce(F.abs(x) <= MOST, F.lit(False)))
    rows = vectors.where((F.size(v) == dims) & fits)
    return rows.select(named(vectors, id_col).alias("id"), F.transform(scaled, lambda x: F.floor(x).cast("int")).alias("v"))


def _start_key(id_: Column, seed: int) -> Column:
    return F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_.cast("string"), F.lit(""))), 256)


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dims)


def _moved(kept: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Each centroid at the floored mean of its vectors, or where it was without any.

    Tasks add up their own vectors, Spark the tasks' sums; what comes back has a
    row per centroid and dimension.
    """
    k, dims = centroids.shape

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists = sorted_lists(centroids)
        sums, count = np.zeros((k, dims), np.int64), np.zeros(k, np.int64)
        for batch in batches:
            x = _matrix(batch.column("v"), dims)
            cluster = nearest(x, lists)[0]
            order = np.argsort(cluster, kind="stable")
            first = np.flatnonzero(np.diff(cluster[order], prepend=-1))
            if len(first):
                sums[cluster[order[first]]] += np.add.reduceat(x[order], first, axis=0)
            count += np.bincount(cluster, minlength=k)
        used = np.flatnonzero(count)
        at = pa.array(np.arange(len(used) + 1, dtype=np.int32) * dims)
        yield pa.RecordBatch.from_arrays(
            [pa.array(used.astype(np.int32)), pa.array(count[used]),
             pa.ListArray.from_arrays(at, pa.array(sums[used].ravel()))],
            names=["cluster", "n", "sums"],
        )

    parts = kept.select("v").mapInArrow(of_batches, "cluster int, n long, sums array<long>")
    whole = parts.select("cluster", "n", F.posexplode("sums").alias("dim", "s")).groupBy("cluster", "dim").agg(
        F.sum(F.col("s").cast("decimal(38,0)")).alias("s"), F.sum("n").alias("n")
    )
    moved = centroids.copy()
    for r in whole.collect():
        moved[r["cluster"], r["dim"]] = int(r["s"]) // r["n"]
    return moved


def fitted(
    kept: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, seed: int = SEED, dims: int = DIMENSIONS
) -> np.ndarray:
    """Centroids after ``rounds``, from the ``k`` vectors whose id hashes lowest (ties: lower vector).

    Of fewer vectors than ``k`` each is a centroid.
    """
    first = kept.orderBy(_start_key(F.col("id"), seed), "v").limit(k).select("v")
    centroids = np.array([r["v"] for r in first.collect()], np.int64).reshape(-1, dims)
    for _ in range(rounds if len(centroids) else 0):
        centroids = _moved(kept, centroids)
    return centroids


def assigned(kept: DataFrame, centroids: np.ndarray) -> DataFrame:
    """``(id, cluster, distance, n_exact)``: nearest centroid and squared distance of every vector.

    ``n_exact`` tells how many exact distances the walk took.
    """
    dims = centroids.shape[1]
    kind = kept.schema["id"].dataType.simpleString()

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists = sorted_lists(centroids)
        for batch in batches:
            cluster, distance, n_exact = nearest(_matrix(batch.column("v"), dims), lists)
            columns = [pa.array(cluster.astype(np.int32)), pa.array(distance), pa.array(n_exact.astype(np.int32))]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), *columns], names=["id", "cluster", "distance", "n_exact"]
            )

    return kept.mapInArrow(of_batches, f"id {kind}, cluster int, distance long, n_exact int")


def clustered(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    k: int = CENTROIDS,
    rounds: int = ROUNDS,
    seed: int = SEED,
    dims: int = DIMENSIONS,
    scale: int = SCALE,
) -> DataFrame:
    """``(id, cluster, distance, n_exact, cluster_inertia, inertia, centroid_sha256)`` per kept vector.

    See ``kept_vectors`` for what is kept and ``fitted`` for the rounds. Ties
    go to the smaller centroid number; repeated rows each count; a null id
    hashes as an empty one. Without a vector that is kept there are no rows.
    ``inertia`` sums the squared distances over all vectors. The hash is of a
    final centroid's components, joined by commas. Other columns are not looked
    at.
    """
    kept = durable(kept_vectors(vectors, id_col, vector_col, dims, scale), "vectors")
    centroids = fitted(kept, k, rounds, seed, dims)
    found = durable(assigned(kept, centroids), "assigned")
    per_cluster = found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s"))
    sums = {r["cluster"]: int(r["s"]) for r in per_cluster.collect()}  # k rows
    total = sum(sums.values())
    facts = [
        (c, s, total, hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest())
        for c, s in sorted(sums.items())
    ]
    schema = "cluster int, cluster_inertia long, inertia long, centroid_sha256 string"
    facts = kept.sparkSession.createDataFrame(facts, schema)
    return found.join(F.broadcast(facts), "cluster").select("id", *found.columns[1:], *facts.columns[1:])
