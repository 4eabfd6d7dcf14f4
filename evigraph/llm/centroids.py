"""Centroid clustering of 64-component vectors by a progressive search over exact Walsh-Hadamard coefficients.

The transform H of 64 integers needs additions only, and |Ha - Hb|^2 = 64 |a - b|^2, so sums of squared coefficient
differences, taken coarse to fine, are lower bounds of a distance that become exact with the last coefficient. Being linear,
the transform also turns sums of vectors into sums of coefficients: only coefficients are stored and read in the rounds.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evigraph.llm.shared import write_table

SIZE, SCALE = 64, 1024
BLOCKS = ((0, 4), (4, 8), (8, 16), (16, 32), (32, 64))
LARGEST = 1 << 52  # a component beyond it is refused: its coefficients would not fit a long for certain
SAFE = 1 << 27  # coefficients up to it keep all squared sums below 2^63


@lru_cache(maxsize=1)
def hadamard() -> tuple[np.ndarray, np.ndarray]:
    """The 64 x 64 matrix of +1 and -1, rows by number of sign changes (coarse patterns first), and that order of the natural rows."""
    natural = np.ones((1, 1), dtype=np.int64)
    while len(natural) < SIZE:
        natural = np.block([[natural, natural], [natural, -natural]])
    order = np.argsort((np.diff(natural, axis=1) != 0).sum(axis=1), kind="stable")
    return natural[order], order


def transform(vectors: np.ndarray) -> np.ndarray:
    """Coefficients of integer vectors, one a row, by six exact butterfly steps."""
    out = vectors.reshape(len(vectors), *[2] * 6)
    for axis in range(1, 7):
        a, b = np.take(out, 0, axis), np.take(out, 1, axis)
        out = np.stack([a + b, a - b], axis)
    return out.reshape(len(vectors), SIZE)[:, hadamard()[1]]


def components(coefs: np.ndarray) -> list[int]:
    """The integers behind exact coefficients."""
    return [int(v) // SIZE for v in hadamard()[0].T.astype(object) @ coefs.astype(object)]


def nearest(coefs: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number, squared distance) of each row's nearest centroid, all given by coefficients; ties: the smaller number.

    After the first block the leader of each row is finished, which gives an upper bound. Later blocks are added for the centroids
    whose lower bound is not above it, so one that ties is always finished.
    """
    if max((int(np.abs(x).max()) for x in (coefs, centroids) if x.size), default=0) > SAFE:
        coefs, centroids = coefs.astype(object), centroids.astype(object)
    n, k = len(coefs), len(centroids)
    if n == 0:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    bound = np.stack([((coefs[:, :4] - c[:4]) ** 2).sum(axis=1) for c in centroids], axis=1)
    lead = np.argmin(bound, axis=1)
    best = bound[np.arange(n), lead] + ((coefs[:, 4:] - centroids[lead, 4:]) ** 2).sum(axis=1)
    alive = bound <= best[:, None]
    for start, end in BLOCKS[1:]:
        for c in range(k):
            rows = np.flatnonzero(alive[:, c])
            bound[rows, c] += ((coefs[rows, start:end] - centroids[c, start:end]) ** 2).sum(axis=1)
        alive &= bound <= best[:, None]
    found = np.argmax(alive & (bound == np.where(alive, bound, best[:, None]).min(axis=1)[:, None]), axis=1)
    return found, bound[np.arange(n), found] // SIZE


def kept(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id and coefs of the vectors with 64 components, none null or non-finite; other columns are left behind."""

    def coefs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.floor(np.asarray(batch.column("x").flatten(), dtype=np.float64).reshape(-1, SIZE) * SCALE)
            if len(x) and np.abs(x).max() > LARGEST:
                raise ValueError(f"a component is beyond {LARGEST // SCALE}: its squared distances do not fit a long")
            out = pa.array(transform(x.astype(np.int64)).reshape(-1))
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.FixedSizeListArray.from_arrays(out, SIZE).cast(pa.list_(pa.int64()))], ["vec_id", "coefs"])

    x = F.col(vector_col).cast("array<double>")
    finite = F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), x.alias("x")).where((F.size("x") == SIZE) & finite)
    return rows.mapInArrow(coefs, "vec_id bigint, coefs array<bigint>")


def first_centroids(table: DataFrame, k: int) -> np.ndarray:
    """Coefficients of the k vectors with the smallest sha256 of `3:<vec_id>`; equal ids by their coefficients; fewer if fewer are kept."""
    key = F.sha2(F.concat(F.lit("3:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    rows = table.orderBy(key, "coefs").limit(k).collect()  # k rows of each partition at most
    return np.array([r.coefs for r in rows], dtype=np.int64).reshape(-1, SIZE)


def assign(table: DataFrame, centroids: np.ndarray) -> DataFrame:
    """vec_id, cluster and distance of every vector."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            number, distance = nearest(_matrix(batch), centroids)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(number.astype(np.int32)), pa.array(distance.tolist(), pa.int64())], ["vec_id", "cluster", "distance"])

    return table.mapInArrow(find, "vec_id bigint, cluster int, distance bigint")


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("coefs").flatten().to_numpy().reshape(-1, SIZE)


def next_centroids(table: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """One round: each non-empty centroid becomes the floor of its vectors' mean. A task sends one row for each centroid and coefficient."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros(centroids.shape, dtype=object), np.zeros(len(centroids), dtype=np.int64)
        for batch in batches:
            coefs = _matrix(batch)
            number, _ = nearest(coefs, centroids)
            wide = int(np.abs(coefs).max()) * len(coefs) >= 1 << 62 if len(coefs) else False
            for c in np.unique(number):
                mine = coefs[number == c]
                total[c] += (mine.astype(object) if wide else mine).sum(axis=0)
                count[c] += len(mine)
        used = np.flatnonzero(count)
        if len(used):
            yield pa.RecordBatch.from_arrays([
                pa.array(np.repeat(used, SIZE).astype(np.int32)), pa.array(np.tile(np.arange(SIZE), len(used)).astype(np.int32)),
                pa.array([str(v) for c in used for v in total[c]]), pa.array(np.repeat(count[used], SIZE)),
            ], ["cluster", "place", "total", "n"])

    parts = table.mapInArrow(sums, "cluster int, place int, total string, n bigint")
    found = parts.groupBy("cluster", "place").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.sum("n").alias("n"))
    rows = found.groupBy("cluster").agg(F.max("n").alias("n"), F.sort_array(F.collect_list(F.struct("place", "total"))).alias("coefs")).collect()
    out = centroids.copy()
    for r in rows:  # a row for each centroid
        means = np.array([[v // r.n for v in components(np.array([int(c.total) for c in r.coefs], dtype=object))]], dtype=np.int64)
        out[r.cluster] = transform(means)[0]
    return out


def cluster(vectors: DataFrame, k: int = 8, rounds: int = 10, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 and n_cluster for every kept vector, repeated rows included.

    Vectors that are null, of another length, or hold a null, NaN or infinity are not kept; without a kept vector there is no
    row. All sums are exact; a distance or inertia beyond a long and a component beyond 2^42 raise an error. The driver
    sees k centroids a round, whatever the number of vectors.
    """
    table = write_table(kept(vectors, id_col, vector_col), "coefficients")
    centroids = first_centroids(table, k)
    if len(centroids):
        for _ in range(rounds):
            centroids = next_centroids(table, centroids)
    found = write_table(assign(table, centroids), "clusters")
    sums = {r.cluster: r for r in found.groupBy("cluster").agg(F.sum("distance").alias("d"), F.count("*").alias("n")).collect()}
    total = sum(r.d for r in sums.values())
    about = [
        (c, r.d, total, hashlib.sha256(",".join(map(str, components(centroids[c]))).encode()).hexdigest(), r.n) for c, r in sorted(sums.items())
    ]
    schema = "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string, n_cluster bigint"
    per_cluster = vectors.sparkSession.createDataFrame(about, schema)
    return found.join(F.broadcast(per_cluster), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256", "n_cluster")
