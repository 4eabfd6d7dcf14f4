"""Centroid clustering: exact transform, search beside all distances, rounds beside plain Python, odd rows."""

import hashlib
import math

import numpy as np
import pytest

from evigraph.llm import centroids

SCHEMA = "cluster string, vec_id long, embedding array<double>, coefs int"


def plain(vectors, k=8, rounds=10):
    """vec_id, cluster and distance by the definition, and the final centroids."""
    rows = [(i, [math.floor(x * 1024) for x in e]) for i, e in vectors if e is not None and len(e) == 64 and all(x is not None and math.isfinite(x) for x in e)]
    seeds = sorted(rows, key=lambda r: hashlib.sha256(f"3:{'' if r[0] is None else r[0]}".encode()).hexdigest())[:k]
    centers = [list(v) for _, v in seeds]

    def near(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), n) for n, c in enumerate(centers))

    for _ in range(rounds):
        where = [near(v)[1] for _, v in rows]
        for n in range(len(centers)):
            mine = [v for (_, v), c in zip(rows, where, strict=True) if c == n]
            if mine:
                centers[n] = [sum(col) // len(mine) for col in zip(*mine, strict=True)]
    return [(i, near(v)[1], near(v)[0]) for i, v in rows], centers


def check(frame, data):
    got = centroids.cluster(frame).collect()
    want, centers = plain(data)
    order = lambda r: (r[0] is None, r[0] or 0, r[1:])
    assert sorted(((r.vec_id, r.cluster, r.distance) for r in got), key=order) == sorted(want, key=order)
    for r in got:
        mine = [d for _, c, d in want if c == r.cluster]
        assert (r.cluster_inertia, r.n_cluster, r.inertia) == (sum(mine), len(mine), sum(d for _, _, d in want))
        assert r.centroid_sha256 == hashlib.sha256(",".join(map(str, centers[r.cluster])).encode()).hexdigest()


def test_transform_is_exact():
    rng = np.random.default_rng(0)
    x = rng.integers(-(1 << 40), 1 << 40, (20, 64))
    coefs = centroids.transform(x)
    assert (coefs == x @ centroids.hadamard()[0].T).all()
    assert [centroids.components(c) for c in coefs] == x.tolist()
    changes = (np.diff(centroids.hadamard()[0], axis=1) != 0).sum(axis=1)
    assert (np.diff(changes) >= 0).all()


@pytest.mark.parametrize("top", [2, 50, 1 << 20, 1 << 45])
def test_search_equals_all_distances(top):
    rng = np.random.default_rng(top)
    x, c = rng.integers(-top, top, (300, 64)), rng.integers(-top, top, (9, 64))
    c[7], c[8], x[:40] = c[2], c[1], c[rng.integers(0, 9, 40)]
    number, distance = centroids.nearest(centroids.transform(x), centroids.transform(c))
    every = ((x[:, None].astype(object) - c[None].astype(object)) ** 2).sum(axis=2)
    assert (number == np.argmin(every, axis=1)).all() and (distance == every.min(axis=1)).all()


def test_rounds_beside_plain_python(spark, sf_dir):
    frame = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    check(frame, [(r.vec_id, r.embedding) for r in frame.collect()])


def test_odd_rows(spark):
    rng = np.random.default_rng(5)
    one = [float(x) for x in rng.normal(0, 1, 64)]
    data = [(i, [float(x) for x in rng.normal(0, 3, 64)]) for i in range(30)]
    data += [(3, one), (3, one), (3, one), (None, one), (40, None), (41, []), (42, one[:63]), (43, [*one[:63], None]), (44, [*one[:63], math.nan]), (45, [*one[:63], math.inf])]
    data += [(52, [0.0] * 64), (53, [700_000.5] + [0.0] * 63)]
    frame = spark.createDataFrame([("x", i, e, 1) for i, e in data], SCHEMA).repartition(3)
    check(frame, data)
    for few in (0, 1, 5):
        check(spark.createDataFrame([("x", i, e, 1) for i, e in data[:few]], SCHEMA), data[:few])
    same = [(i, one) for i in range(20)]
    check(spark.createDataFrame([("x", i, e, 1) for i, e in same], SCHEMA), same)


def test_a_component_beyond_the_bound_is_refused(spark):
    frame = spark.createDataFrame([("x", 1, [1e16] + [0.0] * 63, 1)], SCHEMA)
    with pytest.raises(Exception, match="do not fit a long"):
        centroids.cluster(frame)
