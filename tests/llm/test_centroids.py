"""Clustering with bounds against exact rounds, and the odd cases."""

import hashlib

import numpy as np
import pytest

from seqloom.llm import centroids
from seqloom.llm.centroids import cluster, largest

SCHEMA = "vec_id long, embedding array<double>"


def plain(rows, dimension, k, rounds, seed="2:"):
    """Lloyd's rounds in Python integers; rows of (id, vector) that take part."""
    most = largest(dimension)
    vs = [(i, [int(np.floor(max(-most, min(most, 256 * x)))) for x in v]) for i, v in rows if v is not None and len(v) == dimension and all(x is not None and np.isfinite(x) for x in v)]
    h = lambda i: (i is None, hashlib.sha256(f"{seed}{i}".encode()).hexdigest() if i is not None else "")
    cs = [v for _, v in sorted(vs, key=lambda r: (h(r[0]), r[1]))[:k]]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    for turn in range(rounds + 1):
        own = [min(range(len(cs)), key=lambda c: (far(v, cs[c]), c)) for _, v in vs]
        if turn < rounds:
            for c in set(own):
                mine = [v for (_, v), o in zip(vs, own) if o == c]
                cs[c] = [sum(x) // len(mine) for x in zip(*mine)]
    return sorted(((i, o, far(v, cs[o])) for (i, v), o in zip(vs, own)), key=str), cs


def clouds(n, dimension, seed, spread=0.1):
    draw = np.random.default_rng(seed)
    middle = draw.normal(size=(6, dimension))
    return [(int(i), (middle[i % 6] + spread * draw.normal(size=dimension)).tolist()) for i in range(n)]


ODD = [(1001, None), (1002, []), (1003, [1.0]), (1004, [None, 1.0, 1.0, 1.0]), (1005, [float("nan")] * 4), (1006, [float("inf"), 0.0, 0.0, 0.0]), (1007, [0.0] * 4), (None, [0.5] * 4), (1008, [1e300, -1e300, 0.0, 1e-300])]


@pytest.mark.parametrize("rows,k,rounds", [
    (clouds(300, 4, 1), 7, 5), (clouds(300, 4, 2, 2.0), 12, 4), (clouds(40, 4, 3)[:5], 9, 3), (clouds(60, 4, 4) + ODD, 8, 5),
    ([(i, [float(i % 3), 0.0, 0.0, 0.0]) for i in range(60)], 5, 5),  # ties, equal vectors, centroids without any
    (clouds(20, 4, 5) * 2, 6, 3), ([(1, [2.0] * 4)], 3, 2),
])
def test_equals_exact_rounds(spark, rows, k, rounds):
    found, middle = cluster(spark.createDataFrame(rows, SCHEMA), dimension=4, k=k, rounds=rounds)
    want, cs = plain(rows, 4, k, rounds)
    assert sorted(((r.id, r.cluster, r.distance) for r in found.collect()), key=str) == want
    assert [r.centroid for r in middle.orderBy("cluster").collect()] == cs


def test_bounds_spare_scans(spark):
    rows = clouds(600, 8, 6)
    found, _ = cluster(spark.createDataFrame(rows, SCHEMA), dimension=8, k=6, rounds=8)
    assert found.where("scanned").count() < 300


def test_large_components_are_exact():
    draw = np.random.default_rng(1)
    x, c = (draw.integers(-largest(64), largest(64), size=(n, 64)) for n in (20, 7))
    want = [[sum((int(a) - int(b)) ** 2 for a, b in zip(v, w)) for w in c] for v in x]
    assert centroids.squared(x, c).tolist() == want
    small = x // (1 << 12)
    assert centroids.squared(small, c // (1 << 12)).tolist() == [[sum((int(a) - int(b)) ** 2 for a, b in zip(v, w)) for w in c // (1 << 12)] for v in small]


def test_no_vectors(spark):
    found, middle = cluster(spark.createDataFrame(ODD[:3], SCHEMA), dimension=4)
    assert found.count() == 0 and middle.count() == 0
    clash = spark.createDataFrame([(1, [0.0] * 4, "a")], "x long, id array<double>, cluster string")
    assert cluster(clash, id_col="x", vector_col="id", dimension=4)[0].count() == 1


def test_partitions_do_not_matter(spark):
    rows = spark.createDataFrame(clouds(200, 4, 7), SCHEMA)
    one, many = (sorted(map(tuple, cluster(rows.repartition(n), dimension=4, k=9)[0].drop("scanned").collect())) for n in (1, 13))
    assert one == many
