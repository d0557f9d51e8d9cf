"""Clustering and hard negatives against brute force in integers, with odd rows."""

import hashlib
import math
import random

import numpy as np
import pytest

from folioflow.llm import clustering, hard_negatives
from folioflow.llm.queries import op12_clustering, op13_hard_negatives

KINDS = "vec_id long, embedding array<float>, label int, x int, row string, cluster int, own int"


def rows(dimensions=64, n=400):
    rng = random.Random(5)
    centres = [[rng.gauss(0, 0.2) for _ in range(dimensions)] for _ in range(5)]
    out = []
    for i in range(n):
        c = rng.choice(centres)
        out.append((i, [float(np.float32(x + rng.gauss(0, 0.1))) for x in c], rng.choice([0, 1, 2])))
    same = out[100][1]
    # many equal vectors, ties at either end, repeated rows, odd lengths, nulls and what is not finite
    out += [(1000 + i, same, i % 3) for i in range(60)] + [out[7], out[7], out[200], out[200]]
    out += [(2000, None, 1), (2001, [], 1), (2002, same[:-1], 1), (2003, [*same, 1.0], 1), (2004, [None, *same[1:]], 1), (2005, [math.nan, *same[1:]], 1), (2006, [math.inf, *same[1:]], 1), (2007, [-math.inf, *same[1:]], 2)]
    out += [(None, same, 1), (2100, same, None), (2200, [1e30, *same[1:]], 0), (-100, [-x for x in same], 0), (2300, [0.0] * dimensions, 1), (2301, [300.0, *same[1:]], 2)]
    return out


def frame(spark, data):
    return spark.createDataFrame([(*r, 1, "a", 2, 3) for r in data], KINDS).repartition(3)


def scaled(vector, scale, bits):
    if vector is None or any(x is None or not abs(x) < 2**bits / scale for x in vector):
        return None
    return [math.floor(scale * x) for x in vector]


def brute_clusters(data):
    kept = [(i, v) for i, e, _ in data if e is not None and len(e) == 64 and (v := scaled(e, 1024, 27))]
    starts = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest(), r[1]))[:8]
    centroids = [list(v) for _, v in starts]
    place = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), k) for k, c in enumerate(centroids))
    for _ in range(10):
        at = [place(v)[1] for _, v in kept]
        for k in range(len(centroids)):
            if own := [v for (_, v), a in zip(kept, at, strict=True) if a == k]:
                centroids[k] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    found = [place(v) for _, v in kept]
    inertia = [sum(d for d, a in found if a == k) for k in range(len(centroids))]
    return [(i, k, d, inertia[k], sum(inertia), hashlib.sha256(",".join(map(str, centroids[k])).encode()).hexdigest()) for (i, _), (d, k) in zip(kept, found, strict=True)]


def brute_negatives(data):
    kept = [(i, (lab + 1) % 10 if i is not None and i % 7 == 0 else lab, v) for i, e, lab in data if lab is not None and (v := scaled(e, 256, 24)) is not None]
    out = []
    for i, label, v in kept:
        if i is None or i % 100:
            continue
        order = sorted(((-sum(a * b for a, b in zip(v, w, strict=False)), j is None, j or 0, j, lab) for j, lab, w in kept), key=lambda r: r[:3])
        for minus, _, _, j, _ in [r for r in order if r[4] == label and r[3] != i][:5]:
            found = [r for r in order if r[4] != label and 30 * -minus <= 100 * -r[0] <= 90 * -minus][:10]
            out += [(i, j, k + 1, r[3], -minus, -r[0]) for k, r in enumerate(found)]
    return out


def ordered(found):
    return sorted(found, key=lambda r: [(x is not None, x) if not isinstance(x, str) else (True, x) for x in r])


def test_clusters(spark):
    data = rows()
    got = clustering.cluster_vectors(frame(spark, data)).collect()
    assert ordered(tuple(r)[:6] for r in got) == ordered(brute_clusters(data))
    assert all(1 <= r.n_looked <= 8 for r in got)


def test_pivots_spare_distances(spark):
    """Clusters far apart: most centroids are never looked at."""
    rng = random.Random(1)
    data = [(i, [float(np.float32((i % 8 == j) * 4 + rng.gauss(0, 0.05))) for j in range(64)], 0) for i in range(400)]
    got = clustering.cluster_vectors(frame(spark, data)).collect()
    assert ordered(tuple(r)[:6] for r in got) == ordered(brute_clusters(data))
    assert sum(r.n_looked for r in got) < 0.5 * 8 * len(got)


@pytest.mark.parametrize("n", [0, 1, 5])
def test_few_vectors(spark, n):
    data = rows()[:n]
    got = clustering.cluster_vectors(frame(spark, data)).collect()
    assert ordered(tuple(r)[:6] for r in got) == ordered(brute_clusters(data))
    assert hard_negatives.mine_negatives(frame(spark, data)).count() == len(brute_negatives(data))


def test_all_vectors_equal(spark):
    data = [(i, [0.5] * 64, 0) for i in range(20)]
    got = clustering.cluster_vectors(frame(spark, data)).collect()
    assert {(r.cluster, r.distance, r.inertia, r.n_looked) for r in got} == {(0, 0, 0, 8)}


def test_bounds_are_never_too_high():
    rng = np.random.default_rng(3)
    for size in (3, 1 << 10, 1 << 27):
        x, pivots, centroids = (rng.integers(-size, size, (n, 64)) for n in (500, 8, 8))
        x[:8], centroids[4] = pivots, pivots[4]
        away = np.sqrt(np.stack([clustering.distances(x, p) for p in pivots], axis=1).astype(float))
        exact = np.stack([clustering.distances(x, c) for c in centroids], axis=1)
        assert (clustering.lower_bounds(away, pivots, centroids) <= exact).all()


@pytest.mark.parametrize("sizes", [(8192, 8192, 4096, 512), (50, 3, 16, 7)])
def test_hard_negatives(spark, monkeypatch, sizes):
    for name, value in zip(("ROWS", "ANCHORS", "TABLES", "PIECE"), sizes, strict=True):
        monkeypatch.setattr(hard_negatives, name, value)
    data = rows()
    got = [tuple(r) for r in hard_negatives.mine_negatives(frame(spark, data)).collect()]
    assert got and ordered(got) == ordered(brute_negatives(data))


def test_lookups_are_inner_products():
    rng = np.random.default_rng(4)
    for size, dimensions in ((1, 8), (300, 64), (1 << 24, 13)):
        a, b = (rng.integers(-size, size, (20, dimensions)) for _ in range(2))
        packed = [hard_negatives.pack_planes(v) for v in a]
        assert all((hard_negatives.unpack_planes(*p)[:dimensions] == v).all() for p, v in zip(packed, a, strict=True))
        wide = np.pad(b, ((0, 0), (0, -dimensions % 8)))
        for (bits, planes), v in zip(packed, a, strict=True):
            got = hard_negatives.scores(hard_negatives.subset_sums(wide), np.frombuffer(planes, np.uint8).reshape(1, bits, -1))
            assert (got[0] == b @ v).all()


@pytest.mark.parametrize("module, query", [(clustering, op12_clustering), (hard_negatives, op13_hard_negatives)])
def test_queries_equal_their_sql(spark, small, oracle, module, query):
    got = query(spark, small)
    cursor = oracle.execute(module.ORACLE)
    names = [c[0] for c in cursor.description]
    want = cursor.fetchall()
    assert got.columns == names and want and sorted(tuple(r) for r in got.collect()) == sorted(want)
