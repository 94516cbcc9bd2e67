import hashlib

import numpy as np
import pytest
from rasterlake.llm import centroids as c


def brute(rows, k=8, rounds=10, dims=64, seed=3):
    """Sorted (vec_id, cluster, distance) and centroids, in Python's own integers."""
    kept = []
    for key, v in rows:
        if v is not None and len(v) == dims and all(x is not None and np.isfinite(x) for x in v):
            kept.append((key, [int(np.floor(1024 * float(x))) for x in v]))
    named = sorted((x for x in kept if x[0] is not None), key=lambda x: hashlib.sha256(f"{seed}:{x[0]}".encode()).hexdigest())
    means = [v for _, v in named[:k]]

    def assign():
        out = []
        for key, v in kept:
            d = [sum((a - b) ** 2 for a, b in zip(v, m, strict=True)) for m in means]
            out.append((key, d.index(min(d)), min(d)))
        return out

    for _ in range(rounds):
        at = assign()
        for j in range(len(means)):
            mine = [v for (_, v), (_, cluster, _) in zip(kept, at, strict=True) if cluster == j]
            if mine:
                means[j] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    return sorted(assign(), key=str), means


def test_nearest_is_exact_and_prunes():
    rng = np.random.default_rng(1)
    centroids = rng.integers(-9, 9, (40, 5)) * np.arange(1, 41)[:, None]
    centroids[7] = centroids[3]  # a tie
    x = centroids[rng.integers(0, 40, 500)] + rng.integers(-20, 21, (500, 5))
    x[:40] = centroids
    best, distance, compared = c.nearest(x.astype(np.int32), centroids)
    d = ((x[:, None, :] - centroids[None]) ** 2).sum(axis=2)
    assert (best == d.argmin(axis=1)).all() and (distance == d.min(axis=1)).all()
    assert compared < 0.6 * d.size  # about half lie outside the annuli
    x = rng.integers(-9, 9, (500, 5)) * rng.integers(1, 41, 500)[:, None]  # far from all centroids
    best, distance, _ = c.nearest(x.astype(np.int32), centroids)
    d = ((x[:, None, :] - centroids[None]) ** 2).sum(axis=2)
    assert (best == d.argmin(axis=1)).all() and (distance == d.min(axis=1)).all()


def test_border_of_the_annulus():
    """Both centroids lie on one ray with the vector: the bound equals the difference of norms."""
    best, distance, _ = c.nearest(np.array([[5, 0]], np.int32), np.array([[8, 0], [2, 0], [8, 0]]))
    assert best.tolist() == [0] and distance.tolist() == [9]
    best, _, _ = c.nearest(np.array([[5, 0]], np.int32), np.array([[2, 0], [8, 0]]))
    assert best.tolist() == [0]


@pytest.mark.parametrize("most", [1, 1 << 20, 1 << 27])
def test_large_components(most):
    rng = np.random.default_rng(2)
    x = rng.integers(-most, most + 1, (60, 64)).astype(np.int32)
    best, distance, _ = c.nearest(x, x[:9].astype(np.int64))
    exact = [[sum((int(a) - int(b)) ** 2 for a, b in zip(v, m, strict=True)) for m in x[:9]] for v in x]
    assert distance.tolist() == [min(d) for d in exact] and best.tolist() == [d.index(min(d)) for d in exact]


def test_against_brute_force(spark):
    rng = np.random.default_rng(3)
    rows = [(i, (rng.normal(size=64) * rng.uniform(0.1, 3)).astype(np.float32).tolist()) for i in range(150)]
    rows += [(200 + i, rows[5][1]) for i in range(60)] + [rows[7], rows[7], (None, rows[9][1])]
    rows += [(900, None), (901, []), (902, [1.0] * 63), (903, [None] + [1.0] * 63), (904, [float("nan")] + [1.0] * 63), (905, [float("-inf")] + [1.0] * 63)]
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<float>, cluster int, distance string")
    found, means = c.annulus_clusters(df)
    wanted, exact = brute(rows)
    assert sorted(((r["r"]["vec_id"], r["cluster"], r["distance"]) for r in found.collect()), key=str) == wanted
    assert means.tolist() == exact
    assert found.select("r.*").columns == ["vec_id", "cluster", "distance"]


def test_few_and_no_vectors(spark):
    kind = "vec_id long, embedding array<double>"
    three = spark.createDataFrame([(i, [float(i % 2)] * 64) for i in range(3)], kind)
    found, means = c.annulus_clusters(three)
    assert len(means) == 3 and sorted(r["distance"] for r in found.collect()) == [0, 0, 0]
    found, means = c.annulus_clusters(three.limit(0))
    assert found.collect() == [] and means.shape == (0, 64)
    with pytest.raises(Exception, match="too large"):
        c.annulus_clusters(spark.createDataFrame([(1, [1e12] * 64)], kind))
