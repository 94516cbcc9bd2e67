"""Clustering, components and linear models over pixels. Every round is an aggregate whose result has as many rows as there are clusters or bands."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..graph import components as connected
from ..product import Product
from ..session import materialize, ship


FLOOR = 1e-4  # of a posterior in the sums of a mixture
TINY = 1e-9  # on the diagonals of covariances, for clusters of equal pixels


def _vector(bands: list[str]) -> list[Column]:
    return [F.col(b).cast("double") for b in bands]


def _nearest(bands: list[str], means: list[list[float]]) -> Column:
    """Index of the nearest mean, the lowest of equal ones."""
    far = lambda m: sum(((b - x) * (b - x) for b, x in zip(_vector(bands), m, strict=True)), F.lit(0.0))
    return F.array_min(F.array(*[F.struct(far(m).alias("d"), F.lit(k).alias("k")) for k, m in enumerate(means)]))["k"]


def _whole(bands: list[str]) -> Column:
    """Whether no band is missing."""
    there = F.lit(True)
    for b in bands:
        there = there & F.col(b).isNotNull()
    return there


def initial_means(p: Product, bands: list[str], k: int, seed: int) -> list[list[float]]:
    """k distinct pixels, first by a hash of place and seed. The first rows by that hash nearly always hold them; only a raster of few values is grouped."""
    place = F.struct(F.xxhash64("y", "x", F.lit(seed)).alias("h"), "y", "x")
    first = p.pixels.dropna(subset=bands).select(*bands, place.alias("o")).orderBy("o").limit(64 * k).collect()
    distinct = list(dict.fromkeys(tuple(float(r[b]) for b in bands) for r in first))
    if len(distinct) < k and len(first) == 64 * k:
        rows = p.pixels.dropna(subset=bands).groupBy(*bands).agg(F.min(place).alias("o")).orderBy("o").limit(k).collect()
        distinct = [tuple(float(r[b]) for b in bands) for r in rows]
    return [list(m) for m in distinct[:k]]


def kmeans(p: Product, bands: list[str], k: int, iterations: int = 30, seed: int = 31415, roi: Column | None = None, means: list[list[float]] | None = None) -> tuple[Product, list[list[float]]]:
    """Lloyd's algorithm from k pixels, or given means, to a standstill or the given rounds; clusters are numbered by size. Pixels outside the region, or with a missing band, get no class."""
    rows = materialize((p.pixels if roi is None else p.pixels.where(roi)).dropna(subset=bands).select("y", "x", *bands), "kmeans-pixels")
    means = [list(map(float, m)) for m in means] if means is not None else initial_means(p.with_pixels(rows), bands, k, seed)
    if not means:
        return p.with_pixels(p.pixels.select("y", "x", F.lit(None).cast("int").alias("class"))), []
    sizes: dict[int, int] = {}
    for _ in range(iterations):
        got = rows.groupBy(_nearest(bands, means).alias("k")).agg(*[F.avg(b).alias(b) for b in bands], F.count("*").alias("n")).collect()
        sizes = {r["k"]: r["n"] for r in got}
        new = [list(m) for m in means]
        for r in got:
            new[r["k"]] = [float(r[b]) for b in bands]
        moved = sum((a - b) ** 2 for m, n in zip(means, new, strict=True) for a, b in zip(m, n, strict=True))
        means = new
        if moved == 0:
            break
    order = sorted(range(len(means)), key=lambda i: -sizes.get(i, 0))
    means = [means[i] for i in order]
    inside = _whole(bands) if roi is None else _whole(bands) & F.coalesce(roi, F.lit(False))
    return p.with_pixels(p.pixels.select("y", "x", F.when(inside, _nearest(bands, means)).cast("int").alias("class"))), means


def gaussian_mixture(p: Product, bands: list[str], k: int, iterations: int = 30, seed: int = 31415) -> tuple[Product, list[float], np.ndarray, np.ndarray]:
    """Expectation maximisation from equal priors and unit covariances: each round sums responsibilities, weighted values and products in one aggregate.

    In the sums every cluster has FLOOR more of each pixel, before they are made to
    sum to one, so none runs empty and no covariance gets singular. Result: of each
    pixel the class, its posterior, and posterior0, posterior1, ... of all clusters
    (missing where a band is); priors, means, covariances. Clusters are ordered by
    prior, greatest first. Posteriors are exponentials less the largest exponent.
    """
    rows = materialize(p.pixels.dropna(subset=bands).select("y", "x", *bands), "mixture-pixels")
    d = len(bands)
    mean = np.array(initial_means(p.with_pixels(rows), bands, k, seed))
    k = len(mean)
    if not k:
        return p.with_pixels(p.pixels.select("y", "x", F.lit(None).cast("int").alias("class"), F.lit(None).cast("double").alias("posterior"))), [], mean, np.zeros((0, d, d))
    cov, prior = np.stack([np.eye(d)] * k), np.full(k, 1 / k)

    def posteriors() -> list[Column]:
        logs = []
        for c in range(k):
            inverse = np.linalg.inv(cov[c])
            delta = [v - float(m) for v, m in zip(_vector(bands), mean[c], strict=True)]
            square = sum((float(inverse[i, j]) * delta[i] * delta[j] for i in range(d) for j in range(d)), F.lit(0.0))
            logs.append(F.lit(float(math.log(max(prior[c], 1e-300)) - 0.5 * np.linalg.slogdet(cov[c])[1])) - 0.5 * square)
        top = F.greatest(*logs) if k > 1 else logs[0]
        e = [F.exp(x - top) for x in logs]
        s = sum(e, F.lit(0.0))
        return [x / s for x in e]

    for _ in range(iterations):
        with_r = rows.select(*bands, *[((r + FLOOR) / (1 + k * FLOOR)).alias(f"r{c}") for c, r in enumerate(posteriors())])
        aggs = [F.sum(f"r{c}").alias(f"n{c}") for c in range(k)]
        aggs += [F.sum(F.col(f"r{c}") * F.col(b)).alias(f"s{c}_{i}") for c in range(k) for i, b in enumerate(bands)]
        aggs += [F.sum(F.col(f"r{c}") * F.col(bands[i]) * F.col(bands[j])).alias(f"q{c}_{i}_{j}") for c in range(k) for i in range(d) for j in range(i, d)]
        got = with_r.agg(*aggs).first()
        n = np.array([got[f"n{c}"] for c in range(k)])
        mean = np.array([[got[f"s{c}_{i}"] / n[c] for i in range(d)] for c in range(k)])
        cov = np.array([[[got[f"q{c}_{min(i, j)}_{max(i, j)}"] / n[c] - mean[c, i] * mean[c, j] for j in range(d)] for i in range(d)] for c in range(k)]) + TINY * np.eye(d)
        prior = n / n.sum()
    order = np.argsort(-prior, kind="stable")
    prior, mean, cov = prior[order], mean[order], cov[order]
    each = p.pixels.select("y", "x", *[F.when(_whole(bands), r).alias(f"posterior{c}") for c, r in enumerate(posteriors())])
    best = F.array_max(F.array(*[F.struct(F.col(f"posterior{c}").alias("p"), F.lit(-c).alias("c")) for c in range(k)]))
    out = each.withColumn("_b", F.when(F.col("posterior0").isNotNull(), best))
    return p.with_pixels(out.select("y", "x", (-F.col("_b.c")).cast("int").alias("class"), F.col("_b.p").alias("posterior"), *[f"posterior{c}" for c in range(k)])), prior.tolist(), mean, cov


def pca(p: Product, bands: list[str], components: int, subtract_mean: bool = False) -> tuple[Product, np.ndarray]:
    """Principal components of the bands' population covariance, each less its minimum; the largest entry of each vector is positive. Where a band is missing so are they."""
    source = p.pixels.select("y", "x", *[F.when(_whole(bands), F.col(b)).alias(b) for b in bands])  # sums leave out missing samples
    if subtract_mean:
        pixel_mean = sum((F.col(b) for b in bands), F.lit(0.0)) / len(bands)
        source = source.select("y", "x", *[(F.col(b) - pixel_mean).alias(b) for b in bands])
    got = source.agg(*[F.covar_pop(a, b).alias(f"c{i}_{j}") for i, a in enumerate(bands) for j, b in enumerate(bands) if i <= j]).first()
    cov = np.array([[got[f"c{min(i, j)}_{max(i, j)}"] or 0.0 for j in range(len(bands))] for i in range(len(bands))])
    values, vectors = np.linalg.eigh(cov)
    order = np.argsort(-values)[:components]
    vectors = vectors[:, order]
    vectors = vectors * np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(vectors.shape[1])])
    pcs = [sum((F.col(b) * float(vectors[i, c]) for i, b in enumerate(bands)), F.lit(0.0)).alias(f"pc{c}") for c in range(vectors.shape[1])]
    out = source.select("y", "x", *pcs)
    low = out.agg(*[F.min(f"pc{c}").alias(f"m{c}") for c in range(vectors.shape[1])]).first()
    return p.with_pixels(out.select("y", "x", *[(F.col(f"pc{c}") - F.lit(low[f"m{c}"])).alias(f"pc{c}") for c in range(vectors.shape[1])])), values[order]


def unmix(p: Product, bands: list[str], endmembers: np.ndarray, sum_to_one: bool = False) -> Product:
    """Least squares abundances of endmembers (members, bands): a fixed matrix times the pixel's bands; with sum_to_one the constraint is part of it."""
    e = np.asarray(endmembers, float)
    inverse = np.linalg.pinv(e.T)
    shift = np.zeros(len(e))
    if sum_to_one:
        g = np.linalg.inv(e @ e.T)
        one = np.ones(len(e))
        s = g @ one / (one @ g @ one)
        inverse, shift = inverse - np.outer(s, one @ inverse), s
    out = [(sum((float(inverse[m, i]) * F.col(b) for i, b in enumerate(bands)), F.lit(0.0)) + float(shift[m])).alias(f"abundance{m}") for m in range(len(e))]
    return p.select(*out)


FACES = 6  # members up to which every face of the simplex is a Column


def simplex_fit(v: np.ndarray, e: np.ndarray, rounds: int = 200) -> np.ndarray:
    """For each row of v (rows, bands) the weights of e (members, bands), not negative and summing to one, with the least squared error.

    An active-set search: from the nearest member on, the best point of the face in
    use is gone to as far as weights stay positive, members that fall to 0 leave the
    face, and the one by which the error falls fastest joins it, until none does. Rows
    that use the same face are solved together.
    """
    n, m = len(v), len(e)
    gram, cross = e @ e.T, v @ e.T
    a, used = np.zeros((n, m)), np.zeros((n, m), bool)
    first = (np.diag(gram)[None, :] - 2 * cross).argmin(axis=1)
    a[np.arange(n), first] = 1
    used[np.arange(n), first] = True
    open_ = np.ones(n, bool)
    scale = max(float(np.abs(gram).max(initial=0)), float(np.abs(cross).max(initial=0)), 1e-300)
    for _ in range(rounds * m):
        at = np.flatnonzero(open_)
        if not len(at):
            break
        faces, which = np.unique(used[at], axis=0, return_inverse=True)
        for k, face in enumerate(faces):
            rows, members = at[which.ravel() == k], np.flatnonzero(face)
            size = len(members)
            system = np.zeros((size + 1, size + 1))
            system[:size, :size], system[:size, size], system[size, :size] = gram[np.ix_(members, members)], 1, 1
            z = np.linalg.lstsq(system, np.concatenate([cross[np.ix_(rows, members)].T, np.ones((1, len(rows)))]), rcond=None)[0][:size].T
            now = a[np.ix_(rows, members)]
            low = z <= 1e-13
            step = np.where(low, now / np.where(low, np.maximum(now - z, 1e-300), 1), np.inf).min(axis=1)
            short = step < 1
            moved = np.where(short[:, None], now + np.minimum(step, 1)[:, None] * (z - now), z)
            moved[low & (moved <= 1e-13)] = 0
            a[np.ix_(rows, members)] = moved
            used[np.ix_(rows, members)] &= ~(short[:, None] & low & (moved == 0))
            whole = rows[~short]
            slope = a[whole] @ gram - cross[whole]
            level = (slope * a[whole]).sum(axis=1)  # that of the face's members
            gain = np.where(used[whole], 0, slope - level[:, None])
            best = gain.argmin(axis=1)
            better = gain[np.arange(len(whole)), best] < -1e-11 * scale
            used[whole[better], best[better]] = True
            open_[whole[~better]] = False
    return a


def unmix_fully(p: Product, bands: list[str], endmembers: np.ndarray) -> Product:
    """Least squares abundances that are not negative and sum to one; missing where a band is.

    The best point of the simplex is that of one of its faces: for each set of
    members the constrained solution is a fixed linear map, so up to FACES members
    all 2^m - 1 of them are Columns, and the feasible one with the least error is
    taken. For more members the same point is looked for face by face
    (simplex_fit(), in Arrow batches).
    """
    e = np.asarray(endmembers, float)
    if len(e) > FACES:
        names = [f"abundance{k}" for k in range(len(e))]

        def run(batches):
            for pdf in batches:
                a = np.full((len(pdf), len(e)), np.nan)
                v = pdf[bands].to_numpy(float)
                there = ~np.isnan(v).any(axis=1)
                a[there] = simplex_fit(v[there], e)
                yield pd.DataFrame({"y": pdf["y"], "x": pdf["x"]} | dict(zip(names, a.T, strict=True)))

        ship(p.pixels.sparkSession)
        found = p.pixels.select("y", "x", *[F.col(b).cast("double").alias(b) for b in bands]).mapInPandas(run, "y long, x long, " + ", ".join(f"{n} double" for n in names))
        return p.with_pixels(found.select("y", "x", *[F.when(~F.isnan(n), F.col(n)).alias(n) for n in names]))
    options = []
    for face in range(1, 1 << len(e)):
        members = [k for k in range(len(e)) if face >> k & 1]
        sub, one = e[members], np.ones(len(members))
        g = np.linalg.pinv(sub @ sub.T)
        s = g @ one / (one @ g @ one)
        inverse = np.linalg.pinv(sub.T)
        inverse = inverse - np.outer(s, one @ inverse)
        a = {k: sum((float(inverse[r, i]) * F.col(b) for i, b in enumerate(bands)), F.lit(float(s[r]))) for r, k in enumerate(members)}
        ok = F.lit(True)
        for c in a.values():
            ok = ok & (c >= -1e-12)
        gap = [F.col(b) - sum((float(e[k, i]) * c for k, c in a.items()), F.lit(0.0)) for i, b in enumerate(bands)]
        error = sum((x * x for x in gap), F.lit(0.0))
        options.append(F.struct(F.when(ok, error).otherwise(F.lit(float("inf"))).alias("error"), F.array(*[F.greatest(a[k], F.lit(0.0)) if k in a else F.lit(0.0) for k in range(len(e))]).alias("a")))
    there = F.lit(True)
    for b in bands:
        there = there & F.col(b).isNotNull()
    best = F.when(there, F.array_min(F.array(*options))["a"])
    return p.with_pixels(p.pixels.select("y", "x", best.alias("_a")).select("y", "x", *[F.get("_a", F.lit(k)).alias(f"abundance{k}") for k in range(len(e))]))


def components(p: Product, mask: Column) -> DataFrame:
    """y, x and label (the least y * width + x of its component) of the pixels of a mask, eight neighbours. Runs along lines are joined first; links between runs become components by stars, whose rounds follow the logarithm of a shape's length."""
    rows = p.pixels.where(mask).select("y", "x")
    by = Window.partitionBy("y").orderBy("x")
    rows = rows.withColumn("g", F.col("x") - F.row_number().over(by))
    runs = rows.groupBy("y", "g").agg(F.min("x").alias("a"), F.max("x").alias("b"))
    runs = runs.select("y", "g", "a", "b", (F.col("y") * p.width + F.col("a")).alias("id"))
    step = 64  # runs are cut to buckets of columns for the join
    cut = lambda df, low, high: df.withColumn("bucket", F.explode(F.sequence(F.floor((F.col(low) - 1) / step), F.floor((F.col(high) + 1) / step))))
    up = cut(runs, "a", "b")
    down = up.select((F.col("y") + 1).alias("y"), F.col("a").alias("a2"), F.col("b").alias("b2"), F.col("id").alias("id2"), "bucket")
    edges = up.join(down, ["y", "bucket"]).where((F.col("a2") <= F.col("b") + 1) & (F.col("b2") >= F.col("a") - 1)).select("id", "id2").distinct()
    roots = connected(edges.select(F.col("id").alias("a"), F.col("id2").alias("b")))
    labels = runs.join(roots, F.col("id") == F.col("rid"), "left").select("y", "g", F.coalesce("root", "id").alias("label"))
    return rows.join(labels, ["y", "g"]).select("y", "x", "label")


def objects(p: Product, mask: Column, value: str, least: float, most: float) -> DataFrame:
    """Components whose bounding box has a diagonal (in pixels) within limits, with box, size and summed value."""
    found = components(p, mask).join(p.pixels.select("y", "x", F.col(value).alias("v")), ["y", "x"])
    found = found.groupBy("label").agg(F.min("y").alias("y0"), F.max("y").alias("y1"), F.min("x").alias("x0"), F.max("x").alias("x1"), F.count("*").alias("n"), F.sum("v").alias("total"))
    h, w = F.col("y1") - F.col("y0") + 1, F.col("x1") - F.col("x0") + 1
    return found.withColumn("diagonal", F.sqrt((h * h + w * w).cast("double"))).where(F.col("diagonal").between(least, most))


def drop_small(p: Product, mask: Column, pixels: int) -> DataFrame:
    """Pixels of the components with at least so many pixels."""
    found = components(p, mask)
    large = found.groupBy("label").agg(F.count("*").alias("n")).where(F.col("n") >= pixels)
    return found.join(large, "label").select("y", "x", "label", "n")
