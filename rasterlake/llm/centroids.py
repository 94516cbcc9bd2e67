"""Operator 11: exact k-means by annulus search.

A vector's distance to any centroid is an upper bound of its distance to the
nearest one, and a centroid whose norm differs from the vector's by more than
that bound can't be nearer (triangle inequality). So centroids are sorted by
norm, each vector takes the one whose norm is closest to its own as a bound,
finds the annulus of norms within that bound by binary search, and is compared
exactly with the centroids inside, those on the border included.

Vectors are written once as integers; a round reads them, and gives each task's
counts and sums for each centroid, so what is shuffled doesn't grow with the
vectors but with the tasks, and the driver holds the k centroids alone.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, ship
from .vectors import as_binary, integer_vectors, products, runs, to_matrix

CLUSTERS, ROUNDS, SCALE, DIMS, SEED = 8, 10, 1024, 64, 3
ROWS = 8192  # vectors that a task compares at once


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Of integer vectors x (n, d): the number of the nearest centroid (of equally near ones the smallest), its squared distance, and how many comparisons that took."""
    n, k = len(x), len(centroids)
    square = (x.astype(np.int64) ** 2).sum(axis=1)
    own = (centroids.astype(np.int64) ** 2).sum(axis=1)
    order = np.lexsort((np.arange(k), own))
    norms = np.sqrt(own[order].astype(np.float64))
    norm = np.sqrt(square.astype(np.float64))
    right = np.clip(np.searchsorted(norms, norm), 1, k - 1) if k > 1 else np.zeros(n, np.int64)
    guess = np.where(np.abs(norms[right] - norm) < np.abs(norms[right - 1] - norm), right, right - 1) if k > 1 else right
    best, distance, compared = np.full(n, k, np.int64), np.full(n, np.iinfo(np.int64).max), 0

    def compare(rows: np.ndarray, at: int) -> None:
        nonlocal compared
        compared += len(rows)
        c = int(order[at])
        d = square[rows] + own[c] - 2 * products(x[rows], centroids[c : c + 1])[:, 0]
        closer = (d < distance[rows]) | ((d == distance[rows]) & (c < best[rows]))
        best[rows[closer]], distance[rows[closer]] = c, d[closer]

    for at in range(k):
        compare(np.flatnonzero(guess == at), at)
    # Square roots are rounded: the annulus is widened by far more than that, so that no centroid on its border is lost.
    bound = np.sqrt(distance.astype(np.float64))
    slack = 1e-9 * (norm + bound + 1)
    low, high = np.searchsorted(norms, norm - bound - slack, "left"), np.searchsorted(norms, norm + bound + slack, "right")
    for at in range(k):
        compare(np.flatnonzero((low <= at) & (at < high) & (guess != at)), at)
    return best, distance, compared


def _integers(scale: int, dims: int):
    def run(batches):
        for batch in runs(batches, ROWS):
            keep, x, length = integer_vectors(batch.column("v"), scale, dims)
            yield pa.record_batch([batch.column("r").take(pa.array(keep)), as_binary(x, length)], ["r", "v"])

    return run


def _partial(centroids: np.ndarray):
    """One row a task and centroid: cluster, n, and sums of its vectors' components."""

    def run(batches):
        k, dims = centroids.shape
        n, sums = np.zeros(k, np.int64), np.zeros((k, dims), np.int64)
        for batch in runs(batches, ROWS):
            x = to_matrix(batch.column("v"), dims)
            best, _, _ = nearest(x, centroids)
            n += np.bincount(best, minlength=k)
            for c in np.flatnonzero(n).tolist():
                sums[c] += x[best == c].sum(axis=0, dtype=np.int64)
        full = np.flatnonzero(n)
        yield pa.record_batch([pa.array(full.astype(np.int32)), pa.array(n[full]), pa.array(sums[full].tolist(), pa.list_(pa.int64()))], ["cluster", "n", "sums"])

    return run


def _assigned(centroids: np.ndarray):
    def run(batches):
        for batch in runs(batches, ROWS):
            best, distance, _ = nearest(to_matrix(batch.column("v"), centroids.shape[1]), centroids)
            yield pa.record_batch([batch.column("r"), pa.array(best.astype(np.int32)), pa.array(distance)], ["r", "cluster", "distance"])

    return run


def assign(vectors: DataFrame, centroids: np.ndarray) -> DataFrame:
    """r, cluster and distance for vectors (r, v) as integer_vectors() makes them: the nearest of any number of given centroids."""
    kind = vectors.schema["r"].dataType.simpleString()
    return vectors.mapInArrow(_assigned(centroids), f"r {kind}, cluster int, distance long")


def _step(vectors: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The floors of the means of the vectors nearest to each centroid; centroids that none is nearest to stay."""
    tasks = vectors.select("v").mapInArrow(_partial(centroids), "cluster int, n long, sums array<long>")
    counts = tasks.select("cluster", F.posexplode(F.array_append("sums", F.col("n"))).alias("place", "s"))
    out = centroids.astype(np.int64).copy()
    found = {(r["cluster"], r["place"]): r["s"] for r in counts.groupBy("cluster", "place").agg(F.sum("s").alias("s")).collect()}  # k * (dims + 1) rows
    dims = centroids.shape[1]
    for c in {c for c, _ in found}:
        out[c] = [found[c, i] // found[c, dims] for i in range(dims)]
    return out


def annulus_clusters(df: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS, scale: int = SCALE, dims: int = DIMS, seed: int = SEED, key: str = "vec_id", vector: str = "embedding") -> tuple[DataFrame, np.ndarray]:
    """(r, cluster, distance) for the rows of df that are kept, r being the struct of the other columns, and the final centroids (k, dims).

    Kept are vectors with exactly `dims` components, none null or non-finite;
    their components become floor(scale * x). The first centroids are the k kept
    vectors with the least sha256 of `seed:key` in lower-case hex (rows without a
    key come last; of equal keys the one with the lesser bytes comes first); with fewer than
    k vectors there are as many centroids. Repeated rows count, and are given,
    as often as they occur; equally near centroids give the smaller number. A
    table without kept vectors gives no rows. A component that leaves the range
    in which distances fit in a long is an error. df's columns may have any name.
    """
    ship(df.sparkSession)
    rest = [c for c in df.columns if c != vector]
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in rest]).alias("r"), F.col(f"`{vector}`").alias("v"))
    kind = rows.schema["r"].dataType.simpleString()
    vectors = materialize(rows.mapInArrow(_integers(scale, dims), f"r {kind}, v binary"), "vectors")
    rank = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("r").getField(key).cast("string")), 256)
    first = vectors.select(rank.alias("h"), "v")
    first = first.orderBy(F.col("h").asc_nulls_last(), "v").limit(k).collect()
    centroids = np.array([np.frombuffer(x["v"], "<i4") for x in first], np.int64).reshape(len(first), dims)
    if not len(first):
        return vectors.select("r", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")), centroids
    for _ in range(rounds):
        new = _step(vectors, centroids)
        if (new == centroids).all():
            break  # later rounds would give the same
        centroids = new
    return assign(vectors, centroids), centroids


def op11_annulus_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    found, centroids = annulus_clusters(df)
    found = materialize(found.select(F.col("r.vec_id").alias("vec_id"), "cluster", "distance"), "clusters")
    sums = {r["cluster"]: r["s"] for r in found.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}  # one row a centroid
    names = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centroids]
    per = [(c, int(sums.get(c, 0)), int(sum(sums.values())), name) for c, name in enumerate(names)]
    per = spark.createDataFrame(per, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(per), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")  # k rows are broadcast


def _sql() -> str:
    """k-means by SQL: each round is a step of its own, as the rounds are few."""
    square = "list_sum(list_transform(range(1, 65), lambda i: (v[i] - m[i]) * (v[i] - m[i])))"
    step = f"""a{{r}} as (select vec_id, v, rid, arg_min(c, struct_pack(d := d, c := c)) as c, min(d) as d from (select vec_id, v, rid, c, cast({square} as bigint) as d from vs, m{{r}}) group by all),
s{{r}} as (select c, i, sum(v[i]) as s, count(*) as n from a{{r}}, (select unnest(range(1, 65)) as i) group by c, i),
m{{n}} as (select c, coalesce(new, m) as m from m{{r}} left join (select c, list(cast((s - ((s % n) + n) % n) // n as bigint) order by i) as new from s{{r}} group by c) using (c)),
"""
    return f"""
with vs as (select vec_id, list_transform(embedding, lambda x: cast(floor(1024 * cast(x as double)) as bigint)) as v, row_number() over () as rid from embeddings where len(embedding) = 64 and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = 64),
m0 as (select row_number() over (order by sha256('3:' || vec_id)) - 1 as c, v as m from vs order by sha256('3:' || vec_id) limit 8),
{"".join(step.format(r=r, n=r + 1) for r in range(ROUNDS))}last as (select vec_id, rid, arg_min(c, struct_pack(d := d, c := c)) as c, min(d) as d from (select vec_id, rid, c, cast({square} as bigint) as d from vs, m{ROUNDS}) group by all),
per as (select c, sum(d) as s from last group by c)
select vec_id, cast(c as integer) as cluster, d as distance, cast(per.s as bigint) as cluster_inertia, cast((select sum(d) from last) as bigint) as inertia, sha256(array_to_string(m, ',')) as centroid_sha256
from last join per using (c) join m{ROUNDS} using (c)
"""


OP11_SQL = _sql()
