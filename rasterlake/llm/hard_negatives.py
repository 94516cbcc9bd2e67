"""Operator 12: hard negatives by norm-bucketed search.

An anchor's inner product with a candidate is at most the product of their norms
(Cauchy-Schwarz). Candidates come to a group of anchors in order of norm, the
largest first, and are taken in buckets: a bucket whose largest norm can't bring
an anchor to the lower limit of its window, nor beyond the score that is its
k-th best so far, is skipped for that anchor, and once no anchor of the group is
left, so are all later buckets. The same limit, at the groups' least need, keeps
short candidates out of the shuffle.

Two searches follow each other: the best rows of the anchor's own label are its
positives, and each positive's score opens a window for rows of other labels.
Anchors are dealt into groups that a task can hold, candidates stream past them,
in as many slices as tasks are wanted; what the slices find is merged by rank.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize, ship
from .vectors import as_binary, integer_vectors, products, runs, to_matrix

SCALE, POSITIVES, NEGATIVES, LOW, HIGH = 256, 5, 5, 80, 100
GROUP = 8192  # anchors that a task holds at once
BUCKET = 256  # candidates of a bucket
CLASSES = 32  # of anchors by the norm that a candidate needs at least
NONE = np.iinfo(np.int64).max  # stands for a null id, after all others
LEAST = np.iinfo(np.int64).min


class Search:
    """The k best candidates for each window of each anchor of a group; candidates come in falling order of norm."""

    def __init__(self, k: int, same: bool):
        self.k, self.same, self.parts, self.over, self.compared = k, same, [], False, 0

    def add(self, anchors: pa.RecordBatch) -> None:
        self.parts.append(anchors)

    def start(self) -> None:
        table = pa.Table.from_batches(self.parts).combine_chunks()
        self.parts = []
        self.rid, self.id, self.label = (np.asarray(pc.fill_null(table.column(c), NONE)) for c in ("rid", "id", "label"))
        self.x = to_matrix(table.column("v").combine_chunks())
        self.norm = np.sqrt(np.asarray(table.column("norm2")).astype(np.float64))
        windows = table.column("windows").combine_chunks()
        count = np.asarray(pc.list_value_length(windows)).astype(np.int64)
        flat, width = pc.list_flatten(windows), int(count.max(initial=0))
        there = np.arange(width) < count[:, None]
        self.low, self.high = np.full(there.shape, NONE), np.full(there.shape, LEAST)  # no score lies in a window that isn't there
        self.low[there], self.high[there] = np.asarray(flat.field("low")), np.asarray(flat.field("high"))
        shape = (len(self.rid), width, self.k)
        self.score, self.found, self.n = np.full(shape, LEAST), np.full(shape, NONE), np.zeros(shape[:2], np.int64)

    def need(self) -> np.ndarray:
        """The least score of use, for each window: its lower limit, or the k-th best so far."""
        return np.maximum(self.low, np.where(self.n == self.k, self.score[:, :, -1], LEAST))

    def meet(self, bucket: pa.RecordBatch) -> None:
        if self.parts:
            self.start()
        if self.over or not len(self.rid):
            return
        norm = float(bucket.column("norm2")[0].as_py()) ** 0.5
        need = self.need().min(axis=1)
        live = np.flatnonzero(self.norm * norm * (1 + 1e-9) + 1e-3 >= need)
        if not len(live):
            self.over = True  # later norms are no larger, and needs only rise
            return
        self.compared += len(live) * bucket.num_rows
        rid, ids, label = (np.asarray(pc.fill_null(bucket.column(c), NONE)) for c in ("rid", "id", "label"))
        score = products(self.x[live], to_matrix(bucket.column("v")))
        fit = (score >= need[live, None]) & (score <= self.high[live].max(axis=1)[:, None])
        fit &= (self.label[live, None] == label) == self.same
        a, c = np.nonzero(fit)
        s, a = score[a, c], live[a]
        other = self.rid[a] != rid[c]
        self.take(a[other], ids[c[other]], s[other])

    def take(self, a: np.ndarray, ids: np.ndarray, s: np.ndarray) -> None:
        for w in range(self.low.shape[1]):
            last, last_id = self.score[a, w, -1], self.found[a, w, -1]
            better = (s >= self.low[a, w]) & (s <= self.high[a, w]) & ((self.n[a, w] < self.k) | (s > last) | ((s == last) & (ids < last_id)))
            if not better.any():
                continue
            rows, at = np.unique(a[better], return_inverse=True)
            old = np.arange(self.k) < self.n[rows, w][:, None]
            row = np.concatenate([at, np.nonzero(old)[0]])
            score, found = np.concatenate([s[better], self.score[rows, w][old]]), np.concatenate([ids[better], self.found[rows, w][old]])
            order = np.lexsort((found, -score, row))
            row, score, found = row[order], score[order], found[order]
            rank = np.arange(len(row)) - np.searchsorted(row, row)
            best = rank < self.k
            row, rank = row[best], rank[best]
            self.score[rows[row], w, rank], self.found[rows[row], w, rank] = score[best], found[best]
            self.n[rows, w] = np.bincount(row, minlength=len(rows))

    def result(self) -> pa.RecordBatch:
        if self.parts:
            self.start()
        a, w, place = np.nonzero(np.arange(self.k) < self.n[:, :, None])
        found = self.found[a, w, place]
        return pa.record_batch([pa.array(self.rid[a]), pa.array(w.astype(np.int32)), pa.array(found, mask=found == NONE), pa.array(self.score[a, w, place])], ["rid", "w", "id", "score"])


def _search(k: int, same: bool):
    """Of rows in order of (part, cell, kind, falling norm): what each cell's candidates (kind 1) give its anchors (kind 0)."""

    def run(batches):
        at, search = None, None
        for batch in runs(batches, BUCKET):
            part, cell, kind = (np.asarray(batch.column(c)) for c in ("part", "cell", "kind"))
            edges = np.flatnonzero((np.diff(part) != 0) | (np.diff(cell) != 0) | (np.diff(kind) != 0)) + 1
            for a, b in zip([0, *edges.tolist()], [*edges.tolist(), batch.num_rows], strict=True):
                if (part[a], cell[a]) != at:
                    if search is not None:
                        yield search.result()
                    at, search = (part[a], cell[a]), None
                rows = batch.slice(a, b - a)
                if kind[a] == 0:
                    search = search or Search(k, same)
                    search.add(rows)
                elif search is not None:
                    search.meet(rows)
        if search is not None:
            yield search.result()

    return run


def _integers(scale: int):
    def run(batches):
        for batch in runs(batches, 8192):
            keep, x, length = integer_vectors(batch.column("v"), scale, None, 100)
            ends = np.concatenate([[0], np.cumsum(length)])
            total = np.concatenate([[0], np.cumsum(x.astype(np.int64) ** 2)])
            keep = pa.array(keep)
            yield pa.record_batch([batch.column("id").take(keep), batch.column("label").take(keep), batch.column("anchor").take(keep), as_binary(x, length), pa.array(total[ends[1:]] - total[ends[:-1]])], ["id", "label", "anchor", "v", "norm2"])

    return run


FIELDS = ["rid", "id", "label", "v", "norm2"]


def _stream(anchors: DataFrame, candidates: DataFrame, parts: int, k: int, same: bool) -> DataFrame:
    """rid, w, id and score: the k best candidates for each window of each anchor, from what the cells of both give."""
    both = anchors.withColumn("kind", F.lit(0)).unionByName(candidates.withColumn("kind", F.lit(1)).withColumn("windows", F.lit(None)))
    both = both.repartition(parts, "part", "cell").sortWithinPartitions("part", "cell", "kind", F.col("norm2").desc(), F.col("id").asc_nulls_last())
    found = both.mapInArrow(_search(k, same), "rid long, w int, id long, score long")
    rank = F.row_number().over(Window.partitionBy("rid", "w").orderBy(F.col("score").desc(), F.col("id").asc_nulls_last()))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def hard_negatives(df: DataFrame, anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, scale: int = SCALE, key: str = "vec_id", label: str = "label", vector: str = "embedding") -> DataFrame:
    """anchor_id, positive_id, rank (from 1), negative_id, positive_score and negative_score.

    Components become floor(scale * x); a score is the integer inner product with
    the anchor (of vectors of different length, over the components both have).
    Rows with a null label (an integer), a null vector, or a null or non-finite
    component take no part. Rows where `anchor` holds (null: not) are anchors.
    Positives are an anchor's `positives` best other rows of its label; for each,
    the `negatives` best rows of other labels with low * positive_score <=
    100 * score <= high * positive_score are given (all, if fewer; none: no row).
    Higher scores come first, ties by lesser key, null keys last. Repeated rows
    are rows of their own. Components so large that a score may not fit in a long
    are an error. Other columns are ignored, whatever their names.
    """
    spark = df.sparkSession
    ship(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = df.select(F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{label}`").cast("long").alias("label"), F.coalesce(anchor, F.lit(False)).alias("anchor"), F.col(f"`{vector}`").alias("v")).where("label is not null")
    rows = rows.mapInArrow(_integers(scale), "id long, label long, anchor boolean, v binary, norm2 long")
    rows = materialize(rows.select(F.monotonically_increasing_id().alias("rid"), "*"), "integer-vectors")

    # Positives: an anchor's group and the candidates of its label meet in the label's cells, of which there are as many as its share of the rows asks for.
    labels = rows.groupBy("label").agg(F.count("*").alias("n"), F.count_if("anchor").alias("anchors")).where("anchors > 0")
    every = rows.count()
    labels = labels.withColumn("groups", F.ceil(F.col("anchors") / GROUP).cast("int")).withColumn("slices", F.ceil(parts * F.col("n") / (max(every, 1) * F.col("groups"))).cast("int"))
    labels = materialize(labels.select(F.col("label").alias("part"), "groups", "slices"), "labels")
    of_label = rows.join(labels, rows["label"] == labels["part"])
    group, piece = F.pmod(F.xxhash64("rid"), "groups"), F.pmod(F.xxhash64(F.lit(1), "rid"), "slices")
    count = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    whole = F.array(F.struct(F.lit(LEAST).alias("low"), F.lit(int(NONE)).alias("high")))
    anchors = of_label.where("anchor").select(*FIELDS, "part", group.alias("g"), "slices", count(F.col("slices")).alias("piece"), whole.alias("windows"))
    candidates = of_label.select(*FIELDS, "part", count(F.col("groups")).alias("g"), "slices", piece.alias("piece"))
    cell = (F.col("g").cast("long") * F.col("slices") + F.col("piece")).alias("cell")
    found = _stream(anchors.select(*FIELDS, "part", cell, "windows"), candidates.select(*FIELDS, "part", cell), parts, positives, True)

    # A positive's score opens a window, unless no score can lie in it.
    floor_100 = lambda x: F.when(x >= 0, F.call_function("div", x, F.lit(100))).otherwise(-F.call_function("div", F.lit(99) - x, F.lit(100)))
    found = found.select("rid", F.col("rank").alias("nth"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"), (-floor_100(-low * F.col("score"))).alias("low"), floor_100(high * F.col("score")).alias("high")).where("low <= high")
    found = materialize(found, "positives")
    windows = found.groupBy("rid").agg(F.array_sort(F.collect_list(F.struct("nth", "low", "high"))).alias("windows"))  # at most `positives` of them
    need = F.try_divide(F.array_min(F.transform("windows", lambda w: w["low"])), F.sqrt(F.col("norm2").cast("double")))
    anchors = materialize(rows.join(windows, "rid").select(*FIELDS, "windows", F.coalesce(need, F.lit(0.0)).alias("need")), "anchors")

    # Anchors with like needs share a group, and a candidate goes to the groups that its norm is enough for.
    # A candidate's row is sent once for each group, so there are no more classes than full groups.
    classes = max(1, min(CLASSES, anchors.count() // GROUP))
    shares = [i / classes for i in range(1, classes)] or [0.0]  # the least need as the only cut leaves one class
    cuts = sorted(set(anchors.agg(F.percentile_approx("need", shares, 1000)).first()[0] or ()))
    kind = sum((F.when(F.col("need") >= cut, 1).otherwise(0) for cut in cuts), F.lit(0))
    sizes = anchors.groupBy(kind.alias("kind")).agg(F.count("*").alias("n"), F.min("need").alias("least")).orderBy("kind").collect()  # at most CLASSES rows
    groups = [-(-r["n"] // GROUP) for r in sizes]
    slices = max(1, -(-parts // max(sum(groups), 1)))
    first = {r["kind"]: sum(groups[:i]) for i, r in enumerate(sizes)}
    pick = lambda of: F.element_at(F.create_map(*[F.lit(x) for r, n in zip(sizes, groups, strict=True) for x in (r["kind"], of(r, n))] or [F.lit(0), F.lit(0)]), kind)
    anchors = anchors.withColumn("g", pick(lambda r, n: first[r["kind"]]) + F.pmod(F.xxhash64("rid"), pick(lambda r, n: n))).withColumn("slices", F.lit(slices))
    anchors = anchors.select(*FIELDS, F.lit(0).cast("long").alias("part"), "g", "slices", count(F.col("slices")).alias("piece"), F.transform("windows", lambda w: F.struct(w["low"], w["high"])).alias("windows"))
    enough = F.sqrt(F.col("norm2").cast("double")) * (1 + 1e-9) + 1e-6
    reach = sum((F.when(enough >= r["least"], n).otherwise(0) for r, n in zip(sizes, groups, strict=True)), F.lit(0))
    candidates = rows.withColumn("reach", reach).where("reach > 0").withColumn("slices", F.lit(slices))
    candidates = candidates.select(*FIELDS, F.lit(0).cast("long").alias("part"), count(F.col("reach")).alias("g"), "slices", piece.alias("piece"))
    best = _stream(anchors.select(*FIELDS, "part", cell, "windows"), candidates.select(*FIELDS, "part", cell), parts, negatives, False)

    # Windows are numbered as in their array, which may lack a positive's that is empty.
    named = found.withColumn("w", (F.row_number().over(Window.partitionBy("rid").orderBy("nth")) - 1).cast("int")).join(rows.where("anchor").select("rid", F.col("id").alias("anchor_id")), "rid")
    out = best.select("rid", "w", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score")).join(named, ["rid", "w"])
    return out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op12_norm_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(df.select("vec_id", label.alias("label"), "embedding"), F.col("vec_id") % 100 == 0)


OP12_SQL = """
with c as (select vec_id, row_number() over () as rid, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as v
  from embeddings where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select a.rid as a, a.vec_id as anchor_id, b.rid as b, b.vec_id as id, a.label = b.label as same, cast(coalesce(list_sum(list_transform(range(1, least(len(a.v), len(b.v)) + 1), lambda i: a.v[i] * b.v[i])), 0) as bigint) as score
  from c a, c b where a.vec_id % 100 = 0 and a.rid <> b.rid),
p as (select a, anchor_id, id as positive_id, b, score as positive_score from s where same qualify row_number() over (partition by a order by score desc, id) <= 5),
n as (select p.*, s.id as negative_id, s.score as negative_score, row_number() over (partition by p.a, p.b order by s.score desc, s.id) as rank
  from p join s on s.a = p.a and not s.same and 80 * positive_score <= 100 * s.score and s.score <= positive_score)
select anchor_id, positive_id, cast(rank as integer) as rank, negative_id, positive_score, negative_score from n where rank <= 5
"""
