"""Operator 10: n-gram Jaccard join by chosen paths.

Sets that are alike choose common elements: at each step of a run a set chooses
the one of its shingles that is least by a hash that all sets share, which two
sets do alike with a chance of their likeness, however popular the shingle is.
Sets that chose the same shingle form a bucket; a large bucket is split by the
next choice, so a path is a sequence of them, and the buckets at the paths' ends
are compared by brute force, all of them. Runs are repeated until a pair at the
threshold shares no whole path with a small, stated chance. A pair at the threshold
makes each choice alike with a chance of its likeness; pairs that make so few alike
as one in 10**9 pairs at the threshold does only share a popular passage, and their
sets are not fetched.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..graph import components
from .common import ALNUM, Words, grams, materialize, mix, ship, slices, text_bytes, trimmed
from .groups import whole_groups

SHINGLE, THRESHOLD, RECALL = 5, 0.8, 0.999
SMALL = 128  # sets of a bucket that is compared as it is; larger ones are split
DEPTH = 5  # shingles of a path
BLOCK = 1024  # what is still large, or hardly splits, is compared in pairs of blocks of so many sets
UNLIKE = 1e-9  # chance of a pair at the threshold to make too few choices alike
SHINGLES = 1 << 20  # and so is what holds more shingles than that, so that a task holds about twice as many at once


def runs_for(recall: float, threshold: float = THRESHOLD, depth: int = DEPTH) -> int:
    """Runs until a pair at the threshold has the longest path in common in one of them with this chance; it makes each choice alike with a chance of its likeness."""
    runs = 1
    while (1 - threshold**depth) ** runs > 1 - recall:
        runs += 1
    return runs


def least_alike(made: int, threshold: float = THRESHOLD, chance: float = UNLIKE) -> int:
    """The largest number of choices alike, of `made`, that a pair at the threshold stays under with at most this chance."""
    below = 0.0
    for n in range(made + 1):
        if threshold >= 1:
            return made
        below += math.exp(math.lgamma(made + 1) - math.lgamma(n + 1) - math.lgamma(made - n + 1) + n * math.log(threshold) + (made - n) * math.log1p(-threshold))
        if below > chance:
            return n
    return made


def shingle_sets(words: Words, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each text in order: row, hash, and how many each text has. A text of fewer than k words, but not none, is one shingle."""
    h = grams(words.hash, k)
    row = words.row[: len(h)]
    keep = row == words.row[k - 1 :] if len(h) else np.zeros(0, bool)
    h, row = h[keep], row[keep]
    short = np.flatnonzero((words.count > 0) & (words.count < k))
    if len(short):
        whole = [mix(np.add.reduce(words.hash[words.first[r] : words.first[r + 1]] * (2 * np.arange(words.count[r], dtype=np.uint64) + np.uint64(1)), keepdims=True)) for r in short.tolist()]
        h, row = np.concatenate([h, *whole]), np.concatenate([row, short])
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    if len(h):
        once = np.append(True, (h[1:] != h[:-1]) | (row[1:] != row[:-1]))
        h, row = h[once], row[once]
    return row, h, np.bincount(row, minlength=words.texts)


def choices(h: np.ndarray, n: np.ndarray, runs: int) -> np.ndarray:
    """(texts with shingles, runs, DEPTH) numbers of 32 bits that name the shingle a text chooses at each step of each run, for the hashes of shingle_sets()."""
    size = n[n > 0]
    first = np.cumsum(size) - size
    out = np.zeros((len(size), runs * DEPTH), np.uint32)
    h = mix(h)
    for k in range(runs * DEPTH if len(size) else 0):
        turn, by = mix(np.array([2 * k + 1, 2 * k + 2], np.uint64))
        out[:, k] = mix(np.minimum.reduceat((h ^ turn) * (by | np.uint64(1)), first))
    return out.reshape(-1, runs, DEPTH)


def _scan(runs: int):
    """Per row: doc_id, th, n (shingles), s1 and s2 (sums that name the set), its choices in all runs, and their lowest bytes as a sketch."""

    def run(batches):
        for batch in slices(batches, "text", 2 << 20):
            words = Words(*text_bytes(batch.column("text")), ALNUM)
            _, h, n = shingle_sets(words)
            first = np.concatenate([[0], np.cumsum(n)])
            full = np.flatnonzero(n)
            s1, s2 = np.zeros(words.texts, np.uint64), np.zeros(words.texts, np.uint64)
            if len(full):
                s1[full] = np.add.reduceat(mix(h), first[full])
                s2[full] = np.add.reduceat(mix(h ^ np.uint64(0x5BD1E995)), first[full])
            chosen = choices(h, n, runs)
            steps = pa.array(chosen.view(np.int32).ravel())
            paths = pa.ListArray.from_arrays(pa.array(np.arange(0, len(steps) + 1, DEPTH, dtype=np.int32)), steps)
            ends = np.concatenate([[0], np.cumsum(runs * (n > 0))]).astype(np.int32)
            width, low = runs * DEPTH, chosen.astype(np.uint8).tobytes()
            sketch = pa.array([low[width * k : width * k + width] for k in (np.cumsum(n > 0) - 1).tolist()], pa.binary())
            columns = [batch.column("doc_id"), batch.column("th"), pa.array(n.astype(np.int64)), pa.array(s1.view(np.int64)), pa.array(s2.view(np.int64)), pa.ListArray.from_arrays(pa.array(ends), paths), sketch]
            yield pa.record_batch(columns, ["doc_id", "th", "n", "s1", "s2", "paths", "sketch"])

    return run


def _set_rows(batches):
    """rid, n and the set as sorted numbers of 40 bits."""
    for batch in slices(batches, "text", 2 << 20):
        words = Words(*text_bytes(batch.column("text")), ALNUM)
        _, h, n = shingle_sets(words)
        ends = (5 * np.concatenate([[0], np.cumsum(n)])).tolist()
        raw = np.ascontiguousarray((h >> np.uint64(24)).astype(">u8").view(np.uint8).reshape(-1, 8)[:, 3:]).tobytes()
        yield pa.record_batch([batch.column("rid"), pa.array(n.astype(np.int64)), pa.array([raw[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)], pa.binary())], ["rid", "n", "elements"])


def _numbers(raw: bytes) -> np.ndarray:
    wide = np.zeros((len(raw) // 5, 8), np.uint8)
    wide[:, 3:] = np.frombuffer(raw, np.uint8).reshape(-1, 5)
    return wide.view(">u8").ravel().astype(np.uint64)


KEY = ["path", "i", "j"]


def _plausible(threshold: float, runs: int):
    """Of rows in order of KEY: those with a partner of fitting size that makes enough choices alike."""
    names = ["rid", *KEY, "block"]
    enough = least_alike(runs * DEPTH, threshold)

    def judge(batch: pa.RecordBatch, edges: np.ndarray) -> pa.RecordBatch:
        n, block, across = (np.asarray(batch.column("n")), np.asarray(batch.column("block")), np.asarray(batch.column("i")) != np.asarray(batch.column("j")))
        sketch = np.frombuffer(b"".join(batch.column("sketch").to_pylist()), np.uint8).reshape(batch.num_rows, -1)
        edge, count = edges[:-1], np.diff(edges)
        good = np.zeros(batch.num_rows, bool)
        for distance in range(1, int(count.max())):
            groups = count > distance
            starts, sizes = edge[groups], count[groups] - distance
            a = np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))
            b = a + distance
            open_ = ~(good[a] & good[b]) & (np.minimum(n[a], n[b]) >= threshold * np.maximum(n[a], n[b]) - 1e-9) & (~across[a] | (block[a] != block[b]))
            a, b = a[open_], b[open_]
            for x in range(0, len(a), 50_000):
                c, d = a[x : x + 50_000], b[x : x + 50_000]
                hit = (sketch[c] == sketch[d]).sum(axis=1) >= enough
                good[c[hit]] = good[d[hit]] = True
        keep = pa.array(np.flatnonzero(good))
        return pa.record_batch([batch.column(c).take(keep) for c in names], names)

    return lambda batches: whole_groups(batches, KEY, judge)


def common_counts(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections, from the elements that two sets or more have."""
    g = len(sets)
    sizes = [len(s) for s in sets]
    every = np.concatenate(sets) if g else np.zeros(0, np.uint64)
    owner = np.repeat(np.arange(g), sizes)
    element, back, count = np.unique(every, return_inverse=True, return_counts=True)
    number = np.cumsum(count > 1) - 1
    mine = count[back] > 1
    owner, column = owner[mine], number[back[mine]]
    total = np.zeros((g, g), np.float32)
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    for at in range(0, int((count > 1).sum()), 8192):
        a, b = np.searchsorted(column, [at, at + 8192])
        part = np.zeros((g, min(8192, int((count > 1).sum()) - at)), np.float32)
        part[owner[a:b], column[a:b] - at] = 1
        total += part @ part.T
    return total.astype(np.int64)


def _links(here: int, across: bool, rid: np.ndarray, n: np.ndarray, block: np.ndarray, sets: list[np.ndarray], leaves: list[list[int]], threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a bucket, or a pair of its blocks: sets with a partner, the links of each that are found here and in no lesser bucket, and the least set of its component here."""
    shared = common_counts(sets)
    alike = shared >= threshold * (n[:, None] + n[None, :] - shared) - 1e-9
    np.fill_diagonal(alike, False)
    if across:
        alike &= block[:, None] != block[None, :]
    keep = np.flatnonzero(alike.any(axis=1))
    if not len(keep):
        return rid[:0], rid[:0], rid[:0]
    alike, rid = alike[np.ix_(keep, keep)], rid[keep]
    lower = [[x for x in leaves[k] if x < here] for k in keep.tolist()]
    names = {x: k for k, x in enumerate(sorted({x for own in lower for x in own}))}
    before = np.zeros((len(rid), len(names)), np.float32)
    for k, own in enumerate(lower):
        before[k, [names[x] for x in own]] = 1
    links = (alike & ~(before @ before.T > 0)).sum(axis=1)
    root = np.arange(len(rid))
    while True:
        least = np.where(alike, root[None, :], len(rid)).min(axis=1)
        new = np.minimum(root, least)
        new = new[new]
        if (new == root).all():
            return rid, links, rid[root]
        root = new


def _compare(threshold: float):
    """Of rows in order of KEY: rid, links and root of _links() for each group, summed up over a batch's groups."""

    def work(batch: pa.RecordBatch, edges: np.ndarray) -> pa.RecordBatch:
        rid, n, block, path, i, j = (np.asarray(batch.column(c)) for c in ("rid", "n", "block", *KEY))
        elements, leaves = batch.column("elements"), batch.column("leaves")
        found = []
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            if b - a > 1:
                order = a + np.argsort(rid[a:b], kind="stable")
                sets, own = ([column[k].as_py() for k in order.tolist()] for column in (elements, leaves))
                found.append(_links(int(path[a]), bool(i[a] != j[a]), rid[order], n[order], block[order], [_numbers(x) for x in sets], own, threshold))
        return pa.record_batch([pa.array(np.concatenate([f[k] for f in found] or [rid[:0]]).astype(np.int64)) for k in range(3)], ["rid", "links", "root"])

    return lambda batches: whole_groups(batches, KEY, work)


def classes(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """Per distinct (doc_id, text): doc_id, th (hash of the text), class_id (least doc_id of the class), class_th (th of that document), n_links and n_copies.

    Two texts are linked if the Jaccard likeness of their sets of five-word
    shingles is `threshold` or more; a class is a component of links. n_links
    counts the other shingle sets that a text's set is linked to, n_copies the
    rows with that set. A text of under five words is one shingle; texts without
    words are alike only if they are equal. Null texts are alike. Rows that agree
    in doc_id and text give one row; null doc_ids come first. An empty table
    gives none; other columns are ignored.
    """
    ship(docs.sparkSession)
    runs = runs_for(recall, threshold)
    kind = dict(docs.dtypes)["doc_id"]
    texts = docs.select("doc_id", F.xxhash64("text").alias("th"), "text")
    rows = materialize(texts.mapInArrow(trimmed(_scan(runs)), f"doc_id {kind}, th long, n long, s1 long, s2 long, paths array<array<int>>, sketch binary").withColumn("s1", F.when(F.col("n") == 0, F.col("th")).otherwise(F.col("s1"))), "shingle-paths")
    name = ["n", "s1", "s2"]
    reps = rows.groupBy(*name).agg(F.min(F.struct("doc_id", "th")).alias("rep"), F.count("*").alias("n_copies"), F.first("paths").alias("paths"), F.first("sketch").alias("sketch"))
    reps = materialize(reps.select(F.monotonically_increasing_id().alias("rid"), *name, "rep", "n_copies", "paths", "sketch"), "distinct-sets")

    # Buckets: paths that two sets or more share. Large ones are split by the next choice, unless nearly all of their sets stay together.
    name_of = lambda depth: F.xxhash64(F.slice(F.get("paths", F.col("nth")), 1, depth), "nth")
    paths = reps.select("rid", F.posexplode("paths").alias("nth", "steps")).select("rid", "nth", F.xxhash64(F.slice("steps", 1, 1), "nth").alias("path"), F.lit(1 << 53).alias("parent"))
    leaves = None
    for depth in range(1, DEPTH + 1):
        sizes = paths.groupBy("path").agg(F.count("*").alias("size")).where("size > 1")
        live = materialize(paths.join(sizes, "path").select("rid", "nth", "path", "parent", "size"), f"buckets-{depth}")
        done = F.lit(True) if depth == DEPTH else (F.col("size") <= SMALL) | (10 * F.col("size") > 9 * F.col("parent"))
        here = live.where(done).select("rid", "path")
        leaves = here if leaves is None else leaves.unionAll(here)
        large = live.where(~done)
        if large.isEmpty():
            break
        paths = large.join(reps.select("rid", "paths"), "rid").select("rid", "nth", name_of(depth + 1).alias("path"), F.col("size").alias("parent"))

    # Buckets of the same sets are compared once; those that are still large, or hold long texts, in pairs of blocks.
    leaves = leaves.join(reps.select("rid", "n"), "rid")
    content = leaves.groupBy("path").agg(F.count("*").alias("c"), F.sum(F.xxhash64("rid").cast("decimal(38,0)")).alias("s"), F.sum("n").alias("total"))
    blocks = F.greatest(F.when(F.col("c") <= SMALL, 1).otherwise(F.ceil(F.col("c") / BLOCK)), F.ceil(F.col("total") / SHINGLES)).cast("int")
    once = content.groupBy("c", "s").agg(F.min(F.struct("path", blocks.alias("blocks"))).alias("b")).select("b.*")
    met = leaves.select("rid", "path").join(once, "path").withColumn("block", F.pmod(F.xxhash64("rid", "path"), F.col("blocks")).cast("int"))
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = met.select("rid", "path", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    in_order = lambda df: df.repartition(parts, *KEY).sortWithinPartitions(*KEY)
    met = in_order(met.join(reps.select("rid", "n", "sketch"), "rid"))
    met = materialize(met.mapInArrow(_plausible(threshold, runs), "rid long, path long, i int, j int, block int"), "plausible")

    # The sets of what is left, from the texts.
    wanted = met.select("rid").distinct().join(reps.select("rid", "rep"), "rid").select("rid", F.col("rep.doc_id").alias("k"), F.col("rep.th").alias("kh"))
    wanted = texts.join(wanted, texts["doc_id"].eqNullSafe(wanted["k"]) & (texts["th"] == wanted["kh"])).select("rid", "text")
    sets = materialize(wanted.mapInArrow(trimmed(_set_rows), "rid long, n long, elements binary").dropDuplicates(["rid"]), "candidate-sets")
    mine = met.groupBy("rid").agg(F.array_sort(F.collect_set("path")).alias("leaves"))
    found = in_order(met.join(mine.join(sets, "rid"), "rid")).mapInArrow(trimmed(_compare(threshold)), "rid long, links long, root long")
    found = materialize(found, "found")
    links = found.groupBy("rid").agg(F.sum("links").alias("n_links"))
    roots = components(found.select(F.col("rid").alias("a"), F.col("root").alias("b")))

    whole = reps.join(roots, "rid", "left").join(links, "rid", "left").select("rid", *name, "rep", "n_copies", F.coalesce("root", "rid").alias("root"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
    first = whole.groupBy("root").agg(F.min("rep").alias("first"))
    whole = whole.join(first, "root").select(*name, "first", "n_copies", "n_links")
    out = rows.select("doc_id", "th", *name).distinct().join(whole, name)
    return out.select("doc_id", "th", F.col("first.doc_id").alias("class_id"), F.col("first.th").alias("class_th"), "n_links", "n_copies")


def keep_one(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """docs with one row of each class of classes(): its least (doc_id, hash of the text). Columns stay as they are."""
    kept = classes(docs, threshold, recall).where(F.col("doc_id").eqNullSafe(F.col("class_id")) & (F.col("th") == F.col("class_th"))).select(F.col("doc_id").alias("k"), F.col("th").alias("kh"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("r"))
    rows = rows.withColumn("kd", F.col("r.doc_id")).withColumn("th", F.xxhash64("r.text"))
    rows = rows.join(kept, rows["kd"].eqNullSafe(kept["k"]) & (rows["th"] == kept["kh"])).dropDuplicates(["kd", "th"])
    return rows.select("r.*")


def op10_chosen_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = classes(docs.select("doc_id", "text"))
    return found.select("doc_id", "class_id", "n_links", "n_copies")


OP10_SQL = r"""
with recursive d as (select doc_id, text, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from (select distinct doc_id, text from documents)),
g as (select doc_id, text, list_sort(list_distinct(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: array_to_string(list_slice(w, i, i + least(len(w), 5) - 1), ' ')))) as s, len(w) as n from d),
k as (select doc_id, case when coalesce(n, 0) = 0 then 'text ' || coalesce(text, 'null') else 'set ' || array_to_string(s, '|') end as key, s, coalesce(n, 0) as n from g),
sets as (select key, min(doc_id) as sid, any_value(s) as s, any_value(n) as n from k group by key),
copies as (select key, count(*) as n_copies from (select case when coalesce(len(e.w), 0) = 0 then 'text ' || coalesce(e.text, 'null') else 'set ' || array_to_string(list_sort(list_distinct(list_transform(range(1, greatest(len(e.w) - 4, 1) + 1), lambda i: array_to_string(list_slice(e.w, i, i + least(len(e.w), 5) - 1), ' ')))), '|') end as key from documents join d e using (doc_id, text)) group by key),
sh as (select sid, len(s) as size, unnest(s) as x from sets where n > 0),
link as (select a.sid as u, b.sid as v from sh a join sh b on a.x = b.x and a.sid <> b.sid group by a.sid, b.sid having count(*) * 5 >= 4 * (any_value(a.size) + any_value(b.size) - count(*))),
reach as (select sid as u, sid as v from sets union select r.u, l.v from reach r join link l on r.v = l.u),
root as (select u, min(v) as class_id from reach group by u),
deg as (select u, count(*) as n_links from link group by u)
select k.doc_id, class_id, cast(coalesce(n_links, 0) as bigint) as n_links, n_copies
from k join sets using (key) join root on root.u = sets.sid left join deg on deg.u = sets.sid join copies using (key)
"""
