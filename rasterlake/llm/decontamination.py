"""Operator 2: benchmark decontamination by winnowing.

Of each run of w consecutive k-gram hashes the smallest is kept, so two texts
that share w+k-1 words share a kept hash at the same place. Fingerprints of
documents and benchmark items are joined, and each hit is extended to both sides.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ALNUM, Words, grams, materialize, mix, ship, slices, text_bytes

K = 5
FILTER_BITS = 26  # of the fixed-size bit map that thins out document fingerprints before the join: 8 MB


def _sliding(x: np.ndarray, w: int, take) -> np.ndarray:
    """take (np.minimum or np.maximum) of each w neighbours."""
    done = 1
    while done < w:
        step = min(done, w - done)
        x = take(x[:-step], x[step:])
        done += step
    return x


def winnow(words: np.ndarray, row: np.ndarray, span: int, k: int = K) -> tuple[np.ndarray, np.ndarray]:
    """Places (in words) and hashes of the kept k-grams: each `span` consecutive words of a row hold one. Of equal smallest hashes all are kept."""
    k = min(k, span)
    w = span - k + 1
    n = len(words)
    if n < span:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    h = grams(words, k) ^ mix(np.array([span], np.uint64))[0]
    least = _sliding(h, w, np.minimum)
    whole = row[: n - span + 1] == row[span - 1 :]
    least = np.where(whole, least, 0)
    padded = np.concatenate([np.zeros(w - 1, np.uint64), least, np.zeros(w - 1, np.uint64)])
    kept = np.flatnonzero((_sliding(padded, w, np.maximum) == h) & (h != 0))
    return kept, h[kept]


def _context(words: Words, at: np.ndarray, span: int, k: int = K) -> np.ndarray:
    """Hashes of the words that any window of `span` words around the k-gram at `at` can hold; 0 beyond the text."""
    k = min(k, span)
    side = span - k
    place = at[:, None] + np.arange(-side, k + side)[None, :]
    inside = (place >= words.first[words.row[at]][:, None]) & (place < words.first[words.row[at] + 1][:, None])
    return np.where(inside, words.hash[np.clip(place, 0, max(0, len(words.hash) - 1))], 0).astype(np.uint64)


def _found(words: Words, spans: list[int], rows: np.ndarray | None = None):
    """(span, places, hashes) for each span. rows: per span, the rows that count (of items)."""
    for span in spans:
        at, h = winnow(words.hash, words.row, span)
        if rows is not None:
            keep = rows[words.row[at]] == span
            at, h = at[keep], h[keep]
        yield span, at, h


def _item_rows(span: int):
    def run(batches):
        for batch in slices(batches, "text"):
            words = Words(*text_bytes(batch.column("text")), ALNUM)
            item = batch.column("item_id")
            for length, at, h in _found(words, list(range(1, span + 1)), np.minimum(words.count, span)):
                if len(at):
                    ctx = _context(words, at, length)
                    yield pa.record_batch([pa.array(h.view(np.int64)), item.take(pa.array(words.row[at])), pa.array(np.full(len(at), length, np.int32)), pa.array([c.tobytes() for c in ctx], pa.binary())], ["fp", "item_id", "span", "item_ctx"])

    return run


def _document_rows(spans: list[int], bits: np.ndarray):
    mask = np.uint64((1 << FILTER_BITS) - 1)

    def run(batches):
        for batch in slices(batches, "text"):
            words = Words(*text_bytes(batch.column("text")), ALNUM)
            parts = []
            for span, at, h in _found(words, spans):
                slot = h & mask
                hit = (bits[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63))) & np.uint64(1)
                at, h = at[hit == 1], h[hit == 1]
                if len(at):
                    parts.append((words.row[at], at - words.first[words.row[at]], h, np.full(len(at), span), [c.tobytes() for c in _context(words, at, span)]))
            row = np.concatenate([p[0] for p in parts]) if parts else np.zeros(0, np.int64)
            order = np.argsort(row, kind="stable")
            column = lambda i, kind: np.concatenate([p[i] for p in parts]).astype(kind)[order] if parts else np.zeros(0, kind)
            ctx = [c for p in parts for c in p[4]]
            cands = pa.StructArray.from_arrays([pa.array(column(2, np.uint64).view(np.int64)), pa.array(column(1, np.int32)), pa.array(column(3, np.int32)), pa.array([ctx[i] for i in order], pa.binary())], ["fp", "pos", "span", "ctx"])
            ends = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=words.texts))]).astype(np.int32)
            yield pa.record_batch([batch.column("row_id"), batch.column("doc_id"), batch.column("th"), pa.array(words.count), pa.ListArray.from_arrays(pa.array(ends), cands)], ["row_id", "doc_id", "th", "n_words", "cands"])

    return run


def _extend(batches):
    """Hits whose equal run around the k-gram has a whole window: row_id, item_id, start and end (words)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        span = np.asarray(batch.column("span"))
        pos = np.asarray(batch.column("pos"))
        start, end = np.zeros(len(span), np.int64), np.zeros(len(span), np.int64)
        for s in np.unique(span):
            rows = np.flatnonzero(span == s)
            k = min(K, int(s))
            side = int(s) - k
            a, b = (np.frombuffer(b"".join(batch.column(c).take(pa.array(rows)).to_pylist()), np.uint64).reshape(len(rows), -1) for c in ("ctx", "item_ctx"))
            same = (a == b) & (a != 0)
            middle = same[:, side : side + k].all(axis=1)
            left = np.logical_and.accumulate(same[:, :side][:, ::-1], axis=1).sum(axis=1)
            right = np.logical_and.accumulate(same[:, side + k :], axis=1).sum(axis=1)
            good = middle & (left + k + right >= s)
            start[rows] = np.where(good, pos[rows] - left, -1)
            end[rows] = pos[rows] + k + right
        keep = np.flatnonzero(start >= 0)
        yield pa.record_batch([batch.column("row_id").take(pa.array(keep)), batch.column("item_id").take(pa.array(keep)), pa.array(start[keep]), pa.array(end[keep])], ["row_id", "item_id", "start", "end"])


def contamination(docs: DataFrame, items: DataFrame, span: int = 13, salts: int = 16) -> DataFrame:
    """One row per row of docs (doc_id, text): row_id, doc_id, th (hash of the text), n_words, spans (array of [start, end) in words, merged where they overlap or touch), items (sorted item ids).

    A window is `span` consecutive words of an item, or all words of a shorter
    one. Null and empty texts have no words and no hits. Repeated rows stay and
    are judged alike; null ids stay null; items with a null id count for spans
    only; other columns are ignored. An empty docs or items table works.
    """
    ship(docs.sparkSession)
    items = materialize(items.select(F.col("item_id"), "text").mapInArrow(_item_rows(span), f"fp long, item_id {dict(items.dtypes)['item_id']}, span int, item_ctx binary").distinct(), "benchmark-fingerprints")
    spans = sorted(r["span"] for r in items.select("span").distinct().collect())  # `span` values at most
    slot = F.col("fp").bitwiseAND((1 << FILTER_BITS) - 1)
    words = items.select(F.shiftright(slot, 6).alias("at"), F.expr(f"shiftleft(1L, cast(fp & 63 as int))").alias("bit")).groupBy("at").agg(F.bit_or("bit").alias("bits"))
    bits = np.zeros(1 << (FILTER_BITS - 6), np.int64)
    got = words.toPandas()  # as many rows as the map has words, at most
    bits[got["at"].to_numpy(np.int64)] = got["bits"].to_numpy(np.int64)
    shared = docs.sparkSession.sparkContext.broadcast(bits.view(np.uint64))

    def run(batches):
        yield from _document_rows(spans, shared.value)(batches)

    kind = dict(docs.dtypes)["doc_id"]
    rows = docs.select(F.monotonically_increasing_id().alias("row_id"), "doc_id", F.xxhash64("text").alias("th"), "text").mapInArrow(run, f"row_id long, doc_id {kind}, th long, n_words long, cands array<struct<fp: long, pos: int, span: int, ctx: binary>>")
    rows = materialize(rows, "document-candidates")
    cands = rows.select("row_id", F.explode("cands").alias("c")).select("row_id", "c.*", F.pmod(F.xxhash64("row_id", F.col("c.pos")), F.lit(salts)).cast("int").alias("salt"))
    # Popular fingerprints are dealt over `salts` tasks; each has all items' entries.
    salted = items.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    hits = cands.join(salted, ["fp", "span", "salt"]).select("row_id", "item_id", "span", "pos", "ctx", "item_ctx")
    hits = hits.mapInArrow(_extend, f"row_id long, item_id {dict(items.dtypes)['item_id']}, start long, end long")
    hits = hits.groupBy("row_id").agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("found"), F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("items"))
    merge = """aggregate(found, array(), (acc, x) -> if(size(acc) = 0 or element_at(acc, -1).end < x.start, concat(acc, array(x)),
        concat(slice(acc, 1, size(acc) - 1), array(named_struct('start', element_at(acc, -1).start, 'end', greatest(element_at(acc, -1).end, x.end))))))"""
    merge = merge.replace("array(),", "cast(array() as array<struct<start: bigint, end: bigint>>),", 1)
    hits = hits.select("row_id", "items", F.expr(merge).alias("spans"))
    out = rows.select("row_id", "doc_id", "th", "n_words").join(hits, "row_id", "left")
    return out.select("row_id", "doc_id", "th", "n_words", F.coalesce("spans", F.expr("cast(array() as array<struct<start: bigint, end: bigint>>)")).alias("spans"), F.coalesce("items", F.expr("cast(array() as array<string>)")).alias("items"))


def verdicts(found: DataFrame) -> DataFrame:
    """n_hit, n_items and contaminated (at least a twentieth of the words is hit) added to contamination()'s rows."""
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, x: acc + x["end"] - x["start"])
    return found.withColumn("n_hit", n_hit).withColumn("n_items", F.size("items").cast("long")).withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def without_contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """docs without the rows that verdicts() calls contaminated. Columns stay as they are."""
    bad = verdicts(contamination(docs, items)).where("contaminated").select(F.col("doc_id").alias("k"), F.col("th").alias("kh")).distinct()
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("r"))
    rows = rows.join(bad, F.col("r.doc_id").eqNullSafe(F.col("k")) & (F.xxhash64("r.text") == F.col("kh")), "left_anti")
    return rows.select("r.*")


def op2_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = verdicts(contamination(docs, items))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), "contaminated")


OP2_SQL = r"""
with d as (select row_number() over () as rid, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
b as (select item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
bw as (select distinct item_id, least(len(w), 13) as n, list_slice(w, i, i + least(len(w), 13) - 1) as g
       from (select item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) as i from b where len(w) > 0)),
sizes as (select distinct n from bw),
dw as (select rid, n, i, list_slice(w, i, i + n - 1) as g
       from (select rid, w, n, unnest(range(1, len(w) - n + 2)) as i from d, sizes where len(w) >= n)),
hit as (select rid, item_id, i, dw.n from dw join bw on dw.n = bw.n and dw.g = bw.g),
words as (select rid, count(distinct p) as n_hit from (select rid, unnest(range(i, i + n)) as p from hit) group by rid),
its as (select rid, count(distinct item_id) as n_items, string_agg(distinct cast(item_id as varchar), ',' order by cast(item_id as varchar)) as s from hit group by rid)
select doc_id, cast(coalesce(len(w), 0) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit, cast(coalesce(n_items, 0) as bigint) as n_items,
       sha256(coalesce(s, '')) as items_sha256, coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= coalesce(len(w), 0) as contaminated
from d left join words using (rid) left join its using (rid)
"""
