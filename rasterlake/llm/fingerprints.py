"""Operator 5: document fingerprints from closed syncmers.

A k-mer (of UTF-8 bytes) is chosen if its smallest inner s-mer is its first or
last one. That depends on the k-mer alone, so an edit moves only the anchors it
touches. A fingerprint keeps a share of the whole text's anchors, chosen by hash,
with their places. Two fingerprints are matched by position: equal anchors count
as far as they come in the same order in both.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import mix, place, ship, slices, text_bytes
from .decontamination import _sliding

K, S = 16, 8
KEPT = 96  # anchors that a fingerprint holds at least (all, if the text has fewer)
RATE = 32  # and it holds each anchor whose hash is in the lowest such share, so it grows with the text
_NONE = np.uint64((1 << 40) - 1)


def syncmers(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Closed syncmers of each text: row, place (byte in its text) and hash. A text of under K bytes, but not none, is one anchor."""
    n = len(data)
    rows, at, found = [], [], []
    size = np.diff(offsets)
    if n >= K:
        eight = np.lib.stride_tricks.sliding_window_view(data, 8)
        inner = mix(np.ascontiguousarray(eight).view(np.uint64).ravel())
        least = _sliding(inner, K - S + 1, np.minimum)
        edge = np.flatnonzero((inner[: len(least)] == least) | (inner[K - S :] == least))
        row = np.searchsorted(offsets, edge, "right") - 1
        inside = edge + K <= offsets[row + 1]
        edge, row = edge[inside], row[inside]
        by = place(2)
        rows.append(row)
        at.append(edge - offsets[row])
        found.append(mix(inner[edge] * by[0] + inner[edge + K - S] * by[1]))
    for r in np.flatnonzero((size > 0) & (size < K)):
        raw = data[offsets[r] : offsets[r + 1]].tobytes()
        rows.append(np.array([r]))
        at.append(np.array([0]))
        found.append(np.frombuffer(hashlib.blake2b(raw, digest_size=8).digest(), np.uint64))
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    row, at, found = map(np.concatenate, (rows, at, found))
    order = np.lexsort((at, row))
    return row[order], at[order], found[order]


class Sketches(NamedTuple):
    """Fingerprints of a run of texts: the anchors of text i are at first[i] to first[i + 1], in order of hash; limit[i] is the hash up to which all of its anchors are kept."""

    first: np.ndarray
    hash: np.ndarray
    place: np.ndarray
    limit: np.ndarray


def sketches(texts: list[str]) -> Sketches:
    """Of each text the anchors (hash of 40 bits, first place) with hashes in the lowest RATE-th, or else the KEPT smallest ones."""
    data, offsets = text_bytes(pa.array(texts, pa.large_string()))
    row, at, h = syncmers(data, offsets)
    h = np.minimum(h >> np.uint64(24), _NONE - np.uint64(1))
    order = np.lexsort((at, h, row))
    row, at, h = row[order], at[order], h[order]
    if len(row):
        once = np.append(True, (row[1:] != row[:-1]) | (h[1:] != h[:-1]))
        row, at, h = row[once], at[once], h[once]
    count = np.bincount(row, minlength=len(texts))
    begin = np.cumsum(count) - count
    low = h < _NONE // np.uint64(RATE)
    few = np.arange(len(row)) - begin[row] < KEPT
    limit = np.full(len(texts), _NONE, np.uint64)
    cut = np.bincount(row[~low & ~few], minlength=len(texts)) > 0
    limit[cut] = np.maximum(h[begin[cut] + KEPT - 1], _NONE // np.uint64(RATE) - np.uint64(1))
    keep = low | few
    first = np.concatenate([[0], np.cumsum(np.bincount(row[keep], minlength=len(texts)))])
    return Sketches(first, h[keep], at[keep], limit)


def spelled(s: Sketches) -> list[str]:
    """Fingerprints as base64 strings of big-endian numbers: the limit (5 bytes), then hash (5) and place (4) of each anchor; empty for an empty text."""
    raw = np.empty((len(s.hash), 9), np.uint8)
    raw[:, :5] = s.hash.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 3:]
    raw[:, 5:] = s.place.astype(">u4").view(np.uint8).reshape(-1, 4)
    limit = s.limit.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 3:]
    ends = s.first.tolist()
    return [base64.b64encode(limit[i].tobytes() + raw[a:b].tobytes()).decode() if a < b else "" for i, (a, b) in enumerate(zip(ends[:-1], ends[1:], strict=True))]


def in_order(places: list[int]) -> int:
    """Length of the longest increasing subsequence."""
    tails: list[int] = []
    for x in places:
        k = bisect.bisect_left(tails, x)
        tails[k : k + 1] = [x]
    return len(tails)


def likeness(s: Sketches, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Positional likeness of the fingerprints a and b (indices into s): anchors that match and keep their order, of all anchors of both, up to the lower limit; 1 for two empty ones."""
    limit = np.minimum(s.limit[a], s.limit[b])

    def members(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        size = s.first[rows + 1] - s.first[rows]
        pair = np.repeat(np.arange(len(rows)), size)
        at = np.arange(len(pair)) + np.repeat(s.first[rows] - (np.cumsum(size) - size), size)
        known = s.hash[at] <= limit[pair]
        pair, at = pair[known], at[known]
        return pair, (pair.astype(np.uint64) << np.uint64(40)) | s.hash[at], s.place[at]

    (pair, key, x), (other, key2, y) = members(a), members(b)
    _, i, j = np.intersect1d(key, key2, assume_unique=True, return_indices=True)
    order = np.lexsort((x[i], pair[i]))
    match, y = pair[i][order], y[j][order]
    shared = np.bincount(match, minlength=len(a))
    total = np.bincount(pair, minlength=len(a)) + np.bincount(other, minlength=len(a)) - shared
    chain = shared.copy()
    first = np.searchsorted(match, np.arange(len(a) + 1))
    back = np.flatnonzero((match[1:] == match[:-1]) & (y[1:] < y[:-1]))
    for p in np.unique(match[back]).tolist():
        chain[p] = in_order(y[first[p] : first[p + 1]].tolist())
    return np.where(total > 0, chain / np.maximum(total, 1), 1.0)


def anchors(docs: DataFrame) -> DataFrame:
    """doc_id and anchors (array of place in bytes and hash, in order of place) for positional matching. Null and empty texts have none."""

    def run(batches):
        for batch in slices(batches, "text"):
            row, at, h = syncmers(*text_bytes(batch.column("text")))
            ends = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=batch.num_rows))]).astype(np.int32)
            items = pa.StructArray.from_arrays([pa.array(at), pa.array(h.view(np.int64))], ["place", "hash"])
            yield pa.record_batch([batch.column("doc_id"), pa.ListArray.from_arrays(pa.array(ends), items)], ["doc_id", "anchors"])

    ship(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, anchors array<struct<place: long, hash: long>>")


def with_next(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text), dealt by ranges of doc_id, with columns bucket and guest.

    The rows of the lowest doc_id of each range are also given, as guests, to
    the range before (those of the first range to the last), so each range knows
    the row that follows its last one. Every text moves once.
    """
    spark = docs.sparkSession
    ship(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    shares = [i / parts for i in range(1, parts)] or [0.5]
    stats = docs.agg(F.percentile_approx("doc_id", shares, max(10_000, 20 * parts)).alias("cuts"), F.min("doc_id").alias("least"), F.max(F.col("doc_id").isNull()).alias("nulls")).first()
    # A boundary is an id of the table, so its rows are the first of their range; nulls come before all.
    cuts = np.array(sorted({int(c) for c in stats["cuts"] or ()} - ({int(stats["least"])} if stats["least"] is not None else set())), np.int64)
    lowest, nulls, last = stats["least"], bool(stats["nulls"]), len(cuts)
    if nulls and lowest is not None and lowest not in cuts:
        cuts = np.concatenate([[lowest], cuts]).astype(np.int64)  # null rows are a range of their own
        last = len(cuts)

    @F.pandas_udf("array<int>")
    def codes(ids: pd.Series, none: pd.Series) -> pd.Series:
        out = []
        for x, empty in zip(ids.tolist(), none.tolist(), strict=True):
            b = 0 if empty else int(np.searchsorted(cuts, x, "right"))
            to = [2 * b]
            if b and cuts[b - 1] == x:
                to.append(2 * (b - 1) + 1)
            if empty if nulls else x == lowest:
                to.append(2 * last + 1)
            out.append(to)
        return pd.Series(out)

    rows = docs.select("doc_id", "text").withColumn("code", F.explode(codes(F.coalesce("doc_id", F.lit(0)), F.col("doc_id").isNull())))
    rows = rows.select("doc_id", "text", F.expr("shiftright(code, 1)").alias("bucket"), (F.col("code") % 2).alias("guest"))
    return rows.repartitionById(last + 1, F.col("bucket")).sortWithinPartitions("bucket", "guest", F.col("doc_id").asc_nulls_first(), "text")


def fingerprints(docs: DataFrame) -> DataFrame:
    """Per row of docs (doc_id bigint, text): doc_id, n_chars, fingerprint, edited_sha256, edited_fingerprint, near_edited, near_next.

    The edited text has the last half of the code points replaced by the first
    as many of the next row's text, in order of doc_id (rows with the same id: of
    text); after the last comes the first, so a single row follows itself. Null
    texts count as empty; null ids come first; an empty table gives no rows;
    other columns are ignored. An anchor that a text holds several times counts
    once, at its first place. Texts are held a run at a time, so memory is bounded
    by a megabyte or the longest text and its neighbour.
    """

    def pairs(batches):
        """(bucket, doc_id, text, next text) of the rows that are no guests."""
        held = None
        for batch in slices(batches, "text", 1 << 20):
            rows = list(zip(batch.column("bucket").to_pylist(), batch.column("guest").to_pylist(), batch.column("doc_id").to_pylist(), [t or "" for t in batch.column("text").to_pylist()], strict=True))
            out = []
            for row in rows:
                if held and not held[1] and held[0] == row[0]:
                    out.append((held[2], held[3], row[3]))
                held = row
            yield out

    def run(batches):
        for rows in pairs(batches):
            if not rows:
                continue
            ids, texts, following = map(list, zip(*rows, strict=True))
            edited = [t[: len(t) - len(t) // 2] + f[: len(t) // 2] for t, f in zip(texts, following, strict=True)]
            n = len(texts)
            # the next row's text is the next text of the run but for the last
            same = [i + 1 < n and following[i] is texts[i + 1] for i in range(n)]
            extra = [i for i in range(n) if not same[i]]
            every = sketches(texts + edited + [following[i] for i in extra])
            own, new, after = np.arange(n), np.arange(n, 2 * n), np.arange(1, n + 1)
            after[extra] = np.arange(2 * n, 2 * n + len(extra))
            spelt = spelled(every)
            yield pa.record_batch(
                [
                    pa.array(ids, pa.int64()),
                    pa.array([len(t) for t in texts], pa.int64()),
                    pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited]),
                    pa.array(spelt[:n]),
                    pa.array(spelt[n : 2 * n]),
                    pa.array(likeness(every, own, new)),
                    pa.array(likeness(every, own, after)),
                ],
                ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
            )

    docs = docs.select(F.col("doc_id").cast("long"), "text")
    return with_next(docs).mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def op5_closed_syncmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet"))
