"""Operator 13: SimHash near copies by segment popcounts.

A fingerprint of 64 bits is cut into 32 segments of two bits, whose bit counts
(0, 1 or 2) place it on an integer grid. A bit that differs changes one count by
one at most, so the Manhattan distance of two places is a lower bound of the
fingerprints' Hamming distance, and fingerprints to be linked lie within a
distance of 4 on the grid. The 32 axes are dealt to three bands; of a distance of
4, one band has 1 at most. So the range join of each band is one of cells next to
each other: a fingerprint stays in its cell and visits those that are one step up
on one axis, which finds every pair of neighbours once. Whoever meets in a cell is
compared exactly, by the differing bits.

Equal fingerprints are one from the start. A cell's pairs are never listed: a task
links each fingerprint to a root of its component in the cell, so links that a
large group of near copies shares are as many as its members. Cells with more than
BLOCK rows are cut into blocks that meet pair by pair, in tasks of their own.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..graph import components
from .common import materialize, ship, slices, text_bytes
from .groups import whole_groups

SHINGLE, DISTANCE, HASH_SEED = 4, 4, 42
BLOCK = 8192  # rows of a cell that meet in one task
SMALL = 64  # rows of a cell that is compared along with others
TILE = 256  # fingerprints that are compared with all others of their cell at once
CHUNK = 1 << 16  # shingles whose bits are counted at once
#: Axes (segments of two bits, from the lowest) of each band.
BANDS = ((0, 11), (11, 22), (22, 32))
SPACE = re.compile(rb"[\x20\x09-\x0d]+")


def fingerprint(text: bytes) -> int:
    """The SimHash of a text in UTF-8: a bit is set if it is in over half the hashes of the text's shingles, repeats included."""
    text = SPACE.sub(b" ", text.lower()).strip(b" ")  # bytes.lower() knows A-Z only
    if not text:
        return 0
    gaps = np.flatnonzero(np.frombuffer(text, np.uint8) == 32)
    start, end = np.append(0, gaps + 1), np.append(gaps, len(text))
    k = min(SHINGLE, len(start))
    start, end = start[: len(start) - k + 1], end[k - 1 :]
    ones = np.zeros(64, np.int64)
    for at in range(0, len(start), CHUNK):
        h = [xxhash.xxh64_intdigest(text[a:b], HASH_SEED) for a, b in zip(start[at : at + CHUNK].tolist(), end[at : at + CHUNK].tolist(), strict=True)]
        bits = np.unpackbits(np.array(h, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(start), bitorder="little").view("<u8")[0])


def _scan(batches):
    for batch in slices(batches, "text", 8 << 20):
        data, offsets = text_bytes(batch.column("text"))
        raw = data.tobytes()
        found = np.array([fingerprint(raw[a:b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)], np.uint64)
        yield pa.record_batch([batch.column("doc_id"), pa.array(found.view(np.int64))], ["doc_id", "fp"])


def popcounts(fp: np.ndarray) -> np.ndarray:
    """(fingerprints, 32) bit counts of the segments, the lowest two bits first."""
    pair = (fp[:, None] >> np.arange(0, 64, 2, dtype=np.uint64)) & np.uint64(3)
    return np.bitwise_count(pair).astype(np.int64)


def cells(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of fingerprints: the row, the cell and whether it is a visit, for its cell and those one step up, in each band. A cell's number holds its place (in base 3) and band."""
    counts = popcounts(fp)
    rows, names, visits = [], [], []
    for band, (a, b) in enumerate(BANDS):
        step = 3 ** np.arange(b - a, dtype=np.int64)
        home = counts[:, a:b] @ step
        row, axis = np.nonzero(counts[:, a:b] < 2)
        rows += [np.arange(len(fp)), row]
        names += [home * len(BANDS) + band, (home[row] + step[axis]) * len(BANDS) + band]
        visits += [np.zeros(len(fp), bool), np.ones(len(row), bool)]
    return np.concatenate(rows), np.concatenate(names), np.concatenate(visits)


def _cells(batches):
    for batch in batches:
        for at in range(0, batch.num_rows, CHUNK):
            part = batch.slice(at, CHUNK)
            row, name, visit = cells(np.asarray(part.column("fp")).view(np.uint64))
            yield pa.record_batch([part.column("fp").take(pa.array(row)), pa.array(name), pa.array(visit)], ["fp", "cell", "visit"])


def _near(a: np.ndarray, b: np.ndarray, distance: int) -> np.ndarray:
    return np.bitwise_count(a[:, None] ^ b[None, :]) <= distance


def local_links(home: np.ndarray, visitors: np.ndarray, distance: int = DISTANCE) -> tuple[np.ndarray, np.ndarray]:
    """Links (from, to) that join all that is near each other among `home`, and each visitor to the components of `home` it is near to; one to a component's root for each member."""
    home = np.unique(home)
    root = np.full(len(home), -1)
    left = np.arange(len(home))  # in no component yet
    while len(left):
        tile = left[:TILE]
        alone = _near(home[tile], home[left], distance).sum(axis=1) == 1
        root[tile[alone]] = tile[alone]
        left = left[root[left] < 0]
        for seed in tile[~alone].tolist():
            if root[seed] >= 0:
                continue
            root[seed], edge = seed, np.array([seed])  # all that it reaches, step by step
            left = left[left != seed]
            while len(edge) and len(left):
                hit = np.zeros(len(left), bool)
                for at in range(0, len(edge), TILE):
                    rest = np.flatnonzero(~hit)
                    hit[rest[_near(home[edge[at : at + TILE]], home[left[rest]], distance).any(axis=0)]] = True
                edge, left = left[hit], left[~hit]
                root[edge] = seed
    own = np.flatnonzero(root != np.arange(len(home)))
    pairs = [(home[own], home[root[own]])]
    if len(visitors) and len(home):
        visitors = np.unique(visitors)
        order = np.argsort(root, kind="stable")
        roots, first = np.unique(root[order], return_index=True)
        for at in range(0, len(visitors), TILE):
            near = np.logical_or.reduceat(_near(visitors[at : at + TILE], home[order], distance), first, axis=1)
            v, c = np.nonzero(near)
            pairs.append((visitors[at : at + TILE][v], home[roots[c]]))
    return np.concatenate([p[0] for p in pairs]), np.concatenate([p[1] for p in pairs])


KEY = ["cell", "i", "j"]


def _compare(distance: int):
    """Of rows in order of KEY: links that join all near rows of each group. Small groups are compared all at once, row by the row that lies so many rows on."""

    def work(batch: pa.RecordBatch, edges: np.ndarray) -> pa.RecordBatch:
        fp, visit = np.asarray(batch.column("fp")).view(np.uint64), np.asarray(batch.column("visit"))
        edge, count = edges[:-1], np.diff(edges)
        found = [(fp[:0], fp[:0])]
        for distant in range(1, int(count[count <= SMALL].max(initial=0))):
            some = (count > distant) & (count <= SMALL)
            size = count[some] - distant
            a = np.repeat(edge[some] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
            b = a + distant
            near = (np.bitwise_count(fp[a] ^ fp[b]) <= distance) & ~(visit[a] & visit[b])
            found.append((fp[a[near]], fp[b[near]]))
        for k in np.flatnonzero(count > SMALL).tolist():
            here = slice(int(edge[k]), int(edge[k] + count[k]))
            found.append(local_links(fp[here][~visit[here]], fp[here][visit[here]], distance))
        return pa.record_batch([pa.array(np.concatenate([f[k] for f in found]).view(np.int64)) for k in (0, 1)], ["a", "b"])

    return lambda batches: whole_groups(batches, KEY, work)


def fingerprint_components(fps: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """fp and root (one fingerprint of its component) for distinct fps (fp long), linked at `distance` or fewer differing bits (0 to 5; beyond, a band of the grid could hold more than one step)."""
    if not 0 <= distance <= 2 * len(BANDS) - 1:
        raise ValueError("the bands find fingerprints of at most 5 differing bits")
    parts = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = fps.select("fp").mapInArrow(_cells, "fp long, cell long, visit boolean")
    large = met.groupBy("cell").agg(F.count("*").alias("n")).where(F.col("n") > BLOCK).select(F.col("cell").alias("large"), F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    large = materialize(large, "large-cells")
    met = met.join(large, F.col("cell") == F.col("large"), "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    block = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    met = met.select("fp", "cell", "visit", block.alias("block"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    met = met.select("fp", "cell", "visit", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    links = met.repartition(parts, *KEY).sortWithinPartitions(*KEY).mapInArrow(_compare(distance), "a long, b long")
    roots = components(links)
    return fps.select("fp").join(roots.withColumnRenamed("rid", "fp"), "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"))


def simhash_classes(docs: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """doc_id, fp (long) and component_id (the least doc_id of its component) for each row of docs.

    Words are runs without white space, A-Z in lower case; shingles are four
    words, a text of fewer is one shingle. Texts without words, and null texts,
    have fingerprint 0 and are linked like any other. Null doc_ids are never the
    least, unless a component has no other. Repeated rows are rows of their own;
    an empty table gives none; other columns are ignored.
    """
    ship(docs.sparkSession)
    kind = dict(docs.dtypes)["doc_id"]
    rows = materialize(docs.select("doc_id", "text").mapInArrow(_scan, f"doc_id {kind}, fp long"), "simhashes")
    fps = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "fingerprints")
    whole = materialize(fingerprint_components(fps, distance).join(fps, "fp"), "fingerprint-roots")
    least = whole.groupBy("root").agg(F.min("least").alias("component_id"))
    named = materialize(whole.join(least, "root").select("fp", "component_id"), "components")
    return rows.join(named, "fp").select("doc_id", "fp", "component_id")


def op13_segment_popcounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return simhash_classes(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
