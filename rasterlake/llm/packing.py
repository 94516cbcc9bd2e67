"""Operator 8: order-preserving packing by dynamic programming.

Each partition is one stream of tokens in the order of its rows. Windows are cut
at document or sentence ends so that padding plus penalties for cut documents is
least; a monotone queue holds the open starts, so each end costs constant time.
"""

from __future__ import annotations

import json
import zlib
from collections import deque

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from .common import BYTE_CODE, mix, place, ship, slices, text_bytes, trimmed

SENTENCE_PENALTY = 4  # tokens of padding that a cut between two sentences of a document is worth
FORCED_PENALTY = 12  # the same for a cut inside a sentence
STEP = 32  # tokens between the places inside a longer sentence where it may be cut
SLOTS = 1 << 21  # of the table of chunks whose ids a worker keeps
KNOWN_IDS = 12_000_000  # ids it keeps, at most; then it starts anew

#: White space beyond ASCII, or the special token: such texts are encoded as one piece.
_WHOLE = "[\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]|<\\|endoftext\\|>"
_SPACE = np.zeros(256, bool)
_SPACE[9:14] = _SPACE[32] = True
_LETTER = np.zeros(256, bool)  # ASCII letters and digits, and what never joins them
_LETTER[48:58] = _LETTER[65:91] = _LETTER[97:123] = True
_SIGN = np.zeros(256, bool)
_SIGN[33:48] = _SIGN[58:65] = _SIGN[91:97] = _SIGN[123:127] = True
_SIGN[39] = False  # an apostrophe can begin a contraction
_STOP = np.zeros(256, bool)
_STOP[[33, 46, 63]] = True  # ! . ?


class Encoder:
    """Token ids of many texts. The byte-level pre-tokenizer never joins what stands on both sides of the start of a run of spaces, or an ASCII letter or digit and a sign but the apostrophe, so texts fall into chunks there and each distinct chunk is encoded once."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        kind = json.loads(self.tokenizer.to_str())
        split = kind["pre_tokenizer"] or {}
        self.chunked = split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space") and not kind["normalizer"]
        self.mark = self.tokenizer.encode("\r", add_special_tokens=False).ids
        self.chunked = self.chunked and len(self.mark) == 1
        self.forget()

    def forget(self) -> None:
        self.hash = np.zeros(SLOTS, np.uint64)  # of the chunk last put into each slot
        self.begin = np.zeros(SLOTS, np.int64)
        self.size = np.zeros(SLOTS, np.int32)
        self.ids = np.zeros(1 << 20, np.uint32)
        self.filled = 0

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [x.ids for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encode_chunks(self, chunks: list[str], plain: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all chunks, one after the other, and how many each has. Plain ones, with no more than one space in front, keep their ids in a row of chunks with a carriage return before each."""
        size = np.zeros(len(chunks), np.int64)
        parts = {}
        at = np.flatnonzero(plain)
        for x in range(0, len(at), 50_000):
            some = at[x : x + 50_000]
            row = np.array(self.tokenizer.encode_batch_fast(["\r" + "\r".join([chunks[i] for i in some.tolist()])], add_special_tokens=False)[0].ids, np.uint32)
            marks = np.append(np.flatnonzero(row == self.mark[0]), len(row))
            size[some] = np.diff(marks) - 1
            parts[x] = row[row != self.mark[0]]
        rest = np.flatnonzero(~plain)
        other = self.encode([chunks[i] for i in rest.tolist()])
        size[rest] = [len(x) for x in other]
        begin = np.cumsum(size) - size
        out = np.zeros(int(size.sum()), np.uint32)
        out[_spread(begin[at], size[at])] = np.concatenate(list(parts.values())) if parts else 0
        out[_spread(begin[rest], size[rest])] = [i for x in other for i in x]
        return out, size

    def lookup(self, h: np.ndarray, start: np.ndarray, end: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the ids of each chunk begin in self.ids, and how many there are."""
        slot = (h & np.uint64(SLOTS - 1)).astype(np.int64)
        begin, size = self.begin[slot], self.size[slot].astype(np.int64)
        miss = np.flatnonzero(self.hash[slot] != h)
        if not len(miss):
            return begin, size
        fresh, at, back = np.unique(h[miss], return_index=True, return_inverse=True)
        at = miss[at]
        a, b = start[at], end[at]
        head = _SPACE[data[a]]
        second = np.zeros(len(a), bool)
        longer = b - a > 1
        second[longer] = _SPACE[data[a[longer] + 1]]
        plain = ~(head & second) & ~(head & ~longer)
        raw = data.tobytes()
        chunks = [raw[x:y].decode("utf-8") for x, y in zip(a.tolist(), b.tolist(), strict=True)]
        if 13 in data:
            plain &= np.array(["\r" not in c for c in chunks])
        ids, n = self.encode_chunks(chunks, plain)
        if self.filled + len(ids) > KNOWN_IDS:
            self.forget()
            return self.lookup(h, start, end, data)
        if self.filled + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(max(len(ids), len(self.ids)), np.uint32)])
        self.ids[self.filled : self.filled + len(ids)] = ids
        where = self.filled + np.cumsum(n) - n
        self.filled += len(ids)
        spot = (fresh & np.uint64(SLOTS - 1)).astype(np.int64)
        self.hash[spot], self.begin[spot], self.size[spot] = fresh, where, n
        begin[miss], size[miss] = where[back], n[back]
        return begin, size

    def __call__(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all texts, each text's id count, and the places between ids (as counts of ids before) where a sentence ends."""
        odd = np.asarray(pc.fill_null(pc.match_substring_regex(column, _WHOLE), False)) if self.chunked else np.ones(len(column), bool)
        apart = {}
        if odd.any():
            rows = np.flatnonzero(odd)
            apart = dict(zip(rows.tolist(), self.encode([t or "" for t in column.take(pa.array(rows)).to_pylist()]), strict=True))
            column = pc.if_else(pa.array(odd), "", column)
        data, offsets = text_bytes(column)
        rows = len(offsets) - 1
        begins = _SPACE[data]
        begins[1:] &= ~begins[:-1]
        begins[1:] |= _SIGN[data[1:]] & _LETTER[data[:-1]]
        firsts = offsets[:-1][np.diff(offsets) > 0]
        begins[firsts] = True
        start = np.flatnonzero(begins)
        if len(start):
            end = np.append(start[1:], len(data))
            length = end - start
            within = np.arange(len(data), dtype=np.int32) - np.repeat(start.astype(np.int32), length)
            value = BYTE_CODE[data]
            value *= place(int(length.max()))[within]
            h = mix(np.add.reduceat(value, start) ^ length.astype(np.uint64))
            begin, size = self.lookup(h, start, end, data)
            row = np.repeat(np.arange(rows), np.diff(np.searchsorted(start, offsets)))
            closed = np.zeros(len(start), bool)  # a sentence ends before this chunk
            inner = start > offsets[row]
            closed[inner] = _STOP[data[start[inner] - 1]] | (data[start[inner]] == 10)
        else:
            size = begin = row = np.zeros(0, np.int64)
            closed = np.zeros(0, bool)
        total = np.bincount(row, weights=size, minlength=rows).astype(np.int64) if len(row) else np.zeros(rows, np.int64)
        for r, ids in apart.items():
            total[r] = len(ids)
        total += 1  # id 0 closes each text
        text_at = np.cumsum(total) - total
        chunk_at = np.cumsum(size) - size
        first_chunk = np.searchsorted(row, np.arange(rows), "left")
        chunk_base = np.append(chunk_at, size.sum())[first_chunk]
        out = np.zeros(int(total.sum()), np.uint32)
        to = text_at[row] + chunk_at - chunk_base[row]
        out[_spread(to, size)] = self.ids[_spread(begin, size)]
        for r, ids in apart.items():
            out[text_at[r] : text_at[r] + len(ids)] = ids
        return out, total, to[closed]


def _spread(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """begin[0], begin[0]+1, ... (size[0] numbers), then the same for the next."""
    return np.arange(int(size.sum())) + np.repeat(begin - (np.cumsum(size) - size), size)


def cut_places(places: np.ndarray, penalty: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """The given places, and more where neighbours lie further apart than a step, which is at most a window."""
    step = min(STEP, window)
    room = np.diff(places)
    count = np.maximum(0, (room - 1) // step)
    gaps = np.flatnonzero(count)
    if not len(gaps):
        return places, penalty
    count = count[gaps]
    nth = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + 1
    more = np.repeat(places[gaps], count) + nth * step
    where = np.concatenate([places, more])
    cost = np.concatenate([penalty, np.full(len(more), FORCED_PENALTY)])
    order = np.argsort(where, kind="stable")
    return where[order], cost[order]


def best_cuts(places: np.ndarray, penalty: np.ndarray, window: int) -> list[int]:
    """Indices of the cuts from places[0] to places[-1] with least padding plus penalties; neighbours are at most a window apart."""
    at, fee = places.tolist(), penalty.tolist()
    total, back = [0] * len(at), [0] * len(at)
    queue, key = deque([0]), [at[0]] + [0] * (len(at) - 1)  # key: cost so far plus place; least first
    for j in range(1, len(at)):
        here = at[j]
        while here - at[queue[0]] > window:
            queue.popleft()
        i = queue[0]
        back[j] = i
        total[j] = cost = key[i] + window - here + fee[j]
        key[j] = k = cost + here
        while queue and key[queue[-1]] >= k:
            queue.pop()
        queue.append(j)
    cuts, j = [], len(at) - 1
    while j:
        cuts.append(j)
        j = back[j]
    return cuts[::-1]


_ENCODERS: dict[str, Encoder] = {}


def _pack(path: str, window: int, with_ids: bool):
    def run(batches):
        encoder = _ENCODERS.setdefault(path, None) or Encoder(path)
        _ENCODERS[path] = encoder
        base = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 36
        sequences = 0
        open_docs: list[tuple] = []  # of the stream's rest: (doc_id, ids before in its document, doc_tokens)
        rest, places, penalty = np.zeros(0, np.uint32), np.array([0]), np.array([0])

        def emit(ids, docs, starts, cuts):
            """Pieces of the windows that end at cuts. docs: (doc_id, start, doc_tokens); starts: where each begins in ids."""
            nonlocal sequences
            edges = np.unique(np.concatenate([starts, [0], cuts]))
            edges = edges[edges <= cuts[-1]]
            a, b = edges[:-1], edges[1:]
            doc = np.searchsorted(starts, a, "right") - 1
            seq = np.searchsorted(cuts, a, "right")
            offset = a - np.concatenate([[0], cuts])[seq]
            raw = ids.astype("<u4").tobytes()
            crc = [zlib.crc32(raw[4 * x : 4 * y]) for x, y in zip(a.tolist(), b.tolist(), strict=True)]
            cols = {
                "doc_id": pa.array([docs[d][0] for d in doc.tolist()], doc_type),
                "start": pa.array(a - starts[doc] + np.array([d[1] for d in docs], np.int64)[doc]),
                "length": pa.array(b - a),
                "ids_crc32": pa.array(crc, pa.int64()),
                "doc_tokens": pa.array(np.array([d[2] for d in docs], np.int64)[doc]),
                "sequence_id": pa.array(base + sequences + seq),
                "offset": pa.array(offset),
            }
            if with_ids:
                cols["ids"] = pa.array([ids[x:y].astype(np.int32) for x, y in zip(a.tolist(), b.tolist(), strict=True)], pa.list_(pa.int32()))
            sequences += len(cuts)
            return pa.RecordBatch.from_pydict(cols)

        doc_type = None
        starts = np.zeros(0, np.int64)

        def solve(final: bool):
            nonlocal rest, places, penalty, open_docs, starts
            where, cost = cut_places(places, penalty, window)
            cuts = where[best_cuts(where, cost, window)]
            if not final:
                cuts = cuts[:-2]  # the last windows stay open for what follows
                if not len(cuts):
                    return
            yield emit(rest, open_docs, starts, cuts)
            end = int(cuts[-1])
            keep = int(np.searchsorted(starts, end, "right")) - 1
            if final:
                return
            doc_id, before, tokens = open_docs[keep]
            open_docs = [(doc_id, before + end - int(starts[keep]), tokens), *open_docs[keep + 1 :]]
            starts = np.concatenate([[0], starts[keep + 1 :] - end])
            later = places > end
            places = np.concatenate([[0], places[later] - end])
            penalty = np.concatenate([[0], penalty[later]])
            rest = rest[end:]

        for batch in slices(batches, "text", 2 << 20):
            doc_type = batch.schema.field("doc_id").type
            ids, total, sentences = encoder(batch.column("text"))
            shift = len(rest)
            ends = shift + np.cumsum(total)
            starts = np.concatenate([starts, ends - total])
            open_docs += [(d, 0, t) for d, t in zip(batch.column("doc_id").to_pylist(), total.tolist(), strict=True)]
            where = np.concatenate([places, ends, sentences + shift])
            cost = np.concatenate([penalty, np.zeros(len(ends), np.int64), np.full(len(sentences), SENTENCE_PENALTY)])
            order = np.lexsort((cost, where))
            where, cost = where[order], cost[order]
            once = np.append(True, np.diff(where) > 0)
            places, penalty = where[once], cost[once]
            rest = np.concatenate([rest, ids])
            yield from solve(False)
        if len(rest):
            yield from solve(True)

    return run


def pack(docs: DataFrame, tokenizer: str, window: int = 1024, with_ids: bool = True) -> DataFrame:
    """Pieces of docs (doc_id, text) packed in the order of the rows: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset and, unless with_ids is false, ids.

    Each partition is packed by itself, so nothing is shuffled; only its last
    window can be far from full. A window holds at most `window` ids. Null and
    empty texts are one id 0. Repeated rows and null doc_ids are packed like
    others; other columns are ignored. The optimum is found for runs of about
    2 MB of text; the last two windows of a run are solved anew with the next.
    Padding is counted up to `window`; a window that ends at a power of two
    needs none, so it never counts as less than it is.
    """
    ship(docs.sparkSession)
    kind = dict(docs.dtypes)["doc_id"]
    schema = f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids array<int>" * with_ids
    return docs.select("doc_id", "text").mapInArrow(trimmed(_pack(tokenizer, window, with_ids)), schema)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"), with_ids=False)
