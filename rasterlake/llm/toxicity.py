"""Operator 9: toxic spans by a linear-chain conditional random field.

Words and their beginnings and ends are the features. Token labels come from
the labelled documents: a token is toxic if its word, or the word's beginning, is
far more frequent in toxic documents than chance allows. Forward-backward
marginals give the spans, and their sums the documents' scores.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .class_lm import held_out
from .common import ALNUM, Words, mix, ship, slices, text_bytes, trimmed

BUCKETS = 1 << 18  # of hashed features
TOXIC_SAMPLE, CLEAN_SAMPLE, LONGEST = 1500, 6000, 8000  # training rows of each label at most, and their characters at most
WINDOW = 32  # tokens of a training sequence at most
STRIDE = 64  # tokens of a block of the parallel scan
PREFIXES, SUFFIXES = (3, 4, 5, 6), (3, 4)


def feature_keys(words: Words, at: np.ndarray | None = None) -> np.ndarray:
    """(words, 7) keys of 64 bits of all words, or those with the indices `at`: the word, its first 3 to 6 bytes, its last 3 and 4; 0 where the word is shorter."""
    start, end, h = (x if at is None else x[at] for x in (words.start, words.end, words.hash))
    n = len(start)
    data = np.concatenate([words.data, np.zeros(8, np.uint8)])
    eight = np.lib.stride_tricks.sliding_window_view(data, 8)
    length = end - start
    keys = np.zeros((n, 1 + len(PREFIXES) + len(SUFFIXES)), np.uint64)
    keys[:, 0] = h
    if not n:
        return keys
    head = np.ascontiguousarray(eight[start]).view(np.uint64).ravel()
    column = 1
    for k in PREFIXES:
        keys[:, column] = np.where(length >= k, mix((head & np.uint64((1 << 8 * k) - 1)) ^ mix(np.array([column], np.uint64))[0]), 0)
        column += 1
    for k in SUFFIXES:
        tail = np.ascontiguousarray(eight[np.maximum(end - k, 0)]).view(np.uint64).ravel()
        keys[:, column] = np.where(length >= k, mix((tail & np.uint64((1 << 8 * k) - 1)) ^ mix(np.array([column], np.uint64))[0]), 0)
        column += 1
    return keys


class Sample:
    """Tokens of a bounded set of texts: word (index of its type), row, count (tokens of each text); keys of the types."""

    def __init__(self, texts: pa.Table):
        kinds, keys, tokens, counts = [], [], [], []
        for batch in slices(texts.to_batches(), "text", 2 << 20):
            words = Words(*text_bytes(batch.column("text")), ALNUM)
            kind, first = np.unique(words.hash, return_index=True)
            kinds.append(kind)
            keys.append(feature_keys(words, first))
            tokens.append(words.hash)
            counts.append(words.count)
        join = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
        self.hash = join(tokens, np.uint64)
        self.count = join(counts, np.int64)
        self.row = np.repeat(np.arange(len(self.count), dtype=np.int32), self.count)
        kind, first = np.unique(join(kinds, np.uint64), return_index=True)
        self.keys = np.concatenate(keys)[first] if keys else np.zeros((0, 1 + len(PREFIXES) + len(SUFFIXES)), np.uint64)
        self.word = np.searchsorted(kind, self.hash).astype(np.int32)

    def only(self, rows: np.ndarray) -> None:
        """Keep some of the texts (a mask)."""
        tokens = rows[self.row]
        self.hash, self.word, self.count = self.hash[tokens], self.word[tokens], self.count[rows]
        self.row = np.repeat(np.arange(len(self.count), dtype=np.int32), self.count)


def _slots(keys: np.ndarray) -> np.ndarray:
    """Weights' indices; BUCKETS is that of no feature."""
    return np.where(keys != 0, keys & np.uint64(BUCKETS - 1), BUCKETS).astype(np.int64)


def token_labels(sample: Sample, toxic: np.ndarray) -> np.ndarray:
    """True for tokens with a word or beginning that toxic documents hold far too often to be chance: in three documents at least, four in five of its documents toxic, and a log-likelihood ratio over 2 ln(words tried), so that about one word of all passes by chance, however large the sample is."""
    texts = max(1, len(toxic))
    pair = np.unique(sample.word.astype(np.int64) * texts + sample.row)
    word, doc = pair // texts, pair % texts
    share = toxic.mean()
    part_log = lambda x, y: np.where(x > 0, x * np.log(np.maximum(x, 1e-9) / np.maximum(y, 1e-9)), 0.0)
    hot = np.zeros(len(sample.keys), bool)
    for column in range(1 + len(PREFIXES)):
        key, back = np.unique(sample.keys[:, column], return_inverse=True)
        seen = np.unique(back[word].astype(np.int64) * texts + doc)
        which, where = seen // texts, seen % texts
        a = np.bincount(which, weights=toxic[where], minlength=len(key))
        b = np.bincount(which, minlength=len(key)) - a
        ratio = 2 * (part_log(a, (a + b) * share) + part_log(b, (a + b) * (1 - share)))
        hot |= ((a >= 3) & (a >= 0.8 * (a + b)) & (ratio > 2 * np.log(max(len(key), 2))) & (key != 0))[back]
    return hot[sample.word]


@dataclass
class Crf:
    weights: np.ndarray  # of the toxic label, by slot; the last one, of no feature, stays 0
    bias: float
    start: float
    moves: np.ndarray  # 2 by 2: score of label v after label u
    document: np.ndarray  # logistic weights: 1, and three sums of a document's marginals

    def emission(self, keys: np.ndarray) -> np.ndarray:
        return np.clip(self.weights[_slots(keys)].sum(axis=1) + self.bias, -40, 40)


def _batch_marginals(e: np.ndarray, crf: Crf, real: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Marginals of sequences (rows), and expected label pairs; by odds of the toxic label. Where `real` is false, after a sequence's end, nothing counts."""
    real = np.ones(e.shape, bool) if real is None else real
    t = np.exp(crf.moves)
    x = np.exp(e)
    n, length = e.shape
    f, s = np.empty_like(x), np.empty_like(x)
    f[:, 0] = x[:, 0] * np.exp(crf.start)
    for i in range(1, length):
        f[:, i] = x[:, i] * (t[0, 1] + t[1, 1] * f[:, i - 1]) / (t[0, 0] + t[1, 0] * f[:, i - 1])
    s[:, -1] = 1
    for i in range(length - 2, -1, -1):
        y = x[:, i + 1] * s[:, i + 1]
        s[:, i] = np.where(real[:, i + 1], (t[1, 1] * y + t[1, 0]) / (t[0, 1] * y + t[0, 0]), 1)
    odds = f * s
    y = x[:, 1:] * s[:, 1:]
    both = np.stack([np.full_like(y, t[0, 0]), t[0, 1] * y, t[1, 0] * f[:, :-1], t[1, 1] * f[:, :-1] * y])
    both *= real[:, 1:] / both.sum(axis=0)
    return real * odds / (1 + odds), both.sum(axis=(1, 2)).reshape(2, 2), both


def train_crf(sample: Sample, labels: np.ndarray, rounds: int = 6, seed: int = 0) -> Crf:
    """Adagrad on the log-likelihood of each text's windows of WINDOW tokens, the last one with what is left, with all toxic windows and clean ones up to twice as many, or 4000."""
    rng = np.random.default_rng(seed)
    each = -(-sample.count // WINDOW)
    nth = np.arange(int(each.sum())) - np.repeat(np.cumsum(each) - each, each)
    begin = np.repeat(np.cumsum(sample.count) - sample.count, each) + nth * WINDOW
    size = np.minimum(WINDOW, np.repeat(sample.count, each) - nth * WINDOW)
    inside = np.arange(WINDOW)[None, :] < size[:, None]
    windows = np.where(inside, begin[:, None] + np.arange(WINDOW)[None, :], 0)
    crf = Crf(np.zeros(BUCKETS + 1), -3.0, -1.0, np.zeros((2, 2)), np.zeros(4))
    if not len(windows):
        return crf
    hot = (labels[windows] & inside).any(axis=1)
    cold = np.flatnonzero(~hot)
    taken = np.concatenate([np.flatnonzero(hot), rng.permutation(cold)[: max(4000, 2 * int(hot.sum()))]])
    windows, inside = windows[taken], inside[taken]
    slots = _slots(sample.keys)
    square, small = np.full(BUCKETS + 1, 1e-6), np.full(6, 1e-6)
    for _ in range(rounds):
        order = rng.permutation(len(windows))
        for at in range(0, len(order), 256):
            some, real = windows[order[at : at + 256]], inside[order[at : at + 256]]
            index = np.where(real[:, :, None], slots[sample.word[some]], BUCKETS)
            e = np.clip(crf.weights[index].sum(axis=2) + crf.bias, -30, 30)
            y = (labels[some] & real).astype(float)
            p, pairs, _ = _batch_marginals(e, crf, real)
            gap = y - p
            seen = np.zeros((2, 2))
            np.add.at(seen, (y[:, :-1].astype(int).ravel(), y[:, 1:].astype(int).ravel()), real[:, 1:].ravel())
            g = np.bincount(index.ravel(), weights=np.repeat(gap.ravel(), index.shape[2]), minlength=BUCKETS + 1) / len(some)
            g -= 1e-5 * crf.weights
            g[BUCKETS] = 0
            square += g * g
            crf.weights += 0.3 * g / np.sqrt(square + 1e-8)
            h = np.concatenate([[gap.sum(), gap[:, 0].sum()], (seen - pairs).ravel()]) / len(some)
            small += h * h
            step = 0.1 * h / np.sqrt(small)
            crf.bias += step[0]
            crf.start += step[1]
            crf.moves += step[2:].reshape(2, 2)
    return crf


def _scan(maps: list[np.ndarray], count: np.ndarray) -> np.ndarray:
    """Of r[i] = (p[i] r[i-1] + q[i]) / (u[i] r[i-1] + v[i]) all values, texts one after the other; the first map of each text is constant.

    Blocks of STRIDE tokens are composed side by side, then chained text by text.
    """
    count = count[count > 0]
    blocks = -(-count // STRIDE)
    total = int(blocks.sum())
    first = np.cumsum(blocks) - blocks
    nth = np.arange(total) - np.repeat(first, blocks)
    begin = np.repeat(np.cumsum(count) - count, blocks) + nth * STRIDE
    size = np.minimum(STRIDE, np.repeat(count, blocks) - nth * STRIDE)
    at = begin[:, None] + np.arange(STRIDE)[None, :]
    real = np.arange(STRIDE)[None, :] < size[:, None]
    at = np.where(real, at, 0)
    p, q, u, v = (np.where(real, m[at], fill) for m, fill in zip(maps, (1.0, 0.0, 0.0, 1.0), strict=True))
    entry = np.ones(total)
    if (blocks > 1).any():
        a, b, c, d = np.ones(total), np.zeros(total), np.zeros(total), np.ones(total)
        for t in range(STRIDE):
            a, b, c, d = p[:, t] * a + q[:, t] * c, p[:, t] * b + q[:, t] * d, u[:, t] * a + v[:, t] * c, u[:, t] * b + v[:, t] * d
            top = np.maximum(np.maximum(a, b), np.maximum(c, d))
            a, b, c, d = a / top, b / top, c / top, d / top
        order = np.argsort(-blocks, kind="stable")
        for j in range(int(blocks.max()) - 1):
            live = order[: np.searchsorted(-blocks[order], -(j + 1), "left")]
            k = first[live] + j
            entry[k + 1] = (a[k] * entry[k] + b[k]) / (c[k] * entry[k] + d[k])
    out = np.empty((total, STRIDE))
    r = entry
    for t in range(STRIDE):
        r = (p[:, t] * r + q[:, t]) / (u[:, t] * r + v[:, t])
        out[:, t] = r
    return out[real]


def marginals(e: np.ndarray, count: np.ndarray, crf: Crf) -> np.ndarray:
    """Probability of the toxic label at each token, texts of `count` tokens one after the other."""
    n = len(e)
    if not n:
        return np.zeros(0)
    t = np.exp(crf.moves)
    x = np.exp(e)
    count = count[count > 0]
    begin = np.cumsum(count) - count
    last = begin + count - 1
    maps = [x * t[1, 1], x * t[0, 1], np.full(n, t[1, 0]), np.full(n, t[0, 0])]
    for m, value in zip(maps, (0.0, x[begin] * np.exp(crf.start), 0.0, 1.0), strict=True):
        m[begin] = value
    forward = _scan(maps, count)
    y = np.append(x[1:], 1.0)
    maps = [t[1, 1] * y, np.full(n, t[1, 0]), t[0, 1] * y, np.full(n, t[0, 0])]
    for m, value in zip(maps, (0.0, 1.0, 0.0, 1.0), strict=True):
        m[last] = value
    backward = _scan([m[::-1] for m in maps], count[::-1])[::-1]
    odds = forward * backward
    return odds / (1 + odds)


def _summary(p: np.ndarray, row: np.ndarray, texts: int) -> np.ndarray:
    """(texts, 4): 1, log of 1 plus the sum of squared marginals, the largest marginal, log of 1 plus the tokens over a half."""
    out = np.zeros((texts, 4))
    out[:, 0] = 1
    out[:, 1] = np.log1p(np.bincount(row, weights=p * p, minlength=texts))
    np.maximum.at(out[:, 2], row, p)
    out[:, 3] = np.log1p(np.bincount(row, weights=p > 0.5, minlength=texts))
    return out


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.1) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(x.shape[1])
        w += np.linalg.solve(hessian, x.T @ (y - p) - ridge * w)
    return w


def distinct_texts(sample: Sample) -> np.ndarray:
    """True for texts that are no near copy of an earlier one: no pair of smallest word hashes (three pairs, by other seeds) is shared. Copies would make the words of one text look frequent."""
    texts = len(sample.count)
    keep = np.ones(texts, bool)
    full = np.flatnonzero(sample.count)
    first = (np.cumsum(sample.count) - sample.count)[full]
    for seed in range(3):
        pair = np.zeros((texts, 2), np.uint64)
        for side in range(2):
            if len(full):
                pair[full, side] = np.minimum.reduceat(mix(sample.hash ^ mix(np.array([2 * seed + side], np.uint64))[0]), first)
        _, at = np.unique(mix(pair[:, 0]) ^ pair[:, 1], return_index=True)
        once = np.zeros(texts, bool)
        once[at] = True
        keep &= once
    return keep


def fit(rows: pa.Table) -> Crf:
    """A model from whole texts (text) and their labels (toxic, 0 or 1). With only one label, or no rows, it tells nothing: all scores are the label's share."""
    toxic = np.asarray(rows["toxic"]).astype(np.int64)
    share = float(toxic.mean()) if len(toxic) else 0.0
    crf = Crf(np.zeros(BUCKETS + 1), -3.0, -1.0, np.zeros((2, 2)), np.array([np.log((share + 1e-6) / (1 - share + 1e-6)), 0.0, 0.0, 0.0]))
    if not 0 < share < 1:
        return crf
    sample = Sample(rows)
    fresh = distinct_texts(sample)
    if 0 < toxic[fresh].mean() < 1:
        sample.only(fresh)
        toxic = toxic[fresh]
    if not len(sample.row):
        return crf
    labels = token_labels(sample, toxic.astype(float))
    crf = train_crf(sample, labels)
    p = marginals(crf.emission(sample.keys)[sample.word], sample.count, crf)
    crf.document = _logistic(_summary(p, sample.row, len(sample.count)), toxic.astype(float))
    return crf


def training_rows(docs: DataFrame, labels: DataFrame, is_held_out: Column) -> pa.Table:
    """The bounded sample: TOXIC_SAMPLE and CLEAN_SAMPLE labelled ids, first by hash, whose texts have at most LONGEST characters."""
    known = labels.where(~is_held_out & F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).select("doc_id", "toxic").dropDuplicates(["doc_id"])
    pick = lambda value, most: known.where(F.col("toxic") == value).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    picked = pick(1, TOXIC_SAMPLE).unionAll(pick(0, CLEAN_SAMPLE))
    rows = docs.select("doc_id", "text").where((F.length("text") <= LONGEST) & (F.length("text") > 0)).join(F.broadcast(picked), "doc_id")
    return rows.select("text", "toxic").limit(2 * (TOXIC_SAMPLE + CLEAN_SAMPLE)).toArrow().sort_by([("text", "ascending"), ("toxic", "ascending")])


def _apply(shared, carry: list[str]):
    def run(batches):
        crf = shared.value
        for batch in slices(batches, "text", 2 << 20):
            data, offsets = text_bytes(batch.column("text"))
            words = Words(data, offsets, ALNUM)
            p = marginals(crf.emission(feature_keys(words)), words.count, crf)
            score = 1 / (1 + np.exp(-np.clip(_summary(p, words.row, words.texts) @ crf.document, -30, 30)))
            hot = np.flatnonzero(p > 0.5)
            letters = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])  # code points before each byte
            zero = letters[offsets[words.row[hot]]]
            spans = pa.StructArray.from_arrays([pa.array((letters[words.start[hot]] - zero).astype(np.int32)), pa.array((letters[words.end[hot]] - zero).astype(np.int32)), pa.array(p[hot])], ["start", "end", "p"])
            ends = np.concatenate([[0], np.cumsum(np.bincount(words.row[hot], minlength=words.texts))]).astype(np.int32)
            yield pa.record_batch([*[batch.column(c) for c in carry], pa.array(score), pa.ListArray.from_arrays(pa.array(ends), spans)], [*carry, "toxic_score", "toxic_spans"])

    return run


def score(docs: DataFrame, labels: DataFrame, is_held_out: Column, carry: list[str] | None = None) -> DataFrame:
    """docs' columns (or those of `carry`), with toxic_score (0 to 1) and toxic_spans (array of start and end in code points, and probability, of toxic words).

    The score depends on the text alone. Null and empty texts get the score of
    no toxic word. Repeated rows are scored alike. Labels other than 0 and 1 are
    ignored. Columns of docs with the results' names are replaced.
    """
    ship(docs.sparkSession)
    docs = docs.drop("toxic_score", "toxic_spans")
    carry = carry or docs.columns
    crf = fit(training_rows(docs, labels, is_held_out))
    shared = docs.sparkSession.sparkContext.broadcast(crf)
    schema = docs.select(*carry).schema.add("toxic_score", "double").add("toxic_spans", T.ArrayType(T.StructType().add("start", "integer").add("end", "integer").add("p", "double")))
    return docs.select(*dict.fromkeys([*carry, "text"])).mapInArrow(trimmed(_apply(shared, carry)), schema)


THRESHOLD = 0.3


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    fold = held_out(F.col("doc_id"), 4, 2)
    out = score(docs, labels, fold, ["doc_id"])
    return out.select("doc_id", fold.alias("held_out"), F.col("toxic_score").alias("score"), (F.col("toxic_score") >= THRESHOLD).cast("int").alias("predicted"), F.size("toxic_spans").alias("n_spans"))
