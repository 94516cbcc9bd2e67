"""Operator 4: Brown class-based bigram model.

Exchange clustering puts frequent words into classes so that neighbouring
classes predict one another; a text's probability is that of its class
transitions times that of each word in its class. Words are known by a 64-bit
hash. All counts cover all training texts.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import NONSPACE, Words, materialize, ship, slices, text_bytes

VOCABULARY = 8192  # words that exchange clusters, at most: the most frequent ones
LEAST = 3  # every other word of the head with this count or more gets the class that fits its neighbours best
CLASSES = 48  # with the class of all rarer words and that of the end
ROUNDS = 4  # of exchange
HEAD = 1 << 19  # words whose counts every task has, at most; other words are counted up by a join
SMOOTH = 16.0  # weight of the classes' own frequency in transitions


def held_out(doc_id: Column, modulus: int = 7, rest: int = 2) -> Column:
    """A null doc_id counts as the empty string."""
    return F.crc32(F.encode(F.coalesce(doc_id.cast("string"), F.lit("")), "UTF-8")) % modulus == rest


def _count(batches):
    """(hash, n) of the words of a partition, summed here first."""
    kept, total = [], 0

    def merged():
        h = np.concatenate([x[0] for x in kept])
        n = np.concatenate([x[1] for x in kept])
        distinct, back = np.unique(h, return_inverse=True)
        return distinct, np.bincount(back, weights=n, minlength=len(distinct)).astype(np.int64)

    for batch in slices(batches, "text", 2 << 20):
        kept.append(np.unique(Words(*text_bytes(batch.column("text")), NONSPACE).hash, return_counts=True))
        total += len(kept[-1][0])
        if total > 1_000_000:
            kept = [merged()]
            total = len(kept[0][0])
            if total > 500_000:
                yield pa.record_batch([pa.array(kept[0][0].view(np.int64)), pa.array(kept[0][1])], ["h", "n"])
                kept, total = [], 0
    if kept:
        h, n = merged()
        yield pa.record_batch([pa.array(h.view(np.int64)), pa.array(n)], ["h", "n"])


def _frequent(counts: DataFrame, histogram: list, most: int) -> int:
    """The least count such that at most `most` words have it or more."""
    words, least = 0, None
    for n, m in histogram:  # from the largest count on
        if words + m > most:
            break
        words, least = words + m, n
    return least if least is not None else (histogram[0][0] + 1 if histogram else 1)


@dataclass
class Lexicon:
    """Counts that every task has: head words by hash (sorted), their counts, and whether they have a class."""

    h: np.ndarray
    n: np.ndarray
    classed: np.ndarray
    tokens: int  # N
    types: int  # V
    rare_tokens: int
    rare_types: int
    discount: float

    def base(self, n: np.ndarray) -> np.ndarray:
        return np.log10((n + 1.0) / (self.tokens + self.types + 1))


def _encode(lexicon, texts_end: int):
    """Per text: what needs its words. ids: places of its words in the head (uint32; after its last one for others); rare: hashes that are not in the head."""

    def run(batches):
        lex = lexicon.value
        size = max(1, len(lex.h))
        end_base = float(lex.base(np.array([texts_end]))[0])
        for batch in slices(batches, "text", 2 << 20):
            words = Words(*text_bytes(batch.column("text")), NONSPACE)
            spot = np.minimum(np.searchsorted(lex.h, words.hash), size - 1)
            inside = lex.h[spot] == words.hash if len(lex.h) else np.zeros(len(words.hash), bool)
            n = np.where(inside, lex.n[spot], 0) if len(lex.h) else np.zeros(len(words.hash), np.int64)
            in_class = inside & lex.classed[spot] if len(lex.h) else inside
            emission = np.where(in_class, np.log10(np.maximum(n, 1)), np.where(inside, np.log10(np.maximum(n - lex.discount, 1e-9)), 0.0))
            base = np.where(inside, lex.base(n), 0.0)
            total = lambda x: np.bincount(words.row, weights=x, minlength=words.texts).astype(float)
            raw = np.where(inside, spot, len(lex.h)).astype(np.uint32).tobytes()
            at = (4 * words.first).tolist()
            out = words.hash[~inside].view(np.int64)
            ends = np.concatenate([[0], np.cumsum(total(~inside))]).astype(np.int32)
            yield pa.record_batch(
                [
                    batch.column("row_id"), batch.column("doc_id"), batch.column("held_out"),
                    pa.array(words.count + 1), pa.array(total(inside).astype(np.int64) + (texts_end > 0)),
                    pa.array(total(base) + end_base), pa.array(total(emission)),
                    pa.array([raw[a:b] for a, b in zip(at[:-1], at[1:], strict=True)], pa.binary()),
                    pa.ListArray.from_arrays(pa.array(ends), pa.array(out)),
                ],
                ["row_id", "doc_id", "held_out", "n_tokens", "n_known", "base", "emission", "ids", "rare"],
            )

    return run


def _streams(batches, end: int):
    """Per batch: the ids of all texts with an end before and after each, which of them begin a text, and each one's text."""
    for batch in batches:
        if not batch.num_rows:
            continue
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            column = part.column("ids").cast(pa.large_binary())
            offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
            data = column.buffers()[2]
            data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]].view(np.uint32) if data is not None and data.size else np.zeros(0, np.uint32)
            count = np.diff(offsets) // 4
            full = count + 1
            begin = np.cumsum(full) - full
            text = np.repeat(np.arange(len(count)), full)
            ids = np.full(int(full.sum()), end, np.int64)
            inner = np.ones(len(ids), bool)
            inner[begin + count] = False
            ids[inner] = data
            before = np.empty(len(ids), np.int64)
            before[1:] = ids[:-1]
            before[begin] = end
            yield part, ids, before, text


def _neighbours(shared, words: int, classes: int):
    """(key, n): how often each clustered word is followed, and preceded, by each class. One table per task, of a fixed size."""

    def run(batches):
        cluster, of = shared.value
        after = np.zeros(words * classes, np.int64)
        ahead = np.zeros(words * classes, np.int64)
        for _, ids, before, _ in _streams(batches, len(cluster) - 1):
            ids, before = cluster[ids], cluster[before]
            after += np.bincount(before * classes + of[ids], minlength=words * classes)
            ahead += np.bincount(ids * classes + of[before], minlength=words * classes)
        both = np.concatenate([after, ahead])
        key = np.flatnonzero(both)
        yield pa.record_batch([pa.array(key.astype(np.int64)), pa.array(both[key])], ["key", "n"])

    return run


def _pairs(shared, classes: int):
    """(key, n): how often each class follows each."""

    def run(batches):
        of, total = shared.value, np.zeros(classes * classes, np.int64)
        for _, ids, before, _ in _streams(batches, len(of) - 1):
            total += np.bincount(of[before].astype(np.int64) * classes + of[ids], minlength=classes * classes)
        key = np.flatnonzero(total)
        yield pa.record_batch([pa.array(key.astype(np.int64)), pa.array(total[key])], ["key", "n"])

    return run


def _tail_neighbours(shared, classes: int):
    """(key, n) for words that are to get a class: place of the word times twice the classes, plus the class that follows it, or the number of classes and the class ahead. Summed up in each task as far as a bound."""

    def run(batches):
        of, tail = shared.value
        kept, size = [], 0

        def summed():
            key, back = np.unique(np.concatenate([k for k, _ in kept]), return_inverse=True)
            return key, np.bincount(back, weights=np.concatenate([n for _, n in kept]), minlength=len(key)).astype(np.int64)

        batch_of = lambda x: pa.record_batch([pa.array(x[0]), pa.array(x[1])], ["key", "n"])
        for _, ids, before, _ in _streams(batches, len(of) - 1):
            here, there = tail[ids], tail[before]
            key = np.concatenate([ids[here] * (2 * classes) + classes + of[before[here]], before[there] * (2 * classes) + of[ids[there]]])
            kept.append(np.unique(key, return_counts=True))
            size += len(kept[-1][0])
            if size > 600_000:
                kept = [summed()]
                size = len(kept[0][0])
                if size > 300_000:
                    yield batch_of(kept.pop())
                    size = 0
        if kept:
            yield batch_of(summed())

    return run


def _best_class(log_step: np.ndarray, log_size: np.ndarray, free: int):
    """The class of each word (w, and near: its neighbours' classes with their numbers) that gives its bigrams the greatest probability; the least of equal ones."""
    classes = len(log_size)

    def run(batches):
        for batch in batches:
            near = batch.column("near")
            flat = near.flatten()
            count = np.asarray(near.value_lengths()).astype(np.int64)
            x = np.zeros((batch.num_rows, 2 * classes))
            x[np.repeat(np.arange(batch.num_rows), count), np.asarray(flat.field("k")).astype(np.int64)] = np.asarray(flat.field("n"))
            follow, ahead = x[:, :classes], x[:, classes:]
            value = follow @ log_step.T + ahead @ log_step - ahead.sum(axis=1, keepdims=True) * log_size
            yield pa.record_batch([batch.column("w"), pa.array(np.argmax(value[:, :free], axis=1).astype(np.int32))], ["w", "c"])

    return run


def exchange(of: np.ndarray, after: np.ndarray, ahead: np.ndarray, fixed: int) -> np.ndarray:
    """One sweep: each word, the most frequent first, moves to the class that raises the likelihood of class bigrams most. The last `fixed` words stay."""
    of = of.copy()
    words, classes = after.shape
    pair = np.zeros((classes, classes))
    np.add.at(pair, of, after)
    free = classes - fixed
    f = lambda x: x * np.log(np.maximum(x, 1e-12))
    out_size, in_size = after.sum(axis=1), ahead.sum(axis=1)
    rows, columns = pair.sum(axis=1), pair.sum(axis=0)
    for w in np.argsort(-out_size[: words - fixed], kind="stable"):
        a, b, c = after[w], ahead[w], of[w]
        pair[c] -= a
        pair[:, c] -= b
        np.maximum(pair, 0, out=pair)
        rows[c] -= out_size[w]
        columns[c] -= in_size[w]
        r = np.flatnonzero(a)
        s = np.flatnonzero(b)
        gain = (f(pair[:free][:, r] + a[r]) - f(pair[:free][:, r])).sum(axis=1) + (f(pair[s][:, :free] + b[s][:, None]) - f(pair[s][:, :free])).sum(axis=0)
        gain -= f(rows[:free] + out_size[w]) - f(rows[:free]) + f(columns[:free] + in_size[w]) - f(columns[:free])
        best = int(np.argmax(gain))
        if gain[best] <= gain[c] + 1e-9:
            best = c
        of[w] = best
        pair[best] += a
        pair[:, best] += b
        rows[best] += out_size[w]
        columns[best] += in_size[w]
    return of


def _summed(rows: DataFrame, work, size: int) -> np.ndarray:
    """Numbers by key, summed over all tasks: a table of `size` numbers, whatever the input."""
    got = rows.select("ids").mapInArrow(work, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(size)
    out[np.asarray(got["key"]).astype(np.int64)] = np.asarray(got["n"])
    return out


def _tables(rows: DataFrame, cluster: np.ndarray, of: np.ndarray, classes: int) -> tuple[np.ndarray, np.ndarray]:
    """The two tables of _neighbours over all rows: clustered words times classes numbers each."""
    words = len(of)
    shared = rows.sparkSession.sparkContext.broadcast((cluster, of))
    both = _summed(rows, _neighbours(shared, words, classes), 2 * words * classes)
    return both[: words * classes].reshape(words, classes), both[words * classes :].reshape(words, classes)


def _class_pairs(rows: DataFrame, class_of: np.ndarray, classes: int) -> np.ndarray:
    return _summed(rows, _pairs(rows.sparkSession.sparkContext.broadcast(class_of), classes), classes * classes).reshape(classes, classes)


def _steps(pair: np.ndarray) -> np.ndarray:
    """Probability of each class after each, smoothed by the classes' own; a class that exchange has emptied gets none."""
    entered = pair.sum(axis=0)
    own = entered + (entered > 0)
    own[-2:] = entered[-2:] + 1  # unknown words and ends can always come
    own /= own.sum()
    return (pair + SMOOTH * own) / (pair.sum(axis=1, keepdims=True) + SMOOTH)


@dataclass
class Model:
    """class_of: class of each head word, of all other words, and of the end; step: probabilities of classes after each other; size: tokens of each class."""

    lexicon: Lexicon
    class_of: np.ndarray
    step: np.ndarray
    size: np.ndarray

    @property
    def unknown(self) -> float:
        """Count of all unknown words together in the class of rare ones."""
        return self.lexicon.discount * self.lexicon.rare_types if self.lexicon.rare_tokens else 1.0

    def moves(self) -> np.ndarray:
        """log10 of a step, less that of the entered class' size. The end is alone in its class; a class of rare words without any has the unknown ones only."""
        own = -np.log10(np.maximum(self.size, 1))
        own[-1] = 0.0
        if not self.lexicon.rare_tokens:
            own[-2] = 0.0
        return np.log10(np.maximum(self.step, 1e-300)) + own[None, :]


def learn(docs: DataFrame, is_held_out: Column, vocabulary: int = VOCABULARY, classes: int = CLASSES, rounds: int = ROUNDS) -> tuple[Model, DataFrame, DataFrame]:
    """The model, all rows with their words' places in the head, and the counts of all words."""
    spark = docs.sparkSession
    ship(spark)
    rows = docs.select("doc_id", is_held_out.alias("held_out"), "text")
    train = rows.where("not held_out")
    counts = materialize(train.select("text").mapInArrow(_count, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")), "word-counts")
    # The numbers of words for each count: few rows, as counts that differ add up to all tokens.
    histogram = sorted(((r["n"], r["m"]) for r in counts.groupBy("n").agg(F.count("*").alias("m")).collect()), reverse=True)
    texts = train.count()
    tokens = sum(n * m for n, m in histogram) + texts
    types = sum(m for _, m in histogram) + (texts > 0)
    head = counts.where(F.col("n") >= _frequent(counts, histogram, HEAD)).toArrow()  # HEAD rows at most
    h, n = (np.asarray(head[c]).astype(np.int64) for c in ("h", "n"))
    order = np.argsort(h.view(np.uint64), kind="stable")
    h, n = h.view(np.uint64)[order], n[order]
    by_count = np.lexsort((h, -n))[:vocabulary]  # of equal counts, the lower hash
    size = len(by_count)
    # Clustered ids by place in the head; the two last places are all other words and the end, and so are the two last ids.
    cluster = np.full(len(h) + 2, size, np.int64)
    cluster[by_count], cluster[-1] = np.arange(size), size + 1
    classed = n >= LEAST
    classed[by_count] = True
    once, twice = (dict(histogram).get(i, 0) for i in (1, 2))
    discount = once / (once + 2 * twice) if once + twice else 0.5
    lexicon = Lexicon(h, n, classed, tokens, types, tokens - texts - int(n[classed].sum()), types - (texts > 0) - int(classed.sum()), min(discount, 0.9))
    kind = dict(docs.dtypes)["doc_id"]
    schema = f"row_id long, doc_id {kind}, held_out boolean, n_tokens long, n_known long, base double, emission double, ids binary, rare array<long>"
    coded = materialize(rows.withColumn("row_id", F.monotonically_increasing_id()).mapInArrow(_encode(spark.sparkContext.broadcast(lexicon), texts), schema), "coded-texts")

    # Clusters: words by rank in turn, then exchange.
    known = coded.where("not held_out")
    free = max(1, min(classes - 2, size or 1))
    classes = free + 2
    of = np.append(np.arange(size) % free, [free, free + 1]).astype(np.int64)
    for _ in range(rounds if size else 0):
        of = exchange(of, *_tables(known, cluster, of, classes), 2)
    # The head's other words: one pass over their neighbours, with the classes as they are now.
    class_of = of[cluster]
    tail = np.append(classed, [False, False])
    tail[by_count] = False
    if tail.any():
        pair = _class_pairs(known, class_of, classes)
        near = known.select("ids").mapInArrow(_tail_neighbours(spark.sparkContext.broadcast((class_of, tail)), classes), "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
        near = near.select(F.expr(f"key div {2 * classes}").alias("w"), F.struct((F.col("key") % (2 * classes)).alias("k"), "n").alias("x")).groupBy("w").agg(F.collect_list("x").alias("near"))  # twice the classes entries a word at most
        got = near.mapInArrow(_best_class(np.log(np.maximum(_steps(pair), 1e-300)), np.log(np.maximum(pair.sum(axis=0), 1)), free), "w long, c int").toArrow()  # HEAD rows at most
        class_of[np.asarray(got["w"]).astype(np.int64)] = np.asarray(got["c"])
    pair = _class_pairs(known, class_of, classes)
    return Model(lexicon, class_of, _steps(pair), pair.sum(axis=0)), coded, counts


def score(docs: DataFrame, is_held_out: Column, vocabulary: int = VOCABULARY, classes: int = CLASSES, rounds: int = ROUNDS) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Learns from the rows that are not held out. Tokens are words and one end a
    text; null and empty texts are one end. Repeated rows count as often as they
    occur. Other columns are ignored. With no training rows every token is
    unknown. Exchange clusters the `vocabulary` most frequent words (of equal
    counts those of lower hashes); of the others, those in the head with LEAST
    occurrences get the class that fits their neighbours best, and the rest share
    a class, in which each known word has its discounted count and all unknown
    ones what is left, as one symbol, so probabilities sum to 1. Very long texts
    are coded whole, 4 bytes a word; the memory of a task follows the longest.
    """
    spark = docs.sparkSession
    model, coded, counts = learn(docs, is_held_out, vocabulary, classes, rounds)
    kind, lexicon = dict(docs.dtypes)["doc_id"], model.lexicon
    shared = spark.sparkContext.broadcast((model.class_of, model.moves()))

    def transitions(batches):
        of, value = shared.value
        for part, ids, before, text in _streams(batches, len(of) - 1):
            total = np.bincount(text, weights=value[of[before], of[ids]], minlength=part.num_rows)
            columns = ["row_id", "doc_id", "held_out", "n_tokens", "n_known", "base", "emission"]
            yield pa.record_batch([*[part.column(c) for c in columns], pa.array(total)], [*columns, "moves"])

    out = coded.mapInArrow(transitions, f"row_id long, doc_id {kind}, held_out boolean, n_tokens long, n_known long, base double, emission double, moves double")
    rare = coded.select("row_id", F.explode("rare").alias("h")).groupBy("row_id", "h").agg(F.count("*").alias("k")).join(counts, "h", "left")
    scale = float(lexicon.tokens + lexicon.types + 1)
    rare = rare.groupBy("row_id").agg(
        F.sum(F.when(F.col("n").isNotNull(), F.col("k")).otherwise(0)).alias("r_known"),
        F.sum(F.col("k") * F.log10((F.coalesce("n", F.lit(0)) + 1) / F.lit(scale))).alias("r_base"),
        F.sum(F.col("k") * F.log10(F.coalesce(F.col("n") - F.lit(float(lexicon.discount)), F.lit(float(max(model.unknown, 1e-9)))))).alias("r_emission"),
    )
    out = out.join(rare, "row_id", "left")
    more = lambda c: F.coalesce(c, F.lit(0))
    return out.select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + more("r_known")).alias("n_known"), F.lit(int(lexicon.tokens)).cast("long").alias("train_tokens"),
        (F.col("base") + more("r_base")).alias("base_score"), (F.col("moves") + F.col("emission") + more("r_emission")).alias("score"),
    )


def op4_class_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score(docs, held_out(F.col("doc_id")))
