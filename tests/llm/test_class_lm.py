import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from rasterlake.llm import class_lm as c
from rasterlake.llm.common import NONSPACE, Words, text_bytes


def tokens(text):
    lower = "".join(chr(ord(x) + 32) if "A" <= x <= "Z" else x for x in text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", lower), None]


def check_base(got, rows):
    """rows: (doc_id, text) with distinct ids."""
    out = {k: zlib.crc32(("" if k is None else str(k)).encode()) % 7 == 2 for k, _ in rows}
    count = Counter(t for k, text in rows if not out[k] for t in tokens(text))
    n, v = sum(count.values()), len(count)
    for k, text in rows:
        r = got[k]
        ts = tokens(text)
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (out[k], len(ts), sum(count[t] > 0 for t in ts), n)
        assert math.isclose(r["base_score"], sum(math.log10((count[t] + 1) / (n + v + 1)) for t in ts), rel_tol=1e-9)
        assert r["score"] < 0


def test_base_and_gain(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = {r["doc_id"]: r for r in c.op4_class_lm(spark, sf).collect()}
    check_base(got, [(r["doc_id"], r["text"]) for r in docs.collect()])
    held = [r for r in got.values() if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_rare_words_go_through_the_join(spark, monkeypatch, odd_docs, no_docs):
    monkeypatch.setattr(c, "HEAD", 3)
    docs = odd_docs.dropDuplicates(["doc_id"])
    got = {r["doc_id"]: r for r in c.score(docs, c.held_out(F.col("doc_id")), vocabulary=2, rounds=1).collect()}
    check_base(got, [(r["doc_id"], r["text"]) for r in docs.collect()])
    assert c.score(odd_docs, F.lit(False)).count() == odd_docs.count()
    assert c.score(no_docs, F.lit(False)).collect() == []
    assert all(r["train_tokens"] == r["n_known"] == 0 for r in c.score(odd_docs, F.lit(True)).collect())


def plain_model(model, texts):
    """word: class, and P(class | class before), P(word | class) by counting the training texts in Python."""
    of = {h: int(k) for h, k in zip(model.lexicon.h.tolist(), model.class_of.tolist(), strict=False)}
    rare, end = len(model.step) - 2, len(model.step) - 1
    name = lambda t: int(Words(*text_bytes(pa.array([t], pa.large_string())), NONSPACE).hash[0])
    count = Counter(t for text in texts for t in tokens(text)[:-1])
    cls = lambda t: end if t is None else of.get(name(t), rare) if t in count else rare
    pair, size = Counter(), Counter()
    for text in texts:
        last = end
        for t in tokens(text):
            pair[last, cls(t)] += 1
            size[cls(t)] += 1
            last = cls(t)
    total, k = sum(size.values()), len(model.step)
    alive = [x for x in range(k) if size[x] or x >= rare]
    own = [(size[x] + 1) / (total + len(alive)) if x in alive else 0.0 for x in range(k)]
    step = lambda u, v: (pair[u, v] + c.SMOOTH * own[v]) / (sum(pair[u, x] for x in range(k)) + c.SMOOTH)
    once, twice = (sum(n == i for n in count.values()) for i in (1, 2))
    d = min(once / (once + 2 * twice) if once + twice else 0.5, 0.9)
    few = [t for t in count if cls(t) == rare]

    def emits(t):
        if t is None:
            return 1.0
        if cls(t) != rare:
            return count[t] / size[cls(t)]
        if not few:
            return 1.0
        return (count[t] - d if t in count else d * len(few)) / size[rare]

    return count, cls, step, emits, end


def test_against_plain_model_and_sums(spark, words, monkeypatch):
    """Scores are those of a model counted in Python with the same classes, and what can follow any word sums to one."""
    rng = np.random.default_rng(4)
    monkeypatch.setattr(c, "HEAD", 18)
    texts = [" ".join(words[int(k)] for k in rng.zipf(1.4, rng.integers(0, 30)) % 24) for _ in range(60)]
    rows = [(i, t, False) for i, t in enumerate(texts)] + [(100 + i, t, True) for i, t in enumerate([*words, "unseen words here", "", "alpha unseen beta"])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, held boolean")
    model, _, _ = c.learn(docs, F.col("held"), vocabulary=6, classes=5, rounds=2)
    count, cls, step, emits, end = plain_model(model, texts)
    assert len({cls(t) for t in count}) > 2 and sum(cls(t) < 3 for t in count) > 6
    for last in [*count, "unseen", None]:
        assert math.isclose(sum(step(cls(last), cls(t)) * emits(t) for t in [*count, "unseen", None]), 1.0, rel_tol=1e-9)
    for r, (_, text, _) in zip(sorted(c.score(docs, F.col("held"), vocabulary=6, classes=5, rounds=2).collect(), key=lambda r: r["doc_id"]), rows, strict=True):
        last, wanted = None, 0.0
        for t in tokens(text):
            wanted += math.log10(step(cls(last), cls(t)) * emits(t))
            last = t
        assert math.isclose(r["score"], wanted, rel_tol=1e-6, abs_tol=1e-6)


def test_exchange_finds_alternating_classes():
    rng = np.random.default_rng(0)
    words = 12  # even ones are followed by odd ones, and the other way round
    pairs = np.zeros((words + 2, words + 2))
    for _ in range(4000):
        a = int(rng.integers(words))
        b = int(rng.integers(words // 2)) * 2 + (1 - a % 2)
        pairs[a, b] += 1
    of = np.append(rng.integers(0, 2, words), [2, 3])
    for _ in range(5):
        after, ahead = np.zeros((words + 2, 4)), np.zeros((words + 2, 4))
        for k in range(4):
            after[:, k], ahead[:, k] = pairs[:, of == k].sum(axis=1), pairs[of == k].sum(axis=0)
        of = c.exchange(of, after, ahead, 2)
    assert len(set(of[:words:2])) == len(set(of[1:words:2])) == 1 and of[0] != of[1]
