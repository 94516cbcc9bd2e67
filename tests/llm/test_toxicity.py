import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from rasterlake.llm import toxicity as t
from rasterlake.llm.class_lm import held_out


def brute_marginals(e, crf):
    """By summing over all label sequences."""
    n = len(e)
    total, hot = 0.0, np.zeros(n)
    for y in itertools.product((0, 1), repeat=n):
        s = sum(e[i] for i in range(n) if y[i]) + y[0] * crf.start + sum(crf.moves[y[i], y[i + 1]] for i in range(n - 1))
        total += np.exp(s)
        hot += np.exp(s) * np.array(y)
    return hot / total


def test_marginals_are_exact():
    rng = np.random.default_rng(0)
    crf = t.Crf(np.zeros(t.BUCKETS + 1), 0.0, -0.7, rng.standard_normal((2, 2)), np.zeros(4))
    counts = np.array([1, 0, 7, 3, 10])
    e = rng.standard_normal(counts.sum()) * 2
    got = t.marginals(e, counts, crf)
    at = 0
    for n in counts:
        if n:
            assert np.allclose(got[at : at + n], brute_marginals(e[at : at + n], crf))
            at += n


def test_long_texts_scan_like_the_plain_loop():
    rng = np.random.default_rng(1)
    crf = t.Crf(np.zeros(t.BUCKETS + 1), 0.0, -0.7, rng.standard_normal((2, 2)), np.zeros(4))
    e = rng.standard_normal(1000)
    got = t.marginals(np.concatenate([e, e[:130]]), np.array([1000, 130]), crf)
    assert np.allclose(got[:1000], t._batch_marginals(e[None, :], crf)[0][0])
    assert np.allclose(got[1000:], t._batch_marginals(e[None, :130], crf)[0][0])


def test_held_out_accuracy(spark, words):
    rng = np.random.default_rng(2)
    rows, labels = [], []
    for i in range(900):
        text = [words[int(x)] + str(int(y)) for x, y in zip(rng.integers(0, 24, 60), rng.integers(0, 40, 60), strict=True)]
        toxic = i % 6 == 0
        if toxic:
            for k in rng.integers(0, 60, 3):
                text[int(k)] = ["grumblex" + str(int(rng.integers(500))), "vile"][int(rng.integers(2))]
        rows.append((i, " ".join(text)))
        labels.append((i, 1, int(toxic)))
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    fold = held_out(F.col("doc_id"), 4, 2)
    got = t.score(docs, marks, fold, ["doc_id"]).withColumn("held", fold).where("held").collect()
    wrong = sum((r["toxic_score"] >= 0.3) != (r["doc_id"] % 6 == 0) for r in got)
    assert len(got) > 150 and wrong <= 0.02 * len(got)
    text = dict(rows)
    for r in got:
        if r["toxic_score"] >= 0.3:
            assert all(text[r["doc_id"]][s["start"] : s["end"]].startswith(("grumblex", "vile")) for s in r["toxic_spans"])


def test_score_depends_on_text_alone(spark, sf, odd_docs, no_docs):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    fold = held_out(F.col("doc_id"), 4, 2)
    got = t.score(odd_docs.withColumn("toxic_score", F.lit("x")), labels, fold).collect()
    assert len(got) == odd_docs.count() and all(0 <= r["toxic_score"] <= 1 for r in got)
    assert len({r["toxic_score"] for r in got if r["doc_id"] in (2, 3, 4)}) == 1
    assert t.score(no_docs, labels, fold).collect() == []
    none = t.score(odd_docs, labels.limit(0), fold).collect()
    assert len({r["toxic_score"] for r in none}) == 1


def test_one_label_only():
    crf = t.fit(pa.table({"text": ["É clean words here"], "toxic": [0]}))
    assert crf.document[0] < 0 and (crf.weights == 0).all()


def test_near_copies_count_once():
    assert t.distinct_texts(t.Sample(pa.table({"text": ["a b c", "a b c", "", "d e f", ""]}))).tolist() == [True, False, True, True, False]


def test_marginals_of_padded_sequences():
    rng = np.random.default_rng(3)
    crf = t.Crf(np.zeros(t.BUCKETS + 1), 0.0, -0.7, rng.standard_normal((2, 2)), np.zeros(4))
    e = rng.standard_normal((3, 8))
    real = np.arange(8)[None, :] < np.array([8, 3, 1])[:, None]
    p, pairs, _ = t._batch_marginals(e, crf, real)
    for k, n in enumerate((8, 3, 1)):
        assert np.allclose(p[k, :n], brute_marginals(e[k, :n], crf)) and (p[k, n:] == 0).all()
    assert np.isclose(pairs.sum(), 7 + 2)


def test_short_texts_train(words):
    rng = np.random.default_rng(4)

    def texts(count):
        out = []
        for i in range(count):
            text = [words[int(x)] + str(int(y)) for x, y in zip(rng.integers(0, 24, 20), rng.integers(0, 90, 20), strict=True)][: int(rng.integers(3, 21))]
            if i % 3 == 0:
                text[int(rng.integers(len(text)))] = "grumblex" + str(int(rng.integers(500)))
            out.append(" ".join(text))
        return pa.table({"text": out, "toxic": [int(i % 3 == 0) for i in range(count)]})

    crf = t.fit(texts(900))
    assert (crf.weights != 0).any()
    fresh = texts(300)
    sample = t.Sample(fresh)
    p = t.marginals(crf.emission(sample.keys)[sample.word], sample.count, crf)
    toxic = t._summary(p, sample.row, 300) @ crf.document > 0
    assert (toxic != np.asarray(fresh["toxic"]).astype(bool)).sum() <= 6
