import random
import re

import numpy as np
import pytest
from rasterlake.llm import decontamination as d


def words_of(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def brute(docs, items, span=13):
    out = []
    for k, text in docs:
        w, hit, found = words_of(text), set(), set()
        for item, it in items:
            iw = words_of(it)
            n = min(span, len(iw))
            windows = {tuple(iw[i : i + n]) for i in range(len(iw) - n + 1)} if n else set()
            for i in range(len(w) - n + 1) if n else ():
                if tuple(w[i : i + n]) in windows:
                    hit.update(range(i, i + n))
                    found.add(str(item))
        out.append((k, len(w), len(hit), ",".join(sorted(found)), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(map(str, out))


def run(docs, items):
    rows = d.verdicts(d.contamination(docs, items)).collect()
    return sorted(str((r["doc_id"], r["n_words"], r["n_hit"], ",".join(r["items"]), r["contaminated"])) for r in rows)


@pytest.mark.parametrize("span,k", [(13, 5), (4, 5), (1, 5)])
def test_every_span_keeps_a_fingerprint(span, k):
    rng = np.random.default_rng(0)
    words = d.mix(rng.integers(0, 6, 400).astype(np.uint64))
    at, _ = d.winnow(words, np.zeros(400, np.int64), span, k)
    kept = set(at.tolist())
    for i in range(400 - span + 1):
        assert any(j in kept for j in range(i, i + span - min(k, span) + 1))


def test_against_brute_force(spark, words):
    rng = random.Random(0)
    text = lambda n: " ".join(rng.choice(words) + str(rng.randrange(9)) for _ in range(n))
    items = [(i, text(n)) for i, n in enumerate([40, 13, 14, 12, 5, 3, 30, 60, 25])] + [(100, "Short ITEM"), (101, None), (102, ""), (103, "word")]
    docs = []
    for i in range(60):
        body = text(rng.choice([0, 3, 30, 200]))
        if i % 3 == 0:
            part = rng.choice(items)[1] or ""
            w = part.split()
            a = rng.randrange(max(1, len(w) - 12))
            body = f"{body}. {' '.join(w[a:a + rng.choice([12, 13, 20])]).upper()}, {text(20)}"
        docs.append((i, body))
    docs += [(70, "a short item, here; the WORD"), (71, None), (71, None), (None, items[0][1])]
    d_df, i_df = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert run(d_df, i_df) == brute(docs, items)


def test_odd_rows(spark, odd_docs, no_docs):
    items = spark.createDataFrame([(1, "two three four five six seven eight nine ten eleven twelve thirteen fourteen", 0)], "item_id long, text string, n_words int")
    docs = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    assert run(odd_docs, items) == brute(docs, [(1, items.first()["text"])])
    assert run(no_docs, items) == [] and len(run(odd_docs, items.limit(0))) == odd_docs.count()
    kept = d.without_contaminated(odd_docs, items)
    assert kept.columns == odd_docs.columns and kept.count() == odd_docs.count() - 2
