import math
import random

import numpy as np
import pytest
from rasterlake.llm import jaccard_join as j


def shingles(text):
    import re

    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute(rows, threshold=0.8):
    """doc_id: (class, links) for rows (doc_id, text) with distinct ids."""
    sets = {k: shingles(t) or ("empty", t) for k, t in rows}
    distinct = list(set(sets.values()))
    linked = {s: set() for s in distinct}
    by = {}
    for s in distinct:
        if isinstance(s, frozenset):
            for x in s:
                by.setdefault(x, []).append(s)
    for s in distinct:
        near = {o for x in s if isinstance(s, frozenset) for o in by[x]}
        linked[s] = {o for o in near if o != s and len(s & o) * 5 >= 4 * len(s | o)}
    root = {}
    for s in distinct:
        if s in root:
            continue
        todo, group = [s], {s}
        while todo:
            for o in linked[todo.pop()]:
                if o not in group:
                    group.add(o)
                    todo.append(o)
        least = min((k for k, x in sets.items() if x in group), key=lambda k: (k is not None, k or 0))
        root |= dict.fromkeys(group, least)
    return {k: (root[s], len(linked[s])) for k, s in sets.items()}


def compare(docs):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in j.classes(docs).collect()}
    assert got == brute(rows)
    return got


def test_against_brute_force(spark, sf):
    compare(spark.read.parquet(f"{sf}/documents.parquet"))


def test_large_groups(spark, words):
    rng = random.Random(1)
    common = [rng.choice(words) + str(rng.randrange(50)) for _ in range(120)]
    rows = []
    for i in range(400):  # near copies of one text
        copy = list(common)
        copy[rng.randrange(120)] = f"new{i}"
        rows.append((i, " ".join(copy)))
    passage = " ".join(common[:40])
    rows += [(1000 + i, passage + " " + " ".join(f"w{i}x{k}" for k in range(100))) for i in range(300)]  # one shared passage
    rows += [(2000 + i, "exactly the same text in many rows here") for i in range(200)]
    got = compare(spark.createDataFrame(rows, "doc_id long, text string"))
    assert max(n for _, n in got.values()) > 100


def test_odd_rows(odd_docs, no_docs):
    got = j.classes(odd_docs).collect()
    assert len(got) == odd_docs.select("doc_id", "text").distinct().count()
    assert j.classes(no_docs).collect() == []
    kept = j.keep_one(odd_docs)
    assert kept.columns == odd_docs.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == ["1", "2", "3", "4", "5", "6", "None"]


@pytest.mark.parametrize("recall", [0.9, 0.999])
def test_runs(recall):
    assert j.runs_for(recall) >= 1
    assert (np.array([j.runs_for(r) for r in (0.5, 0.9, 0.99, 0.999)]) >= 1).all()


def test_documents_of_popular_passages(spark, words):
    """Texts that fill fifteen slots with one of two passages each, and their beginnings (likeness 0.8017): every shingle is in far more than SMALL texts."""
    rng = random.Random(3)
    slots = [[[rng.choice(words) + str(rng.randrange(1000)) for _ in range(8)] for _ in range(2)] for _ in range(15)]
    rows = []
    for k, x in enumerate(rng.sample(range(1 << 15), 300)):
        text = [w for i in range(15) for w in slots[i][x >> i & 1]]
        rows += [(2 * k, " ".join(text)), (2 * k + 1, " ".join(text[:97]))]
    got = compare(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sum(n for _, n in got.values()) >= 600


@pytest.mark.parametrize("threshold", [0.3, 0.5, 0.8, 0.95])
def test_least_alike(threshold):
    """Simulated pairs at the threshold make enough choices alike, and the bound isn't far below what they make."""
    made = j.runs_for(0.999, threshold) * j.DEPTH
    n = j.least_alike(made, threshold)
    alike = np.random.default_rng(1).binomial(made, threshold, 200_000)
    assert n <= alike.min()
    if made < 1000:
        under = lambda n: sum(math.comb(made, i) * threshold**i * (1 - threshold) ** (made - i) for i in range(n))
        assert under(n) <= 1e-9 < under(n + 1)


def test_low_threshold(spark):
    """Pairs just over a likeness of a half are found at that threshold: 124 shingles, of which 83 are shared."""
    rows = []
    for k in range(200):
        common = [f"c{k}x{i}" for i in range(87)]
        rows += [(2 * k, " ".join([*common, *[f"a{k}x{i}" for i in range(41)]])), (2 * k + 1, " ".join([*common, *[f"b{k}x{i}" for i in range(41)]]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in j.classes(docs, 0.5, 0.999).collect()}
    assert sum(got[2 * k + 1] == (2 * k, 1) for k in range(200)) >= 198
