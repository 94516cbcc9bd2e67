import random
import re

import pytest
from rasterlake.llm import line_dedup as l


def brute(docs, least=50):
    """The rule itself: every run of lines with enough words that occurs earlier goes. Rows alike count once."""
    seqs = {}
    for k, t in docs:
        if t is not None:
            seqs[(k, t)] = [(i, x, len(re.findall(r"[^\x20\x09-\x0D]+", x))) for i, x in enumerate(t.split("\n"))]
            seqs[(k, t)] = [x for x in seqs[(k, t)] if x[2]]
    order = sorted(seqs, key=lambda d: (d[0] is not None, d[0] or 0))
    first = {}
    for rank, d in enumerate(order):
        s = seqs[d]
        for a in range(len(s)):
            for b in range(a + 1, len(s) + 1):
                if sum(x[2] for x in s[a:b]) >= least:
                    first.setdefault(tuple(x[1] for x in s[a:b]), (rank, a))
    gone = {}
    for rank, d in enumerate(order):
        s, out = seqs[d], set()
        for a in range(len(s)):
            for b in range(a + 1, len(s) + 1):
                if sum(x[2] for x in s[a:b]) >= least:
                    r, f = first[tuple(x[1] for x in s[a:b])]
                    if r < rank or f + (b - a) <= a:
                        out.update(x[0] for x in s[a:b])
        gone[d] = out
    return sorted(str((k, t if t is None else "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone[(k, t)]))) for k, t in docs)


def run(df, least=50):
    return sorted(str((r["doc_id"], r["text"])) for r in l.line_dedup(df, least).collect())


@pytest.mark.parametrize("seed", range(2))
def test_against_brute_force(spark, words, seed):
    rng = random.Random(seed)
    line = lambda: " ".join(rng.choice(words) for _ in range(rng.choice([0, 1, 2, 4, 7])))
    pool = [line() for _ in range(12)]
    docs = []
    for i in range(25):
        body = [rng.choice(pool) if rng.random() < 0.85 else line() for _ in range(rng.randrange(1, 14))]
        if docs and rng.random() < 0.6:
            other = rng.choice(docs)[1].split("\n")
            a = rng.randrange(len(other))
            body[1:1] = other[a : a + rng.randrange(1, 8)]
        docs.append((i, "\n".join(body)))
    docs.append((90, "\n".join(["one two three"] * 30)))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert run(df, 10) == brute(docs, 10)


def test_odd_rows(spark, odd_docs, no_docs):
    docs = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    assert run(odd_docs) == sorted(str(d) for d in docs)
    assert l.line_dedup(no_docs).collect() == []
    long = "word " * 60
    df = spark.createDataFrame([(None, f"{long}\nx", 1), (2, f"a\n\n{long}\nb", 2), (3, long, 3)], "doc_id long, text string, deleted_lines int")
    got = {r["doc_id"]: (r["text"], r["deleted_lines"]) for r in l.line_dedup(df).collect()}
    assert got == {None: (f"{long}\nx", []), 2: ("a\n\nb", [2]), 3: ("", [0])}
