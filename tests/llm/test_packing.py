import zlib

import numpy as np
import public_tokenizers
import pytest
from rasterlake.llm import packing
from tokenizers import Tokenizer

PATH = public_tokenizers.path("byte_bpe_50k.json")


TOKENIZER = Tokenizer.from_file(PATH)


def brute(text):
    return TOKENIZER.encode(text or "", add_special_tokens=False).ids + [0]


def check(rows, texts, window):
    """texts: (doc_id, text) pairs; every id lies in exactly one piece and sequences are gapless."""
    docs, sequences = {}, {}
    for r in rows:
        docs.setdefault(r["doc_id"], []).append(r)
        sequences.setdefault(r["sequence_id"], []).append(r)
    for key, pieces in docs.items():
        wanted = sorted(str(brute(t)) for k, t in texts if k == key)
        by_start = sorted(pieces, key=lambda p: (p["sequence_id"], p["offset"]))
        got, ids = [], []
        for p in by_start:
            assert p["start"] == len(ids)
            assert p["ids_crc32"] == zlib.crc32(np.array(p["ids"], "<u4").tobytes())
            ids += p["ids"]
            assert p["length"] == len(p["ids"])
            if len(ids) == p["doc_tokens"]:
                got.append(str(ids))
                ids = []
        assert not ids and sorted(got) == wanted
    for pieces in sequences.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert 0 < at <= window
    return [sum(p["length"] for p in s) for s in sequences.values()]


def test_round_trip(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    lengths = check(packing.pack(docs, PATH).collect(), texts, 1024)
    assert sum(lengths) / (1024 * len(lengths)) > 0.97


def test_odd_rows(odd_docs, no_docs):
    texts = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    check(packing.pack(odd_docs.coalesce(1), PATH, 64).collect(), texts, 64)
    assert packing.pack(no_docs, PATH).collect() == []


@pytest.mark.parametrize("seed", range(20))
def test_cuts_are_best(seed):
    rng = np.random.default_rng(seed)
    places = np.unique(np.append(rng.integers(1, 60, 12), [0]))
    penalty = rng.integers(0, 8, len(places))
    penalty[0] = 0
    where, cost = packing.cut_places(places, penalty, 16)
    best = [0] + [10**9] * (len(where) - 1)
    for j in range(1, len(where)):
        best[j] = min(best[i] + 16 - (where[j] - where[i]) + cost[j] for i in range(j) if where[j] - where[i] <= 16)
    cuts = packing.best_cuts(where, cost, 16)
    total, at = 0, 0
    for j in cuts:
        total += 16 - (where[j] - at) + cost[j]
        at = where[j]
    assert cuts[-1] == len(where) - 1 and total == best[-1]
