import random
import re

import numpy as np
import pytest
import xxhash
from rasterlake.llm import simhash as s


def plain_fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(w[i : i + 4]) for i in range(len(w) - 3)] if len(w) >= 4 else [" ".join(w)] if w else []
    h = [xxhash.xxh64(x.encode(), seed=42).intdigest() for x in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute(fps, distance=4):
    """fingerprint: least fingerprint it reaches."""
    fps = sorted(set(fps))
    a = np.array(fps, np.uint64)
    near = [np.flatnonzero(np.bitwise_count(a ^ x) <= distance).tolist() for x in a]
    root = {}
    for i in range(len(fps)):
        if i not in root:
            todo = [i]
            root[i] = i
            while todo:
                for o in near[todo.pop()]:
                    if o not in root:
                        root[o] = i
                        todo.append(o)
    return {fps[i]: fps[r] for i, r in root.items()}


def compare(docs):
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    fp = [plain_fingerprint(t) for _, t in rows]
    root = brute(fp)
    least = {}
    for (d, _), f in zip(rows, fp, strict=True):
        if d is not None:
            least[root[f]] = min(d, least.get(root[f], d))
    wanted = sorted(((d, f, least.get(root[f])) for (d, _), f in zip(rows, fp, strict=True)), key=str)
    got = sorted(((r["doc_id"], r["fp"] % (1 << 64), r["component_id"]) for r in s.simhash_classes(docs).collect()), key=str)
    assert got == wanted
    return got


def test_against_brute_force(spark, sf):
    got = compare(spark.read.parquet(f"{sf}/documents.parquet"))
    assert any(d != c for d, _, c in got)


def test_odd_rows(odd_docs, no_docs):
    got = compare(odd_docs)
    assert len(got) == odd_docs.count()
    assert s.simhash_classes(no_docs).collect() == []


def test_same_hash_as_the_engine(spark):
    """The engine's xxhash64 of one string has the same seed."""
    assert spark.range(1).selectExpr("xxhash64('one two three four') h").first()["h"] % (1 << 64) == plain_fingerprint("one TWO\n three\tfour")


def test_popcounts_bound_the_distance():
    rng = np.random.default_rng(5)
    a, b = rng.integers(0, 1 << 63, (2, 2000), dtype=np.uint64)
    b[:1000] = a[:1000] ^ (np.uint64(1) << rng.integers(0, 64, 1000, dtype=np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 1000, dtype=np.uint64))
    assert (np.abs(s.popcounts(a) - s.popcounts(b)).sum(axis=1) <= np.bitwise_count(a ^ b)).all()


def test_cells_find_all_pairs():
    """Each pair with four differing bits meets in a cell that one of the two calls home."""
    rng = random.Random(6)
    for _ in range(300):
        a = rng.getrandbits(64)
        b = a
        for bit in rng.sample(range(64), 4):
            b ^= 1 << bit
        found = [{}, {}]
        for k, x in enumerate((a, b)):
            _, name, visit = s.cells(np.array([x], np.uint64))
            found[k] = dict(zip(name.tolist(), visit.tolist(), strict=True))
        assert any(c in found[1] and not (v and found[1][c]) for c, v in found[0].items())


@pytest.mark.parametrize("block", [50, 8192])
def test_large_groups(spark, block, monkeypatch):
    """A chain, a dense cloud and equal fingerprints, in cells cut into blocks and not."""
    monkeypatch.setattr(s, "BLOCK", block)
    rng = random.Random(7)
    base = rng.getrandbits(64)
    fps = {base}
    for _ in range(600):
        x = base
        for bit in rng.sample(range(64), rng.randrange(1, 6)):
            x ^= 1 << bit
        fps.add(x)
    x = rng.getrandbits(64)
    for _ in range(40):
        for bit in rng.sample(range(64), 4):
            x ^= 1 << bit
        fps.add(x)
    fps |= {rng.getrandbits(64) for _ in range(300)} | {0, (1 << 64) - 1}
    signed = lambda f: f - (1 << 64) if f >> 63 else f
    df = spark.createDataFrame([(signed(f),) for f in fps], "fp long")
    got = {r["fp"] % (1 << 64): r["root"] for r in s.fingerprint_components(df).collect()}
    wanted = brute(fps)
    groups = lambda of: {frozenset(f for f in of if of[f] == r) for r in of.values()}
    assert groups(got) == groups(wanted)


def test_local_links():
    rng = np.random.default_rng(8)
    home = rng.integers(0, 1 << 10, 400, dtype=np.uint64) << np.uint64(20)
    visitors = rng.integers(0, 1 << 12, 300, dtype=np.uint64) << np.uint64(20)
    a, b = s.local_links(home, visitors, 1)
    assert (a != b).all() or set(a[a == b].tolist()) <= set(visitors.tolist())
    reach = {int(f): int(f) for f in [*home, *visitors]}

    def top(f):
        while reach[f] != f:
            f = reach[f]
        return f

    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        reach[top(x)] = top(y)
    for x in set(home.tolist()):
        for y in {*home.tolist(), *visitors.tolist()}:
            if (x ^ y).bit_count() <= 1:
                assert top(x) == top(y)
