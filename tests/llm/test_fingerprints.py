import base64
import hashlib
import random

import numpy as np
from rasterlake.llm import fingerprints as f


def brute_anchors(raw):
    """Anchors and their first places."""
    if 0 < len(raw) < f.K:
        return {hashlib.blake2b(raw, digest_size=8).digest(): 0}
    if not raw:
        return {}
    order = f.mix(np.array([int.from_bytes(raw[j : j + f.S], "little") for j in range(len(raw) - f.S + 1)], np.uint64)).tolist()
    found = {}
    for i in range(len(raw) - f.K + 1):
        inner = order[i : i + f.K - f.S + 1]
        if min(inner) in (inner[0], inner[-1]):
            found.setdefault(raw[i : i + f.K], i)
    return found


def chain(places):
    """Longest increasing subsequence by the plain quadratic rule."""
    best = []
    for i, x in enumerate(places):
        best.append(1 + max((best[j] for j in range(i) if places[j] < x), default=0))
    return max(best, default=0)


def like(x, y):
    """Anchors that match in order, of all anchors of both texts."""
    shared = sorted(x.keys() & y.keys(), key=x.get)
    return chain([y[a] for a in shared]) / len(x.keys() | y.keys()) if x or y else 1.0


def brute(rows):
    """doc_id, edited text, and exact Jaccard likenesses."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    out = []
    for i, (k, t) in enumerate(rows):
        t, n = t or "", rows[(i + 1) % len(rows)][1] or ""
        e = t[: len(t) - len(t) // 2] + n[: len(t) // 2]
        a, b, c = (brute_anchors(x.encode()) for x in (t, e, n))
        out.append((k, len(t), hashlib.sha256(e.encode()).hexdigest(), like(a, b), like(a, c), max(len(a), len(b)) <= f.KEPT, max(len(a), len(c)) <= f.KEPT))
    return out


def test_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    wanted = {r[0]: r for r in brute([(r["doc_id"], r["text"]) for r in docs.collect()])}
    got = {r["doc_id"]: r for r in f.fingerprints(docs).collect()}
    assert got.keys() == wanted.keys()
    for k, w in wanted.items():
        assert (got[k]["n_chars"], got[k]["edited_sha256"]) == w[1:3]
        # exact where a fingerprint holds all anchors, else within four standard errors
        assert abs(got[k]["near_edited"] - w[3]) < (1e-9 if w[5] else 0.2) and abs(got[k]["near_next"] - w[4]) < (1e-9 if w[6] else 0.2)
    errors = [got[k]["near_edited"] - w[3] for k, w in wanted.items()]
    assert abs(np.mean(errors)) < 0.02


def brute_likeness(s, a, b):
    """Of two fingerprints, as spelled out: the rule on what both know."""
    read = lambda t: (int.from_bytes(t[:5], "big"), {t[k : k + 5]: int.from_bytes(t[k + 5 : k + 9], "big") for k in range(5, len(t), 9)}) if t else (1 << 40, {})
    (la, x), (lb, y) = (read(base64.b64decode(f.spelled(s)[k])) for k in (a, b))
    known = lambda d: {h: p for h, p in d.items() if int.from_bytes(h, "big") <= min(la, lb)}
    return like(known(x), known(y))


def test_positions_and_growth(words):
    """Swapped halves share their anchors but not their order; fingerprints grow with the text; likeness follows from the strings alone."""
    rng = random.Random(5)
    text = lambda n: " ".join(rng.choice(words) + str(rng.randrange(10_000)) for _ in range(n))
    one, two, long = text(300), text(300), text(60_000)
    texts = [one, two + " " + one, one + " " + two, "", long, long[:300_000] + text(200) + long[302_000:], "tiny", one]
    s = f.sketches(texts)
    pairs = [(a, b) for a in range(len(texts)) for b in range(len(texts))]
    got = f.likeness(s, *np.array(pairs).T).tolist()
    assert [round(x, 9) for x in got] == [round(brute_likeness(s, a, b), 9) for a, b in pairs]
    of = dict(zip(pairs, got, strict=True))
    assert of[(1, 2)] < 0.65 and of[(0, 7)] == of[(3, 3)] == 1.0 and of[(3, 6)] == 0.0
    assert 0.97 < of[(4, 5)] < 1.0  # an edit of half a hundredth of a long text is seen
    size = np.diff(s.first)
    assert size[0] >= f.KEPT and size[4] > 20 * f.KEPT and size[6] == 1


def test_odd_rows(odd_docs, no_docs):
    wanted = sorted(map(str, (r[:3] for r in brute([(r["doc_id"], r["text"]) for r in odd_docs.collect() if len(r["text"] or "") < 5000]))))
    short = odd_docs.where("coalesce(length(text), 0) < 5000")
    got = sorted(str((r["doc_id"], r["n_chars"], r["edited_sha256"])) for r in f.fingerprints(short).collect())
    assert got == wanted
    assert f.fingerprints(odd_docs).count() == odd_docs.count()
    assert f.fingerprints(no_docs).collect() == []
    assert f.fingerprints(short.limit(1)).collect()[0]["near_next"] == 1.0
    rows = f.anchors(odd_docs).collect()
    assert len(rows) == odd_docs.count() and all(r["anchors"] == sorted(r["anchors"]) for r in rows)
