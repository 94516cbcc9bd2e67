import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from rasterlake.llm import hard_negatives as h
from rasterlake.llm.vectors import as_binary


def brute(rows, anchors, k=5, m=5):
    """Sorted rows of the operator for (vec_id, label, vector)."""
    kept = [(i, y, [int(np.floor(256 * float(x))) for x in v]) for i, y, v in rows if y is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    first = lambda found, n: sorted(found, key=lambda s: (-s[0], s[1] is None, s[1] or 0))[:n]
    for at, (i, y, v) in enumerate(kept):
        if i is None or not anchors(i):
            continue
        score = [(sum(a * b for a, b in zip(v, w, strict=False)), key, label == y) for n, (key, label, w) in enumerate(kept) if n != at]
        for ps, pid, _ in first([s for s in score if s[2]], k):
            fit = [s for s in score if not s[2] and 80 * ps <= 100 * s[0] <= 100 * ps]
            out += [(i, pid, rank + 1, nid, ps, ns) for rank, (ns, nid, _) in enumerate(first(fit, m))]
    return sorted(out, key=str)


def rows_of(df):
    return sorted((tuple(r[c] for c in ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")) for r in df.collect()), key=str)


KIND = "vec_id long, label int, embedding array<float>, rank string, n int"


def made(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], KIND)


@pytest.mark.parametrize("group", [3, 8192])
def test_against_brute_force(spark, group, monkeypatch):
    monkeypatch.setattr(h, "GROUP", group)
    rng = np.random.default_rng(4)
    rows = [(i, int(rng.integers(0, 3)), (rng.normal(size=6) * rng.uniform(0.1, 4)).astype(np.float32).tolist()) for i in range(300)]
    rows += [(400 + i, 1, rows[5][2]) for i in range(150)] + [(600 + i, 2, rows[5][2]) for i in range(30)]  # one vector many times
    rows += [rows[10], rows[10], (None, 0, rows[3][2]), (None, 1, rows[3][2])]
    rows += [(700, None, [1.0] * 6), (710, 1, None), (720, 1, [None] * 6), (730, 1, [float("nan")] * 6), (740, 1, [float("inf")] * 6), (750, 1, []), (760, 2, [1.0] * 3), (770, 2, [0.0] * 6), (780, 99, [1.0] * 6)]
    got = rows_of(h.hard_negatives(made(spark, rows), F.col("vec_id") % 10 == 0))
    assert got == brute(rows, lambda i: i % 10 == 0)
    assert len(got) > 100


def test_empty_and_no_anchors(spark):
    df = made(spark, [(1, 1, [1.0, 2.0]), (2, 2, [1.0, 2.0])])
    assert h.hard_negatives(df, F.lit(False)).collect() == []
    assert h.hard_negatives(df, F.lit(True)).collect() == []  # no positives
    assert h.hard_negatives(df.limit(0), F.lit(True)).collect() == []
    with pytest.raises(Exception, match="too large"):
        h.hard_negatives(made(spark, [(1, 1, [1e8])]), F.lit(True)).collect()


def test_buckets_are_pruned():
    """Norms fall: once a bucket's norm can't reach what an anchor needs, nothing more is compared."""
    x = np.arange(1000, 0, -1).repeat(2).reshape(-1, 2).astype(np.int32)
    norm2 = (x.astype(np.int64) ** 2).sum(axis=1)
    binary = as_binary(x.ravel(), np.full(1000, 2))
    column = {"rid": pa.array(np.arange(1000)), "id": pa.array(np.arange(1000)), "label": pa.array(np.zeros(1000, np.int64)), "v": binary, "norm2": pa.array(norm2)}
    search = h.Search(2, False)
    anchor = pa.record_batch([pa.array([5000]), pa.array([5000]), pa.array([1]), as_binary(np.array([1, 1], np.int32), np.array([2])), pa.array([2]), pa.array([[{"low": 100, "high": 5000}]], pa.list_(pa.struct([("low", pa.int64()), ("high", pa.int64())])))], [*h.FIELDS, "windows"])
    search.add(anchor)
    for at in range(0, 1000, 50):
        search.meet(pa.record_batch([c.slice(at, 50) for c in column.values()], list(column)))
    assert search.over and search.compared == 50
    assert search.result().to_pydict()["score"] == [2000, 1998]
