import numpy as np
from pyspark.sql import functions as F
from rasterlake.llm import sharding as s


def test_curve_visits_neighbours():
    for dims, bits in ((2, 4), (3, 3)):
        grid = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij")).reshape(dims, -1).T
        index = s.hilbert_index(grid, bits)
        assert sorted(index) == list(range(len(grid)))
        path = grid[np.argsort(index)]
        assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


def check(rows, shards):
    counts = {}
    for r in rows:
        counts.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in counts.values())
    sizes = [len(counts.get(i, ())) for i in range(shards)]
    assert max(sizes) - min(sizes) <= 1
    return sizes


def test_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = s.op1_hilbert_shards(spark, sf).collect()
    assert sum(check(rows, 16)) == docs.count() and all(r["law"] == "rows" and r["grown_shard"] is None for r in rows)
    import zlib

    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert all(r["size"] == len(texts[r["doc_id"]].encode()) + 1 and r["text_crc32"] == zlib.crc32(texts[r["doc_id"]].encode()) for r in rows)
    by_shard = sorted(rows, key=lambda r: (r["shard"], r["slot"]))
    assert [r["hilbert"] for r in by_shard] == sorted(r["hilbert"] for r in rows)


def test_hot_cell_is_split(spark):
    df = spark.range(1000).selectExpr("id as doc_id", "if(id % 3 = 0, 'hot', cast(id as string)) as source", "id % 7 as n")
    rows = s.hilbert_shards(df, ["source", "n"], 7, rows_per_group=20).collect()
    assert sum(check(rows, 7)) == 1000


def test_odd_rows(odd_docs, no_docs, tmp_path):
    out = s.hilbert_shards(odd_docs, ["lang", "n_chars", "source"], 3)
    assert sum(check(out.collect(), 3)) == odd_docs.count()
    assert sorted(out.columns) == sorted([*odd_docs.columns, "hilbert", "shard"])
    assert s.hilbert_shards(no_docs, ["lang", "n_chars"], 3).collect() == []
    s.write_shards(out, f"{tmp_path}/shards")
    assert out.sparkSession.read.parquet(f"{tmp_path}/shards").count() == odd_docs.count()


def plain_cuts(values, steps):
    """The least value that at least i/steps of all are up to, for i from 1 to steps - 1."""
    values = sorted((v for v in values if v is not None), key=lambda v: v.encode() if isinstance(v, str) else v)
    return list(dict.fromkeys(values[-(-i * len(values) // steps) - 1] for i in range(1, steps))) if values else []


def test_cuts_of_whole_strings(spark):
    rng = np.random.default_rng(1)
    names = [f"https://www.site{k:03d}.example/{'x' * int(rng.integers(0, 30))}" for k in range(60)] + ["é", "zz", "Ω", "a", ""]
    values = [names[int(k)] for k in rng.integers(0, len(names), 3000)] + [names[7]] * 1500 + [None] * 40
    df = spark.createDataFrame([(v,) for v in values], "d0 string")
    for steps in (2, 4, 16):
        assert s.string_cuts(df, "d0", steps) == plain_cuts(values, steps)
    assert s.string_cuts(df.where("d0 is null"), "d0", 4) == [] and s.string_cuts(df.limit(0), "d0", 4) == []


def test_against_a_plain_version(spark):
    """Cells by plain quantiles, the curve by its own definition of neighbours, and shards as runs of equal counts."""
    rng = np.random.default_rng(2)
    rows = [(k, f"https://www.source-{int(rng.integers(0, 20)):02d}.example", int(rng.integers(0, 1000))) for k in range(2000)]
    df = spark.createDataFrame(rows, "doc_id long, source string, n long")
    got = s.hilbert_shards(df, ["source", "n"], 8).collect()
    numbers = df.agg(F.percentile_approx(F.col("n").cast("double"), [i / 16 for i in range(1, 16)], 1000)).first()[0]  # approximate, so taken as they are
    assert all(abs(a - b) <= 5 for a, b in zip(numbers, plain_cuts([r[2] for r in rows], 16), strict=True))
    cuts = [plain_cuts([r[1] for r in rows], 16), list(dict.fromkeys(numbers))]
    cell = {r[0]: tuple(sum(r[i] >= c for c in cuts[i - 1]) for i in (1, 2)) for r in rows}
    index = s.hilbert_index(np.array(list(cell.values())), 4)
    assert [r["hilbert"] for r in sorted(got, key=lambda r: r["doc_id"])] == index.tolist()
    order = sorted(got, key=lambda r: (r["shard"], r["slot"]))
    assert [r["hilbert"] for r in order] == sorted(index.tolist())
    assert [r["shard"] for r in order] == [k * 8 // 2000 for k in range(2000)]
    held = {}
    for r in got:
        held.setdefault(r["shard"], set()).add(r["source"])
    assert max(len(v) for v in held.values()) <= 12  # of 20: readers of one source leave out shards
