import random

import corpus_pipeline
import pytest
import test_decontamination
import test_jaccard_join
import test_line_dedup
import test_packing
from pyspark.sql import functions as F
from rasterlake.llm import decontamination, jaccard_join, line_dedup, toxicity


def test_stages_in_order(spark, sf):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "near_copies", "decontamination", "packing"]
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        out = corpus_pipeline.materialize(out, "test")
        assert out.columns == docs.columns and out.dtypes == docs.dtypes
        before, after = ({r["doc_id"]: r for r in df.collect()} for df in (docs, out))
        if name == "toxicity":
            bad = {r["doc_id"] for r in toxicity.op9_toxicity(spark, sf).where("predicted = 1").collect()}
            assert after.keys() == before.keys() - bad
        elif name == "line_dedup":
            wanted = {r["doc_id"]: r["text"] for r in line_dedup.line_dedup(docs).collect()}
            assert {k: r["text"] for k, r in after.items()} == wanted and all(r["n_chars"] == len(r["text"]) for r in after.values())
        elif name == "near_copies":
            wanted = {r["class_id"] for r in jaccard_join.classes(docs).collect()}
            assert after.keys() == wanted
        else:
            bad = {r["doc_id"] for r in decontamination.verdicts(decontamination.contamination(docs, spark.read.parquet(f"{sf}/benchmark.parquet"))).where("contaminated").collect()}
            assert after.keys() == before.keys() - bad
        docs = out
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, sf).collect()
    assert {p["doc_id"] for p in pieces} == {r["doc_id"] for r in docs.collect()}


@pytest.fixture(scope="module")
def corpus(spark, words, tmp_path_factory):
    """Documents of which some are toxic, repeat passages of lines, are near copies, or hold benchmark passages."""
    rng = random.Random(5)
    line = lambda n: " ".join(rng.choice(words) + str(rng.randrange(400)) for _ in range(n))
    item, passage = line(30), "\n".join(line(12) for _ in range(6))
    docs, labels = [], []
    for i in range(160):
        text = "\n".join(line(rng.randrange(4, 16)) for _ in range(rng.randrange(2, 9)))
        if i % 5 == 0:
            text += " " + " ".join(f"vile{rng.randrange(3)}" for _ in range(9))
            labels.append((i, 1))
        elif i % 2:
            labels.append((i, 0))
        if i % 7 == 1:
            text += "\n" + passage
        if i % 9 == 2:
            text = f"{text} {item} {line(3)}"
        if i % 11 == 3 and docs:
            text = docs[-1][1] + (" end" if docs[-1][1] else "")
        docs.append((i, text, "en", "a", len(text)))
    docs += [(200, None, None, None, None), (201, "", "en", "a", 0), (202, docs[4][1], "en", "b", 1)]
    at = tmp_path_factory.mktemp("corpus")
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int").withColumn("quality", F.lit(1)).write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return str(at), docs, item


def test_run_against_plain_versions(spark, corpus):
    at, docs, item = corpus
    toxic = {r["doc_id"] for r in toxicity.op9_toxicity(spark, at).where("predicted = 1").collect()}
    assert toxic == {k for k, t, *_ in docs if "vile" in (t or "")}
    left = [(k, t) for k, t, *_ in docs if k not in toxic]
    cut = test_line_dedup.brute(left)
    left = sorted((eval(x) for x in cut), key=lambda r: r[0])  # noqa: S307
    classes = test_jaccard_join.brute(left)
    left = [(k, t) for k, t in left if classes[k][0] == k]
    verdicts = [eval(x) for x in test_decontamination.brute(left, [(1, item)])]  # noqa: S307
    bad = {v[0] for v in verdicts if v[4]}
    left = [(k, t) for k, t in left if k not in bad]
    rows = corpus_pipeline.run(spark, at).collect()
    assert bad and len(left) < len(docs) - len(toxic) - len(bad)
    assert {r["doc_id"] for r in rows} == {k for k, _ in left}
    test_packing.check(rows, left, 1024)


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_odd_rows_of_stages(spark, corpus, odd_docs, no_docs, name):
    """Nulls, empty and long texts, repeated rows, and columns with the names that the operators use inside."""
    at, stage = corpus[0], dict(corpus_pipeline.STAGES)[name]
    clash = ["deleted_lines", "toxic_score", "contaminated", "class_id", "r", "k", "kd", "th", "rid", "lines"]
    docs = odd_docs.withColumns({c: F.lit(7) for c in clash})
    out = stage(spark, docs, at)
    rows = out.collect()
    assert {r["doc_id"] for r in rows} == {1, 2, 3, 4, 5, 6, None}
    if name != "packing":
        assert out.columns == docs.columns and all(r[c] == 7 for r in rows for c in clash)
    assert stage(spark, docs.limit(0), at).collect() == []
