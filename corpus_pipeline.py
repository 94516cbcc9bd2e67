"""Corpus pipeline: documents become packed training sequences.

Each stage is a function of (spark, docs, sf_dir) and works on all that its
predecessor kept; run() writes each stage's result as Parquet to the folder that
the cluster's executors share and reads it again for the next stage.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterlake.llm import decontamination, jaccard_join, line_dedup, packing, toxicity
from rasterlake.llm.class_lm import held_out
from rasterlake.llm.common import materialize
from rasterlake.session import discard


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose toxicity score is under the threshold of op9; the model learns from the labels of the same fold."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = toxicity.score(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("r"), "doc_id", "text"), labels, held_out(F.col("doc_id"), 4, 2), ["r"])
    return scored.where(F.col("toxic_score") < toxicity.THRESHOLD).select("r.*")


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without later copies of line runs of 50 words or more; n_chars follows a text that changes."""
    names = docs.columns
    apart = {c: f"_kept_{i}" for i, c in enumerate(names) if c not in ("doc_id", "text")}  # no name meets the operator's own
    out = line_dedup.line_dedup(docs.withColumnsRenamed(apart))
    cut = F.size("deleted_lines") > 0

    def back(c: str) -> Column:
        kept = F.col(f"`{apart.get(c, c)}`")
        return (F.when(cut, F.length("text").cast("long")).otherwise(kept) if c == "n_chars" else kept).alias(c)

    return out.select(*[back(c) for c in names])


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of texts that are alike."""
    return jaccard_join.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that op2's rule doesn't call contaminated by the benchmark."""
    return decontamination.without_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 1024 tokens, as op8 gives them, with their token ids."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("near_copies", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("packing", pack),
]

#: Training a field and byte-pair encoding are beyond SQL; tests/llm/test_pipeline.py holds run() against plain versions of the
#: stages after the first, and the first one's rows against op9's predictions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        before, docs = docs, materialize(stage(spark, docs, sf_dir), f"stage-{name}")
        discard(before)  # nothing reads a stage's rows once the next one's are written
    return docs
