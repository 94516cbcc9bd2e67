"""Operator 6: deletion of repeated line runs, with DataFrame functions only.

The suffixes of all documents' line sequences are put in order by prefix
doubling: the rank of a place by its first 2h lines follows from the ranks by h
lines at the place and h lines on. Places whose lines occur nowhere else drop
out at once, so later rounds touch repeated text only. Places that share a rank
form an interval of the suffix array whose common prefix has that many lines;
the intervals of runs with enough words give every repeated run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize

MIN_WORDS = 50
BUCKETS = 4096


def _sequences(docs: DataFrame) -> DataFrame:
    """One row per (doc_id, text): d (long), doc_id, th (hash of the text), seq (array of line number, hash and word count of its non-blank lines)."""
    lines = F.transform(F.split("text", "\n", -1), lambda x, i: F.struct(i.alias("line"), F.xxhash64(x).alias("h"), F.regexp_count(x, F.lit(r"[^\x20\x09-\x0D]+")).alias("w")))
    seqs = docs.where("text is not null").select("doc_id", F.xxhash64("text").alias("th"), F.filter(lines, lambda x: x["w"] > 0).alias("seq"))
    seqs = seqs.groupBy("doc_id", "th").agg(F.first("seq").alias("seq")).where(F.size("seq") > 0)
    return materialize(seqs.select(F.monotonically_increasing_id().alias("d"), "*"), "line-sequences")


def _before(groups: DataFrame, within: list[str], by: str, bucket: Column) -> DataFrame:
    """groups (one row a group, with n members) with before: the members of groups that come earlier by `by`, among those alike in `within`. Summed first inside buckets, then over the buckets, so no task sees all groups."""
    groups = groups.withColumn("bucket", bucket)
    to_here = lambda keys, order: Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    inner = F.coalesce(F.sum("n").over(to_here([*within, "bucket"], by)), F.lit(0))
    totals = groups.groupBy(*within, "bucket").agg(F.sum("n").alias("m"))
    totals = totals.select(*within, "bucket", F.coalesce(F.sum("m").over(to_here(within or [F.lit(0)], "bucket")), F.lit(0)).alias("base"))  # at most BUCKETS rows a window
    return groups.withColumn("inner", inner).join(totals, [*within, "bucket"]).withColumn("before", F.col("inner") + F.col("base")).drop("bucket", "inner", "base")


def _first_ranks(lines: DataFrame) -> DataFrame:
    """d, pos, w and rank of the lines that occur more than once; the order is that of the hashes."""
    groups = lines.groupBy("h").agg(F.count("*").alias("n")).where("n > 1")
    groups = _before(groups, [], "h", F.shiftrightunsigned("h", 52)).select("h", F.col("before").alias("rank"))
    groups = materialize(groups, "line-groups-1")  # read back, both sides of the join are plain shuffles, whose hot partitions Spark splits
    return materialize(lines.join(groups, "h").select("d", "pos", "w", "rank"), "line-ranks-1")


def _double(ranks: DataFrame, h: int, scale: int) -> DataFrame:
    """d, pos and rank by the first 2h lines, from ranks by h lines, where that run occurs more than once."""
    ahead = F.lead(F.struct("pos", "rank"), h).over(Window.partitionBy("d").orderBy("pos"))
    pairs = ranks.select("d", "pos", "rank", ahead.alias("a")).where(F.col("a.pos") == F.col("pos") + h).select("d", "pos", "rank", F.col("a.rank").alias("then"))
    groups = pairs.groupBy("rank", "then").agg(F.count("*").alias("n")).where("n > 1")
    groups = _before(groups, ["rank"], "then", F.expr(f"then div {scale}"))
    groups = materialize(groups.select("rank", "then", (F.col("rank") + F.col("before")).alias("next")), f"line-groups-{2 * h}")
    return materialize(pairs.join(groups, ["rank", "then"]).select("d", "pos", F.col("next").alias("rank")), f"line-ranks-{2 * h}")


def _least_runs(active: DataFrame, words: int) -> DataFrame:
    """d, start and m: from each place on, and up to each place, the shortest run of repeated lines with enough words. Each line has a word, so m is at most `words`."""
    island = F.col("pos") - F.row_number().over(Window.partitionBy("d").orderBy("pos"))
    lines = active.select("d", "pos", "w", island.alias("island"))
    by = Window.partitionBy("d", "island").orderBy("pos")

    def shortest(ws: Column) -> Column:
        none = F.struct(F.lit(0).alias("total"), F.lit(0).alias("m"))
        sums = F.aggregate(ws, none, lambda a, x: F.when(a["total"] >= words, a).otherwise(F.struct((a["total"] + x).alias("total"), (a["m"] + 1).alias("m"))))
        return F.when(sums["total"] >= words, sums["m"])

    onward = F.collect_list("w").over(by.rowsBetween(0, words - 1))
    back = F.reverse(F.collect_list("w").over(by.rowsBetween(1 - words, 0)))
    both = lines.select("d", "pos", shortest(onward).alias("onward"), shortest(back).alias("back"))
    runs = both.select("d", F.explode(F.array(F.struct(F.col("pos").alias("start"), F.col("onward").alias("m")), F.struct((F.col("pos") - F.col("back") + 1).alias("start"), F.col("back").alias("m")))).alias("r"))
    return runs.select("d", "r.*").where("m is not null").distinct()


def repeated_runs(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """Lines of later copies: doc_id, th (hash of the text) and lines (array of line numbers from 0, in order).

    A line is given if it lies in a run of consecutive lines (blank ones aside)
    with at least min_words words that also occurs earlier: in a row with a lower
    doc_id (null first; then lower th), or further up in the same text without
    overlap. Such a run is covered by shortest runs with enough words that begin
    at its lines or end at them, so those are all that is grouped.
    """
    seqs = _sequences(docs)
    lines = seqs.select("d", F.posexplode("seq").alias("pos", "x")).select("d", "pos", "x.h", "x.w")
    ranks = _first_ranks(lines)
    runs = materialize(_least_runs(ranks, min_words), "line-runs")
    longest = runs.agg(F.max("m")).first()[0] or 0
    scale = max(1, -(-ranks.count() // BUCKETS))
    found, h = None, 1
    while h <= longest:
        # A run of h to 2h-1 lines is named by the ranks of its first h and its last h lines.
        here = runs.where(f"m >= {h} and m < {2 * h}").withColumn("pos", F.col("start"))
        here = here.join(ranks.select("d", "pos", F.col("rank").alias("first")), ["d", "pos"]).withColumn("pos", F.expr(f"start + m - {h}"))
        here = here.join(ranks.select("d", "pos", F.col("rank").alias("last")), ["d", "pos"]).select("d", "start", "m", "first", "last")
        found = here if found is None else found.unionAll(here)
        if 2 * h > longest:
            break
        ranks = _double(ranks.select("d", "pos", "rank"), h, scale)
        h *= 2
    if found is None:
        found = runs.select("d", "start", "m", F.lit(0).cast("long").alias("first"), F.lit(0).cast("long").alias("last"))
    keys = seqs.select("d", F.struct("doc_id", "th").alias("doc"))
    found = materialize(found.join(keys, "d"), "line-intervals")
    # The first copy is looked for by its document too, so that no task gets all copies of a run.
    first = found.groupBy("m", "first", "last").agg(F.min(F.struct("doc", "start", "d")).alias("o"))
    first = first.select(F.col("m").alias("o_m"), F.col("first").alias("o_first"), F.col("last").alias("o_last"), F.col("o.d").alias("o_d"), F.col("o.start").alias("o_start"))
    run = (F.col("m") == F.col("o_m")) & (F.col("first") == F.col("o_first")) & (F.col("last") == F.col("o_last"))
    later = found.join(first, run & (F.col("d") == F.col("o_d")) & (F.col("start") < F.col("o_start") + F.col("o_m")), "left_anti")
    gone = later.select("d", F.explode(F.expr("sequence(start, start + m - 1)")).alias("pos")).groupBy("d").agg(F.array_sort(F.collect_set("pos")).alias("gone"))
    return seqs.join(gone, "d").select("doc_id", "th", F.transform("gone", lambda p: F.get("seq", p)["line"]).alias("lines"))


def line_dedup(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """docs (doc_id, text and others) with text without the lines of repeated_runs(), and deleted_lines (array of line numbers, empty if none).

    Null texts stay null, a text of which all lines go becomes empty, rows stay
    all. Rows that agree in doc_id and text count as one document and are cut
    alike. Blank lines stay, and so do lines and runs of under min_words words,
    however often they occur. A column deleted_lines of docs is replaced.
    """
    docs = docs.drop("deleted_lines")
    gone = repeated_runs(docs, min_words).select(F.col("doc_id").alias("k"), F.col("th").alias("kh"), F.col("lines").alias("deleted_lines"))
    names = docs.columns
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("r"))
    rows = rows.join(gone, F.col("r.doc_id").eqNullSafe(F.col("k")) & (F.xxhash64("r.text") == F.col("kh")), "left")
    parts = F.split("r.text", "\n", -1)
    kept = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), "deleted_lines")
    text = F.when(F.col("deleted_lines").isNull(), F.col("r.text")).otherwise(F.array_join(F.transform(kept, lambda i: F.get(parts, i)), "\n"))
    gone = F.coalesce("deleted_lines", F.expr("cast(array() as array<int>)"))
    return rows.select(*[text.alias(c) if c == "text" else F.col(f"r.`{c}`") for c in names], gone.alias("deleted_lines"))


def op6_line_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = line_dedup(docs.select("doc_id", "text"))
    return out.select("doc_id", F.size("deleted_lines").cast("long").alias("n_deleted"), "text")


OP6_SQL = r"""
with dd as (select distinct doc_id, text from documents where text is not null),
al as (select doc_id, text, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as i from dd),
aw as (select *, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) as w from al),
l as (select doc_id, text, line, i, w, row_number() over (partition by doc_id, text order by i) as pos, sum(w) over (partition by doc_id, text order by i) as cum from aw where w > 0),
runs as (
  select a.doc_id, a.text, a.pos as s, min(b.pos) as e from l a join l b on a.doc_id = b.doc_id and a.text = b.text and b.pos between a.pos and a.pos + 49 and b.cum - a.cum + a.w >= 50 group by all
  union
  select a.doc_id, a.text, max(b.pos) as s, a.pos as e from l a join l b on a.doc_id = b.doc_id and a.text = b.text and b.pos between a.pos - 49 and a.pos and a.cum - b.cum + b.w >= 50 group by all),
named as (select r.doc_id, r.text, s, e, string_agg(line, chr(10) order by pos) as run from runs r join l on l.doc_id = r.doc_id and l.text = r.text and l.pos between s and e group by all),
firsts as (select run, min(struct_pack(d := doc_id, s := s)) as o from named group by run),
gone as (select distinct n.doc_id, n.text, unnest(range(n.s, n.e + 1)) as pos from named n join firsts f on n.run = f.run where f.o.d <> n.doc_id or f.o.s + (n.e - n.s + 1) <= n.s),
gi as (select l.doc_id, l.text, l.i from l join gone using (doc_id, text, pos)),
kept as (select aw.doc_id, aw.text, string_agg(case when gi.i is null then line end, chr(10) order by aw.i) as new, count(gi.i) as n from aw left join gi on aw.doc_id = gi.doc_id and aw.text = gi.text and aw.i = gi.i group by all)
select d.doc_id, cast(coalesce(n, 0) as bigint) as n_deleted, case when d.text is null then null else coalesce(new, '') end as text
from documents d left join kept k on d.doc_id = k.doc_id and d.text = k.text
"""
