"""Operator 3: temporal URL list join, with DataFrame functions only.

Dated additions and removals of list entries become validity intervals; each
capture is judged by the entries that were active when it was fetched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def host_of(url: Column) -> Column:
    """Lower-case host without user, port and final dots; null if there is none or it has over 253 characters (no DNS name)."""
    host = F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:@]+)", 1)
    host = F.regexp_replace(host, r"\.+$", "")
    return F.when((F.length(host) > 0) & (F.length(host) <= 253), host)


def host_suffixes(host: Column) -> Column:
    """a.b.c, b.c and c for a.b.c."""
    parts = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))


def validity(entries: DataFrame) -> DataFrame:
    """Intervals [valid_from, valid_to) of (list, action, pattern): an addition is in force until the next removal, or for good.

    Changes at the same time: the addition wins. Additions to what is active and
    removals of what is not change nothing. Entries with a null in a needed
    column are no entries.
    """
    entries = entries.select("list", "action", "pattern", "op", "at").dropna()
    entries = entries.groupBy("list", "action", "pattern", "at").agg(F.max((F.col("op") == "add").cast("int")).alias("on"))
    by_time = Window.partitionBy("list", "action", "pattern").orderBy("at")
    changed = entries.withColumn("was", F.lag("on").over(by_time)).where((F.col("on") == 1) & (F.coalesce("was", F.lit(0)) == 0) | (F.col("on") == 0) & (F.col("was") == 1))
    ends = changed.withColumn("valid_to", F.lead("at").over(by_time)).where("on = 1")
    return ends.select("list", "action", "pattern", F.col("at").alias("valid_from"), "valid_to")


def judge(captures: DataFrame, entries: DataFrame, url: str = "url", fetched: str = "fetched_at") -> DataFrame:
    """captures with blocked (boolean), matched (sorted array of list:pattern in force) and allowed (boolean).

    entries: list, action ('block' or 'allow'), pattern (a domain, which covers
    its subdomains, or a whole URL), op ('add' or 'remove'), at. A capture is
    blocked if a block entry and no allow entry is in force. Null URLs or times
    match nothing. Repeated captures stay. Columns of captures with the names of
    results are replaced, others are kept.

    The history of one pattern is gathered in an array, so a capture meets one
    row for each of its patterns and the join multiplies nothing; a pattern that
    most captures have is split by the engine's skew join.
    """
    captures = captures.drop("blocked", "matched", "allowed")
    names = captures.columns
    history = validity(entries).groupBy("pattern").agg(F.array_sort(F.collect_list(F.struct("valid_from", "valid_to", "list", "action"))).alias("history"))
    rows = captures.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("r"), F.monotonically_increasing_id().alias("row_id"), F.col(url).alias("u"), F.col(fetched).alias("t"))
    patterns = F.array_distinct(F.concat(F.coalesce(host_suffixes(host_of(F.col("u"))), F.expr("cast(array() as array<string>)")), F.array(F.coalesce("u", F.lit("")))))
    rows = rows.withColumn("pattern", F.explode(patterns))
    joined = rows.join(history, "pattern", "left")
    live = F.filter("history", lambda x: (x["valid_from"] <= F.col("t")) & (x["valid_to"].isNull() | (x["valid_to"] > F.col("t"))))
    live = F.transform(live, lambda x: F.struct(F.concat_ws(":", x["list"], F.col("pattern")).alias("name"), x["action"].alias("action")))
    found = joined.select("row_id", "r", F.coalesce(live, F.expr("cast(array() as array<struct<name: string, action: string>>)")).alias("live"))
    found = found.groupBy("row_id").agg(F.first("r").alias("r"), F.flatten(F.collect_list("live")).alias("live"))
    blocked = F.exists("live", lambda x: x["action"] == "block")
    allowed = F.exists("live", lambda x: x["action"] == "allow")
    return found.select("r.*", (blocked & ~allowed).alias("blocked"), F.array_sort(F.transform("live", lambda x: x["name"])).alias("matched"), allowed.alias("allowed"))


DAY_0 = "2024-01-01"


def capture_times(pages: DataFrame) -> DataFrame:
    """The pages table has no fetch times; page p counts as fetched p mod 366 days after DAY_0."""
    return pages.select("page_id", "url", F.expr(f"cast(date_add(date'{DAY_0}', cast(pmod(page_id, 366) as int)) as timestamp_ntz)").alias("fetched_at"))


def dated_lists(pages: DataFrame) -> DataFrame:
    """Dated entries for the pages' own hosts, as the tables have no list: by a digest of the name, every third host is blocked for some months, every ninth for two spells, and every seventh registered domain is allowed for a while."""
    host = pages.select(host_of(F.col("url")).alias("pattern")).dropna().distinct()
    digest = F.conv(F.substring(F.md5("pattern"), 1, 6), 16, 10).cast("long")
    domain = host.select(F.regexp_extract("pattern", r"([^.]+\.[^.]+\.[^.]+)$", 1).alias("pattern")).where("pattern <> ''").distinct().withColumn("d", digest)
    host = host.withColumn("d", digest)

    def part(df: DataFrame, keep: str, name: str, action: str, op: str, day: str) -> DataFrame:
        return df.where(keep).select(F.lit(name).alias("list"), F.lit(action).alias("action"), "pattern", F.lit(op).alias("op"), F.expr(f"cast(date_add(date'{DAY_0}', cast({day} as int)) as timestamp_ntz)").alias("at"))

    parts = [
        part(host, "d % 3 = 0", "spam", "block", "add", "d % 200"),
        part(host, "d % 3 = 0", "spam", "block", "remove", "d % 200 + 60 + d % 90"),
        part(host, "d % 9 = 0", "spam", "block", "add", "d % 200 + 170 + d % 50"),
        part(domain, "d % 7 = 0", "trusted", "allow", "add", "d % 100"),
        part(domain, "d % 7 = 0", "trusted", "allow", "remove", "d % 100 + 120"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out


def op3_temporal_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    out = judge(capture_times(pages), dated_lists(pages))
    return out.select("page_id", "url", "fetched_at", "blocked", "allowed", F.array_join("matched", ",").alias("matched"))


OP3_SQL = r"""
with cap as (select row_number() over () as rid, page_id, url, cast(date '2024-01-01' + cast(page_id % 366 as integer) as timestamp) as fetched_at,
  regexp_replace(regexp_extract(lower(url), '^[a-z][a-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:@]+)', 1), '\.+$', '') as host from pages),
h as (select distinct host as pattern from cap where length(host) between 1 and 253),
hd as (select pattern, cast('0x' || substr(md5(pattern), 1, 6) as bigint) as d from h),
dd as (select pattern, cast('0x' || substr(md5(pattern), 1, 6) as bigint) as d from (select distinct regexp_extract(pattern, '([^.]+\.[^.]+\.[^.]+)$', 1) as pattern from h) where pattern <> ''),
e as (
  select 'spam' as list, 'block' as action, pattern, 1 as op, d % 200 as day from hd where d % 3 = 0
  union all select 'spam', 'block', pattern, 0, d % 200 + 60 + d % 90 from hd where d % 3 = 0
  union all select 'spam', 'block', pattern, 1, d % 200 + 170 + d % 50 from hd where d % 9 = 0
  union all select 'trusted', 'allow', pattern, 1, d % 100 from dd where d % 7 = 0
  union all select 'trusted', 'allow', pattern, 0, d % 100 + 120 from dd where d % 7 = 0),
one as (select list, action, pattern, day, max(op) as op from e group by all),
act as (select c.rid, one.list, one.action, one.pattern, arg_max(one.op, one.day) as op
  from cap c join one on (c.host = one.pattern or ends_with(c.host, '.' || one.pattern)) and date '2024-01-01' + cast(one.day as integer) <= cast(c.fetched_at as date)
  group by all),
live as (select rid, bool_or(action = 'allow') as allowed, bool_or(action = 'block') as block, string_agg(list || ':' || pattern, ',' order by list || ':' || pattern) as matched from act where op = 1 group by rid)
select page_id, url, fetched_at, coalesce(block and not allowed, false) as blocked, coalesce(allowed, false) as allowed, coalesce(matched, '') as matched
from cap left join live using (rid)
"""
