from datetime import datetime

from pyspark.sql import functions as F
from rasterlake.llm import url_lists as u

T = lambda day: datetime(2024, 1, day)
ENTRIES = [
    ("spam", "block", "bad.example", "add", T(3)), ("spam", "block", "bad.example", "remove", T(6)), ("spam", "block", "bad.example", "add", T(6)), ("spam", "block", "bad.example", "remove", T(9)),
    ("spam", "block", "bad.example", "remove", T(1)), ("good", "allow", "ok.bad.example", "add", T(4)), ("spam", "block", "http://x.example/page", "add", T(2)),
    ("spam", "block", None, "add", T(2)), ("spam", "block", "null.example", "add", None),
]


def entries(spark):
    return spark.createDataFrame(ENTRIES, "list string, action string, pattern string, op string, at timestamp")


def active(pattern, list_name, t):
    changes = sorted((at, op == "add") for l, _, p, op, at in ENTRIES if p == pattern and l == list_name and at and at <= t)
    return bool(changes) and changes[-1][1]


def test_against_brute_force(spark):
    urls = ["http://bad.example/a", "https://www.ok.bad.example:8080/", "HTTP://user@BAD.example./x", "http://notbad.example/", "http://x.example/page", "http://x.example/page2", None, "", "no url", "http://null.example/"]
    rows = [(i, url, T(day), "x") for i, (url, day) in enumerate((url, day) for url in urls for day in range(1, 12))]
    rows.append((999, urls[0], None, "x"))
    rows += rows[:3]
    got = u.judge(spark.createDataFrame(rows, "id int, url string, fetched_at timestamp, blocked string"), entries(spark)).collect()
    assert len(got) == len(rows)
    for r in got:
        url, t = r["url"] or "", r["fetched_at"]
        host = {urls[0]: "bad.example", urls[1]: "www.ok.bad.example", urls[2]: "bad.example"}.get(r["url"], "")
        block = t is not None and (host.endswith("bad.example") and active("bad.example", "spam", t) or active(url, "spam", t))
        allow = t is not None and host.endswith("ok.bad.example") and active("ok.bad.example", "good", t)
        assert (r["blocked"], r["allowed"]) == (block and not allow, allow), r


def test_empty_tables(spark):
    none = spark.createDataFrame([], "id int, url string, fetched_at timestamp")
    assert u.judge(none, entries(spark)).collect() == []
    one = spark.createDataFrame([(1, "http://bad.example", T(4))], "id int, url string, fetched_at timestamp")
    assert u.judge(one, entries(spark).limit(0)).first()["blocked"] is False
    assert one.select(u.host_of(F.lit("http://" + "a." * 200 + "com"))).first()[0] is None


def test_intervals(spark):
    got = {(r["valid_from"].day, r["valid_to"].day if r["valid_to"] else None) for r in u.validity(entries(spark)).where("pattern = 'bad.example'").collect()}
    assert got == {(3, 9)}
