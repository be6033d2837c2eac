import datetime as dt

from pyspark.sql import functions as F

from shoptrail.llm import urllists

D = lambda n: dt.date(2024, 1, 1) + dt.timedelta(days=n)
LISTS = "list_key string, action string, day date"
CAPTURES = "url string, day date, list_key int"


def test_as_of_equals_brute_force(spark):
    entries = [("a.com", "add", D(3)), ("a.com", "remove", D(40)), ("a.com", "add", D(41)), ("x.a.com", "add", D(10)),
               ("x.a.com", "remove", D(10)), ("b.org", "remove", D(1)), ("b.org", "add", D(200)), ("b.org", "add", D(210)),
               (None, "add", D(1)), ("c.net", "add", None)] + [("hot.com", "add" if i % 2 else "remove", D(i)) for i in range(300)]
    urls = ["http://a.com/", "https://X.a.com/p", "http://u:p@x.a.com:80?q", "http://nota.com", "http://b.org", "http://hot.com/1", "c.net", None, ""]
    captures = [(u, D(n), 1) for u in urls for n in range(0, 330, 7)] + [("http://a.com/", None, 1), ("http://a.com/", D(5), 1), ("http://a.com/", D(5), 1)]
    got = urllists.flag(spark.createDataFrame(captures, CAPTURES), spark.createDataFrame(entries, LISTS))
    listed = {"http://a.com/": ["a.com"], "https://X.a.com/p": ["x.a.com", "a.com"], "http://u:p@x.a.com:80?q": ["x.a.com", "a.com"],
              "http://b.org": ["b.org"], "http://hot.com/1": ["hot.com"]}

    def active(key, day):
        events = {}
        for k, action, d in entries:
            if k == key and d is not None:
                events[d] = events.get(d, False) or action == "add"
        before = [d for d in events if d <= day]
        return bool(before) and events[max(before)]
    want = sorted((u or "", str(d), next((k for k in listed.get(u, []) if d and active(k, d)), None) or "") for u, d, _ in captures)
    assert sorted((r.url or "", str(r.day), r.list_key or "") for r in got.collect()) == want
    assert got.filter("blocked <> (list_key IS NOT NULL)").count() == 0


def test_intervals_are_disjoint_and_hold_as_listed(spark):
    entries = spark.createDataFrame([("k", "add", D(1)), ("k", "add", D(2)), ("k", "remove", D(5)), ("k", "add", D(9))], LISTS)
    assert sorted(map(tuple, urllists.intervals(entries).collect())) == [("k", D(1), D(5)), ("k", D(9), None)]


def test_empty_tables(spark):
    none, one = spark.createDataFrame([], LISTS), spark.createDataFrame([("http://a.com", D(1), 1)], CAPTURES)
    assert [r.blocked for r in urllists.flag(one, none).collect()] == [False]
    assert urllists.flag(spark.createDataFrame([], CAPTURES), spark.createDataFrame([("a.com", "add", D(0))], LISTS)).count() == 0


def test_hosts(spark):
    urls = ["HTTP://A.Com:8/x", "ftp://h", "//h", "http://[::1]/", "http://u@h.d.e#f", "no url"]
    got = spark.createDataFrame([(u,) for u in urls], "u string").select(urllists.host(F.col("u")).alias("h"))
    assert [r.h for r in got.collect()] == ["a.com", "h", "", "[", "h.d.e", ""]
