import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from fleetlens.llm import url_filter


def at(hours):
    return dt.datetime(2024, 1, 1) + dt.timedelta(hours=hours)


@pytest.mark.parametrize(
    ("url", "want"),
    [
        ("http://a.b.c/x/y/z?q=/no/#f", {"a.b.c", "b.c", "c", "a.b.c/", "a.b.c/x/", "a.b.c/x/y/"}),
        ("HTTPS://user:pw@A.B:8080", {"a.b", "b"}), ("ftp://h/", {"h", "h/"}), ("no url", set()), ("", set()), (None, None),
        ("http://[2001:DB8::1.2.3.4]:80/x", {"[2001:db8::1.2.3.4]", "[2001:db8::1.2.3.4]/"}), ("http://u@a.b./", {"a.b", "b", "a.b/"}),
    ],
)
def test_patterns_of_a_url(spark, url, want):
    got = spark.createDataFrame([(url,)], "u string").select(url_filter.patterns_of(F.col("u")).alias("p")).first().p
    assert (set(got) if got is not None else None) == (want if url is not None else set()) or got is None


def brute(captures, log):
    """Entries replayed for every capture."""
    out = []
    for i, url, when in captures:
        n = {"block": 0, "allow": 0}
        host = url.split("//")[1].split("/")[0] if url else None
        for lst in n:
            for pattern in {e[1] for e in log if e[0] == lst and e[1]} if url and when else ():
                rows = sorted((t, a == "add") for k, p, a, t in log if (k, p) == (lst, pattern) and t and a in ("add", "remove") and t <= when)
                covers = host == pattern or host.endswith("." + pattern) or "/" in pattern and url.split("//")[1].startswith(pattern)
                n[lst] += bool(rows and rows[-1][1] and covers)
        out.append((i, n["block"], n["allow"], "allowed" if n["allow"] else "blocked" if n["block"] else "open"))
    return sorted(out, key=repr)


def test_any_history_equals_a_replay(spark):
    rng = np.random.Generator(np.random.PCG64(8))
    hosts = ["a.x.com", "b.x.com", "x.com", "com", "x.com/p/", "a.x.com/p/q/", "z.org"]
    log = [(str(rng.choice(["block", "allow"])), hosts[rng.integers(7)], str(rng.choice(["add", "remove"])), at(int(rng.integers(0, 400)))) for _ in range(300)]
    log += [("block", "hot.net", ["add", "remove"][i % 2], at(i)) for i in range(200)]
    log += [("block", None, "add", at(0)), ("block", "com", "add", None), (None, "com", "add", at(0)), ("block", "com", "other", at(0)), log[0], log[0]]
    urls = ["http://a.x.com/p/q/r", "http://b.x.com/", "http://x.com/p/1", "http://z.org/a", "http://hot.net/x", "http://axx.com/"]
    captures = [(i, urls[rng.integers(6)], at(int(rng.integers(-5, 450)))) for i in range(200)]
    captures += [(900, None, at(1)), (901, urls[0], None), (902, urls[4], at(50)), (902, urls[4], at(50))]
    df = spark.createDataFrame([(*c, "old") for c in captures], "id int, url string, fetched timestamp, verdict string")
    entries = spark.createDataFrame(log, "list string, pattern string, action string, ts timestamp")
    for days in (1, 5):
        got = url_filter.judge(df, entries, days=days)
        assert got.columns == ["id", "url", "fetched", "n_block", "n_allow", "since", "verdict"]
        assert sorted(((r.id, r.n_block, r.n_allow, r.verdict) for r in got.collect()), key=repr) == brute(captures, log)
    assert {r.verdict for r in url_filter.judge(df, entries.limit(0)).collect()} == {"open"}
    assert url_filter.judge(df.limit(0), entries).count() == 0


def test_intervals_are_disjoint(spark):
    log = [("block", "h", a, at(t)) for a, t in [("remove", 0), ("add", 1), ("add", 2), ("remove", 30), ("remove", 31), ("add", 90), ("remove", 90)]]
    got = url_filter.validity(spark.createDataFrame(log, "list string, pattern string, action string, ts timestamp")).collect()
    assert sorted((r.valid_from, r.valid_to) for r in got if r.valid_to) == [(at(1), at(30))]
    assert [r.valid_from for r in got if not r.valid_to] == [at(90)]


def test_patterns_of_any_depth_match(spark):
    deep = "h.org/" + "".join(f"p{i}/" for i in range(30))
    url = f"http://{deep}page"
    assert deep in spark.createDataFrame([(url,)], "u string").select(url_filter.patterns_of(F.col("u")).alias("p")).first().p
    log = [("block", deep, "add", at(0)), ("block", deep + "page/", "add", at(0)), ("allow", "h.org/p0/" + "x/" * 9, "add", at(0))]
    captures = [(1, url, at(5)), (2, "http://h.org/p0/page", at(5)), (3, "http://h.org", at(5))]
    df = spark.createDataFrame(captures, "id int, url string, fetched timestamp")
    got = url_filter.judge(df, spark.createDataFrame(log, "list string, pattern string, action string, ts timestamp")).collect()
    assert sorted((r.id, r.n_block, r.n_allow, r.verdict) for r in got) == brute(captures, log) == [(1, 1, 0, "blocked"), (2, 0, 0, "open"), (3, 0, 0, "open")]


def test_long_intervals_cost_only_the_buckets_asked_for(spark):
    log = [("block", f"h{i}.org", "add", at(i)) for i in range(50)] + [("allow", "h3.org", "add", at(30)), ("allow", "h3.org", "remove", at(200_000))]
    entries = spark.createDataFrame(log, "list string, pattern string, action string, ts timestamp")
    captures = [(1, "http://h3.org/", at(0)), (2, "http://h3.org/", at(100_000)), (3, "http://h3.org/", at(300_000)), (4, "http://h4.org/", at(4))]
    df = spark.createDataFrame(captures, "id int, url string, fetched timestamp")
    got = url_filter.judge(df, entries).collect()
    assert sorted((r.id, r.n_block, r.n_allow, r.verdict) for r in got) == brute(captures, log)
    wanted = df.select(F.regexp_extract("url", "//([^/]*)", 1).alias("pattern"), url_filter._bucket("fetched", 1).alias("bucket"))
    laid = url_filter.active(url_filter.validity(entries), wanted).collect()
    assert len(laid) <= 2 * len(captures) and len({tuple(r) for r in laid}) == len(laid)
