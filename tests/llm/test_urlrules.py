"""URL rules against a direct search of all rules, and awkward rows."""

import random

from lotwise.llm import urlrules


def direct(url, rules, default):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host, rest = rest[:cut].translate({c: c + 32 for c in range(65, 91)}), rest[cut:]
        path = rest[: min([rest.find(c) for c in "?#" if c in rest] or [len(rest)])]
    fits = [(len(h) + len(p), len(h), h + p) for h, p, _ in rules if h and (host == h or host.endswith("." + h)) and path.startswith(p)]
    if not fits:
        return host, path, None, default
    top = max(fits)
    return host, path, top[2], min(v for h, p, v in rules if h + p == top[2] and len(h) == top[1])


def test_rules_equal_a_direct_search(spark):
    rng = random.Random(3)
    hosts = ["org", "com", "a.org", "b.a.org", "example.org", "x.example.org", "c", "ample.org", ""]
    paths = ["", "/", "/a", "/a/", "/a/b", "/a/b/c", "/b", "/ab", "/é"]
    for _ in range(2):
        rules = [(rng.choice(hosts), rng.choice(paths), rng.choice(["allow", "block"])) for _ in range(16)]
        urls = ["HTTP://" + rng.choice(["", "x.", "y.x.", "Z."]) + rng.choice(hosts) + rng.choice(paths) + rng.choice(["", "q", "/", "?z=/a", "#/a"]) for _ in range(300)]
        urls += [None, "", "nope", "http:/a.org/a", "http://", "://org", "https://org?a://com/", "http://a..org/", "http://.org/a", "http://É.org/\n/a", "http://x\x00.org/a"]
        urls += ["http://" + "a." * 3000 + "org/" + "b/" * 3000] * 2
        pages = spark.createDataFrame([(i, u, "h", 3) for i, u in enumerate(urls)], "page_id long, url string, host string, verdict int").repartition(5)
        out = urlrules.judge_urls(pages, spark.createDataFrame(rules, "host string, path string, verdict string"), "other")
        got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in out.collect()}
        assert got == {i: direct(u, rules, "other") for i, u in enumerate(urls)}


def test_repeats_nulls_and_empty_tables(spark):
    rules = spark.createDataFrame([("org", None, "block"), (None, "/", "allow")], "host string, path string, verdict string")
    pages = spark.createDataFrame([(1, "http://a.org"), (1, "http://a.org"), (None, "http://a.org"), (2, None)], "page_id long, url string")
    seen = sorted((str(r["page_id"]), r["host"], r["path"], r["rule"], r["verdict"]) for r in urlrules.judge_urls(pages, rules).collect() if r["rule"])
    assert seen == [("1", "a.org", "", "org", "block")] * 2 + [("None", "a.org", "", "org", "block")]
    assert urlrules.judge_urls(pages.limit(0), rules).count() == 0
    assert {r["verdict"] for r in urlrules.judge_urls(pages, rules.limit(0), "block").collect()} == {"block"}


def test_plan_is_native(spark, tiny):
    plan = urlrules.op12_urls(spark, tiny)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan
