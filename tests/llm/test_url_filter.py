"""Rules and trees over urls: a plain version of the rules, held-out accuracy, odd rows."""

import math
import random
from collections import Counter

from rowsense.llm import url_filter

ROWS = "page_id long, url string"
ODD = [None, "", "no scheme", "://", "http://", "HTTP://A.NET", "http://NET/x", "http://a.net?x", "http://a.net/#f", "http://example.net/en/1?a=1&b=2", "http://x.EXAMPLE.net/en/", "http://notexample.net/en/", "http://example.net/de/",
       "http://example.com/de/1", "http://xexample.com/de/", "http://example.com/DE/", "http://a.org/fr/é", "http://a.org:80/fr/", "http://user@a.org/fr/", "a?b://x.net/y", "http://a.net/\nb", "İ://ÄB.net/", "ftp://net/", "http://a..net/", "x://" + "a." * 3000 + "net/" + "z" * 90000, "http://😀.net/😀"]


def plain(url):
    url = url or ""
    at = url.find("://")
    host = path = ""
    if at >= 0:
        rest = url[at + 3 :]
        end = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:end])
        tail = rest[end:]
        path = tail[: min([tail.find(c) for c in "?#" if c in tail], default=len(tail))]
    fits = [(len(h + p), h + p, v) for v, h, p in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *max(fits)[1:]) if fits else (host, path, None, None)


def urls(rng, n):
    """What is blocked has digits and parameters; hosts of .io have no rule."""
    for i in range(n):
        bad = rng.random() < 0.4
        host = f"{rng.choice('abcdefgh')}{rng.randrange(40)}.example.{'net' if bad else 'org'}"
        if rng.random() < 0.3:
            host = f"{rng.choice('abcdefgh')}{rng.randrange(40)}.site.io"
        yield bad, f"http://{host}/fr/{rng.randrange(10**12) if bad else 'plain-words'}{'?a=1&b=2&c=3' if bad else ''}"


def test_rules_equal_a_plain_version(spark):
    rows = [(i, u) for i, u in enumerate(ODD)] + [(None, "http://a.net/"), (5, ODD[5])]
    df = spark.createDataFrame(rows, ROWS).selectExpr("*", "'x' AS host", "'y' AS rule", "1 AS features", "2 AS prediction")
    got = url_filter.judge(df, url_filter.RULES).collect()
    assert len(got) == len(rows)
    key = lambda r: tuple(str(x) for x in r)
    expected = sorted(((i, *plain(u)) for i, u in rows), key=key)
    assert sorted(((r["page_id"], r["host"], r["path"], r["rule"], r["verdict"] if r["rule"] else None) for r in got), key=key) == expected
    assert all(r["verdict"] in ("allow", "block") and (r["score"] is None) == (r["rule"] is not None) for r in got)


def test_longest_rule_wins_and_ties_go_to_the_longer_host(spark):
    rules = [("allow", "b.c", "/xx"), ("block", "a.b.c", "/x"), ("block", "c", "/"), ("allow", "c", "/"), ("allow", "d", "/longer")]
    df = spark.createDataFrame([(1, "h://a.b.c/xx"), (2, "h://b.c/xx"), (3, "h://c/"), (4, "h://d/long")], ROWS)
    rows = url_filter.ruled(url_filter.parsed(df), rules).collect()
    assert {r["page_id"]: (r["rule"], r["decided"]) for r in rows} == {1: ("a.b.c/x", "block"), 2: ("b.c/xx", "allow"), 3: ("c/", "block"), 4: (None, None)}


def test_trees_tell_urls_that_no_rule_decides(spark):
    made = list(urls(random.Random(1), 3000))
    df = spark.createDataFrame([(i, u) for i, (_, u) in enumerate(made)], ROWS)
    got = {r["page_id"]: r for r in url_filter.judge(df, url_filter.RULES).collect()}
    free = [i for i in got if got[i]["rule"] is None]
    assert len(free) > 500
    assert sum((got[i]["verdict"] == "block") == made[i][0] for i in free) / len(free) > 0.95
    again = {r["page_id"]: r["score"] for r in url_filter.judge(df, url_filter.RULES).collect()}
    assert again == {i: got[i]["score"] for i in got}


def test_sample_is_bounded_and_shares_are_not(spark, monkeypatch):
    monkeypatch.setattr(url_filter, "SAMPLE", 50)
    made = [(i, u) for i, (_, u) in enumerate(urls(random.Random(2), 800))] + [(i, "http://hot.net/") for i in range(900, 1300)]
    rows = url_filter.ruled(url_filter.parsed(spark.createDataFrame(made, ROWS)), url_filter.RULES).filter("decided IS NOT NULL")
    shares = url_filter.Shares(rows)
    counted = Counter(plain(u)[3] for _, u in made)
    assert (shares.rows, shares.blocked) == (counted["allow"] + counted["block"], counted["block"])
    assert url_filter.sampled(rows, shares.rows, rows.select("url").distinct().count()).count() == 50


def test_features(spark):
    df = spark.createDataFrame([(1, "http://a-b.c/x//y1?p=1&&q#r?s&t"), (2, None)], ROWS)
    rows = url_filter.vectors(df.select("page_id", url_filter.whole("url").alias("url"), url_filter.host_of(url_filter.whole("url")).alias("host"), url_filter.path_of(url_filter.whole("url")).alias("path")).selectExpr("*", "0.5 AS share_1", "0.5 AS share_2")).collect()
    one, none = sorted(rows, key=lambda r: r["page_id"])
    url = "http://a-b.c/x//y1?p=1&&q#r?s&t"
    entropy = -sum(c / len(url) * math.log2(c / len(url)) for c in Counter(url).values())
    assert (one["length"], one["depth"], one["parameters"], one["labels"], one["hyphens"], one["host_length"]) == (len(url), 2, 2, 2, 1, 5)
    assert abs(one["entropy"] - entropy) < 1e-9 and abs(one["digits"] - 2 / len(url)) < 1e-9
    assert all(none[c] == 0 for c in url_filter.LEXICAL)


def test_one_verdict_or_nothing(spark):
    assert url_filter.judge(spark.createDataFrame([], ROWS), url_filter.RULES).count() == 0
    got = url_filter.judge(spark.createDataFrame([(1, "h://a.net/"), (2, "h://q/")], ROWS), url_filter.RULES).collect()
    assert {r["page_id"]: r["verdict"] for r in got} == {1: "block", 2: "allow"}
    assert [r["verdict"] for r in url_filter.judge(spark.createDataFrame([(1, "h://a.net/")], ROWS), []).collect()] == ["allow"]
