"""Url verdicts against plain Python."""

import re

from corpusloom.llm.urls import RULES, judge_urls, op10_urls

SF = "/root/testdata/sf0.01"
ODD = [
    None, "", "no scheme/x", "http://", "HTTP://A.Example.ORG/es/1", "http://example.org/es", "http://example.org/en/1?x=/es/",
    "https://x.com/de/é#f", "https://notexample.org/en/1", "http://y.com?/de/", "ftp://com/fr/", "http://a.b/c://d.org/",
    "http://ÀB.org/", "http://x.net/" + "long/" * 5000, "http://x.net\n/a", "://org/",
]


def split(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), path


def rule(host, path):
    fits = [(len(h + p), h + p, v) for v, h, p in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[1:] if fits else (None, None)


def test_odd_urls(spark):
    rows = [(n, u, 0) for n, u in enumerate(ODD)] + [(None, ODD[4], 0), (1, "", 0)]
    pages = spark.createDataFrame(rows, "page_id long, url string, score int")
    labelled = spark.createDataFrame(
        [(f"http://bad.net/casino/{n}", 1) for n in range(30)] + [(f"http://fine.net/news/{n}", 0) for n in range(30)]
        + [(None, 1), ("http://fine.net/x", None)], "url string, label int",
    )
    got = judge_urls(pages, RULES, labelled, rounds=8).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.page_id is None:
            continue
        url = ODD[r.page_id]
        assert (r.host, r.path) == split(url)
        name, verdict = rule(r.host, r.path)
        assert r.rule == name and r.verdict == (verdict or ("block" if r.score > 0.5 else "allow"))
    assert judge_urls(pages.where("page_id = 99"), RULES, labelled, rounds=1).collect() == []
    nothing = judge_urls(pages, RULES, labelled.where("label = 7")).collect()
    assert {r.score for r in nothing} == {0.5} and all(r.verdict == "allow" for r in nothing if r.rule is None)
    new = spark.createDataFrame([(1, "http://bad.net/casino/x"), (2, "http://fine.net/news/y")], "page_id long, url string")
    assert {r.page_id: r.verdict for r in judge_urls(new, RULES, labelled).collect()} == {1: "block", 2: "allow"}


def test_registered(spark):
    urls = {r.page_id: r.url for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    got = op10_urls(spark, SF).collect()
    assert len(got) == len(urls)
    for r in got:
        assert (r.host, r.path) == split(urls[r.page_id])
        name, verdict = rule(r.host, r.path)
        assert r.rule == name and r.verdict == (verdict or ("block" if r.score > 0.5 else "allow"))
    decided = [r for r in got if r.rule]  # the model agrees with the rules that it learned from
    agree = sum((r.score > 0.5) == (r.verdict == "block") for r in decided)
    assert agree >= 0.9 * len(decided)
    assert not any("Python" in x for x in [op10_urls(spark, SF)._jdf.queryExecution().toString()])
