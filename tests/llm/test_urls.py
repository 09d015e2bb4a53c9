import pytest

from tillpath.llm.urls import RULES, judge_urls

URLS = [
    None,
    "",
    "no scheme",
    "http://",
    "http://net",
    "http://net/",
    "https://A.Example.NET/en/1?x=1#y",
    "https://a.example.net/en",
    "https://a.example.net/EN/1",
    "https://example.net.evil.org/fr/2",
    "https://org/fr/?q",
    "https://badexample.com/de/",
    "https://m.example.com/de/7#t",
    "https://m.example.com?/de/",
    "https://m.example.com#/de/",
    "ftp://x.y.z.net/a/b//c",
    "x://É.net/ü",
    "http://" + "a." * 3000 + "net/" + "p/" * 3000,
]


def plain(url, rules):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    cut = min((rest.index(c) for c in "/?#" if c in rest), default=len(rest))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:].split("#")[0].split("?")[0]
    fits = [
        (len(h + p), v == "block", h + p, v)
        for h, p, v in rules
        if (host == h or host.endswith("." + h)) and path.startswith(p)
    ]
    best = max(fits, default=(0, False, None, "allow"))
    return host, path, best[2], best[3]


@pytest.mark.parametrize("rules", [RULES, [*RULES, ("example.net", "/en", "block"), ("net", "/", "allow")], []])
def test_against_plain_rules(spark, rules):
    data = [(i, u, "x", "y") for i, u in enumerate(URLS * 2)]
    pages = spark.createDataFrame(data, "page_id long, url string, rule string, known string")
    given = rules or spark.createDataFrame([], "host string, path string, verdict string")
    found = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in judge_urls(pages, given).collect()}
    assert found == {i: plain(u, rules) for i, u, *_ in data}


def test_empty_table(spark):
    assert judge_urls(spark.createDataFrame([], "page_id long, url string")).count() == 0
