from specframe.llm import url_filter


def test_verdicts(spark):
    cases = [
        (None, "", "", None, "allow"), ("no scheme", "", "", None, "allow"), ("", "", "", None, "allow"),
        ("http://A.Example.NET/en/x?q#f", "a.example.net", "/en/x", "example.net/en/", "allow"),
        ("http://a.example.net/EN/x", "a.example.net", "/EN/x", "net/", "block"), ("http://a.net", "a.net", "", None, "allow"), ("http://net/", "net", "/", "net/", "block"),
        ("http://myexample.com/de/", "myexample.com", "/de/", None, "allow"), ("http://example.com/de/", "example.com", "/de/", "example.com/de/", "block"),
        ("https://x.org/fr/casino", "x.org", "/fr/casino", "org/fr/", "allow"), ("https://x.org/casino", "x.org", "/casino", None, "block"),
        ("https://x.org/casinova", "x.org", "/casinova", None, "allow"), ("https://x.org/free", "x.org", "/free", None, "allow"),
        ("https://x.org/free-bonus", "x.org", "/free-bonus", None, "block"), ("https://x.org/free/free", "x.org", "/free/free", None, "allow"),
        ("a://b://c/d", "b:", "//c/d", None, "allow"), ("ftp://é.org/fr", "é.org", "/fr", None, "allow"), ("x\ny://h\n.org/p", "h\n.org", "/p", None, "allow"),
    ]
    pages = spark.createDataFrame([(i, c[0], "clash") for i, c in enumerate(cases)] * 2, "page_id long, url string, host string")
    got = url_filter.filter_urls(pages).collect()
    assert len(got) == 2 * len(cases)
    for r in got:
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == cases[r["page_id"]][1:], cases[r["page_id"]]
    assert url_filter.filter_urls(pages.limit(0)).count() == 0


def test_own_rules_and_terms(spark):
    pages = spark.createDataFrame([(1, "http://a.b/c/d"), (2, "http://a.b/c"), (3, "http://z/bad-term")], "page_id long, url string")
    got = {r["page_id"]: r for r in url_filter.filter_urls(pages, rules=(("b/", "allow"), ("a.b/c/", "block")), strict=("bad",), soft=("term",)).collect()}
    assert (got[1]["rule"], got[1]["verdict"]) == ("a.b/c/", "block") and (got[2]["rule"], got[2]["verdict"]) == ("b/", "allow")
    assert (got[3]["verdict"], got[3]["strict_hits"], got[3]["soft_terms"]) == ("block", 1, 1)
