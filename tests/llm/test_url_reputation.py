from newsloom.llm import url_reputation as u


def test_rules_and_parts(spark):
    urls = ["HTTP://WWW.Example.NET/en/x?y#z", "http://example.net/en", "http://xexample.net/en/", "a://example.com/de/1", "a://Ä.ORG/fr/", "a://net?/", "no scheme", None, "x://y://net/", "a://b.net#f", "a://example.com\n/de/"]
    pages = spark.createDataFrame([(i, x, "h") for i, x in enumerate(urls)], "page_id long, url string, host string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = {r.page_id: tuple(r)[1:5] for r in u.judged(pages, labels).collect()}
    assert got == {
        0: ("www.example.net", "/en/x", "example.net/en/", "allow"), 1: ("example.net", "/en", "net/", "block"), 2: ("xexample.net", "/en/", "net/", "block"),
        3: ("example.com", "/de/1", "example.com/de/", "block"), 4: ("Ä.org", "/fr/", "org/fr/", "allow"), 5: ("net", "", None, "allow"), 6: ("", "", None, "allow"),
        7: ("", "", None, "allow"), 8: ("y:", "//net/", None, "allow"), 9: ("b.net", "", None, "allow"), 10: ("example.com\n", "/de/", None, "allow"),
    }


def test_reputation_shrinks_and_blocks(spark):
    pages, labels, n = [], [], 0
    for host, good, bad in (("bad.one.com", 2, 60), ("good.one.com", 60, 2), ("few.one.com", 0, 1), ("x.two.org", 50, 1), ("y.two.org", 40, 3), ("z.bad.org", 0, 40)):
        for i in range(good + bad):
            pages.append((n, f"http://{host}/a/{n}"))
            labels.append((n, int(i < good), 0))
            n += 1
    pages += [(n, "http://new.two.org/"), (n + 1, "http://new.bad.org/"), (n + 1, "http://new.bad.org/")]
    got = u.judged(spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(labels + labels[:5], "doc_id long, quality int, toxic int"))
    verdicts = {(r.host, r.verdict) for r in got.collect()}
    assert verdicts == {("bad.one.com", "block"), ("good.one.com", "allow"), ("few.one.com", "allow"), ("x.two.org", "allow"), ("y.two.org", "allow"), ("z.bad.org", "block"), ("new.two.org", "allow"), ("new.bad.org", "block")}
    assert got.count() == n + 3
    empty = spark.createDataFrame([], "page_id long, url string")
    assert u.judged(empty, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).count() == 0


def test_levels(spark):
    hosts = {"www.a.co.uk:8080": ("www.a.co.uk", "a.co.uk", "co.uk"), "me:x@b.com": ("b.com", "b.com", "com"), "co.uk": ("co.uk", "co.uk", "co.uk"), "localhost": ("localhost",) * 3, "": ("",) * 3, "a.b.example.com:": ("a.b.example.com", "example.com", "com")}
    rows = spark.createDataFrame([(h,) for h in hosts], "host string")
    levels = u.levels_of(rows.host)
    assert {r[0]: tuple(r[1:]) for r in rows.select("host", *[levels[k] for k in ("site", "domain", "suffix")]).collect()} == hosts


def test_sites_of_a_shared_suffix_and_long_urls(spark):
    # one bad site under co.uk does not block the others there; its subdomains and ports share its name
    pages = [(i, f"http://bad.co.uk:80/x/{i}") for i in range(40)] + [(i, f"http://good{i % 9}.co.uk/x/{i}") for i in range(40, 120)]
    labels = [(i, int(i >= 40), 0) for i in range(120)]
    pages += [(200, "http://www.bad.co.uk/"), (201, "http://new.co.uk/"), (202, "http://bad.co.uk/" + "a" * 300_000)]
    got = {r.page_id: r for r in u.judged(spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()}
    assert (got[0].verdict, got[50].verdict, got[200].verdict, got[201].verdict, got[202].verdict) == ("block", "allow", "block", "allow", "block")
    assert got[0].host == "bad.co.uk:80" and len(got[202].path) == 300_001


def test_each_level_decides_a_page(spark):
    rows, n = [], 0
    for host, good, bad in (("bad.fine.com", 0, 60), ("ok.fine.com", 200, 4), ("a.worse.net", 1, 40), ("b.worse.net", 0, 30), ("c.poor.bad", 1, 40), ("d.weak.bad", 0, 50), ("e.low.bad", 2, 50), ("x.y.org", 300, 3)):
        rows += [(n + i, f"http://{host}/a/{n + i}", int(i < good)) for i in range(good + bad)]
        n += good + bad
    asked = {"http://bad.fine.com/": ("site", "block"), "http://new.worse.net/": ("domain", "block"), "http://new.other.bad/": ("suffix", "block"), "http://new.ok.zz/": ("top", "allow"), "http://x.y.org/": ("site", "allow")}
    pages = spark.createDataFrame([r[:2] for r in rows] + [(n + i, url) for i, url in enumerate(asked)], "page_id long, url string")
    got = {r.page_id: r for r in u.judged(pages, spark.createDataFrame([(i, q, 0) for i, _, q in rows], "doc_id long, quality int, toxic int")).collect()}
    assert {url: (got[n + i].level, got[n + i].verdict) for i, url in enumerate(asked)} == asked
    assert all(0 < r.bound < r.mean < 1 for r in got.values()) and u.limit_of(0.5, 1.0) == 0.5
