from fluxgate.llm.url_filter import judge_urls


def pages(spark, rows, **more):
    return spark.createDataFrame([(i, u, h, *more.values()) for i, (u, h) in enumerate(rows)], "page_id long, url string, html string" + "".join(f", {k} string" for k in more))


def verdicts(spark, rows, redirects=None, **more):
    links = None if redirects is None else spark.createDataFrame(redirects, "url string, target string")
    got = judge_urls(pages(spark, rows, **more), links).collect()
    return {r.page_id: r for r in got}


def test_rules(spark):
    urls = ["http://example.com/en/1", "https://WWW.Example.com/en/x?y#z", "http://a.example.com/fr/", "http://x.net/es/1", "http://x.net/de/1", "http://notexample.com/en/1", "example.com/en/", None, "http://", "x://u@example.com:80/en/", "http://com", "http://b.www.example.com/en/q"]
    got = verdicts(spark, [(u, None) for u in urls], host="h", node="n", own="o", id="i")
    assert [(got[i].rule, got[i].verdict) for i in range(len(urls))] == [
        ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("com/", "allow"), ("net/es/", "block"), (None, "allow"),
        ("com/", "allow"), (None, "allow"), (None, "allow"), (None, "allow"), (None, "allow"), (None, "allow"), ("www.example.com/en/", "allow"),
    ]
    assert (got[1].host, got[1].path) == ("www.example.com", "/en/x") and (got[6].host, got[6].path) == ("", "")


def test_blocks_reach_aliases(spark):
    canon = lambda u: f'<html><LINK REL="canonical" href="{u}"></html>'
    rows = [
        ("http://x.org/a", canon("http://y.org/b")),
        ("http://y.org/b", "<meta http-equiv='refresh' content='0; url=http://bad.net/es/1'>"),
        ("http://z.org/c", canon("https://ok.com/")),
        ("http://w.org/d", canon("/e")),
        ("http://w.org/e/", canon("//bad.net/fr/9")),
        ("http://free.org/f", "<p>text</p>"),
        ("http://both.org/g", canon("http://bad.net/es/1")),
        ("http://bad.net/es/1#frag", None),
    ]
    got = verdicts(spark, rows, redirects=[("http://moved.org/x", "http://bad.net/fr/2"), ("http://both2.org/h", "http://good.com/1"), ("http://both2.org/h", "http://bad.net/fr/3")])
    assert [got[i].verdict for i in range(8)] == ["block", "block", "allow", "block", "block", "allow", "block", "block"]
    assert got[0].component == got[6].component != got[3].component and got[5].component is None


def test_explicit_allow_has_precedence(spark):
    rows = [("http://a.org/1", None), ("http://good.com/1", None), ("http://bad.net/es/1", None)]
    got = verdicts(spark, rows, redirects=[("http://a.org/1", "http://good.com/1"), ("http://good.com/1", "http://bad.net/es/1")])
    assert [got[i].verdict for i in range(3)] == ["allow", "allow", "block"]


def test_odd_pages(spark):
    assert judge_urls(pages(spark, [])).collect() == []
    got = verdicts(spark, [(None, '<link rel="canonical" href="x">'), ("http://a.org", '<link rel="canonical" href="">'), ("http://a.org", "<link rel=canonical href='#x'>"), ("http://a.org/", "<" * 100_000)])
    assert len(got) == 4 and all(r.verdict == "allow" for r in got.values())


def test_long_chain(spark):
    rows = [(f"http://c{i}.org/", f'<link rel="canonical" href="http://c{i + 1}.org/">') for i in range(60)] + [("http://c60.org/", '<link rel="canonical" href="http://q.net/es/">')]
    got = verdicts(spark, rows)
    assert all(r.verdict == "block" for r in got.values()) and len({r.component for r in got.values()}) == 1


def test_relative_links(spark):
    canon = lambda u: f'<link rel="canonical" href="{u}">'
    rows = [
        ("http://a.org/b/c.html", canon("?p=2")),
        ("http://a.org/b/c.html?p=2", canon("http://bad.net/es/1")),
        ("http://a.org/b/d.html", canon("../x")),
        ("http://a.org/x", canon("/y/./z/../../../w/..")),
        ("http://a.org/", canon("http://bad.net/es/1")),
        ("http://free.org/1", canon("http://bad.net/es/../x")),
        ("http://free.org/2", canon("http://bad.net/de/?q=/../es/")),
        ("http://late.org/1", canon("http://bad.net/de/../es/2")),
        ("http://a.org?k", canon("?p=3")),
        ("http://a.org?p=3", canon("./b/./c.html#part")),
    ]
    got = verdicts(spark, rows)
    assert [got[i].verdict for i in range(len(rows))] == ["block", "block", "block", "block", "block", "allow", "allow", "block", "block", "block"]


def test_unclosed_tags_take_linear_time(spark):
    bad = '<link rel="canonical" href="http://bad.net/es/1">'
    rows = [("http://a.org/1", "<link rel=canonical " * 50_000), ("http://a.org/2", "<link " + "rel " * 250_000 + ">"), ("http://a.org/3", "<meta" + " " * 1_000_000), ("http://a.org/4", "<link rel=canonical " * 1000 + bad)]
    got = verdicts(spark, rows)
    assert [got[i].verdict for i in range(4)] == ["allow", "allow", "allow", "block"]


def test_spellings_are_edges(spark):
    rows = [("http://a.org/x", None), ("https://A.org/x/#part", None), ("http://bad.net/es/1", None), ("https://bad.net:443/es/1/", None), ("http://alone.org/", None)]
    got = verdicts(spark, rows, redirects=[("https://a.org/x", "http://bad.net/es/1")])
    assert [got[i].verdict for i in range(5)] == ["block", "block", "block", "block", "allow"]
    assert len({got[i].component for i in range(4)}) == 1 and got[4].component is None
