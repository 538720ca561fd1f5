"""URL algebra, rules, robots and paths on literal cases."""

import pytest
from pyspark.sql import functions as F

from tidemark.functions import formats, urls
from tidemark.operators import paths, robots, rules
from tidemark.plans.config import Settings, difference, glob, overlay, portable, reconfigured

CANONICAL = [
    ("HTTP://Example.COM:80/a/../b", "http://example.com/b"),
    ("https://example.com.:443", "https://example.com/"),
    ("https://example.com/a/./b/", "https://example.com/a/b/"),
    ("https://example.com/é x", "https://example.com/%C3%A9%20x"),
    ("https://example.com/?", "https://example.com/"),
    ("example.com/x", "https://example.com/x"),
]


def one(spark, expr, **columns):
    df = spark.createDataFrame([tuple(columns.values())], ", ".join(f"{c} string" for c in columns)) if columns else spark.range(1)
    return df.select(F.expr(expr).alias("v")).first()["v"]


def test_canonical(spark):
    got = urls.with_url(spark.createDataFrame(CANONICAL, "raw string, want string"), "raw").select("u_url", "want").collect()
    assert [r.u_url for r in got] == [r.want for r in got]


def test_key_orders_params(spark):
    rows = [("http://h/?b=2&a=1&b=1",), ("http://h/?a=1&b=1&b=2",), ("http://h/?x=%zz&a",), ("http://h/?q=a+b*",)]
    got = [r.u_key for r in urls.with_url(spark.createDataFrame(rows, "raw string"), "raw").collect()]
    assert got == ["http://h/?a=1&b=1&b=2", "http://h/?a=1&b=1&b=2", "http://h/?x=%zz&a", "http://h/?q=a+b%2A"]


@pytest.mark.parametrize("ref", ["", "#x", "mailto:a@b", "javascript:1", "data:,x", "tel:1"])
def test_rejected(spark, ref):
    df = spark.createDataFrame([(ref, "http://h/d/p")], "ref string, base string")
    assert urls.with_url(df, "ref", "base").first()["u_url"] is None


def test_resolve(spark):
    cases = [("../x", "http://h/x"), ("?q=1", "http://h/a/b?q=1"), ("//o/p", "http://o/p"), ("/r", "http://h/r"), ("c\n", "http://h/a/c")]
    df = spark.createDataFrame([(r, "http://h/a/b?z=1#f", w) for r, w in cases], "ref string, base string, want string")
    got = urls.with_url(df, "ref", "base").collect()
    assert [r.u_url for r in got] == [r.want for r in got]


@pytest.mark.parametrize(
    ("pattern", "host", "want"),
    [("example.com", "EXAMPLE.com.", True), ("*.example.com", "a.example.com", True), (".example.com", "example.com", True), ("example.com", "a.example.com", False), ("*", "x", True), ("", "x", False), ("*.example.com", "badexample.com", False)],
)
def test_host_pattern(spark, pattern, host, want):
    assert one(spark, urls.host_pattern("p", "h"), p=pattern, h=host) is want


def test_registrable(spark):
    for host, want in (("www.bbc.co.uk", "bbc.co.uk"), ("a.b.example.com", "example.com"), ("10.0.0.1", "10.0.0.1"), ("localhost", "localhost")):
        assert one(spark, urls.registrable("h"), h=host) == want


def test_prohibitions_are_a_prefix_of_the_scope(spark):
    s = Settings(start_urls=("http://h/",), exclude=("bad",), max_repeat_segment=2, block_extensions=("zip",), max_levels=2)
    rows = [(f"http://h/{p}", role, d) for p in ("", "bad", "a/a/a", "x.zip", "ok?q", "deep/er") for role in ("page", "asset") for d in (0, 2, 3)]
    df = urls.with_url(spark.createDataFrame(rows, "raw string, role string, depth int"), "raw")
    got = df.select(F.expr(rules.prohibited(s, "role", "depth")).alias("p"), F.expr(rules.scope_reason(s, "role", "depth", "null")).alias("c")).collect()
    assert all(r.p == r.c for r in got if r.p) and any(r.p for r in got) and any(r.c is None for r in got)


def test_exclude_beats_include(spark):
    s = Settings(start_urls=("http://h/",), include=("x",), exclude=("x",), constraint="rules")
    df = urls.with_url(spark.createDataFrame([("http://h/x",)], "raw string"), "raw")
    assert df.select(F.expr(rules.scope_reason(s, "'page'", "0", "null")).alias("v")).first()["v"] == "excluded"


def test_robots(spark):
    body = "User-agent: *\nDisallow: /private\nAllow: /private/ok\nDisallow: /*.pdf$\n\nUser-agent: bot\nCrawl-delay: 2\nDisallow: /\n"
    lines = robots.directives(spark.createDataFrame([("o", body)], "origin string, body string"))
    cases = {"/private/x": False, "/private/ok/1": True, "/a.pdf": False, "/a.pdfx": True, "/a.pdf.pdf": True, "": True}
    targets = spark.createDataFrame([("o", t) for t in cases], "origin string, target string")
    got = {r.target: r.allowed for r in robots.allowed(targets, robots.rules(lines, "mozilla")).collect()}
    assert got == cases
    assert not robots.allowed(targets, robots.rules(lines, "Bot/1")).where("allowed").count()
    assert robots.rules(lines, "bot").first()["delay"] == 2.0
    missing = spark.createDataFrame([("p", "/x")], "origin string, target string")
    assert robots.allowed(missing, robots.rules(lines, "bot")).first()["allowed"]


def test_sitemap_index(spark):
    index = "<sitemapindex><sitemap><loc>http://h/2.xml</loc></sitemap></sitemapindex>"
    rows = [("http://h/1.xml", index), ("http://h/2.xml", "<urlset><url><loc>http://h/p</loc></url></urlset>"), ("http://h/3.txt", "http://h/q\nx")]
    stored = spark.createDataFrame(rows, "url string, body string")
    starts = spark.createDataFrame([("http://h/1.xml",), ("http://h/3.txt",)], "loc string")
    assert {r.loc for r in robots.sitemap_seeds(stored, starts).collect()} == {"http://h/p", "http://h/q"}


def test_paths(spark):
    s = Settings()
    rows = [("https://h/", "text/html", "h/index.html"), ("https://h/a", "text/html", "h/a.html"), ("https://h/a.php?x=1", "text/html", "h/a.php@x=1.html"), ("https://h/i.png", "image/png", "h/i.png"), ("https://h:8080/con", "", "h_8080/_con")]
    df = urls.with_url(spark.createDataFrame(rows, "raw string, media_type string, want string"), "raw")
    got = paths.with_path(df, s).select("path", "want").collect()
    assert [r.path for r in got] == [r.want for r in got]


def test_paths_stay_inside(spark):
    rows = [(f"https://h/{p}",) for p in ("%2e%2e/%2e%2e/x", "..%5c..%5cx", "a/%2F%2Fb", "%00", "con/aux.txt", "x" * 400, ". ./..")]
    df = urls.with_url(spark.createDataFrame(rows, "raw string"), "raw").withColumn("media_type", F.lit(""))
    got = [r.path for r in paths.with_path(df, Settings()).collect()]
    assert all(seg not in ("", ".", "..") and len(seg.encode()) <= 200 for p in got for seg in p.split("/"))


def test_collisions(spark):
    df = spark.createDataFrame([(1, "a.html"), (2, "a.html"), (3, "a~1.html"), (4, "a.html")], "key int, path string")
    got = {r.key: r.path for r in paths.disambiguated(df, "key", "key").collect()}
    assert got[1] == "a.html" and len(set(got.values())) == 4


@pytest.mark.parametrize(("a", "b", "want"), [("x/a.html", "x/b.html", "./b.html"), ("a/b/c.html", "d/e.html", "../../d/e.html"), ("a.html", "s/é #.css", "./s/%C3%A9%20%23.css"), ("h/a.html", "h/i/x.png", "./i/x.png")])
def test_relative_link(spark, a, b, want):
    assert one(spark, paths.relative_link("a", "b"), a=a, b=b) == want


def test_formats(spark):
    assert one(spark, formats.human_bytes("1280L")) == "1.2 KB"
    assert one(spark, formats.human_bytes("1792L")) == "1.8 KB"
    assert one(spark, formats.parse_bytes("s"), s="1.5 kb") == 1536
    assert one(spark, formats.parse_bytes("s"), s="x") is None
    assert one(spark, formats.parse_seconds("s"), s="2 min") == 120
    assert one(spark, formats.parse_seconds("s"), s="1h30m") == 5400
    assert one(spark, formats.short_duration("3720")) == "1h02m"


def test_settings():
    s = overlay({"exclude": ["a"], "max_levels": 2}, {"exclude": []}, {"hosts": ["h"]})
    assert s.exclude == () and s.max_levels == 2 and s.hosts == ("h",)
    with pytest.raises(ValueError, match="unknown"):
        overlay({"nope": 1})
    with pytest.raises(ValueError, match="constraint"):
        overlay({"constraint": "moon"})
    with pytest.raises(ValueError, match="lookaround"):
        portable("(?=x)")
    new = overlay({"exclude": ["b"], "constraint": "none"})
    assert difference(Settings(), new) == (["exclude"], ["constraint"])
    assert reconfigured(Settings(), new).exclude == ("b",) and reconfigured(Settings(), new).constraint == "host"
    assert glob("*/wp-admin/?") == "^.*/wp\\-admin/.$"


def test_start_urls_are_normalised_or_refused(spark):
    raw = ["example.com", " localhost:80/x ", "127.0.0.1", "h:8443", "h:8080/p", "a.local", "https://h/p?q", "", "  ", "ftp://h", "http:///p", "//h"]
    made = spark.createDataFrame([(i, x) for i, x in enumerate(raw)], "i int, raw string").orderBy("i").selectExpr(f"{urls.start_problem('raw')} as problem", f"{urls.started('raw')} as url").collect()
    for x, row in zip(raw, made, strict=True):
        if row.problem:
            with pytest.raises(ValueError, match=row.problem):
                Settings(start_urls=(x,)).normalized()
        else:
            assert Settings(start_urls=(x, x), max_levels=-1).normalized() == Settings(start_urls=(row.url,))
    assert [r.problem for r in made] == [None] * 7 + ["empty", "empty", "unsupported scheme", "no host", "no host"]
    with pytest.raises(ValueError, match="no start URL"):
        Settings().normalized()
