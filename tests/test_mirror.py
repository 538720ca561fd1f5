"""A site as a table of responses, crawled, rewritten and checked end to end."""

from tidemark.plans.config import Settings
from tidemark.plans.mirror import Mirror

SITE = {
    "http://site/": ("text/html", "<a href='/a.html?s=1'>a</a><link rel=stylesheet href=/s.css><a href=/gone>g</a><a href=http://other/x>o</a><a href=/private/p>p</a>"),
    "http://site/a.html": ("text/html", "<a href='/b/'>b</a><img src=i.png><img src=http://cdn.site/c.png>"),
    "http://site/b/": ("text/html", "<base href=/b/sub/><a href=../>self</a><a href=/x/x/x/x/x>trap</a>"),
    "http://site/s.css": ("text/css", "@import 't.css'; a{b:url(/bg.png)}"),
    "http://site/t.css": ("text/css", "a{c:url(deep.png)}"),
    "http://site/i.png": ("image/png", "i"),
    "http://site/bg.png": ("image/png", "b"),
    "http://site/deep.png": ("image/png", "d"),
    "http://cdn.site/c.png": ("image/png", "c"),
    "http://site/private/p": ("text/html", "secret"),
    "http://other/x": ("text/html", "elsewhere"),
}


def test_crawl_rewrite_check(spark):
    rows = [(u, 200, m, b.encode()) for u, (m, b) in SITE.items()]
    responses = spark.createDataFrame(rows, "url string, status int, media_type string, body binary")
    robots = spark.createDataFrame([("http://site", "User-agent: *\nDisallow: /private")], "origin string, body string")
    settings = Settings(start_urls=("http://site/",), drop_query_params=("s",), asset_hosts=("cdn.site",), user_agent="mozilla")
    m = Mirror(spark, settings, responses, robots)
    entries = m.crawl().cache()
    got = {r.key: (r.status, r.depth, r.reason) for r in entries.collect()}
    done = {k for k, v in got.items() if v[0] == "done"}
    assert {"http://site/", "http://site/b/", "http://site/s.css", "http://site/t.css", "http://site/bg.png", "http://site/deep.png", "http://cdn.site/c.png"} <= done
    assert got["http://other/x"][0] == "skipped" and got["http://other/x"][2] == "outside_host"
    assert got["http://site/private/p"][2] == "robots" and got["http://site/gone"][0] == "failed"
    assert got["http://site/x/x/x/x/x"][2] == "repeated_segment"
    assert m.status(entries).first()["verdict"] == "done"
    pages = m.localize(entries)
    home = bytes(pages.where("url = 'http://site/'").first()["body"]).decode()
    assert "./s.css" in home and "href=http://other/x" in home and "/gone" in home
    sheet = bytes(pages.where("url = 'http://site/s.css'").first()["body"]).decode()
    assert sheet == "@import './t.css'; a{b:url(./bg.png)}"
    mirror = pages.select("path", "body").unionByName(entries.where("status = 'done' and path not like '%.html'").selectExpr("path", "cast('' as binary) as body"))
    classes = {r["class"] for r in m.check(mirror).where("doc_path = 'site/index.html'").collect()}
    assert classes <= {"ok", "remote"} and m.entries(entries, "done", "css").count() == 2
    assert m.retry({"max_levels": 1}).settings.max_levels == 1
