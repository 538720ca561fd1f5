"""Scanner, rewriting, audit, closure, journal, folds and streams."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.functions import urls
from tidemark.operators import closure, rewrite, scan, state
from tidemark.plans.config import Settings
from tidemark.sources import files
from tidemark.streaming import folds, live

PAGE = b"""<!doctype html><head><base href="/b/"><title> T &amp; x </title><meta charset=utf-8><meta http-equiv=refresh content="5; url='/next'">
<meta name=robots content="noindex, nofollow"><link rel=stylesheet href=s.css><link rel="preconnect dns-prefetch" href=//cdn/>
<style>@import "i.css"; /* url(no.png) */ a{background:url( 'bg.png' )} b{c:url(data:x)}</style></head>
<a href="/a?x=1&amp;y=2" rel=nofollow>A</a><img srcset="1.png 1x, 2.png 2x" src='i.png' style="background:url(st.png)">
<!-- <a href="old.html">o</a> --><script src=app.js>var x='<a href="no">';</script><iframe src=f.html></iframe><form action=/go></form>"""


def test_scan_values_and_offsets():
    doc = scan.scan_html(PAGE)
    assert [x[0] for x in doc["links"]] == ["/b/", "/next", "s.css", "i.css", "bg.png", "/a?x=1&y=2", "1.png", "2.png", "i.png", "st.png", "old.html", "app.js", "f.html", "/go"]
    assert (doc["base"], doc["charset"], doc["noindex"], doc["nofollow_all"], doc["title"]) == ("/b/", "utf-8", True, True, "T & x")
    for value, *_, start, end, _, _ in doc["links"]:
        assert PAGE[start:end].decode().replace("&amp;", "&").strip() == value


def test_the_scan_query_gives_every_kind_of_link(spark, tmp_path):
    from tidemark.plans.queries import QUERIES

    spark.createDataFrame([(1, "http://h/", PAGE.decode())], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = [(r.value, r.kind) for r in QUERIES["d01_scan_links"](spark, str(tmp_path)).collect()]
    assert got == [(x[0], x[1]) for x in scan.scan_html(PAGE)["links"]]


def test_titles_are_given_as_written(spark, tmp_path):
    import duckdb

    from tidemark.plans import queries, queries_more  # noqa: F401  adds its queries

    titles = ["a &amp; b", "cut&amp", "cut&am", "&amp;&", "x = &quot;y", "&nbsp;n", " \u3000 spaces\u00a0 ", "line\n", "", None]
    rows = [(i, "http://h/", "<meta charset=\"utf-8\">" * (i % 2) + ("<p>none" if t is None else f"<title>{t}</title><title>second</title>")) for i, t in enumerate(titles)]
    spark.createDataFrame([*rows, (99, "http://h/", None)], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.sql(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    for name in ("d03_meta_title", "d03_robots_meta"):
        got, want = queries.QUERIES[name](spark, str(tmp_path)), con.sql(queries.ORACLE[name])
        assert got.columns == want.columns
        assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())
    assert scan.scan_html(b"<title> </title><title>&lt;2</title>")["title"] == "<2"


def test_css():
    src = b"@import 'a.css'; .x{background:url(b.png)} /* url(c.png) */ .y{content:\"url(d.png)\"; src:URL( \"e.woff\" )} .z{f:url(#g)}"
    assert [x[0] for x in scan.css_links(src)] == ["a.css", "b.png", "e.woff"]


def test_hostile_bytes_keep_offsets_in_bounds():
    rng = random.Random(1)
    parts = [b"<a href=", b'"', b"'", b">", b"<!--", b"-->", b"<style>", b"url(", b"\xff\xfe", b"</", b"=", b"<meta ", b"srcset=", b",", b"\x00", b"<script", b" "]
    for _ in range(400):
        src = b"".join(rng.choice(parts) for _ in range(rng.randint(0, 60)))
        assert all(0 <= x[4] <= x[5] <= len(src) for x in scan.scan_html(src)["links"])


def test_splice_and_ranges():
    assert scan.apply_spans(b"abcdef", [(1, 2, b"XX"), (1, 4, b"no"), (4, 6, b"")]) == b"aXXcd"
    assert scan.element_ranges(b"x<script>1</script >y<SCRIPT a>2", "script") == [(1, 20), (21, 32)]


def test_rewrite_is_faithful_and_idempotent(spark):
    body = '<a href="/x">п</a><a href="/gone#t">g</a><img src="i.png">'.encode("cp1251")
    docs = spark.createDataFrame([(1, "http://h/d/p", "h/d/p.html", body)], "doc_id int, url string, path string, body binary")
    entries = spark.createDataFrame([("http://h/x", "h/x.html", "done"), ("http://h/d/i.png", "h/d/i.png", "done")], "key string, path string, status string")
    once = rewrite.rewritten(docs, entries, Settings())
    got = bytes(once.first()["body"])
    assert got == '<a href="../x.html">п</a><a href="http://h/gone#t">g</a><img src="./i.png">'.encode("cp1251")


def test_audit(spark):
    rows = [("p/a.html", v) for v in ("b.html", "c.html?x", "/abs", "http://h/x", "#f", "mailto:x", "gone.html", "//h/x", "tel:1")]
    got = rewrite.audited(spark.createDataFrame(rows, "doc_path string, value string"), spark.createDataFrame([("p/b.html",)], "path string"))
    assert {r.value: r["class"] for r in got.collect()} == {"b.html": "ok", "c.html?x": "query_left", "/abs": "site_absolute", "http://h/x": "remote", "gone.html": "missing", "//h/x": "site_absolute", "tel:1": "missing"}


def test_closure_reaches_every_branch_but_the_blocked_one(spark):
    chain = [(f"/p{i}", f"/p{i + 1}", True) for i in range(14)]
    extra = [("/p14", "/frame", True), ("/frame", "/meta", True), ("/p14", "/a.css", False), ("/a.css", "/b.css", False), ("/b.css", "/c.png", False), ("/p3", "http://other/1", True), ("http://other/1", "http://other/2", True), ("/p5", "http://blocked/x", True), ("http://blocked/x", "/never", True), ("/p2", "/p0", True)]
    edges = spark.createDataFrame(chain + extra, "src string, dst string, page boolean")
    got = {r.key: (r.depth, r.status) for r in closure.closure(spark.createDataFrame([("/p0",)], "key string"), edges, ~F.col("dst").startswith("http://blocked")).collect()}
    assert got["/p14"] == (14, "done") and got["/c.png"] == (14, "done") and got["/meta"] == (16, "done") and got["http://other/2"] == (5, "done")
    assert got["http://blocked/x"] == (6, "skipped") and "/never" not in got and got["/p0"] == (0, "done")


def test_claims_are_exactly_once(spark):
    rows = [(f"a{j}", 1, i * 24 + j) for i in range(24) for j in range(24)]
    got = closure.claimed(spark.createDataFrame(rows, "key string, depth int, seq int"), spark.createDataFrame([("a0",)], "key string"))
    assert sorted((r.key, r.seq) for r in got.collect()) == sorted((f"a{j}", j) for j in range(1, 24))


def test_journal_replay(spark, tmp_path):
    (tmp_path / "j.jsonl").write_text('{"k":"a","u":"http://a","s":"active","d":1}\n\nnot json\n{"u":"no key"}\n{"k":"a","u":"http://a","s":"done","p":"a.html","sz":5}\n')
    j = state.read_journal(spark, str(tmp_path / "j.jsonl"))
    assert j.count() == 2 and [r.status for r in j.orderBy("seq").collect()] == ["pending", "done"]
    e = state.latest(j).first()
    assert (e.status, e.path, e["size"], e.depth, e.localized) == ("done", "a.html", 5, 0, False)
    state.compact(j, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1


def test_empty_tables(spark):
    empty = spark.createDataFrame([], state.JOURNAL)
    assert state.statistics(state.latest(empty)).first()["total"] == 0
    assert state.error_buckets(empty).count() == 0
    edges = spark.createDataFrame([], "src string, dst string, page boolean")
    assert closure.closure(spark.createDataFrame([("x",)], "key string"), edges).count() == 1
    assert urls.with_url(spark.createDataFrame([], "raw string"), "raw").count() == 0


def test_host_health_batch_and_stream_agree(spark, tmp_path):
    rows = [("a", 1, False), ("a", 2, False), ("b", 3, True), ("b", 4, False), ("b", 5, False), ("c", 6, False)]
    df = spark.createDataFrame(rows, "host string, seq int, ok boolean")
    assert {r.host for r in folds.host_health(df).where("dead").collect()} == {"a"}
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = live.host_health(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")))
    got = {(r.host, r.successes, r.failures, r.dead) for r in live.drained(stream, "health_test").collect()}
    assert got == {(r.host, r.successes, r.failures, r.dead) for r in folds.host_health_final(df).collect()}


def test_outage_needs_three_in_a_row(spark):
    rows = [("g", i, f"2024-01-01 00:00:0{i}", ok) for i, ok in enumerate([False, False, True, False, False, False, False, True])]
    df = spark.createDataFrame(rows, "k string, seq int, ts string, ok boolean").withColumn("ts", F.col("ts").cast("timestamp"))
    got = folds.outages(df, "k").collect()
    assert [(r.since.second, r.until.second, r.failures) for r in got] == [(5, 7, 4)]
    assert folds.outage_totals(folds.outages(df, "k"), "k").first()["downtime_s"] == 2.0


def test_pacing_and_rates(spark):
    df = spark.createDataFrame([("h", i, i in (0, 1)) for i in range(42)], "host string, seq int, throttled boolean")
    got = {r.seq: (r.conns, r.delay) for r in folds.pacing(df).collect()}
    assert got[0] == (4, 0.5) and got[1] == (2, 1.0) and got[21] == (3, 0.5) and got[41] == (4, 0.25)
    t = spark.createDataFrame([("h", i, i * 10, i * 50) for i in range(30)], "k string, seq int, s int, total int").withColumn("ts", F.timestamp_seconds("s"))
    want = 0.0
    for _ in range(29):
        want += (1 - 2 ** (-10 / 10)) * (5 - want)
    assert abs(folds.decayed_rate(t, "k", "ts", "total", 10.0).first()["rate"] - want) < 1e-9


def test_cookies(spark, tmp_path):
    (tmp_path / "c.txt").write_text("# note\n.h.example\tTRUE\t/\tTRUE\t0\ta\t1\n#HttpOnly_h.example\tFALSE\t/\tTRUE\t99\tb\t2\nh.example\tFALSE\t/\tFALSE\t1\told\tx\n")
    assert [(r.origin, r.cookies) for r in files.cookies(spark, str(tmp_path / "c.txt"), now=50).collect()] == [("https://h.example", "a=1; b=2")]


def test_script_driven(spark):
    cases = [("<div id=root></div><script src=x></script>", True), ("<p>" + "word " * 80 + "</p><script>1</script>", False), ("<p>short</p>", False), ("<p>short</p><script>1</script>", True)]
    got = spark.createDataFrame(cases, "body string, want boolean").selectExpr(f"{scan.script_driven('body')} as got", "want").collect()
    assert [r.got for r in got] == [r.want for r in got]


def walked(seeds, edges, most):
    """One queue by (depth, turn); the first link to a key claims it."""
    import heapq

    out = {k: (0, "done") for k in seeds}
    queue = [(0, n, k) for n, k in enumerate(sorted(seeds))]
    turn = len(queue)
    while queue:
        depth, _, key = heapq.heappop(queue)
        for _, _, dst, page, ok in sorted(e for e in edges if e[0] == key):
            if dst not in out:
                at = depth + page
                ok = ok and at <= most
                out[dst] = at, "done" if ok else "skipped"
                if ok:
                    turn += 1
                    heapq.heappush(queue, (at, turn, dst))
    return out


@pytest.mark.parametrize("one_task", [0, 200_000])
def test_closure_takes_keys_in_turn(spark, monkeypatch, one_task):
    monkeypatch.setattr(closure, "EDGES_ONE_TASK", one_task)
    schema = "src string, seq int, dst string, page boolean, ok boolean"
    run = lambda seeds, edges, most: {r.key: (r.depth, r.status) for r in closure.closure(spark.createDataFrame([(k,) for k in seeds], "key string"), spark.createDataFrame(edges, schema), F.col("ok"), most).collect()}
    chain = [("P", 1, "A", True, True), ("A", 1, "X", True, True), ("P", 2, "a", False, True), ("a", 1, "b", False, True), ("b", 1, "X", True, True)]
    assert run(["P"], chain, 1) == walked(["P"], chain, 1) and run(["P"], chain, 1)["X"] == (1, "done")
    denied_first = [("P", 1, "Q", True, False), ("P", 2, "Q", False, True), ("P", 3, "R", True, True), ("R", 1, "Q", False, True)]
    assert run(["P"], denied_first, 9) == {"P": (0, "done"), "Q": (1, "skipped"), "R": (1, "done")}
    rng = random.Random(1 + one_task)
    edges = [(f"k{rng.randrange(40)}", rng.randrange(9), f"k{rng.randrange(40)}", rng.random() < 0.5, rng.random() < 0.8) for _ in range(110)]
    assert run(["k0", "k1"], edges, 3) == walked(["k0", "k1"], edges, 3)


def test_transport_errors(spark):
    from tidemark.operators import rules

    texts = {"net/http: TLS handshake timeout": True, "read tcp 1.2.3.4:80: connection reset by peer": True, "context deadline exceeded": True, "no such host": True, "404 not found": False, "context canceled": False, None: False}
    got = spark.createDataFrame([(t,) for t in texts], "e string").selectExpr("e", f"{rules.transport_error('e')} as t").collect()
    assert {r.e: r.t for r in got} == texts


def test_declarative_links_are_not_fetched(spark):
    html = "<link rel='next' href=n><link rel='webmention nofollow' href=w><link rel='canonical stylesheet' href=c><link rel=x rel=pingback href=p><link rel=prev href=v>"
    df = spark.createDataFrame([(html,)], "html string")
    row = scan.scanned(df, "html").first()
    assert [x.value for x in row.links] == ["n", "c", "v"]


def test_one_gate_for_a_job(spark):
    """Failures of several trusted hosts add up; unknown hosts don't count; probes end an outage."""
    rows = [(0, "a", True), (1, "x", False), (2, "x", False), (3, "x", False), (4, "a", False), (5, "b", False), (6, "a", False), (8, "a", False), (9, "x", True), (20, "a", True), (21, "a", False)]
    df = spark.createDataFrame([("j", n, t, h, ok) for n, (t, h, ok) in enumerate(rows)], "job string, seq int, t int, host string, ok boolean").withColumn("ts", F.timestamp_seconds("t"))
    tried = folds.trusted(df, ["b"]).drop("t")
    got = {r.seq: (r.state, r.streak, r.outages, r.downtime_s) for r in folds.gate(tried, "job").collect()}
    # Down from 6; probes at 8, 12, 20, ...; the network answers at 9, so the probe at 12 ends it.
    assert got[5][0] == "online" and got[6] == ("offline", 3, 1, 0.0) and got[8] == ("offline", 0, 1, 0.0) and got[9] == ("online", 0, 1, 6.0) and got[10] == ("online", 1, 1, 6.0)


def test_a_cluster_has_to_name_its_scratch_folder():
    from types import SimpleNamespace

    from tidemark.runtime import scratch

    conf = {}
    session = lambda master: SimpleNamespace(conf=SimpleNamespace(get=lambda k, d: conf.get(k, d), set=conf.__setitem__), sparkContext=SimpleNamespace(master=master))
    for master in ("spark://h:7077", "yarn", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError):
            scratch(session(master))
    assert scratch(session("local[2]")).startswith("file://")
    conf["spark.checkpoint.dir"] = "hdfs://h/x/"
    assert scratch(session("yarn")) == "hdfs://h/x"


@pytest.mark.parametrize("slot", [3, 4096])
def test_schedules_against_one_by_one(spark, monkeypatch, slot):
    monkeypatch.setattr(folds, "SLOT", slot)
    rng = random.Random(5)
    rows = [(rng.choice(["a", "a", "b", None]), i, rng.randint(0, 400)) for i in range(60)]
    df = spark.createDataFrame(rows, "host string, seq long, at long").selectExpr("host", "seq", "timestamp_seconds(at) as ts")
    want, last = {}, {}
    for host, i, at in rows:
        want[i] = last[host] = max(at, last[host] + 10) if host in last else at
    got = folds.schedule(df, "host", "seq", "ts", 10.0).collect()
    assert {r.seq: round(r.start, 6) for r in got} == want and len(got) == 60
    assert folds.schedule(df.limit(0), "host", "seq", "ts", 10.0).count() == 0
