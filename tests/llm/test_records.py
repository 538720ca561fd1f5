"""WARC fixity, quotations, and the pipeline as a whole."""

import os
import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tidemark.llm import bpe, quotes, warc
from tidemark.llm import queries as llm_queries

SF = "/root/testdata/sf0.001"


def pages(spark, n):
    return spark.createDataFrame([(i, f"http://h/{i}", f"<p>{i}é</p>" * (i % 7)) for i in range(n)], "page_id long, url string, html string")


@pytest.mark.parametrize("n", [1, 63, 64, 65, 5000])
def test_only_damaged_records_are_found(spark, n):
    ours = warc.manifest(pages(spark, n))
    rows = ours.orderBy("position").collect()
    assert [r.page_id for r in rows] == list(range(n)) and [r.offset for r in rows] == [sum(x.length for x in rows[:i]) for i in range(n)][: len(rows)] if n < 100 else True
    bad = {0, n - 1, n // 2}
    theirs = ours.withColumn("sha256", F.when(F.col("position").isin(*bad), F.md5("sha256")).otherwise(F.col("sha256")))
    a, b = warc.tree(ours), warc.tree(theirs)
    assert a.where(a.level == a.agg(F.max("level")).first()[0]).count() == 1
    assert {r.node for r in warc.audit(a, b).where("level = 0").collect()} == bad
    assert warc.audit(a, a).count() == 0


def test_lost_records_and_empty_archives(spark):
    ours = warc.manifest(pages(spark, 70))
    short = ours.where("position < 69")
    assert {r.node for r in warc.audit(warc.tree(ours), warc.tree(short)).where("level = 0").collect()} == {69}
    none = warc.manifest(pages(spark, 3).limit(0))
    assert none.count() == 0 and warc.tree(none).count() == 0 and warc.audit(warc.tree(none), warc.tree(none)).count() == 0
    odd = spark.createDataFrame([(None, None, None), (1, "u", None), (1, "u", None)], "page_id long, url string, html string")
    assert warc.manifest(odd).count() == 3


def test_records_survive_a_round_trip(spark, tmp_path):
    rows = warc.write_segments(pages(spark, 20).coalesce(2)).collect()
    for segment in {r.segment for r in rows}:
        (tmp_path / f"{segment}.warc.gz").write_bytes(b"".join(bytes(r.member) for r in rows if r.segment == segment))
    back = {r.url: bytes(r.body).decode() for r in warc.read_warc(spark, str(tmp_path)).collect()}
    assert back == {r.url: r.html for r in pages(spark, 20).collect()}
    assert warc.parse(b"") == [] and warc.parse(b"junk WARC/1.1\r\n") == []


def test_payloads_that_look_like_records(spark, tmp_path):
    import gzip

    head = "WARC/1.1\r\nWARC-Type: response\r\nWARC-Target-URI: {}\r\nWARC-Record-ID: <{}>\r\nContent-Length: {}\r\n\r\n"
    bodies = {"plain": [b"a", b"", b"\xff\xfe" * 50_000, b"x\r\n\r\n"], "trap": [b"before\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\nabc", b"after"], "empty": []}
    for name, each in bodies.items():
        raw = [head.format(f"http://{name}/{i}", i, len(b)).encode() + b + b"\r\n\r\n" for i, b in enumerate(each)]
        (tmp_path / f"{name}.warc").write_bytes(b"".join(raw))
        (tmp_path / f"{name}2.warc.gz").write_bytes(b"".join(map(gzip.compress, raw)))
    got = sorted((os.path.basename(r.path), r.record_id, r.url, bytes(r.body)) for r in warc.read_warc(spark, str(tmp_path)).collect())
    assert got == sorted((f"{name}{kind}", f"<{i}>", f"http://{name}/{i}", b) for name, each in bodies.items() for i, b in enumerate(each) for kind in (".warc", "2.warc.gz"))


def test_a_replica_is_audited_by_its_bytes(spark, tmp_path):
    """Both replicas go through written archives; the audit finds the records that were cut."""
    from tidemark.llm.warc import flipped

    src = pages(spark, 3000)
    theirs = src.withColumn("html", flipped(F.col("html")))
    want = {r.page_id for r in src.where(flipped(F.col("html")) != F.col("html")).collect()}
    roots = []
    for name, frame in (("ours", src), ("theirs", theirs)):
        (tmp_path / name).mkdir()
        for r in warc.write_segments(frame.coalesce(2)).collect():
            with open(tmp_path / name / f"{r.segment}.warc.gz", "ab") as f:
                f.write(bytes(r.member))
        back = warc.read_warc(spark, str(tmp_path / name)).select(F.regexp_extract("url", "([0-9]+)$", 1).cast("long").alias("page_id"), "url", F.col("body").cast("string").alias("html"))
        roots.append(warc.tree(warc.manifest(back)))
    assert want and {r.node for r in warc.audit(*roots).where("level = 0").collect()} == want


TALK = [
    (1, 0, "Hello  there world.\nHow are you?"), (1, 1, "> how are you?\nFine, thanks."), (1, 2, "> > How are you?\n> fine, thanks.\nGood."),
    (1, 3, "> hello there WORLD.\nreply to first"), (2, 0, ">fine, thanks.\nme too"), (2, 1, "> nobody said this\nok"), (2, 2, "more"), (None, 0, "x"), (3, None, None), (4, 0, ">"),
]


def test_quotes_link_to_their_sources(spark):
    df = spark.createDataFrame([(c, t, "user", x, "kept") for c, t, x in TALK], "conv_id long, turn long, role string, text string, thread string")
    got = {(r.conv_id, r.turn): r for r in quotes.link(df).collect()}
    assert len(got) == len(TALK)
    links = {k: (r.reply_conv, r.reply_turn, r.quoted) for k, r in got.items()}
    assert links == {
        (1, 0): (None, None, False), (1, 1): (1, 0, True), (1, 2): (1, 1, True), (1, 3): (1, 0, True), (2, 0): (1, 1, True), (2, 1): (2, 0, False),
        (2, 2): (2, 1, False), (None, 0): (None, None, False), (3, None): (None, None, False), (4, 0): (None, None, False),
    }
    assert got[1, 2].body == "Good." and got[1, 2].n_quotes == 2 and got[1, 2].max_level == 2 and got[4, 0].body == ""
    assert all(not re.search(r"^\s*>", r.body, re.M) for r in got.values())
    assert quotes.link(df.limit(0)).count() == 0
    order = [(r.conv_id, r.thread, r.turn) for r in quotes.reply_order(quotes.link(df)).where("conv_id = 1").collect()]
    assert order == sorted(order)


def test_whole_passages_before_single_lines(spark):
    talk = [
        (1, 0, "First point.\nSecond point.\nThanks."), (1, 1, "Thanks."), (1, 2, "Second point.\nThanks."), (1, 3, "> first point.\n> second point.\n>\n> thanks."),
        (2, 0, "Thanks."), (2, 1, "> first point.\n> second point.\n> thanks.\nyes"), (2, 2, "> first point.\n> another point.\n> thanks."),
        (3, 0, "> first point.\n> second point.\n> something else.\nyes"), (3, 1, "> nobody\n> thanks.\nno"), (3, 2, "Thanks.\nOdd.\nSecond point."), (3, 3, "> second point.\n> thanks.\n> what"),
        (4, 0, "> thanks.\n> > first point.\n> > second point.\nok"),
    ]
    df = spark.createDataFrame(talk, "conv_id long, turn long, text string")
    got = {(r.conv_id, r.turn): (r.reply_conv, r.reply_turn) for r in quotes.link(df).where("quoted").collect()}
    assert got == {(1, 3): (1, 0), (2, 1): (1, 0), (2, 2): (1, 0), (3, 0): (1, 0), (3, 3): (3, 2), (4, 0): (1, 0)}


def test_own_conversation_hides_no_other_source(spark):
    talk = [(1, 0, "> Same line.\n> more\nyes"), (1, 1, "Same line.\nmore"), (1, 2, "> two\n> three\n> none"), (1, 3, "two\nthree"), (2, 0, "same line.\nMore"), (2, 1, "Three\nTwo"), (3, 0, "> same line.\n> more"), (5, 0, "> only here"), (5, 1, "only here")]
    df = spark.createDataFrame(talk, "conv_id long, turn long, text string")
    got = {(r.conv_id, r.turn): (r.reply_conv, r.reply_turn) for r in quotes.link(df).where("quoted").collect()}
    assert got == {(1, 0): (2, 0), (1, 2): (2, 1), (3, 0): (1, 1)}


def brute_sources(talk):
    """By conversation and turn, what the first traceable passage of each message was quoted from."""
    own = {(c, t): [x.lower() for x in text.split("\n") if not x.startswith(">")] for c, t, text in talk}
    out = {}
    for c, t, text in talk:
        asked = [x.lstrip("> ").lower() for x in text.split("\n") if x.startswith(">")]
        if not asked:
            continue
        has = {k: any(v[i : i + len(asked)] == asked for i in range(len(v))) for k, v in own.items()}
        n = {k: len(set(v) & set(asked)) for k, v in own.items()}
        can = [k for k in own if k[0] != c or k[1] < t]
        for good, rank in ((lambda k: has[k], lambda k: 0), (lambda k: 2 * n[k] > len(set(asked)), n.get)):
            if found := [k for k in can if good(k)]:
                out[c, t] = min(found, key=lambda k: (-rank(k), k[0] != c, -k[1] if k[0] == c else k))
                break
    return out


def test_sources_against_brute_force(spark):
    rng, talk = random.Random(11), []
    for c in range(30):
        for t in range(rng.randint(1, 8)):
            asked = [rng.choice("abcdefgh") for _ in range(rng.randint(0, 4))]
            talk.append((c, t, "\n".join([f"> {x}" for x in asked] + [rng.choice("abcdefgh").upper() for _ in range(rng.randint(1, 4))])))
    got = {(r.conv_id, r.turn): (r.reply_conv, r.reply_turn) for r in quotes.link(spark.createDataFrame(talk, "conv_id long, turn long, text string")).where("quoted").collect()}
    assert got == brute_sources(talk)


def test_reply_order_walks_the_tree(spark):
    rng, talk, want = random.Random(5), [(1, 1, "aa"), (1, 2, "bb"), (1, 3, "> aa\ncc"), (1, 4, "> bb\ndd")], {1: [1, 2, 4, 3]}
    for c in range(2, 12):
        under, n = {}, 1 if c == 2 else rng.randint(2, 40)
        for t in range(n):
            to = rng.choice([None, rng.randrange(t)]) if t and c < 11 else t - 1 if t else None
            talk.append((c, t, (f"> say {c} {to}\n" if to is not None else "") + f"say {c} {t}"))
            under.setdefault((t - 1 if t else None) if to is None else to, []).append(t)
        want[c], todo = [], under[None][::-1]
        while todo:
            want[c].append(todo.pop())
            todo += under.get(want[c][-1], [])[::-1]
    df = spark.createDataFrame([*talk, (1, None, "x"), (None, 3, "x")], "conv_id long, turn long, text string").repartition(3)
    got = [(r.conv_id, r.turn) for r in quotes.reply_order(quotes.link(df)).collect()]
    assert got == [(None, 3), (1, None), *((c, t) for c in sorted(want) for t in want[c])]


def random_talk(seed):
    rng, talk = random.Random(seed), []
    for c in range(25):
        for t in range(rng.randint(1, 7)):
            asked = [f"{rng.choice(('> ', '> ', '>> '))}{rng.choice('abcdefgh')}" for _ in range(rng.randint(0, 5))]
            talk.append((c, t, "\n".join(asked + [rng.choice("abcdefgh").upper() for _ in range(rng.randint(0, 4))])))
    return talk


@pytest.mark.parametrize("talk", [TALK, random_talk(1), random_talk(2)], ids=["fixed", "random1", "random2"])
def test_the_sql_says_the_same(spark, talk):
    con = duckdb.connect()
    con.sql("create table conversations(conv_id bigint, turn bigint, role varchar, text varchar)")
    con.executemany("insert into conversations values (?, ?, 'user', ?)", talk)
    df = spark.createDataFrame([(c, t, "user", x) for c, t, x in talk], "conv_id long, turn long, role string, text string")
    for made, sql in ((df, quotes.OP9_SQL), (quotes.requoted(df), quotes.REQUOTED_SQL)):
        want = con.sql(sql)
        got = quotes.link(made).select(*want.columns)
        assert sorted(repr(tuple(r)) for r in got.collect()) == sorted(map(repr, want.fetchall()))


def test_long_conversations_and_small_slots_agree(spark, monkeypatch):
    rng, talk = random.Random(9), []
    for c, n in ((0, 150), (1, 3), (2, 40), (3, 1)):
        for t in range(n):
            to = rng.choice([None, 0, rng.randrange(t), max(t - 2, 0)]) if t else None
            talk.append((c, 3 * t, (f"> say {c} {to}\n" if to is not None else "") + f"say {c} {t}"))
    talk += [(2, 6, "again"), (2, 6, "again"), (2, 9, "> say 2 1\nonce more")]
    df = spark.createDataFrame(talk, "conv_id long, turn long, text string")
    read = lambda: [(r.conv_id, r.turn, r.body, r.reply_turn, r.thread) for r in quotes.reply_order(quotes.link(df)).collect()]
    plain = read()
    monkeypatch.setattr(quotes, "SLOT", 4)
    assert len(plain) == len(talk) and [x[:2] + x[3:] for x in read()] == [x[:2] + x[3:] for x in plain]
    assert {x[3] for x in plain if x[:2] == (2, 6) and x[2] == "again"} == {3}


def test_requoted_conversations_link(spark):
    got = quotes.requoted_replies(spark, "/root/testdata/sf0.001").where("quoted").collect()
    assert any(r.reply_conv != r.conv_id for r in got) and any(r.reply_turn == r.turn - 2 for r in got) and any(r.max_level == 2 for r in got)


def test_a_passage_everyone_says_links_once(spark):
    rows = [(c, 0, "Same line.") for c in range(300)] + [(500, 0, "> same line.\nyes")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, text string")
    got = quotes.link(df).where("quoted").collect()
    assert [(r.conv_id, r.reply_conv, r.reply_turn) for r in got] == [(500, 0, 0)]


def test_pipeline_against_brute_force(spark):
    import corpus_pipeline

    words = [f"wo{i}rd" for i in range(400)]
    rng = random.Random(2)
    made = [" ".join(rng.choice(words) for _ in range(70)) for _ in range(41)]
    prose = made.__getitem__
    texts = [prose(k) for k in range(30)] + [prose(3), prose(4) + " tail", "short", None, prose(40) + " token = \"" + "0a" * 20 + "\""]
    df = spark.createDataFrame([(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    stages = dict(corpus_pipeline.STAGES)
    kept = stages["quality_rules"](spark, df, "")
    assert {r.doc_id for r in kept.collect()} == set(range(len(texts))) - {32, 33}
    unique = stages["near_duplicates"](spark, kept, "")
    assert {r.doc_id for r in unique.collect()} == set(range(len(texts))) - {30, 31, 32, 33}
    clean = stages["secret_scan"](spark, unique, "")
    assert "[SECRET]" in clean.where("doc_id = 34").first()["text"] and clean.count() == unique.count()
    mixed = stages["source_mix"](spark, clean, "")
    assert mixed.columns == df.columns and set(r.doc_id for r in mixed.collect()) <= {r.doc_id for r in clean.collect()}
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(bpe.default_path())
    by_id = {r.doc_id: r.text for r in clean.collect()}
    for r in stages["tokens"](spark, mixed, "").collect():
        assert r.ids == tokenizer.encode(by_id[r.doc_id], add_special_tokens=False).ids
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, df.limit(0), "").count() == 0, name


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", list(llm_queries.ORACLE))
def test_query_agrees_with_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings", "conversations"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got, want = entry.queries()[name](spark, SF), con.sql(entry.oracle_sql()[name])
    order = [want.columns.index(c) for c in got.columns]
    assert sorted(repr(tuple(r)) for r in got.collect()) == sorted(repr(tuple(r[i] for i in order)) for r in want.fetchall())
