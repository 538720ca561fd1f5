"""Columns with clashing names, very long texts and hot ids, through every operator and stage."""

import random

import pytest

import corpus_pipeline
from tidemark.llm import bpe, minhash, mixing, pii, quality, quotes, secret_links, suffix_dedup, warc
from tidemark.llm.subspace import near_vectors

#: Names that plans use for columns of their own.
NAMES = ("_row", "_once", "_body", "_words", "_h", "_slice", "_at", "_hit", "_new", "_sha", "_conv", "_turn", "_c", "_left", "x", "y", "b", "own", "class", "weight", "n", "places", "row", "same", "doc", "base_ref")
WORDS = [f"wo{i}rd" for i in range(300)]


def prose(seed, n=80):
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) for _ in range(n))


def clashing(df):
    return df.selectExpr("*", *[f"concat('{n}', doc_id) as `{n}`" for n in NAMES])


@pytest.fixture(scope="module")
def docs(spark):
    texts = [prose(k) for k in range(6)] + [prose(0), None, "", prose(7) + ' token = "' + "0a" * 20 + '"']
    rows = [(i, t, "en", f"s{i % 2}", len(t or "")) for i, t in enumerate(texts)]
    return clashing(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"))


def carried(out, names=NAMES):
    rows = out.collect()
    assert len(out.columns) == len(set(out.columns)) and set(names) <= set(out.columns)
    assert all(r[n] == f"{n}{r['doc_id']}" for r in rows for n in names)
    return rows


OPERATORS = {
    "mix": mixing.mix,
    "mixed_documents": mixing.mixed_documents,
    "scan": secret_links.scan,
    "redact": secret_links.redact,
    "remove_repeats": suffix_dedup.remove_repeats,
    "deduplicate": minhash.deduplicate,
    "encode_decode": lambda df: bpe.encode_decode(df, bpe.default_path()),
    "pseudonymise": lambda df: pii.pseudonymise(df, "key"),
    "ledger": quality.ledger,
    "apply_policy": lambda df: quality.apply_policy(quality.ledger(df), quality.BASE),
    "replies": lambda df: quotes.reply_order(quotes.link(df.withColumn("turn", df.doc_id), "source", "turn"), "source", "turn"),
}


@pytest.mark.parametrize("name", list(OPERATORS))
def test_columns_with_clashing_names_are_carried(docs, name):
    rows = carried(OPERATORS[name](docs))
    assert len(rows) == docs.count() or name in ("mixed_documents", "deduplicate", "apply_policy")
    assert OPERATORS[name](docs.limit(0)).count() == 0


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES[:-1]])
def test_stages_return_the_columns_they_get(docs, name):
    df = docs.withColumn("n_words", docs.doc_id * 0 - 1).withColumn("failed", docs.lang).withColumn("base", docs.lang).withColumn("size", docs.lang)
    out = dict(corpus_pipeline.STAGES)[name](docs.sparkSession, df, "")
    assert out.columns == df.columns
    assert {(r.n_words, r.failed, r.base, r["size"]) for r in carried(out)} == {(-1, "en", "en", "en")}


def test_very_long_texts_are_handled_whole(spark):
    long = "\n".join(prose(k, 200) for k in range(700))
    texts = [long, long + " end", prose(1000), None]
    df = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], "doc_id long, text string, source string")
    words = len(long.split())
    assert len(long) > 900_000
    assert {r.doc_id: r["size"] for r in mixing.mix(df).collect()} == {0: words, 1: words + 1, 2: 80, 3: 0}
    assert [r.n_words for r in quality.ledger(df).orderBy("doc_id").collect()] == [words, words + 1, 80, 0]
    groups = {r.doc_id: r.component_id for r in minhash.near_duplicates(df, 5).collect()}
    assert groups == {0: 0, 1: 0, 2: 2, 3: 3}
    cut = {r.doc_id: (r.n_bytes, r.n_removed) for r in suffix_dedup.remove_repeats(df).collect()}
    assert cut[0] == (len(long), len(long)) and cut[1] == (len(long) + 4, len(long)) and cut[2][1] == cut[3][1] == 0
    coded = bpe.encode_decode(df, bpe.default_path()).collect()
    from tokenizers import Tokenizer

    assert next(r.ids for r in coded if r.doc_id == 0) == Tokenizer.from_file(bpe.default_path()).encode(long, add_special_tokens=False).ids
    dated = df.where("doc_id < 2").selectExpr("doc_id", "concat(text, ' on 2024-05-01') as text")
    assert {r.n_date for r in pii.pseudonymise(dated, "key").collect()} == {1}
    hidden = df.where("doc_id = 0").selectExpr("doc_id", "concat(text, ' token=abcdefgh1') as text")
    assert secret_links.redact(hidden).first().text == long + " [SECRET]"
    talk = spark.createDataFrame([(1, 0, long), (1, 1, "yes"), (1, 2, "> " + long.replace("\n", "\n> "))], "conv_id long, turn long, text string")
    assert [(r.quoted, r.reply_turn) for r in quotes.link(talk).orderBy("turn").collect()] == [(False, None), (False, 0), (True, 0)]
    pages = spark.createDataFrame([(1, "u", long)], "page_id long, url string, html string")
    assert warc.manifest(pages).count() == 1


def test_one_id_on_very_many_rows_is_spread(spark, monkeypatch):
    monkeypatch.setattr(mixing, "SLICE_ROWS", 2)
    df = spark.range(400).selectExpr("cast(null as bigint) as doc_id", "concat('a b ', id) as text", "'s' as source")
    rows = mixing.mix(df).collect()
    assert sum(r.taken for r in rows) == 1200 and len({r.position for r in rows}) == 400


def test_classes_of_equal_weight_keep_their_schedules(spark):
    df = spark.range(300).selectExpr("id as doc_id", "repeat('w ', 10) as text", "concat('s', id % 3) as source")
    rows = mixing.mix(df, weights=[1, 1, 2], schedules=((2.0, 0.0), (0.0, 2.0), (1.0, 1.0))).collect()
    at = {s: [r.position for r in rows if r.source == s and r.taken] for s in ("s0", "s1")}
    mean = {s: sum(p) / len(p) for s, p in at.items()}
    assert mean["s0"] < 0.4 < 0.6 < mean["s1"]


def test_very_many_words_do_not_overflow(spark):
    totals = spark.range(1000).selectExpr("lpad(id, 4, '0') as source", "1000000000000000 + id as source_size")
    rows = mixing.targets(totals, [1, 10**6]).collect()
    assert all(0 < r.target <= 3.0 * r.source_size for r in rows) and abs(sum(r.target for r in rows) / sum(r.source_size for r in rows) - 1) < 1e-9


def test_vectors_without_rows(spark):
    assert near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>, _row int")).count() == 0
