"""Linked spans against the SQL on generated texts, and texts of very many parts."""

import time

import duckdb
import pyarrow as pa
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tidemark.llm import secret_links

SCHEMA = "doc_id long, text string"
PIECES = st.sampled_from(
    ["AKIA" + "B7" * 6, "AKIA" + "C" * 20, "wJalrXUtnFEMI7K7MDENGbPxRfiCY", "0f" * 17, "password = hunter2hunter2", "token: 'aB3dE5gH7jK9mN1pQ3sT5vW7'", "username=bobby1", "client_id: abcd",
     "https://s3.example.com", "http://h:80/AbCdEfGhIjKlMnOpQrStUvWxYz012", "é🙂 ", "x " * 150, "word\n", "secret=short", "a" * 40]
)
TEXTS = st.one_of(st.none(), st.lists(PIECES, max_size=14).map(" ".join), st.lists(PIECES, max_size=5).map("".join))


def in_sql(texts):
    documents = pa.table({"doc_id": pa.array(range(len(texts)), pa.int64()), "text": pa.array(texts, pa.string())})  # noqa: F841
    rows = duckdb.sql(f"SELECT doc_id, n_assign, n_access, n_hex, base_sha256, spans FROM ({secret_links.OP2_SQL}) ORDER BY doc_id").fetchall()
    return [tuple(r) for r in rows]


def in_spark(spark, texts, folder):
    spark.createDataFrame(list(enumerate(texts)), SCHEMA).write.mode("overwrite").parquet(f"{folder}/documents.parquet")
    out = secret_links.op2(spark, str(folder)).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans")
    return sorted(tuple(r) for r in out.collect())


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(TEXTS, min_size=20, max_size=40))
def test_spans_agree_with_the_sql(spark, tmp_path, texts):
    want = in_sql(texts)
    assert in_spark(spark, texts, tmp_path) == want


def test_links_are_found(spark, tmp_path):
    part = "wJalrXUtnFEMI7K7MDENGbPxRfiCY"
    texts = [f"AKIA{'B' * 12} {'y ' * k}{part} https://a.example.com" for k in (0, 150, 190, 200, 400)]
    got = in_spark(spark, texts, tmp_path)
    assert got == in_sql(texts) and sum("part" in r[-1] for r in got) == 3


def test_a_text_of_very_many_parts_ends_soon(spark, tmp_path):
    part = "wJalrXUtnFEMI7K7MDENGbPxRfiCY"
    texts = ["".join(f"https://h{i}.example.com/ " for i in range(50_000)) + f"username=bobby {part}", "".join(f"password=abcdefgh{i} https://h{i}.example.com username=bobby " for i in range(6_000))]
    began = time.time()
    got = in_spark(spark, texts, tmp_path)
    assert time.time() - began < 120
    assert got[0][-1].count("host:") and got[1][1] == 6_000 and got[1][-1].count("id:") == 6_000 and got[1][-1].count("host:") == 6_000


def test_redaction_of_long_texts(spark, monkeypatch):
    texts = ["".join(f"é token=abcdefgh{i:05d}, " for i in range(3_000)), "secret=" + "a" * 20_000 + " é", "x" * 4090 + " password=12345678 " + "y" * 5000, None, ""]
    df = spark.createDataFrame([(i, t, 7) for i, t in enumerate(texts)], "doc_id long, text string, spans int")
    got = secret_links.redact(df).orderBy("doc_id").collect()
    assert [r.text for r in got] == ["é [SECRET], " * 3_000, "[SECRET] é", "x" * 4090 + " [SECRET] " + "y" * 5000, None, ""]
    assert [r.spans for r in got] == [7] * 5
