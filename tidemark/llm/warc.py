"""WARC records and a Merkle fixity audit of their replicas.

Pages become WARC/1.1 response records at running byte offsets. Each record is hashed; ``FANOUT``
consecutive hashes make the hash of an offset range, ranges make larger ranges, up to a root, so
one comparison tells whether two replicas agree. Where they do not, the audit goes down from the
root and joins, on each level, only the children of ranges that differ, which leads to the
corrupted records in as many steps as the tree has levels.

A range's hash gathers at most ``FANOUT`` children. Positions and offsets are numbered over range
partitions, whose totals are summed first, so no task sees more than its part of the archive.

Edge cases: null url or body is the empty string; records are ordered by id, url and body, nulls
first, so repeated rows stand side by side and are interchangeable; an empty table has no records
and no root; a record that only one replica has differs there; extra columns are not read, so
their names can't clash. A record of any length is hashed whole.
"""

from __future__ import annotations

import gzip
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.runtime import shuffle_width, small_batches, stash

FANOUT = 64
DATE = "2024-01-01T00:00:00Z"


def record(url: Column, body: Column) -> Column:
    """The bytes of a response record as text; the id is named by what it holds."""
    url, body = F.coalesce(url, F.lit("")), F.coalesce(body, F.lit(""))
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: response\r\nWARC-Target-URI: "), url,
        F.lit(f"\r\nWARC-Date: {DATE}\r\nWARC-Record-ID: <urn:md5:"), F.md5(F.concat(url, F.lit("\n"), body)),
        F.lit(">\r\nContent-Type: text/html\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"),
    )
    return F.concat(head, body, F.lit("\r\n\r\n"))


def manifest(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", name: str | None = None) -> DataFrame:
    """(page_id, position, offset, length, sha256) of the records, in archive order.

    ``name`` is the column by which records of one id and url are ordered: a replica keeps the
    names its records had in the archive, whatever has become of them. By default their own hash.
    """
    spark = pages.sparkSession
    raw = record(F.col(url), F.col(html))
    rows = pages.select(
        F.col(page_id).alias("page_id"), F.coalesce(F.col(url), F.lit("")).alias("u"), F.octet_length(raw).cast("bigint").alias("length"), F.sha2(raw, 256).alias("sha256"),
        (F.col(name) if name else F.sha2(raw, 256)).alias("name"),
    )
    keys = ["page_id", "u", "name"]
    rows = stash(rows.repartitionByRange(shuffle_width(spark), *keys).withColumn("part", F.spark_partition_id()), "warc-ranges")
    parts = rows.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.sum("length").alias("bytes"))
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n0"), F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("b0"))
    own = W.partitionBy("part").orderBy(*keys)
    placed = rows.withColumn("k", F.row_number().over(own) - 1).withColumn("b", F.sum("length").over(own.rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("length"))
    return placed.join(F.broadcast(parts), "part").select("page_id", (F.col("n0") + F.col("k")).alias("position"), (F.col("b0") + F.col("b")).alias("offset"), "length", "sha256")


def tree(records: DataFrame) -> DataFrame:
    """(level, node, hash): records are level 0; the single node of the last level is the root."""
    level = records.select(F.lit(0).alias("level"), F.col("position").alias("node"), F.col("sha256").alias("hash"))
    n = records.agg(F.max("position")).first()[0]
    out, at, top = level, 0, n if n is not None else 0
    while top > 0 or (at == 0 and n is not None):
        at, top = at + 1, top // FANOUT
        children = F.array_sort(F.collect_list(F.struct(F.col("node").alias("c"), "hash")))
        level = stash(
            level.groupBy(F.floor(F.col("node") / FANOUT).alias("node"))
            .agg(F.sha2(F.array_join(F.transform(children, lambda x: x["hash"]), ""), 256).alias("hash"))
            .select(F.lit(at).alias("level"), "node", "hash"),
            "warc-level",
        )
        out = out.unionByName(level)
    return out


def audit(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """Nodes of two trees that differ, found from the roots down: (level, node)."""
    depth = ours.unionByName(theirs).agg(F.max("level")).first()[0]
    found = None
    for level in range(depth if depth is not None else -1, -1, -1):
        a = ours.where(F.col("level") == level).select("node", F.col("hash").alias("a"))
        b = theirs.where(F.col("level") == level).select("node", F.col("hash").alias("b"))
        if found is not None:
            inside = found.select(F.col("node").alias("up"))
            a = a.join(inside, F.floor(F.col("node") / FANOUT) == F.col("up"), "left_semi")
            b = b.join(inside, F.floor(F.col("node") / FANOUT) == F.col("up"), "left_semi")
        differs = a.join(b, "node", "full").where(~F.col("a").eqNullSafe(F.col("b"))).select(F.lit(level).alias("level"), "node")
        found = stash(differs, "warc-differs")
        if level and found.isEmpty():
            return found
    return found if found is not None else ours.select("level", "node").limit(0)


def write_segments(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(segment, member): each partition as one gzip-per-record WARC file's content."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = [gzip.compress(x.encode("utf-8"), 6, mtime=0) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(data, pa.binary())], ["segment", "member"])

    return pages.select(F.spark_partition_id().alias("segment"), record(F.col(url), F.col(html)).alias("raw")).mapInArrow(run, "segment int, member binary")


def parse(raw: bytes) -> list[tuple[str, str, bytes]]:
    """(record id, url, payload) of the records in a WARC file, gzipped or not."""
    if raw[:2] == b"\x1f\x8b":
        raw = gzip.decompress(raw)
    out, at = [], 0
    while True:
        at = raw.find(b"WARC/", at)
        end = raw.find(b"\r\n\r\n", at)
        if at < 0 or end < 0:
            return out
        head = dict(line.split(": ", 1) for line in raw[at:end].decode("utf-8", "replace").split("\r\n")[1:] if ": " in line)
        size = int(head.get("Content-Length", "0"))
        out.append((head.get("WARC-Record-ID", ""), head.get("WARC-Target-URI", ""), raw[end + 4 : end + 4 + size]))
        at = end + 4 + size


#: What stands between two records of a file.
BETWEEN = "\r\n\r\nWARC/1."
RECORDS = "path string, record_id string, url string, body binary"


def _rows(parsed: list[tuple[str, list]]) -> pa.RecordBatch:
    rows = [(path, *x) for path, found in parsed for x in found]
    columns = list(zip(*rows, strict=True)) if rows else [(), (), (), ()]
    kinds = (pa.string(), pa.string(), pa.string(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["path", "record_id", "url", "body"])


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """(path, record_id, url, body) of all records of the WARC files under ``path``, gzipped or not.

    Files are streamed and cut where a record begins, so a task holds a few records whatever the
    archive's size. A record whose length differs from what it states shows that a payload looks like
    a record's beginning; only files that hold such a one are read again in one piece.
    """

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                raw = bytes(raw.as_buffer())
                yield _rows([(name, parse(raw if raw.startswith(b"WARC/") else b"WARC/1." + raw))])

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _rows([(name, parse(raw)) for name, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)])

    small_batches(spark, 100)
    at = F.col("_metadata.file_path").alias("path")
    pieces = spark.read.option("lineSep", BETWEEN).text(path).select(at, F.col("value").cast("binary").alias("raw"))
    start = F.instr(F.col("raw").cast("string"), "\r\n\r\n")
    head = F.substring(F.col("raw").cast("string"), F.lit(1), start)
    stated = F.regexp_extract(head, r"(?i)\nContent-Length:\x20*([0-9]+)", 1).cast("bigint")
    # The payload is what follows the head's blank line; the file's last record ends in one of its own.
    length = F.octet_length("raw") - F.octet_length(head) - 3
    fits = F.coalesce((start > 0) & ((length == stated) | ((length == stated + 4) & F.col("raw").cast("string").endswith("\r\n\r\n"))), F.lit(False))
    odd = stash(pieces.where(~fits).select("path").distinct(), "warc-odd")
    kept = pieces.join(odd, "path", "left_anti").mapInArrow(one, RECORDS)
    again = spark.read.format("binaryFile").load(path).select(at, "content").join(odd, "path", "left_semi")
    return kept.unionByName(again.mapInArrow(whole, RECORDS))


def flipped(body: Column) -> Column:
    """A replica's fault: every body whose MD5 begins with 00 has lost its last character."""
    return F.when(F.substring(F.md5(body), 1, 2) == "00", F.substring(body, F.lit(1), F.length(body) - 1)).otherwise(body)


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest of all pages and, record by record, whether a faulty replica differs.

    The replica is a table of records, some of them damaged: every byte it holds is read and
    hashed into a tree of its own.
    """
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    ours = manifest(pages)
    held = stash(ours, "warc-manifest")
    replica = pages.select("page_id", "url", flipped(F.col("html")).alias("html"), F.sha2(record(F.col("url"), F.col("html")), 256).alias("name"))
    theirs = stash(manifest(replica, name="name"), "warc-replica")
    wrong = audit(tree(held), tree(theirs)).where("level = 0").select(F.col("node").alias("position"), F.lit(True).alias("bad"))
    return held.join(wrong, "position", "left").select(
        "page_id", "position", "offset", "length", "sha256", F.floor(F.col("position") / FANOUT).alias("range"), F.coalesce("bad", F.lit(False)).alias("corrupt")
    )


OP8_SQL = f"""
WITH p AS (SELECT page_id, coalesce(url, '') AS u, coalesce(html, '') AS h FROM pages),
r AS (
  SELECT page_id, u, h, 'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10) || 'WARC-Target-URI: ' || u
    || chr(13) || chr(10) || 'WARC-Date: {DATE}' || chr(13) || chr(10) || 'WARC-Record-ID: <urn:md5:' || md5(u || chr(10) || h)
    || '>' || chr(13) || chr(10) || 'Content-Type: text/html' || chr(13) || chr(10) || 'Content-Length: ' || strlen(h) || chr(13) || chr(10)
    || chr(13) || chr(10) || h || chr(13) || chr(10) || chr(13) || chr(10) AS raw FROM p
), m AS (SELECT page_id, u, h, CAST(strlen(raw) AS BIGINT) AS length, sha256(raw) AS sha256 FROM r),
o AS (
  SELECT *, row_number() OVER w - 1 AS position, CAST(sum(length) OVER w - length AS BIGINT) AS "offset" FROM m
  WINDOW w AS (ORDER BY page_id NULLS FIRST, u, sha256 ROWS UNBOUNDED PRECEDING)
)
SELECT page_id, position, "offset", length, sha256, CAST(position // {FANOUT} AS BIGINT) AS range, left(md5(h), 2) = '00' AND h <> '' AS corrupt FROM o
"""
