"""Readers and writers: pages, cookies, mirrors and JSON reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.paths import contained

RESPONSES = "url string, status int, media_type string, headers map<string,string>, final_url string, body binary"


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored pages as responses (page_id, url, html)."""
    return spark.read.parquet(f"{sf_dir}/pages.parquet")


def responses(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RESPONSES).parquet(path)


def fetched(frontier: DataFrame, stored: DataFrame) -> DataFrame:
    """A fetch is a lookup: the frontier with its responses; what isn't stored has no status."""
    return frontier.join(stored.withColumnRenamed("url", "_url"), F.col("url") == F.col("_url"), "left").drop("_url")


def cookies(spark: SparkSession, path: str, now: int = 0) -> DataFrame:
    """(origin, cookies): a tab-separated cookie file; comments and expired rows are dropped."""
    line = F.regexp_replace("value", "^#HttpOnly_", "")
    rows = spark.read.text(path).select(line.alias("line")).where("trim(line) <> '' and line not like '#%'")
    f = F.when(F.col("line").contains("\t"), F.split("line", "\t")).otherwise(F.split(F.trim("line"), r"\s+", 7))
    rows = rows.select(f.alias("f")).where("size(f) >= 7").selectExpr(
        "regexp_replace(f[0], r'^\\.', '') as host", "f[3] = 'TRUE' as secure", "try_cast(f[4] as bigint) as expires", "f[5] as name", "f[6] as value"
    )
    live = rows.where(f"name <> '' and (coalesce(expires, 0) = 0 or expires > {now})")
    origin = F.concat(F.when(F.col("secure"), "https://").otherwise("http://"), F.col("host"))
    return live.groupBy(origin.alias("origin")).agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", "name", "value"))), "; ").alias("cookies"))


def cookie_pairs(header: str) -> str:
    """SQL: the (name, value) pairs of a cookie header, split at the first =; nameless ones go."""
    return f"filter(transform(split({header}, ';'), x -> struct(trim(substring_index(x, '=', 1)) as name, if(instr(x, '=') > 0, trim(substr(x, instr(x, '=') + 1)), '') as value)), p -> p.name <> '')"


def mirror(spark: SparkSession, folder: str) -> DataFrame:
    """(path, body): the files of a mirror, with paths relative to its folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    root = F.lit(folder.rstrip("/").split(":", 1)[-1].lstrip("/") + "/")
    return files.select(F.regexp_replace(F.substring_index("path", root, -1), "^/", "").alias("path"), F.col("content").alias("body"))


def export(rows: DataFrame, folder: str) -> None:
    """Writes (path, body) as Parquet for a mirror; a path that leaves its folder is an error."""
    bad = rows.where(~F.expr(contained("path"))).limit(1).collect()
    if bad:
        raise ValueError(f"refusing to write {bad[0]['path']!r}")
    rows.select("path", "body").write.mode("errorifexists").parquet(folder)


def report(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("multiLine", True).json(path)


def requests_of_page(requests: str) -> str:
    """SQL: what a rendered page asked for, once each, in order; nothing inline."""
    return f"array_distinct(filter({requests}, x -> x <> '' and x not like 'data:%' and x not like 'blob:%'))"
