"""The crawl journal: replay, latest row by key, statistics, error buckets, compaction, seeds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import formats

STATUSES = ("pending", "active", "done", "failed", "skipped")
JOURNAL = (
    "seq bigint, key string, url string, status string, path string, depth int, role string, referer string, media_type string, "
    "size bigint, etag string, last_mod string, http_code int, err string, err_kind string, attempts int, localized boolean, "
    "alias boolean, pass int, updated_at bigint"
)
#: Short names of the fields in a stored line. Fixed values.
SHORT = {
    "k": "key", "u": "url", "s": "status", "p": "path", "d": "depth", "r": "role", "ref": "referer", "mt": "media_type", "sz": "size",
    "et": "etag", "lm": "last_mod", "c": "http_code", "e": "err", "ek": "err_kind", "a": "attempts", "loc": "localized", "al": "alias",
    "ps": "pass", "t": "updated_at",
}


def read_journal(spark: SparkSession, path: str) -> DataFrame:
    """Lines of a journal in order; blank, malformed and key-less ones are dropped."""
    long = dict(x.strip().split(" ") for x in JOURNAL.split(","))
    schema = ", ".join(f"{k} {long[v]}" for k, v in SHORT.items())
    lines = spark.read.text(path).select(F.monotonically_increasing_id().alias("seq"), F.from_json("value", schema).alias("j")).where("j.k is not null and j.k <> ''")
    zero = {"string": "''", "int": "0", "bigint": "0L", "boolean": "false"}
    fields = [F.expr(f"coalesce(j.{k}, {zero[long[v]]})").cast(long[v]).alias(v) for k, v in SHORT.items()]
    return lines.select("seq", *fields).withColumn("status", F.expr("if(status = 'active', 'pending', status)"))


def append(rows: DataFrame, folder: str, batch: int, now: int) -> None:
    """Adds ``rows`` of a journal as one batch of lines, stamped with ``now``.

    A batch that is written again replaces itself, so a job that was cut off can simply run again.
    """
    stamped = rows.withColumn("updated_at", F.lit(now).cast("bigint"))
    have = [(short, long) for short, long in SHORT.items() if long in stamped.columns]
    stamped.select("seq", *[F.col(long).alias(short) for short, long in have]).write.mode("overwrite").json(f"{folder.rstrip('/')}/batch={batch:010d}")


def appended(spark: SparkSession, folder: str) -> DataFrame:
    """The rows of all batches; ``seq`` orders them by batch and then as they were numbered there."""
    long = dict(x.strip().split(" ") for x in JOURNAL.split(","))
    schema = "seq bigint, " + ", ".join(f"{k} {long[v]}" for k, v in SHORT.items())
    rows = spark.read.schema(schema + ", batch bigint").option("basePath", folder).json(folder).where("k <> ''")
    return rows.select(F.struct(F.col("batch"), F.col("seq")).alias("seq"), *[F.col(k).alias(v) for k, v in SHORT.items()])


def latest(journal: DataFrame, key: str = "key", seq: str = "seq") -> DataFrame:
    """The last row of each key: one partial aggregation, no sort."""
    rest = [c for c in journal.columns if c != key]
    return journal.groupBy(key).agg(F.max_by(F.struct(*rest), seq).alias("_r")).select(key, "_r.*")


def statistics(entries: DataFrame) -> DataFrame:
    """One row: counts by status without aliases, bytes over all rows, rewritten documents."""
    count = lambda cond: F.count_if(F.expr(f"not alias and {cond}"))
    return entries.agg(
        *[count(f"status = '{s}'").alias(s) for s in STATUSES],
        count("true").alias("total"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"), count("localized").alias("localized"),
    )


def error_buckets(entries: DataFrame, most: int = 10) -> DataFrame:
    """(reason, n, sample): failures by kind and short reason, the most frequent first."""
    failed = entries.where("status = 'failed'").withColumn("reason", F.expr(f"concat(err_kind, ': ', {formats.short_reason('err')})"))
    buckets = failed.groupBy("reason").agg(F.count(F.lit(1)).alias("n"), F.min_by("url", F.struct("depth", "key")).alias("sample"))
    return buckets.orderBy(F.desc("n"), "reason").limit(most)


def listing(entries: DataFrame, status: str = "", text: str = "", most: int = 500, skip: int = 0) -> DataFrame:
    """Entries of a status whose URL or path contains ``text``, by depth and key."""
    rows = entries.where(F.col("status") == status) if status else entries
    if text:
        rows = rows.where(F.lower("url").contains(text.lower()) | F.lower(F.coalesce("path", F.lit(""))).contains(text.lower()))
    return rows.orderBy("depth", "key").offset(skip).limit(min(most, 5000))


def retryable() -> str:
    """SQL: failures worth another try: of the connection, or of a busy server."""
    return "status = 'failed' and (err_kind = 'network' or (err_kind = 'http' and http_code in (408, 425, 429, 500, 502, 503, 504)))"


def outcome(kind: str, code: str, attempts: str) -> str:
    """SQL: struct(status, err_kind, http_code, attempts) that an error leaves in the journal."""
    status = f"case when {kind} = 'canceled' then 'pending' when {kind} in ('robots', 'too-large') then 'skipped' when {kind} = 'ok' then 'done' else 'failed' end"
    return f"struct({status} as status, {kind} as err_kind, {code} as http_code, {attempts} as attempts)"


def verdict(stats: DataFrame, stopped: bool = False) -> DataFrame:
    state = F.expr(f"case when done = 0 and failed > 0 then 'failed' when {str(stopped).lower()} then 'stopped' else 'done' end")
    return stats.select("*", state.alias("verdict"))


def seeds(entries: DataFrame, starts: DataFrame, sitemap: DataFrame, passes: int) -> DataFrame:
    """(key, url, source): what a run begins with; the first source of a key wins.

    Pending rows of an earlier run, failures that may be tried again, start URLs, sitemap URLs.
    """
    rows = entries.where("status = 'pending'").select("key", "url", F.lit(0).alias("source"))
    rows = rows.unionByName(entries.where(F.expr(retryable()) & (F.col("pass") < passes)).select("key", "url", F.lit(1).alias("source")))
    rows = rows.unionByName(starts.select("key", "url", F.lit(2).alias("source"))).unionByName(sitemap.select("key", "url", F.lit(3).alias("source")))
    return rows.groupBy("key").agg(F.min(F.struct("source", "url")).alias("r")).select("key", "r.url", "r.source")


def compact(journal: DataFrame, path: str) -> None:
    """Writes one row for each key to a new folder; the caller swaps folders when it is whole."""
    latest(journal).write.mode("errorifexists").parquet(path)


def aliases(entries: DataFrame, redirects: DataFrame) -> DataFrame:
    """Rows that let a redirect's final key find the file of the requested one.

    ``redirects`` is (key, final_key). A real entry under the final key is never masked.
    """
    new = redirects.where("key <> final_key").join(entries.select("key", "path", "depth"), "key").select(F.col("final_key").alias("key"), "path", "depth")
    return new.groupBy("key").agg(F.min_by("path", F.struct("depth", "path")).alias("path")).join(entries.select("key"), "key", "left_anti")


def report(entries: DataFrame) -> DataFrame:
    """One JSON document: statistics and the most frequent errors."""
    top = error_buckets(entries).agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("o"), "reason", "n", "sample"))).alias("e"))
    errors = F.transform("e", lambda x: F.struct(x["reason"].alias("reason"), x["n"].alias("count"), x["sample"].alias("sample")))
    return statistics(entries).crossJoin(top.select(errors.alias("top_errors"))).select(F.to_json(F.struct("*")).alias("report"))
