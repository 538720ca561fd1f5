"""Queries over journals, logs, robots files, paths, rewriting, formats and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark import runtime
from tidemark.functions import formats, urls
from tidemark.operators import closure, paths, rewrite, robots, rules, scan, state
from tidemark.plans.config import Settings
from tidemark.plans.queries import ANCHOR, LINKS_SQL, QUERIES, ORACLE, _table, _url_query, add, resolved
from tidemark.sources import files
from tidemark.streaming import folds, live

# --- The journal: events as log lines ----------------------------------------------------------------

_STATUS = "case event_type when 'error' then 'failed' when 'signup' then 'skipped' when 'view' then 'pending' else 'done' end"
_KIND = "case when event_type <> 'error' then 'ok' when user_id % 3 = 0 then 'network' when user_id % 3 = 1 then 'http' else 'too-large' end"
_ERR = "case when event_type = 'error' then concat('fetch u', user_id, ': reason ', user_id % 7) else '' end"


def journal(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "events").selectExpr(
        "event_id as seq", "concat('u', user_id, '/', event_id % 3) as key", "concat('http://h', user_id, '.example.com/', event_id % 3) as url", f"{_STATUS} as status",
        "if(event_type in ('click', 'purchase'), concat('h', user_id, '/', event_id % 3, '.html'), '') as path", "int(event_id % 4) as depth", "'page' as role", "'' as referer",
        "'text/html' as media_type", "bigint(value) as size", "'' as etag", "'' as last_mod", "int(if(user_id % 2 = 0, 503, 404)) as http_code", f"{_ERR} as err", f"{_KIND} as err_kind",
        "1 as attempts", "event_id % 5 = 0 as localized", "event_id % 11 = 0 as alias", "int(event_id % 3) as pass", "unix_seconds(cast(ts as timestamp)) as updated_at",
    )


JOURNAL_SQL = """j AS (
  SELECT event_id AS seq, 'u' || user_id || '/' || event_id % 3 AS key, 'http://h' || user_id || '.example.com/' || event_id % 3 AS url,
    CASE event_type WHEN 'error' THEN 'failed' WHEN 'signup' THEN 'skipped' WHEN 'view' THEN 'pending' ELSE 'done' END AS status,
    CASE WHEN event_type IN ('click', 'purchase') THEN 'h' || user_id || '/' || event_id % 3 || '.html' ELSE '' END AS path,
    CAST(event_id % 4 AS INT) AS depth, CAST(trunc(value) AS BIGINT) AS size, CASE WHEN user_id % 2 = 0 THEN 503 ELSE 404 END AS http_code,
    CASE WHEN event_type = 'error' THEN 'fetch u' || user_id || ': reason ' || user_id % 7 ELSE '' END AS err,
    CASE WHEN event_type <> 'error' THEN 'ok' WHEN user_id % 3 = 0 THEN 'network' WHEN user_id % 3 = 1 THEN 'http' ELSE 'too-large' END AS err_kind,
    event_id % 5 = 0 AS localized, event_id % 11 = 0 AS alias, CAST(event_id % 3 AS INT) AS pass, CAST(floor(epoch(ts)) AS BIGINT) AS updated_at, ts, user_id, value FROM events
), e AS (SELECT * FROM j QUALIFY row_number() OVER (PARTITION BY key ORDER BY seq DESC) = 1)"""


def entries(spark: SparkSession, d: str) -> DataFrame:
    return state.latest(journal(spark, d))


def _j(sql: str) -> str:
    return f"WITH {JOURNAL_SQL} {sql}"


_BUCKET = "err_kind || ': ' || CASE WHEN strpos(err, ': ') > 0 THEN substr(err, strpos(err, ': ') + 2) ELSE err END"
_RETRY = "status = 'failed' AND (err_kind = 'network' OR (err_kind = 'http' AND http_code = 503))"

add("w01_latest", lambda s, d: entries(s, d).select("key", "seq", "status", "path", "depth", "size"), _j("SELECT key, seq, status, path, depth, size FROM e"))
add("a01_statistics", lambda s, d: state.statistics(entries(s, d)), _j("""SELECT count(*) FILTER (status = 'pending' AND NOT alias) AS pending, CAST(0 AS BIGINT) AS active, count(*) FILTER (status = 'done' AND NOT alias) AS done,
  count(*) FILTER (status = 'failed' AND NOT alias) AS failed, count(*) FILTER (status = 'skipped' AND NOT alias) AS skipped, count(*) FILTER (NOT alias) AS total,
  CAST(coalesce(sum(size), 0) AS BIGINT) AS bytes, count(*) FILTER (localized AND NOT alias) AS localized FROM e"""))
add("a02_byte_total", lambda s, d: entries(s, d).agg(F.sum("size").alias("bytes")), _j("SELECT CAST(sum(size) AS BIGINT) AS bytes FROM e"))
add("a03_error_buckets", lambda s, d: state.error_buckets(entries(s, d)), _j(f"""SELECT {_BUCKET} AS reason, count(*) AS n, arg_min(url, (depth, key)) AS sample FROM e WHERE status = 'failed' GROUP BY 1 ORDER BY n DESC, reason LIMIT 10"""))
add("a08_fetch_counters", lambda s, d: journal(s, d).agg(F.count(F.lit(1)).alias("requests"), F.count_if(F.expr("status = 'done'")).alias("ok"), F.count_if(F.expr("err_kind = 'network'")).alias("network"), F.sum("size").alias("bytes")),
    _j("SELECT count(*) AS requests, count(*) FILTER (status = 'done') AS ok, count(*) FILTER (err_kind = 'network') AS network, CAST(sum(size) AS BIGINT) AS bytes FROM j"))
add("a09_files_per_host", lambda s, d: entries(s, d).where("status = 'done'").groupBy(F.expr("regexp_extract(url, '^http://([^/]*)', 1)").alias("host")).agg(F.count(F.lit(1)).alias("n")),
    _j("SELECT regexp_extract(url, '^http://([^/]*)', 1) AS host, count(*) AS n FROM e WHERE status = 'done' GROUP BY 1"))
add("a12_distinct_first", lambda s, d: journal(s, d).groupBy("status").agg(F.min("seq").alias("first")), _j("SELECT status, min(seq) AS first FROM j GROUP BY 1"))
add("o01_by_depth", lambda s, d: state.listing(entries(s, d), most=50).select("depth", "key"), _j("SELECT depth, key FROM e ORDER BY depth, key LIMIT 50"))
add("o02_recent_errors", lambda s, d: entries(s, d).where("status = 'failed'").orderBy(F.desc("updated_at"), "depth", "key").limit(100).select("key", "updated_at"),
    _j("SELECT key, updated_at FROM e WHERE status = 'failed' ORDER BY updated_at DESC, depth, key LIMIT 100"))
add("o03_list", lambda s, d: state.listing(entries(s, d), "done", "H1", 40).select("key", "url"), _j("SELECT key, url FROM e WHERE status = 'done' AND (contains(lower(url), 'h1') OR contains(lower(path), 'h1')) ORDER BY depth, key LIMIT 40"))
add("o08_page_of_list", lambda s, d: state.listing(entries(s, d), most=20, skip=40).select("key"), _j("SELECT key FROM e ORDER BY depth, key LIMIT 20 OFFSET 40"))
add("p17_retryable", lambda s, d: entries(s, d).where(state.retryable()).select("key"), _j(f"SELECT key FROM e WHERE {_RETRY}"))
add("p25_select", lambda s, d: entries(s, d).where("status = 'done' and not localized").select("key", "depth"), _j("SELECT key, depth FROM e WHERE status = 'done' AND NOT localized"))
add("p24_filter", lambda s, d: entries(s, d).where("contains(lower(url), 'h12')").select("key"), _j("SELECT key FROM e WHERE contains(lower(url), 'h12')"))
add("c04_outcome", lambda s, d: journal(s, d).where("err <> ''").select("seq", F.expr(state.outcome("err_kind", "http_code", "attempts")).alias("o")).select("seq", "o.*"),
    _j("SELECT seq, CASE err_kind WHEN 'too-large' THEN 'skipped' ELSE 'failed' END AS status, err_kind, CAST(http_code AS INT) AS http_code, CAST(1 AS INT) AS attempts FROM j WHERE err <> ''"))
add("c05_verdict", lambda s, d: state.verdict(state.statistics(entries(s, d))).select("done", "failed", "verdict"),
    _j("SELECT count(*) FILTER (status = 'done' AND NOT alias) AS done, count(*) FILTER (status = 'failed' AND NOT alias) AS failed, CASE WHEN count(*) FILTER (status = 'done' AND NOT alias) = 0 THEN 'failed' ELSE 'done' END AS verdict FROM e"))


def _starts(s: SparkSession, d: str) -> DataFrame:
    return _table(s, d, "nation").selectExpr("concat('u', n_nationkey, '/0') as key", "concat('http://h', n_nationkey, '.example.com/0') as url")


def _sitemap(s: SparkSession, d: str) -> DataFrame:
    return _table(s, d, "supplier").selectExpr("concat('u', s_suppkey, '/9') as key", "concat('http://h', s_suppkey, '.example.com/9') as url")


add("e01_seeds", lambda s, d: state.seeds(entries(s, d), _starts(s, d), _sitemap(s, d), 2).select("key", "source"), _j(f"""SELECT key, min(source) AS source FROM (
  SELECT key, 0 AS source FROM e WHERE status = 'pending' UNION ALL SELECT key, 1 FROM e WHERE {_RETRY} AND pass < 2
  UNION ALL SELECT 'u' || n_nationkey || '/0', 2 FROM nation UNION ALL SELECT 'u' || s_suppkey || '/9', 3 FROM supplier) GROUP BY key"""))
add("e05_requeue", lambda s, d: entries(s, d).where(F.expr(state.retryable()) & (F.col("pass") < 2)).selectExpr("key", "pass + 1 as pass"), _j(f"SELECT key, pass + 1 AS pass FROM e WHERE {_RETRY} AND pass < 2"))
add("e06_drain", lambda s, d: entries(s, d).where("status = 'pending'").select("key"), _j("SELECT key FROM e WHERE status = 'pending'"))
add("j02_unseen", lambda s, d: _sitemap(s, d).unionByName(_starts(s, d)).join(entries(s, d).select("key"), "key", "left_anti"),
    _j("SELECT * FROM (SELECT 'u' || s_suppkey || '/9' AS key, 'http://h' || s_suppkey || '.example.com/9' AS url FROM supplier UNION ALL SELECT 'u' || n_nationkey || '/0', 'http://h' || n_nationkey || '.example.com/0' FROM nation) WHERE key NOT IN (SELECT key FROM e)"))
add("j03_claim", lambda s, d: closure.claimed(journal(s, d).selectExpr("key", "depth", "seq", "url"), _starts(s, d)).select("key", "depth", "seq"),
    _j("SELECT key, depth, seq FROM j WHERE key NOT IN (SELECT 'u' || n_nationkey || '/0' FROM nation) QUALIFY row_number() OVER (PARTITION BY key ORDER BY depth, seq) = 1"))
add("w02_first_discovery", lambda s, d: closure.claimed(journal(s, d).selectExpr("key", "depth", "seq"), _starts(s, d).limit(0)), _j("SELECT key, depth, seq FROM j QUALIFY row_number() OVER (PARTITION BY key ORDER BY depth, seq) = 1"))
add("j04_saved_paths", lambda s, d: journal(s, d).select("path").distinct().join(entries(s, d).where("status = 'done'").select("path"), "path", "left_semi"), _j("SELECT DISTINCT path FROM j WHERE path IN (SELECT path FROM e WHERE status = 'done')"))
add("j09_aliases", lambda s, d: state.aliases(entries(s, d), journal(s, d).where("status = 'done'").selectExpr("key", "concat('u', seq % 40, '/', seq % 7) as final_key").distinct()),
    _j("SELECT key, arg_min(path, (depth, path)) AS path FROM (SELECT DISTINCT 'u' || seq % 40 || '/' || seq % 7 AS key, key AS src FROM j WHERE status = 'done') r JOIN (SELECT key AS k, path, depth FROM e) x ON r.src = x.k WHERE key <> src AND key NOT IN (SELECT key FROM e) GROUP BY key"))
add("j11_prior_state", lambda s, d: _starts(s, d).join(entries(s, d).select("key", "status", "updated_at"), "key", "left").select("key", "status", "updated_at"),
    _j("SELECT n.key, e.status, e.updated_at FROM (SELECT 'u' || n_nationkey || '/0' AS key FROM nation) n LEFT JOIN e USING (key)"))
add("j13_seed_flag", lambda s, d: entries(s, d).where("status = 'pending'").join(F.broadcast(_starts(s, d).selectExpr("key", "true as seed")), "key", "left").selectExpr("key", "coalesce(seed, false) as seed"),
    _j("SELECT key, key IN (SELECT 'u' || n_nationkey || '/0' FROM nation) AS seed FROM e WHERE status = 'pending'"))
add("p20_limits", lambda s, d: rules.within_limit(journal(s, d).select("seq", "size"), "seq", "size", 700, 20000), _j("SELECT seq, size FROM (SELECT seq, size, count(*) OVER w - 1 AS n, sum(size) OVER w - size AS b FROM j WINDOW w AS (ORDER BY seq ROWS UNBOUNDED PRECEDING)) WHERE n < 700 AND b < 20000"))
add("p21_host_rank", lambda s, d: urls.with_url(journal(s, d).select("seq", "url"), "url").select("seq", F.row_number().over(W.partitionBy("u_host").orderBy("seq")).cast("bigint").alias("n")), _j("SELECT seq, row_number() OVER (PARTITION BY user_id ORDER BY seq) AS n FROM j"))
add("w03_frontier_order", lambda s, d: entries(s, d).where("status = 'pending'").orderBy("depth", "seq").limit(30).select("depth", "seq"), _j("SELECT depth, seq FROM e WHERE status = 'pending' ORDER BY depth, seq LIMIT 30"))
add("w09_recent", lambda s, d: _table(s, d, "events").orderBy(F.desc("event_id")).limit(50).select("event_id"), "SELECT event_id FROM events ORDER BY event_id DESC LIMIT 50")
add("w10_first_matching", lambda s, d: entries(s, d).where("status = 'failed'").orderBy("key").limit(10).select("key"), _j("SELECT key FROM e WHERE status = 'failed' ORDER BY key LIMIT 10"))


def _compacted(s: SparkSession, d: str) -> DataFrame:
    """The compacted journal as written and read again; replaying it changes nothing."""
    from uuid import uuid4

    folder = f"{runtime.scratch(s)}/tidemark/compact-{uuid4().hex}"
    state.compact(journal(s, d), folder)
    return state.latest(s.read.parquet(folder)).select("key", "seq", "url", "status", "path", "depth", "size", "err")


add("k03_compaction", _compacted, _j("SELECT key, seq, url, status, path, depth, size, err FROM e"))


def _appended(s: SparkSession, d: str) -> DataFrame:
    """The journal written in two batches, the second one twice, and folded again."""
    from uuid import uuid4

    folder, rows = f"{runtime.scratch(s)}/tidemark/journal-{uuid4().hex}", journal(s, d)
    for batch, odd in ((1, 1), (2, 0), (2, 0)):
        state.append(rows.where(f"seq % 2 = {odd}"), folder, batch, 1000 + batch)
    return state.latest(state.appended(s, folder)).select("key", F.col("seq.seq").alias("seq"), "url", "status", "path", "size", "updated_at")


add("k01_journal_append", _appended, _j("SELECT key, seq, url, status, path, size, CAST(1002 - seq % 2 AS BIGINT) AS updated_at FROM j QUALIFY row_number() OVER (PARTITION BY key ORDER BY seq % 2, seq DESC) = 1"))
add("k12_log_threshold", lambda s, d: _table(s, d, "events").withColumn("level", F.expr("case event_type when 'error' then 'error' when 'signup' then 'warn' when 'view' then 'debug' else 'info' end")).where(f"{formats.level_rank('level')} >= 2").select("event_id", "level"),
    "SELECT event_id, CASE event_type WHEN 'error' THEN 'error' ELSE 'warn' END AS level FROM events WHERE event_type IN ('error', 'signup')")
add("k07_report", lambda s, d: state.report(entries(s, d)))
add("a14_snapshot", lambda s, d: state.statistics(entries(s, d)).selectExpr("done", "pending", "bytes", f"round({formats.eta('pending', '0.5D')}, 6) as eta"), _j("SELECT count(*) FILTER (status = 'done' AND NOT alias) AS done, count(*) FILTER (status = 'pending' AND NOT alias) AS pending, CAST(sum(size) AS BIGINT) AS bytes, count(*) FILTER (status = 'pending' AND NOT alias) / 0.5::DOUBLE AS eta FROM e"))

# --- Attempts: events as a fetch log ---------------------------------------------------------------------


def attempts(s: SparkSession, d: str) -> DataFrame:
    return _table(s, d, "events").selectExpr("user_id as host", "event_id as seq", "ts", "event_type <> 'error' as ok", "event_type = 'signup' as throttled", "value")


_A = "WITH a AS (SELECT user_id AS host, event_id AS seq, ts, event_type <> 'error' AS ok, event_type = 'signup' AS throttled, value FROM events)"
add("w06_host_health", lambda s, d: folds.host_health(attempts(s, d)).select("seq", "successes", "failures", "dead"),
    f"""{_A} SELECT seq, CAST(sum(ok::INT) OVER w AS BIGINT) AS successes, CAST(sum((NOT ok)::INT) OVER w AS BIGINT) AS failures, sum(ok::INT) OVER w = 0 AND sum((NOT ok)::INT) OVER w >= 2 AS dead FROM a WINDOW w AS (PARTITION BY host ORDER BY seq)""")
add("x03_host_health", lambda s, d: folds.host_health_final(attempts(s, d)), f"{_A} SELECT host, count(*) FILTER (ok) AS successes, count(*) FILTER (NOT ok) AS failures, count(*) FILTER (ok) = 0 AND count(*) FILTER (NOT ok) >= 2 AS dead FROM a GROUP BY host")
add("a10_dead_hosts", lambda s, d: folds.host_health(attempts(s, d)).where("dead").select("host").distinct(),
    f"{_A} SELECT DISTINCT host FROM (SELECT host, sum(ok::INT) OVER w AS s, sum((NOT ok)::INT) OVER w AS f FROM a WINDOW w AS (PARTITION BY host ORDER BY seq)) WHERE s = 0 AND f >= 2")
add("w07_streaks", lambda s, d: folds.streaks(attempts(s, d), "host", "seq", "ok").select("seq", "streak"),
    f"""{_A}, i AS (SELECT *, sum(ok::INT) OVER (PARTITION BY host ORDER BY seq) AS g FROM a) SELECT seq, CAST(sum((NOT ok)::INT) OVER (PARTITION BY host, g ORDER BY seq) AS BIGINT) AS streak FROM i""")
def _gate(s: SparkSession, d: str) -> DataFrame:
    """All users are hosts of one of three jobs; the first of each job is a start host."""
    tried = folds.trusted(attempts(s, d).withColumn("job", F.expr("host % 3")), [0, 1, 2])
    return folds.gate(tried.withColumn("ok", F.expr("ok and not throttled")), "job", first_wait=3600.0, longest_wait=14400.0)


# Probes after since: 1, 3 and 7 hours, then every four.
_GATE = f"""{_A}, b AS (SELECT host % 3 AS job, seq, epoch_us(ts) / 1e6 AS now, ok AND NOT throttled AS good,
    coalesce(max(ok::INT) OVER (PARTITION BY host ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 1 OR host IN (0, 1, 2) AS known FROM a),
  n AS (SELECT *, row_number() OVER (PARTITION BY job ORDER BY seq) AS i FROM b),
  g AS (
    SELECT DISTINCT job, CAST(0 AS BIGINT) AS i, CAST(NULL AS BIGINT) AS seq, CAST(0 AS BIGINT) AS streak, CAST(NULL AS DOUBLE) AS since, CAST(NULL AS DOUBLE) AS back, CAST(0 AS BIGINT) AS outages, CAST(0 AS DOUBLE) AS down FROM n
    UNION ALL
    SELECT job, i, seq, streak, CASE WHEN falls THEN now ELSE since END, CASE WHEN falls THEN NULL WHEN good AND since IS NOT NULL THEN coalesce(back, now) ELSE back END, outages + falls::BIGINT, down FROM (
      SELECT *, NOT good AND known AND since IS NULL AND streak >= 3 AS falls FROM (
        SELECT n.job, n.i, n.seq, n.now, n.good, n.known, outages, CASE WHEN good THEN 0 ELSE CASE WHEN up THEN 0 ELSE streak END + known::BIGINT END AS streak,
          CASE WHEN NOT up THEN since END AS since, CASE WHEN NOT up THEN back END AS back, CASE WHEN up THEN down + found - since ELSE down END AS down
        FROM (SELECT *, coalesce(found <= next_now, false) AS up FROM (
          SELECT g.*, nn.now AS next_now, since + CASE WHEN back - since <= 3600 THEN 3600 WHEN back - since <= 10800 THEN 10800 WHEN back - since <= 25200 THEN 25200 ELSE 25200 + ceil((back - since - 25200) / 14400) * 14400 END AS found
          FROM g JOIN n nn ON nn.job = g.job AND nn.i = g.i + 1)) x JOIN n ON n.job = x.job AND n.i = x.i + 1)))"""
_GATE = _GATE.replace("WITH a AS", "WITH RECURSIVE a AS", 1)
add("x05_outages", lambda s, d: _gate(s, d).selectExpr("job", "seq", "state", "streak", "outages", "round(downtime_s, 3) as downtime_s"),
    f"{_GATE} SELECT job, seq, CASE WHEN since IS NULL THEN 'online' ELSE 'offline' END AS state, streak, outages, round(down, 3) AS downtime_s FROM g WHERE i > 0")
add("a13_outage_totals", lambda s, d: _gate(s, d).groupBy("job").agg(F.max("outages").alias("outages"), F.round(F.max("downtime_s"), 3).alias("downtime_s")),
    f"{_GATE} SELECT job, max(outages) AS outages, round(max(down), 3) AS downtime_s FROM g WHERE i > 0 GROUP BY job")
add("x13_render_breaker", lambda s, d: folds.streaks(attempts(s, d), "host", "seq", "ok").groupBy("host").agg((F.max("streak") >= 5).alias("disabled")),
    f"{_A}, i AS (SELECT *, sum(ok::INT) OVER (PARTITION BY host ORDER BY seq) AS g FROM a) SELECT host, max(n) >= 5 AS disabled FROM (SELECT host, g, count(*) FILTER (NOT ok) AS n FROM i GROUP BY host, g) GROUP BY host")
add("x15_trusted", lambda s, d: folds.trusted(attempts(s, d), [1, 2, 3]).select("seq", "trusted"),
    f"{_A} SELECT seq, coalesce(max(ok::INT) OVER (PARTITION BY host ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 1 OR host IN (1, 2, 3) AS trusted FROM a")
_RATE = f"""{_A}, c AS (SELECT host, seq, epoch_us(ts) / 1e6 AS t, sum(CAST(trunc(value) AS BIGINT)) OVER (PARTITION BY host ORDER BY seq) AS v FROM a),
  s AS (SELECT host, t, t - lag(t) OVER w AS dt, greatest(v - lag(v) OVER w, 0) AS dv FROM c WINDOW w AS (PARTITION BY host ORDER BY t)),
  p AS (SELECT *, coalesce(sum(-dt / 86400.0) OVER (PARTITION BY host ORDER BY t DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest FROM s WHERE dt > 0)"""
add("w05_decayed_rate", lambda s, d: folds.decayed_rate(attempts(s, d).withColumn("total", F.sum(F.expr("bigint(value)")).over(W.partitionBy("host").orderBy("seq"))), "host", "ts", "total", 86400.0).selectExpr("host", "round(rate, 6) as rate"),
    f"{_RATE} SELECT host, round(sum((1 - pow(2.0, -dt / 86400.0)) * pow(2.0, rest) * dv / dt), 6) AS rate FROM p GROUP BY host")
_PACE = f"""{_A.replace("WITH a", "WITH RECURSIVE a")}, n AS (SELECT host, seq, throttled, CASE WHEN value > 90 THEN value / 10 END AS after, row_number() OVER (PARTITION BY host ORDER BY seq) AS i FROM a),
  p AS (
    SELECT DISTINCT host, CAST(0 AS BIGINT) AS i, CAST(NULL AS BIGINT) AS seq, 8 AS conns, CAST(0.25 AS DOUBLE) AS delay, 0 AS strikes, 0 AS clean FROM n
    UNION ALL
    SELECT host, i, seq, CASE WHEN halves THEN greatest(2, conns // 2) WHEN eases THEN least(8, conns + 1) ELSE conns END,
      CASE WHEN throttled THEN greatest(least(30.0, delay * 2), CASE WHEN after > 0 THEN least(after, 30.0) ELSE 0 END) WHEN eases THEN greatest(0.25, delay / 2) ELSE delay END,
      CASE WHEN halves OR eases THEN 0 ELSE strikes END, CASE WHEN throttled OR eases THEN 0 ELSE clean END
    FROM (SELECT *, throttled AND conns > 2 AND strikes >= 2 AS halves, clean >= 20 AS eases FROM (
      SELECT n.host, n.i, n.seq, n.throttled, n.after, conns, delay, CASE WHEN n.throttled THEN strikes + 1 ELSE strikes END AS strikes, CASE WHEN n.throttled THEN 0 ELSE clean + 1 END AS clean
      FROM p JOIN n ON n.host = p.host AND n.i = p.i + 1)))"""
add("x04_pacing", lambda s, d: folds.pacing(attempts(s, d).withColumn("after", F.expr("if(value > 90, value / 10, null)")), retry_after="after", connections=8, least=2, base_delay=0.25).selectExpr("host", "seq", "conns", "round(delay, 6) as delay"),
    f"{_PACE} SELECT host, seq, conns, round(delay, 6) AS delay FROM p WHERE i > 0")
_REFILL = f"""{_A.replace("WITH a", "WITH RECURSIVE a")}, n AS (SELECT host, seq, epoch_us(ts) / 1e6 AS t, CAST(trunc(value * 1000) AS DOUBLE) AS size, row_number() OVER (PARTITION BY host ORDER BY seq) AS i FROM a),
  b AS (
    SELECT DISTINCT host, CAST(0 AS BIGINT) AS i, CAST(NULL AS BIGINT) AS seq, CAST(NULL AS DOUBLE) AS ready, CAST(1000 AS DOUBLE) AS have, CAST(0 AS DOUBLE) AS wait FROM n
    UNION ALL
    SELECT host, i, seq, now + greatest(0, (size - filled) / 10), greatest(0, filled - size), greatest(0, (size - filled) / 10) FROM (
      SELECT n.host, n.i, n.seq, n.size, greatest(n.t, coalesce(ready, n.t)) AS now, least(1000, have + (greatest(n.t, coalesce(ready, n.t)) - coalesce(ready, greatest(n.t, coalesce(ready, n.t)))) * 10) AS filled
      FROM b JOIN n ON n.host = b.host AND n.i = b.i + 1))"""
add("x06_token_bucket", lambda s, d: folds.token_bucket(attempts(s, d).withColumn("bytes", F.expr("bigint(value * 1000)")), "host", "seq", "ts", "bytes", 10.0, 1000.0).selectExpr("host", "seq", "round(wait, 2) as wait"),
    f"{_REFILL} SELECT host, seq, round(wait, 2) AS wait FROM b WHERE i > 0")
add("x07_schedule", lambda s, d: folds.schedule(attempts(s, d), "host", "seq", "ts", 600.0).selectExpr("host", "seq", "round(start, 3) as start"),
    f"""{_A}, k AS (SELECT host, seq, epoch_us(ts) / 1e6 AS t, 600 * row_number() OVER (PARTITION BY host ORDER BY seq) AS g FROM a)
    SELECT host, seq, round(max(t - g) OVER (PARTITION BY host ORDER BY seq) + g, 3) AS start FROM k""")
add("x18_phase", lambda s, d: _gate(s, d).selectExpr("job", "seq", f"{folds.phase('state')} as phase"),
    f"{_GATE} SELECT job, seq, CASE WHEN since IS NULL THEN 'running' ELSE 'waiting for the network' END AS phase FROM g WHERE i > 0")
add("x01_event_windows", lambda s, d: _table(s, d, "events").withColumn("start", F.expr("cast(date_trunc('HOUR', ts) as string)")).groupBy("start", "event_type").agg(F.count(F.lit(1)).alias("n")),
    "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
#: Error texts, and whether they speak of the network.
_ERRORS = {
    "dial tcp: lookup x: no such host": True, "dial tcp 1.2.3.4:80: connect: connection refused": True, "read tcp 1.2.3.4:80: connection reset by peer": True, "net/http: TLS handshake timeout": True,
    "context deadline exceeded": True, "http2: client conn not usable": True, "http: server closed idle connection": True, "proxyconnect tcp: EOF": True, "connect: host is unreachable": True,
    "context canceled": False, "404 not found": False, "x509: certificate signed by unknown authority": False, "remote error: tls: handshake failure": False,
    "net/http: HTTP/1.x transport connection broken: malformed HTTP response": False, "http: server gave HTTP response to HTTPS client": False, "tls: unsupported curve": False,
}
_ERROR_TEXTS = "array(" + ", ".join(f"'{e}'" for e in _ERRORS) + ")"
add("p19_transport_error", lambda s, d: _table(s, d, "events").withColumn("err", F.expr(f"get({_ERROR_TEXTS}, int(event_id % {len(_ERRORS) + 1}))")).selectExpr("event_id", f"{rules.transport_error('err')} as transport"),
    f"SELECT event_id, event_id % {len(_ERRORS) + 1} IN ({', '.join(str(i) for i, known in enumerate(_ERRORS.values()) if known)}) AS transport FROM events")

# --- Robots and sitemaps ----------------------------------------------------------------------------------

_ROBOTS = "User-agent: *\nDisallow: /n\nAllow: /nation\nDisallow: /*.pdf$\nCrawl-delay: 2\n# note\nUser-agent: tidebot\nUser-agent: other\nDisallow: /s\nAllow: /sup*a\nDisallow:\nSitemap: https://x.example.com/map.xml\n"


def _robots(s: SparkSession, d: str) -> DataFrame:
    return _table(s, d, "region").select(F.concat(F.lit("o"), F.col("r_regionkey")).alias("origin"), F.lit(_ROBOTS).alias("body"))


_TARGETS = "array('/nation/x', '/n', '/a.pdf', '/a.pdf.b', '/sup/', '/supxa', '/s', '', '/zebra')"


def _checked(s: SparkSession, d: str, agent: str) -> DataFrame:
    targets = _table(s, d, "region").select(F.concat(F.lit("o"), F.col("r_regionkey")).alias("origin"), F.explode(F.expr(_TARGETS)).alias("target"))
    return robots.allowed(targets, robots.rules(robots.directives(_robots(s, d)), agent))


_T = "WITH t AS (SELECT 'o' || r_regionkey AS origin, unnest(['/nation/x', '/n', '/a.pdf', '/a.pdf.b', '/sup/', '/supxa', '/s', '', '/zebra']) AS target FROM region)"
add("d22_robots_groups", lambda s, d: robots.directives(_robots(s, d)).groupBy("origin", "grp").agg(F.count(F.lit(1)).alias("n")).selectExpr("origin", "bigint(grp) as grp", "n"),
    "SELECT 'o' || r_regionkey AS origin, CAST(g AS BIGINT) AS grp, CAST(n AS BIGINT) AS n FROM region, (VALUES (1, 5), (2, 6)) v(g, n)")
add("p12_p13_robots_any", lambda s, d: _checked(s, d, "mozilla"), f"{_T} SELECT origin, target, NOT (target LIKE '%.pdf' OR (target LIKE '/n%' AND target NOT LIKE '/nation%')) AS allowed FROM t")
add("p12_p13_robots_named", lambda s, d: _checked(s, d, "TideBot/1.0"), f"{_T} SELECT origin, target, NOT (target LIKE '/s%' AND NOT target LIKE '/sup%a') AS allowed FROM t")
add("p15_crawl_delay", lambda s, d: robots.rules(robots.directives(_robots(s, d)), "mozilla").select("origin", "delay").distinct(), "SELECT 'o' || r_regionkey AS origin, 2.0::DOUBLE AS delay FROM region")
_MAP = "<?xml version=\"1.0\"?><urlset><url><loc> http://a.example.com/1 </loc><lastmod>2024-01-01</lastmod></url><url><loc>http://a.example.com/2</loc></url></urlset>"
add("s06_sitemap", lambda s, d: _table(s, d, "region").select("r_regionkey", F.explode(F.expr(robots.sitemap_entries(f"if(r_regionkey % 2 = 0, '{_MAP}', 'http://b.example.com/x\\nnone\\n https://b.example.com/y ')"))).alias("e")).selectExpr("r_regionkey", "e.loc as loc", "e.lastmod as lastmod", "e.is_index as is_index"),
    """SELECT r_regionkey, loc, lastmod, false AS is_index FROM region, (VALUES (0, 'http://a.example.com/1', '2024-01-01'), (0, 'http://a.example.com/2', ''), (1, 'http://b.example.com/x', ''), (1, 'https://b.example.com/y', '')) v(k, loc, lastmod) WHERE r_regionkey % 2 = k""")

# --- Closure ----------------------------------------------------------------------------------------------


def _edges(s: SparkSession, d: str) -> DataFrame:
    """Links among part numbers: trees of pages and assets, chains, and links that compete for a key."""
    n = _table(s, d, "part").select(F.col("p_partkey").alias("src"))
    link = lambda dst, page, seq: f"struct({dst} as dst, {page} as page, {seq} as seq)"
    to = [link("src * 2", "true", 1), link("src * 2 + 1", "src % 4 <> 0", 2), link("src * 5 % 997 + 1", "src % 6 <> 0", 3), link("if(src % 11 = 0, src + 1, null)", "src % 2 = 0", 0), link("src * 2", "false", 4)]
    out = n.select("src", F.explode(F.expr(f"array({', '.join(to)})")).alias("x")).select("src", "x.*")
    return out.join(n.select(F.col("src").alias("dst")), "dst", "left_semi")


#: Pages of every seventh key are denied, the same keys as assets are not.
_ALLOW = "not page or dst % 7 <> 0"
#: One queue by depth and turn; the first link to a key claims it.
_WALK = """WITH RECURSIVE p AS (SELECT CAST(p_partkey AS BIGINT) AS k FROM part), e AS (
    SELECT src, dst, page, page AND dst % 7 = 0 AS no, seq FROM (
      SELECT k AS src, 2 * k AS dst, true AS page, 1 AS seq FROM p UNION ALL SELECT k, 2 * k + 1, k % 4 <> 0, 2 FROM p UNION ALL SELECT k, k * 5 % 997 + 1, k % 6 <> 0, 3 FROM p
      UNION ALL SELECT k, k + 1, k % 2 = 0, 0 FROM p WHERE k % 11 = 0 UNION ALL SELECT k, 2 * k, false, 4 FROM p)
    WHERE dst IN (SELECT k FROM p) QUALIFY row_number() OVER (PARTITION BY src, dst ORDER BY seq) = 1
  ), t(key, depth, status, open, wave, parent, pos) USING KEY (key) AS (
    SELECT CAST(1 AS BIGINT), 0, 'done', true, CAST(0 AS BIGINT), CAST(0 AS BIGINT), 0
    UNION (
    WITH r AS (SELECT * FROM recurring.t), q AS (SELECT key, depth, row_number() OVER (ORDER BY wave, parent, pos) AS id FROM r WHERE open AND depth = (SELECT min(depth) FROM r WHERE open)),
      f AS (SELECT e.dst, CASE WHEN page THEN depth + 1 ELSE depth END AS depth, no OR (page AND depth + 1 > {most}) AS no, id AS parent, seq FROM q JOIN e ON e.src = q.key WHERE e.dst NOT IN (SELECT key FROM r)),
      c AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY dst ORDER BY parent, seq) = 1)
    SELECT r.key, r.depth, r.status, false, r.wave, r.parent, r.pos FROM r JOIN q USING (key)
    UNION ALL SELECT dst, depth, CASE WHEN no THEN 'skipped' ELSE 'done' END, NOT no, (SELECT max(wave) + 1 FROM r), parent, seq FROM c)
  )"""
add("f01_closure", lambda s, d: closure.closure(s.createDataFrame([(1,)], "key bigint"), _edges(s, d), F.expr(_ALLOW)), _WALK.format(most=1_000_000) + " SELECT key, depth, status FROM t")
add("f02_depth_limit", lambda s, d: closure.closure(s.createDataFrame([(1,)], "key bigint"), _edges(s, d), F.expr(_ALLOW), max_depth=4).groupBy("depth", "status").agg(F.count(F.lit(1)).alias("n")),
    _WALK.format(most=4) + " SELECT depth, status, count(*) AS n FROM t GROUP BY ALL")

# --- Paths, rewriting, audit ----------------------------------------------------------------------------------

_FLAT = Settings(replace_special=True)


def _pathed(s: SparkSession, d: str) -> DataFrame:
    return paths.with_path(resolved(s, d).where("u_url is not null").withColumn("media_type", F.lit("text/html")), _FLAT)


_NAME = "CASE WHEN u_path LIKE '%/' THEN 'index.html' ELSE regexp_extract(u_path, '([^/]*)$', 1) END"
_SAFE = "regexp_replace(regexp_replace({0}, '[/\\\\:*?\"<>|#%]', '_', 'g'), '[. ]+$', '')"
_SAFE = "regexp_replace(" + _SAFE + ", '^((?i)con|prn|aux|nul|com[1-9]|lpt[1-9])(\\.|$)', '_\\1\\2')"
_HTML = f"CASE WHEN regexp_matches(lower({_SAFE.format(_NAME)}), '\\.(html|htm|xhtml)$') THEN {_SAFE.format(_NAME)} ELSE {_SAFE.format(_NAME)} || '.html' END"
_QS = "regexp_replace(u_query, '[^A-Za-z0-9._=&,-]', '-', 'g')"
_PATH_SQL = f"""(SELECT page_id, ref, u_key, regexp_replace(u_host || CASE WHEN u_port <> '' THEN '_' || u_port ELSE '' END, ':', '_') || '/' || regexp_replace(substr(regexp_extract(u_path, '^(.*/)', 1), 2), '[:*?"<>|#%]', '_', 'g')
  || CASE WHEN u_query = '' THEN {_HTML} ELSE regexp_replace({_HTML}, '(\\.[^./]*)$', '') || '@' || {_QS} || regexp_extract({_HTML}, '(\\.[^./]*)$', 1) END AS path FROM links WHERE u_url IS NOT NULL)"""
add("m01_path", lambda s, d: _pathed(s, d).select("page_id", "ref", "path"), f"WITH {LINKS_SQL} SELECT page_id, ref, path FROM {_PATH_SQL}")
add("m10_collisions", lambda s, d: paths.disambiguated(_pathed(s, d).withColumn("path", F.expr("concat('f', page_id % 20, '.html')")).select("u_key", "path", "page_id").groupBy("u_key").agg(F.min("page_id").alias("page_id"), F.min("path").alias("path")), "u_key", "page_id").groupBy("path").agg(F.count(F.lit(1)).alias("n")),
    f"""WITH {LINKS_SQL}, k AS (SELECT u_key, min(page_id) AS page_id, min('f' || page_id % 20 || '.html') AS path FROM links WHERE u_url IS NOT NULL GROUP BY u_key),
    r AS (SELECT path, row_number() OVER (PARTITION BY path ORDER BY page_id, u_key) - 1 AS i FROM k)
    SELECT CASE WHEN i = 0 THEN path ELSE replace(path, '.html', '~' || i || '.html') END AS path, count(*) AS n FROM r GROUP BY 1""")
_HERE = "if(page_id % 2 = 0, 'a/b/c.html', concat(u_host, '/c.html'))"
add("m11_relative_link", lambda s, d: resolved(s, d).where("u_url is not null and u_path not like '%/'").selectExpr("page_id", "ref", f"{paths.relative_link(_HERE, 'concat(u_host, u_path)')} as link"),
    f"""WITH {LINKS_SQL} SELECT page_id, ref, array_to_string(list_transform(string_split(CASE WHEN page_id % 2 = 0 THEN '../../' || u_host || u_path WHEN u_path LIKE '/.%' THEN substr(u_path, 2) ELSE '.' || u_path END, ''), lambda c: CASE WHEN unicode(c) > 127 OR c IN (' ', '%', '?', '#', '\') THEN url_encode(c) ELSE c END), '') AS link FROM links WHERE u_url IS NOT NULL AND u_path NOT LIKE '%/'""")
_ESCAPES = "array(path, concat('../', path), concat('x/../../', path), concat('/', path), concat(path, '/..'), concat('x..y/', path), '..')"
add("k06_contained", lambda s, d: _pathed(s, d).select("page_id", "ref", F.posexplode(F.expr(_ESCAPES)).alias("k", "p")).selectExpr("page_id", "ref", "k", f"{paths.contained('p')} as inside"),
    f"WITH {LINKS_SQL} SELECT page_id, ref, CAST(k AS INT) AS k, k IN (0, 5) AS inside FROM links, range(7) r(k) WHERE u_url IS NOT NULL")


def _saved(s: SparkSession, d: str) -> DataFrame:
    """A job that kept whatever was served without encryption."""
    return resolved(s, d).where("u_url like 'http://%'").groupBy(F.col("u_key").alias("key")).agg(F.concat(F.lit("p/"), F.md5(F.first("u_key")), F.lit(".html")).alias("path")).withColumn("status", F.lit("done"))


def _targets(s: SparkSession, d: str) -> DataFrame:
    return rewrite.local_paths(resolved(s, d).where("u_url is not null"), _saved(s, d), Settings())


add("j01_local_paths", lambda s, d: _targets(s, d).select("page_id", "ref", "target"),
    f"""WITH {LINKS_SQL}, s AS (SELECT DISTINCT u_key AS key FROM links WHERE u_url LIKE 'http://%')
    SELECT page_id, ref, CASE WHEN u_url IN (SELECT key FROM s) THEN 'p/' || md5(u_url) || '.html' WHEN u_key IN (SELECT key FROM s) THEN 'p/' || md5(u_key) || '.html' END AS target FROM links WHERE u_url IS NOT NULL""")


def _decisions(s: SparkSession, d: str) -> DataFrame:
    rows = _targets(s, d).withColumns({"value": F.col("ref"), "kind": F.lit("anchor"), "tag": F.lit("a"), "attr": F.lit("href"), "doc_path": F.lit("p/x.html")})
    return rewrite.decided(rows, Settings())


add("r04_decisions", lambda s, d: _decisions(s, d).groupBy("outcome").agg(F.count(F.lit(1)).alias("n")),
    f"""WITH {LINKS_SQL}, s AS (SELECT DISTINCT u_key AS key FROM links WHERE u_url LIKE 'http://%')
    SELECT CASE WHEN u_url IN (SELECT key FROM s) OR u_key IN (SELECT key FROM s) THEN 'local' ELSE 'remote' END AS outcome, count(*) AS n FROM links WHERE u_url IS NOT NULL GROUP BY 1""")
add("a04_unresolved_hosts", lambda s, d: _decisions(s, d).where("outcome = 'remote'").groupBy("u_host").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "u_host").limit(5),
    f"""WITH {LINKS_SQL}, s AS (SELECT DISTINCT u_key AS key FROM links WHERE u_url LIKE 'http://%')
    SELECT u_host, count(*) AS n FROM links WHERE u_url IS NOT NULL AND u_url NOT IN (SELECT key FROM s) AND u_key NOT IN (SELECT key FROM s) GROUP BY 1 ORDER BY n DESC, u_host LIMIT 5""")


def _rewritten(s: SparkSession, d: str) -> DataFrame:
    docs = _table(s, d, "pages").selectExpr("page_id as doc_id", "url", "concat('p/', page_id, '.html') as path", "html as body")
    return rewrite.rewritten(docs, _saved(s, d), Settings())


# What a link of a page in p/ becomes: the saved file, or where it led.
_NEW = f"""{LINKS_SQL}, saved AS (SELECT DISTINCT u_key AS key FROM links WHERE u_url LIKE 'http://%'), turned AS (
    SELECT DISTINCT page_id, ref, CASE WHEN u_url IN (SELECT key FROM saved) THEN './' || md5(u_url) || '.html' WHEN u_key IN (SELECT key FROM saved) THEN './' || md5(u_key) || '.html' ELSE u_url END
      || CASE WHEN ref LIKE '%#%' THEN regexp_extract(ref, '#.*$') ELSE '' END AS new FROM links WHERE u_url IS NOT NULL
  )"""
add("r02_rewrite_html", lambda s, d: _rewritten(s, d).selectExpr("doc_id", "changed", "octet_length(body) as size", "md5(body) as digest"),
    rf"""WITH {_NEW}, m AS (SELECT page_id, map(list(ref), list(replace(replace(replace(replace(new, '&', '&amp;'), '"', '&quot;'), '<', '&lt;'), '>', '&gt;'))) AS m FROM turned GROUP BY page_id),
    f AS (SELECT page_id, html, string_split_regex(html, '{ANCHOR}') AS between, regexp_extract_all(html, '(?i)(<a\b[^>]*?\bhref=")[^"]*"', 1) AS heads, regexp_extract_all(html, '{ANCHOR}', 1) AS refs FROM pages),
    b AS (SELECT page_id, html, array_to_string(list_transform(range(1, len(refs) + 1), lambda i: between[i] || heads[i] || coalesce(element_at(m, refs[i])[1], refs[i]) || '"'), '') || between[len(refs) + 1] AS body FROM f JOIN m USING (page_id))
    SELECT page_id AS doc_id, body <> html AS changed, CAST(strlen(body) AS INT) AS size, md5(body) AS digest FROM b""")
_SHEET = "'/* url(no) */ @import \"' || ref || '\"; .a{b:url( ' || chr(39) || ref || chr(39) || ' )} .c{d:url(data:x)}'"


def _sheets(s: SparkSession, d: str) -> DataFrame:
    """A style sheet in p/ for every link, which imports and shows what it leads to."""
    sheet = resolved(s, d).select("page_id", "ref", "base").distinct().selectExpr("to_json(struct(page_id, ref)) as doc_id", "page_id", "ref", "base as url", "concat('p/', page_id, '.css') as path", f"{_SHEET} as body")
    return rewrite.rewritten(sheet, _saved(s, d), Settings(), css=True)


add("r03_rewrite_css", lambda s, d: _sheets(s, d).selectExpr("page_id", "ref", "changed", "cast(body as string) as body"),
    f"""WITH {_NEW}, e AS (SELECT DISTINCT l.page_id, l.ref, coalesce(replace(replace(replace(replace(replace(new, ' ', '%20'), '(', '%28'), ')', '%29'), '"', '%22'), chr(39), '%27'), l.ref) AS x FROM links l LEFT JOIN turned t ON t.page_id = l.page_id AND t.ref = l.ref)
    SELECT page_id, ref, {_SHEET.replace("ref", "x")} <> {_SHEET} AS changed, {_SHEET.replace("ref", "x")} AS body FROM e""")
add("r06_escape", lambda s, d: _table(s, d, "pages").selectExpr("page_id", f"md5({rewrite.attribute_escaped('html')}) as attr"),
    "SELECT page_id, md5(replace(replace(replace(replace(html, '&', '&amp;'), '\"', '&quot;'), '<', '&lt;'), '>', '&gt;')) AS attr FROM pages")
add("r07_substitute", lambda s, d: _table(s, d, "pages").selectExpr("page_id", f"md5({rewrite.substituted('html', [('<b>', '<strong>', False), ('[0-9]+', 'N', True)])}) as digest"),
    "SELECT page_id, md5(regexp_replace(replace(html, '<b>', '<strong>'), '[0-9]+', 'N', 'g')) AS digest FROM pages")
add("r08_banner", lambda s, d: _table(s, d, "pages").selectExpr("page_id", f"length({rewrite.with_banner('html', 'Offline', 'url')}) - length(html) as added", f"{rewrite.with_banner('html', 'Offline', 'url')} like '%<body><div%' as inside"),
    "SELECT page_id, CAST(length('<div class=\"offline-note\">Offline &middot; <a href=\"\"></a></div>') + 2 * length(replace(url, '&', '&amp;')) AS INT) AS added, html LIKE '%<body>%' AS inside FROM pages")
add("r10_interval", lambda s, d: _table(s, d, "events").selectExpr("event_id", rewrite.next_interval("300", "value") + " as next"), "SELECT event_id, CASE WHEN value > 75 THEN 600 ELSE 300 END AS next FROM events")


def _audit(s: SparkSession, d: str) -> DataFrame:
    found = resolved(s, d).selectExpr("concat('p/', page_id, '.html') as doc_path", "ref as value")
    return rewrite.audited(found, s.createDataFrame([("p/img/Photo.JPG",), ("p/a b/ü.php",)], "path string"))


_AUDIT = f"""WITH {LINKS_SQL}, c AS (SELECT 'p/' || page_id || '.html' AS doc_path, CASE WHEN ref LIKE '%://%' THEN 'remote' WHEN ref LIKE '/%' THEN 'site_absolute' WHEN regexp_replace(ref, '#.*$', '') LIKE '%?%' THEN 'query_left'
  WHEN ref IN ('img/Photo.JPG', 'a b/ü.php') THEN 'ok' ELSE 'missing' END AS class FROM links WHERE ref <> '' AND NOT regexp_matches(ref, '^(#|data:|javascript:|mailto:)'))"""
add("c01_audit", lambda s, d: rewrite.audit_totals(_audit(s, d)), _AUDIT + " SELECT count(*) AS links, " + ", ".join(f"count(*) FILTER (class = '{c}') AS {c}" for c in rewrite.CLASSES) + " FROM c")
add("a06_audit_classes", lambda s, d: _audit(s, d).groupBy("class").agg(F.count(F.lit(1)).alias("n")), _AUDIT + " SELECT class, count(*) AS n FROM c GROUP BY 1")
add("a07_worst_files", lambda s, d: rewrite.worst_files(_audit(s, d)), _AUDIT + " SELECT doc_path, count(*) AS n FROM c WHERE class IN ('site_absolute', 'query_left', 'missing') GROUP BY 1 ORDER BY n DESC, doc_path LIMIT 10")

# --- Formats ------------------------------------------------------------------------------------------------------

_P = "SELECT p_partkey, "


def _format(name: str, expr: str, sql: str, table: str = "part", key: str = "p_partkey") -> None:
    add(name, lambda s, d: _table(s, d, table).selectExpr(key, f"{expr} as v"), f"SELECT {key}, {sql} AS v FROM {table}")


_N = "p_partkey * p_partkey * 977"
_format("f11_parse_bytes", formats.parse_bytes("concat(p_size, element_at(array('KB', 'm', ' GB', '', 'b'), int(p_partkey % 5 + 1)))"), "CAST(CAST(p_size AS BIGINT) * [1024, 1048576, 1073741824, 1, 1][p_partkey % 5 + 1] AS BIGINT)")
_format("f12_exact_bytes", formats.exact_bytes("(p_size * if(p_partkey % 2 = 0, 1024L, 1048576L))"), "CASE WHEN p_size * (CASE WHEN p_partkey % 2 = 0 THEN 1024 ELSE 1048576 END) % 1048576 = 0 THEN (p_size * (CASE WHEN p_partkey % 2 = 0 THEN 1024 ELSE 1048576 END) // 1048576) || 'MB' ELSE p_size || 'KB' END")
_format("f13_human_bytes", formats.human_bytes("(p_size * 512L)"), "CASE WHEN p_size * 512 < 1024 THEN p_size * 512 || ' B' ELSE (p_size // 2) || CASE WHEN p_size % 2 = 0 THEN '.0' ELSE '.5' END || ' KB' END")
_format("f14_short_duration", formats.short_duration("p_partkey * 7"), "CASE WHEN p_partkey * 7 >= 3600 THEN (p_partkey * 7 // 3600) || 'h' || lpad(CAST(p_partkey * 7 % 3600 // 60 AS VARCHAR), 2, '0') || 'm' WHEN p_partkey * 7 >= 60 THEN (p_partkey * 7 // 60) || 'm' || lpad(CAST(p_partkey * 7 % 60 AS VARCHAR), 2, '0') || 's' ELSE p_partkey * 7 || 's' END")
_format("f10_parse_duration", formats.parse_seconds("element_at(array(concat(p_size, 'm'), concat(p_size, ' seconds'), concat('1h', p_size, 'm'), string(p_size)), int(p_partkey % 4 + 1))"), "CAST([p_size * 60, p_size, 3600 + p_size * 60, p_size][p_partkey % 4 + 1] AS DOUBLE)")
_format("f15_short_type", formats.short_type("element_at(array('text/html; charset=x', 'application/x-tar', 'application/vnd.rar'), int(p_partkey % 3 + 1))"), "['html', 'tar', 'rar'][p_partkey % 3 + 1]")
_format("f16_truncate", formats.truncated("p_name", 12), "CASE WHEN length(p_name) <= 12 THEN p_name ELSE left(p_name, 11) || '…' END")
_format("f16_truncate_left", formats.truncated_left("p_name", 12), "CASE WHEN length(p_name) <= 12 THEN p_name ELSE '…' || right(p_name, 11) END")
_format("f17_short_reason", formats.short_reason("concat('get x: ', repeat(p_name, 9))"), "CASE WHEN strlen(repeat(p_name, 9)) > 80 THEN left(repeat(p_name, 9), 80) || '...' ELSE repeat(p_name, 9) END")
_format("f18_content_type", formats.content_type("concat('Text/', p_name, '; charset=utf-8')"), "lower('text/' || p_name)")
_format("f18_disposition", formats.disposition_name("concat('attachment; filename=', chr(34), p_brand, chr(34))"), "p_brand")
_format("f20_backoff", formats.backoff("0.5D", "(p_partkey % 9 + 1)", "30D"), "least(0.5 * pow(2, p_partkey % 9), 30)::DOUBLE")
_format("f21_eta", formats.eta("p_size", "if(p_partkey % 2 = 0, 0D, 2D)"), "CASE WHEN p_partkey % 2 = 0 THEN NULL ELSE p_size / 2.0::DOUBLE END")
_format("f24_job_name", formats.job_name("concat(' ', p_name, '/', p_type)"), "trim(regexp_replace(' ' || p_name || '/' || p_type, '[^A-Za-z0-9._-]+', '-', 'g'), '-')")
_format("f26_level_rank", formats.level_rank("element_at(array('debug', 'info', 'warn', 'error'), int(p_partkey % 4 + 1))"), "CAST(p_partkey % 4 AS INT)")
_format("j12_extension_of_type", f"coalesce({formats.lookup('element_at(array(' + chr(39) + 'image/png' + chr(39) + ', ' + chr(39) + 'font/woff2' + chr(39) + ', ' + chr(39) + 'x/y' + chr(39) + '), int(p_partkey % 3 + 1))', formats.EXTENSIONS)}, '-')", "['.png', '.woff2', '-'][p_partkey % 3 + 1]")
_format("m04_safe_segment", paths.safe_segment("concat(p_name, ':', if(p_partkey % 2 = 0, '. ', '?'))", _FLAT), "CASE WHEN p_partkey % 2 = 0 THEN p_name || '_' ELSE p_name || '__' END")
_format("m05_truncate_segment", paths.safe_segment("concat(repeat(p_name, 30), '.txt')", _FLAT), "CASE WHEN length(repeat(p_name, 30)) + 4 <= 120 THEN repeat(p_name, 30) || '.txt' ELSE left(repeat(p_name, 30), 107) || '-' || left(sha1(repeat(p_name, 30) || '.txt'), 8) || '.txt' END")
_format("s09_cookie_pairs", "size(" + files.cookie_pairs("concat('a=1; b=', p_size, '; =x; c')") + ")", "CAST(3 AS INT)")
_format("s13_request_dedupe", "array_join(" + files.requests_of_page("array('/a', '', 'data:x', concat('/', p_size), '/a')") + ", ' ')", "'/a /' || p_size")

# --- Streams -------------------------------------------------------------------------------------------------------


def _streamed(s: SparkSession, d: str) -> DataFrame:
    """The host-health fold over a stream of the event files; the last state of each host."""
    from uuid import uuid4

    events = s.readStream.schema(live.EVENTS).option("pathGlobFilter", "events*").parquet(f"{d}/events.parquet" if _is_folder(s, f"{d}/events.parquet") else d)
    stream = live.host_health(events.selectExpr("user_id as host", "event_type <> 'error' as ok"))
    out = live.drained(stream, f"health_{uuid4().hex}")
    return out.groupBy("host").agg(F.max_by(F.struct("successes", "failures", "dead"), F.col("successes") + F.col("failures")).alias("r")).select("host", "r.*")


def _is_folder(s: SparkSession, path: str) -> bool:
    p = s._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(s._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory()


add("x03_host_health_stream", _streamed, ORACLE["x03_host_health"])
