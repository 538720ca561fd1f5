"""One object for the jobs of a mirror: crawl, rewrite, audit, status and lists.

Responses stand in for the network. Their links are extracted, resolved and judged once, for all
stored documents together; the crawl is then a closure over that edge table, and every other job
is a query over its entries.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import urls
from tidemark.operators import closure, paths, rewrite, robots, rules, scan, state
from tidemark.plans.config import Settings
from tidemark.runtime import stash, where_computed


@dataclass(frozen=True)
class Mirror:
    """``responses`` is (url, status, media_type, body); ``robots_raw`` is (origin, body)."""

    spark: SparkSession
    settings: Settings
    responses: DataFrame
    robots_raw: DataFrame | None = None

    def documents(self) -> DataFrame:
        """Responses with the parts of their URLs; one for each key."""
        kept = where_computed(urls.with_url(self.responses, "url"), F.col("u_key").isNotNull())
        return kept.groupBy("u_key").agg(F.min_by(F.struct(*[c for c in kept.columns if c != "u_key"]), "url").alias("r")).select("u_key", "r.*")

    def links(self) -> DataFrame:
        """(doc_key, value, kind, role, u_...) of every stored page and style sheet."""
        found = []
        for css, test in ((False, "media_type like 'text/html%'"), (True, "media_type like 'text/css%'")):
            docs = self.documents().where(test).select(F.col("u_key").alias("doc_key"), F.col("u_url").alias("doc_url"), "body")
            rows = scan.scanned(docs, "body", css).select("doc_key", "doc_url", F.col("base").alias("base_ref"), F.explode("links").alias("l"))
            found.append(rows.select("doc_key", "doc_url", "base_ref", "l.*"))
        rows = found[0].unionByName(found[1]).where("kind <> 'base'")
        if not self.settings.follow_forms:
            rows = rows.where("kind <> 'form'")
        if self.settings.respect_nofollow:
            rows = rows.where("not nofollow")
        rows = urls.with_url(rows, "base_ref", "doc_url", "b_").withColumn("_base", F.coalesce("b_url", "doc_url"))
        rows = stash(rows.drop(*[f"b_{p}" for p in urls.PARTS]), "scanned")
        rows = stash(urls.with_url(rows, "value", "_base"), "resolved").where("u_url is not null")
        query, stem = F.expr(rules.queue_query(self.settings, "u_query")), F.substring_index("u_url", "?", 1)
        rows = rows.withColumn("_q", query).withColumn("_norm", F.when(F.col("_q") == "", stem).otherwise(F.concat(stem, F.lit("?"), F.col("_q"))))
        rows = urls.with_url(rows.drop("_q", *[f"u_{p}" for p in urls.PARTS]), "_norm").drop("_norm")
        return stash(rows.withColumn("role", F.expr(rules.kind_role("kind", "u_path"))).drop("_base", "base_ref"), "links")

    def crawl(self) -> DataFrame:
        """Entries (key, url, status, depth, path, reason) of all that the start URLs lead to."""
        s = self.settings
        links = self.links()
        origin = F.expr("regexp_extract(doc_key, '^[a-z]+://([^/]*)', 1)")
        judged = stash(links.withColumn("from_origin", origin).withColumn("reason", F.expr(rules.scope_reason(s, "role", "0", "from_origin"))), "judged")
        if self.robots_raw is not None:
            own = robots.rules(robots.directives(self.robots_raw), s.user_agent)
            site = F.expr("concat(u_scheme, '://', u_origin)")
            target = F.expr("concat(u_path, if(u_query <> '', concat('?', u_query), ''))")
            judged = robots.allowed(judged.withColumns({"origin": site, "target": target}), own)
            judged = judged.withColumn("reason", F.expr("coalesce(reason, if(allowed, null, 'robots'))"))
        edges = stash(judged.select(F.col("doc_key").alias("src"), F.col("u_key").alias("dst"), (F.col("role") == "page").alias("page"), F.col("start").alias("seq"), "reason", "u_url"), "edges")
        starts = urls.with_url(self.spark.createDataFrame([(u,) for u in s.start_urls], "raw string"), "raw")
        reached = closure.closure(starts.select(F.col("u_key").alias("key")), edges.select("src", "dst", "page", "seq", "reason"), F.col("reason").isNull(), s.max_levels or None)
        why = edges.groupBy(F.col("dst").alias("key")).agg(F.min("reason").alias("reason"), F.min("u_url").alias("link"))
        docs = self.documents().withColumnRenamed("u_key", "key")
        held = paths.with_path(docs, s).select("key", "u_url", "media_type", "status", "path", F.octet_length("body").cast("bigint").alias("size"))
        out = reached.withColumnRenamed("status", "verdict").join(held, "key", "left").join(why, "key", "left")
        status = "case when verdict = 'skipped' then 'skipped' when status between 200 and 299 then 'done' else 'failed' end"
        return out.select(
            "key", F.coalesce("u_url", "link", "key").alias("url"), F.expr(status).alias("status"), "depth", "media_type", F.coalesce("size", F.lit(0)).alias("size"),
            F.expr(f"if({status} = 'done', path, '')").alias("path"), F.expr("if(verdict = 'skipped', reason, null)").alias("reason"),
            F.expr(f"if({status} = 'failed', 'http', 'ok')").alias("err_kind"), F.expr("if(status is null, 'not stored', concat('status ', status))").alias("err"),
            F.lit(False).alias("alias"), F.lit(False).alias("localized"),
        )

    def localize(self, entries: DataFrame) -> DataFrame:
        """(doc_id, url, path, body, changed): saved pages and style sheets with their links turned
        to saved files."""
        saved = entries.where("status = 'done'").select("key", F.col("path").alias("_path"))
        docs = self.documents().join(saved, F.col("u_key") == F.col("key")).select(F.col("u_key").alias("doc_id"), F.col("u_url").alias("url"), F.col("_path").alias("path"), "media_type", "body")
        docs = stash(docs.where("media_type like 'text/html%' or media_type like 'text/css%'"), "saved")
        kinds = [(False, "text/html%"), (True, "text/css%")]
        done = [rewrite.rewritten(docs.where(f"media_type like '{kind}'").drop("media_type"), entries, self.settings, css) for css, kind in kinds]
        return done[0].unionByName(done[1])

    def check(self, mirror: DataFrame) -> DataFrame:
        """The class of every link in saved pages (path, body)."""
        docs = mirror.where("path like '%.html'").select(F.col("path").alias("doc_path"), "body")
        links = scan.scanned(docs, "body").select("doc_path", F.explode("links").alias("l")).select("doc_path", "l.value")
        return rewrite.audited(links, mirror.select("path"))

    def status(self, entries: DataFrame) -> DataFrame:
        return state.verdict(state.statistics(entries))

    def entries(self, entries: DataFrame, status: str = "", q: str = "", limit: int = 500) -> DataFrame:
        return state.listing(entries, status, q, limit)

    def recent_events(self, events: DataFrame, n: int = 200) -> DataFrame:
        return events.orderBy(F.desc("ts"), F.desc("event_id")).limit(n)

    def retry(self, changes: dict | None = None) -> Mirror:
        """The same mirror, its settings changed for another pass."""
        return replace(self, settings=replace(self.settings, **(changes or {})).validated())
