"""Breadth-first closure of a site over a table of edges or of stored responses.

The driver only runs the loop: each wave is one plan that removes what was seen, decides, and
claims each new key once, and is written out, so neither lineage nor the driver grows with the
site. Keys, depths and claim order travel; bodies never do.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tidemark.functions import urls
from tidemark.operators import rules
from tidemark.runtime import shuffle_width, stash
from tidemark.sources.files import requests_of_page


#: A wave of at most so many keys is put in order in one task; a larger one by ranges.
ONE_TASK = 100_000
#: So many edges at most, and as many seeds, are walked in one task.
EDGES_ONE_TASK = 200_000


def closure(seeds: DataFrame, edges: DataFrame, allow: Column | None = None, max_depth: int | None = None) -> DataFrame:
    """(key, depth, status): all that ``seeds`` (key) reach through ``edges`` (src, dst, page, seq).

    A page link is one deeper than its page, an asset as deep. Keys are taken up by depth, then in
    the order they were claimed; the first link to a key, by its document's turn and then by
    ``seq`` (0 where the column is missing, ties by key), claims it for good, whatever a later one
    would allow. A denied key is recorded as skipped and doesn't lead on. Seeds are exempt, at
    depth 0, in the order of their keys.

    Up to ``EDGES_ONE_TASK`` edges, checked by their count, are walked in one task. More go in waves:
    a wave is what is queued at the least depth. Assets it finds are the next wave, the pages wait
    for the next depth. An empty table of seeds gives an empty result; null keys are left out.
    """
    allow = F.lit(True) if allow is None else allow
    seq = F.col("seq").cast("bigint") if "seq" in edges.columns else F.lit(0).cast("bigint")
    edges = edges.select("src", "dst", F.coalesce("page", F.lit(True)).alias("page"), allow.alias("ok"), seq.alias("pos")).where("src is not null and dst is not null")
    # Of several links from one document to one key the first decides.
    first = F.min(F.struct(F.coalesce("pos", F.lit(0)).alias("pos"), (~F.coalesce("ok", F.lit(False))).alias("no"), (~F.col("page")).alias("asset"))).alias("e")
    edges = stash(edges.groupBy("src", "dst").agg(first).select("src", "dst", "e.*"), "edges")
    start = seeds.select("key").where("key is not null").distinct()
    if edges.count() <= EDGES_ONE_TASK and start.count() <= EDGES_ONE_TASK:
        return stash(_walked(start, edges, max_depth), "seen")
    seen = stash(start.selectExpr("key", "0 as depth", "'done' as status", "0 as wave", "0L as parent", "0L as pos"), "wave")
    queue, depth, waves = seen, 0, 1
    count = queue.count()
    while count:
        found = _in_turn(queue, count).join(edges, F.col("key") == F.col("src")).select(
            F.col("dst").alias("key"), F.expr(f"if(asset, {depth}, {depth + 1})").alias("depth"), "no", F.col("id").alias("parent"), edges["pos"]
        )
        if max_depth is not None:
            found = found.withColumn("no", F.col("no") | (F.col("depth") > max_depth))
        new = found.join(seen.select("key"), "key", "left_anti").groupBy("key").agg(F.min(F.struct("parent", "pos", "depth", "no")).alias("m"))
        wave = stash(new.selectExpr("key", "m.depth", "if(m.no, 'skipped', 'done') as status", f"{waves} as wave", "m.parent", "m.pos"), "wave")
        waves += 1
        seen = seen.unionByName(wave)
        if waves % 8 == 0:
            seen = stash(seen, "seen")
        queue = wave.where(f"status = 'done' and depth = {depth}")
        count = queue.count()
        if not count:
            # All waves of this depth are over; what they queued deeper is next.
            depth += 1
            queue = seen.where(f"status = 'done' and depth = {depth}")
            count = queue.count()
    return seen.select("key", "depth", "status")


def _walked(start: DataFrame, edges: DataFrame, max_depth: int | None) -> DataFrame:
    """The closure by one queue: the same as by waves."""
    kind = start.schema["key"].dataType
    rows = start.selectExpr("key as src", f"cast(null as {edges.schema['dst'].dataType.simpleString()}) as dst", "0L as pos", "false as no", "false as asset")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        links, seeds, count = {}, [], 0
        for batch in batches:
            for src, dst, pos, no, asset in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if dst is None:
                    seeds.append(src)
                else:
                    links.setdefault(src, []).append((pos, dst, no, asset))
        seen = {key: (0, "done") for key in seeds}
        queue = [(0, n, key) for n, key in enumerate(sorted(seeds))]
        count = len(queue)
        while queue:
            depth, _, key = heapq.heappop(queue)
            for _, dst, no, asset in sorted(links.get(key, ())):
                if dst not in seen:
                    at = depth if asset else depth + 1
                    no = no or (max_depth is not None and at > max_depth)
                    seen[dst] = at, "skipped" if no else "done"
                    if not no:
                        heapq.heappush(queue, (at, count, dst))
                        count += 1
        columns = [list(seen), [d for d, _ in seen.values()], [x for _, x in seen.values()]]
        yield pa.RecordBatch.from_arrays([pa.array(columns[0], to_arrow_type(kind)), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.string())], ["key", "depth", "status"])

    both = rows.unionByName(edges).repartition(1)
    return both.mapInArrow(run, f"key {kind.simpleString()}, depth int, status string")


def _in_turn(queue: DataFrame, count: int) -> DataFrame:
    """(key, id): ids rise in the order in which the queue is taken up."""
    order = ["wave", "parent", "pos", "key"]
    dealt = queue.coalesce(1) if count <= ONE_TASK else queue.repartitionByRange(shuffle_width(queue.sparkSession), *order)
    return dealt.sortWithinPartitions(*order).select("key", F.monotonically_increasing_id().alias("id"))


def crawl_edges(links: DataFrame) -> DataFrame:
    """(src, dst, page, seq) from resolved links (doc_key, u_key, role, pos): the first of a
    document's links to a key tells its role."""
    one = F.min(F.struct("pos", (F.col("role") != "page").alias("asset"))).alias("m")
    return links.where("u_key is not null").groupBy(F.col("doc_key").alias("src"), F.col("u_key").alias("dst")).agg(one).select("src", "dst", (~F.col("m.asset")).alias("page"), F.col("m.pos").alias("seq"))


def claimed(frontier: DataFrame, seen: DataFrame) -> DataFrame:
    """New keys of a frontier (key, depth, seq, ...): each once, its first discovery."""
    rest = [c for c in frontier.columns if c != "key"]
    return frontier.join(seen.select("key"), "key", "left_anti").groupBy("key").agg(F.min_by(F.struct(*rest), F.struct("depth", "seq")).alias("_r")).select("key", "_r.*")


def requested(rendered: DataFrame, url: str = "url", depth: str = "depth", requests: str = "requests") -> DataFrame:
    """The frontier rows of what rendered pages asked for: each page's requests once, without the
    page itself, with role and depth; a page lies one below the page that asked for it."""
    rows = rendered.withColumn("_asked", F.expr(f"explode({requests_of_page(requests)})")).drop(requests)
    rows = urls.with_url(rows.withColumn("_page", F.col(url)), "_page")
    rows = rows.withColumn("_self", F.col("u_url")).drop(*[c for c in rows.columns if c.startswith("u_")])
    rows = urls.with_url(rows, "_asked", url).where("u_url is not null and not u_url <=> _self").drop("_asked", "_page", "_self")
    return rows.withColumn("role", F.expr(rules.guessed_role("u_path"))).withColumn(depth, F.expr(f"{depth} + if(role = 'page', 1, 0)"))
