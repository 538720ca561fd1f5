"""Link rewriting: look targets up, decide, and splice the bytes; and the audit of the result."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import urls
from tidemark.operators import paths, scan
from tidemark.plans.config import Settings
from tidemark.runtime import small_batches, stash

#: Whole pages that go to Python at once.
PAGES = 256


def attribute_escaped(s: str) -> str:
    return f"""replace(replace(replace(replace({s}, '&', '&amp;'), '"', '&quot;'), '<', '&lt;'), '>', '&gt;')"""


def css_escaped(s: str) -> str:
    return f"replace(replace(replace(replace(replace({s}, ' ', '%20'), '(', '%28'), ')', '%29'), '\"', '%22'), chr(39), '%27')"


def local_paths(links: DataFrame, entries: DataFrame, s: Settings) -> DataFrame:
    """``links`` with ``target``: the saved path of a link's normalized key, else of its plain key,
    else of its literal URL.

    All three follow from the URL, so each distinct URL is looked up once, by whichever of them
    differ, and what was found is joined back by URL; the few paths found may be broadcast.
    """
    # Written once: scanning and resolving are read twice, and filters would repeat their expressions.
    links = stash(links, "resolved")
    query = F.expr(f"if(u_query = '', '', {urls_query(s)})")
    stem = F.expr("if(instr(u_url, '?') > 0, substring_index(u_url, '?', 1), u_url)")
    normal = F.concat(stem, F.when(F.col("_q") != "", F.concat(F.lit("?"), F.col("_q"))).otherwise(F.lit("")))
    wanted = links.where("u_url is not null").withColumn("_q", query).select("u_url", F.array_compact(F.array_distinct(F.array(normal, F.col("u_key"), F.col("u_url")))).alias("_keys"))
    tried = wanted.groupBy("u_url").agg(F.first("_keys").alias("_keys")).select("u_url", F.posexplode("_keys").alias("_rank", "key"))
    saved = entries.where("status = 'done' and path <> ''").select("key", F.col("path").alias("_p"))
    best = stash(tried.join(saved, "key").groupBy("u_url").agg(F.min_by("_p", F.struct("_rank", "_p")).alias("target")), "targets")
    return links.join(best, "u_url", "left")


def urls_query(s: Settings) -> str:
    from tidemark.operators.rules import queue_query

    return queue_query(s, "u_query")


def decided(links: DataFrame, s: Settings, doc_path: str = "doc_path") -> DataFrame:
    """``links`` with ``text``, what a link becomes (null: it stays), and ``outcome``."""
    fragment = "if(instr(value, '#') > 0, substr(value, instr(value, '#')), '')"
    local = f"concat({paths.relative_link(doc_path, 'target')}, {fragment})"
    absolute = f"concat(u_url, {fragment})" if s.absolute_fallback else "cast(null as string)"
    return (
        links.withColumn("outcome", F.expr("case when kind = 'base' then 'base' when u_url is null then 'unresolved' when target is not null then 'local' else 'remote' end"))
        .withColumn("text", F.expr(f"case outcome when 'base' then './' when 'local' then {local} when 'remote' then {absolute} end"))
        .withColumn("text", F.expr(f"if(tag = 'css' or attr = 'style', {css_escaped('text')}, {attribute_escaped('text')})"))
    )


def already_local(doc: str, value: str) -> str:
    """SQL: the saved path a relative value points at, null if it isn't one."""
    bare = f"coalesce({urls.decoded(f'regexp_replace({value}, chr(35) || chr(46) || chr(42), chr(32))')}, {value})".replace("chr(35) || chr(46) || chr(42), chr(32)", "'#.*$', ''")
    joined = f"concat(regexp_extract(concat('/', {doc}), '^(.*/)', 1), {bare})"
    return f"if({value} like './%' or {value} like '../%', ltrim('/', {urls.cleaned_path(joined)}), null)"


def spliced(docs: DataFrame, changes: DataFrame, doc: str = "doc_id", body: str = "body") -> DataFrame:
    """``docs`` with ``body`` rewritten: the changes (doc, start, end, text) of each document.

    A document's changes are bounded by its size, so they may be gathered with it.
    """
    small_batches(docs.sparkSession, PAGES)
    spans = changes.where("text is not null").groupBy(doc).agg(F.collect_list(F.struct("start", "end", F.encode("text", "UTF-8").alias("text"))).alias("_spans"))
    kept = [c for c in docs.columns if c != body]
    joined = docs.withColumn(body, F.col(body).cast("binary")).join(spans, doc, "left").select(*kept, body, "_spans")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in joined.drop("_spans").schema) + ", changed boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_columns
            out = []
            for src, spans in zip(batch.column(n - 2).to_pylist(), batch.column(n - 1).to_pylist(), strict=True):
                out.append(scan.apply_spans(src or b"", [(x["start"], x["end"], x["text"]) for x in spans or ()]))
            changed = [a != b for a, b in zip(out, batch.column(n - 2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: n - 2], pa.array(out, pa.binary()), pa.array(changed, pa.bool_())], [*kept, body, "changed"])

    return joined.mapInArrow(run, schema)


def without_scripts(body: str) -> str:
    return rf"regexp_replace({body}, r'(?is)<script(?=[\s/>]).*?(</script\s*>|$)', '')"


def with_banner(body: str, text: str, url: str) -> str:
    """SQL: a note at the top of the page: after <body ...>, or else in front."""
    note = f"""concat('<div class="offline-note">', {attribute_escaped(urls._lit(text))}, ' &middot; <a href="', {attribute_escaped(url)}, '">', {attribute_escaped(url)}, '</a></div>')"""
    at = f"instr(lower({body}), '<body')"
    end = f"locate('>', {body}, {at})"
    return f"if({at} > 0 and {end} > 0, concat(left({body}, {end}), {note}, substr({body}, {end} + 1)), concat({note}, {body}))"


def substituted(body: str, subs: list[tuple[str, str, bool]]) -> str:
    """SQL: (pattern, replacement, is_regex) applied in order."""
    for pattern, replacement, regex in subs:
        body = f"regexp_replace({body}, {urls._lit(pattern)}, {urls._lit(replacement)})" if regex else f"replace({body}, {urls._lit(pattern)}, {urls._lit(replacement)})"
    return body


def next_interval(interval: str, took: str) -> str:
    """SQL: the pause before the next pass doubles if a pass took over a quarter of it."""
    return f"if({took} > {interval} / 4, {interval} * 2, {interval})"


def rewritten(docs: DataFrame, entries: DataFrame, s: Settings, css: bool = False) -> DataFrame:
    """The flagship: documents (doc_id, url, path, body) with every link turned to the saved copy.

    ``css`` says that they are style sheets: their url() and @import values are turned.
    """
    links = scan.scanned(docs.select("doc_id", "url", F.col("path").alias("doc_path"), "body"), "body", css).select("doc_id", "url", "doc_path", "base", F.explode("links").alias("l")).select("doc_id", "url", "doc_path", "base", "l.*")
    based = urls.with_url(links, "base", "url", "b_").withColumn("_base", F.coalesce("b_url", "url"))
    links = urls.with_url(based.drop(*[f"b_{p}" for p in urls.PARTS]), "value", "_base").drop("_base", "base")
    return spliced(docs, decided(local_paths(links, entries, s), s), "doc_id")


CLASSES = ("remote", "site_absolute", "query_left", "missing", "ok")


def audited(links: DataFrame, files: DataFrame, doc: str = "doc_path", value: str = "value") -> DataFrame:
    """``links`` with ``class``; fragments, data:, javascript: and mailto: are left out.

    ``files`` (path) are joined by the path a link leads to.
    """
    rows = links.where(~F.col(value).rlike("^(#|data:|javascript:|mailto:)") & (F.col(value) != ""))
    bare = f"regexp_replace({value}, '#.*$', '')"
    target = f"ltrim('/', {urls.cleaned_path(f'''concat(regexp_extract(concat('/', {doc}), '^(.*/)', 1), coalesce({urls.decoded(bare)}, {bare}))''')})"
    rows = rows.withColumn("_target", F.expr(target))
    saved = files.select(F.col("path").alias("_target"), F.lit(True).alias("_there")).distinct()
    cases = f"case when {value} like '%://%' then 'remote' when {value} like '/%' then 'site_absolute' when {bare} like '%?%' then 'query_left' when _there then 'ok' else 'missing' end"
    return rows.join(saved, "_target", "left").withColumn("class", F.expr(cases)).drop("_target", "_there")


def audit_totals(classes: DataFrame) -> DataFrame:
    return classes.agg(F.count(F.lit(1)).alias("links"), *[F.count_if(F.col("class") == c).alias(c) for c in CLASSES])


def worst_files(classes: DataFrame, doc: str = "doc_path", most: int = 10) -> DataFrame:
    broken = classes.where(F.col("class").isin("site_absolute", "query_left", "missing"))
    return broken.groupBy(doc).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), doc).limit(most)
