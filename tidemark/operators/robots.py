"""robots.txt and sitemaps: parsing, the choice of a group, and the longest matching rule."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.runtime import stash


def directives(files: DataFrame, origin: str = "origin", body: str = "body") -> DataFrame:
    """(origin, line, field, value, grp): one row for each directive.

    An agent line after a rule opens a group; rules before any agent line form a group for *. The
    number of groups so far is a running count over the lines of one file.
    """
    rows = files.select(origin, F.posexplode(F.split(body, "\n")).alias("line", "raw"))
    rows = rows.withColumn("raw", F.expr(r"regexp_replace(regexp_replace(raw, '#.*$', ''), r'^\s+|\s+$', '')")).where("instr(raw, ':') > 0")
    rows = rows.select(origin, "line", F.expr("lower(trim(substring_index(raw, ':', 1)))").alias("field"), F.expr(r"regexp_replace(substr(raw, instr(raw, ':') + 1), r'^\s+|\s+$', '')").alias("value"))
    rows = rows.withColumn("field", F.expr("if(field = 'useragent', 'user-agent', field)"))
    order = W.partitionBy(origin).orderBy("line")
    kind = F.expr("case when field = 'user-agent' then 'a' when field in ('allow', 'disallow') then 'r' end")
    before = F.last(kind, ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, -1))
    opens = F.when((kind == "a") & F.coalesce(before != "a", F.lit(True)), 1).when((kind == "r") & before.isNull(), 1).otherwise(0)
    return rows.withColumn("_opens", opens).withColumn("grp", F.sum("_opens").over(order)).drop("_opens")


def rules(lines: DataFrame, agent: str, origin: str = "origin") -> DataFrame:
    """(origin, path, allow, delay): the rules of the group that fits ``agent`` best.

    The longest agent token contained in the agent's name wins, * being the shortest; the first
    of equals does.
    """
    named = lines.where("field = 'user-agent'").select(origin, "grp", "line", F.lower("value").alias("token"))
    unnamed = lines.where("field in ('allow', 'disallow')").join(named.select(origin, "grp").distinct(), [origin, "grp"], "left_anti").groupBy(origin, "grp").agg(F.min("line").alias("line")).withColumn("token", F.lit("*"))
    fits = named.unionByName(unnamed).where((F.col("token") == "*") | F.lit(agent.lower()).contains(F.col("token")))
    score = F.struct(F.when(F.col("token") == "*", 0).otherwise(F.octet_length("token")).alias("len"), (-F.col("line")).alias("first"))
    best = fits.groupBy(origin).agg(F.max_by("grp", score).alias("grp"))
    chosen = lines.join(best, [origin, "grp"])
    delay = chosen.where("field = 'crawl-delay'").groupBy(origin).agg(F.max_by(F.expr("try_cast(value as double)"), "line").alias("delay"))
    own = chosen.where("field = 'allow' or (field = 'disallow' and value <> '')").select(origin, F.col("value").alias("path"), (F.col("field") == "allow").alias("allow"))
    return best.select(origin).join(own, origin, "left").join(delay, origin, "left")


def pattern_sql(path: str) -> str:
    """SQL: a robots path as a pattern. Each * takes as little as it can and gives nothing back."""
    bare = f"regexp_replace({path}, r'\\$$', '')"
    parts = f"filter(split({bare}, r'\\*'), (x, i) -> i = 0 or x <> '')"
    quoted = "concat('\\\\Q', replace(x, '\\\\E', ''), '\\\\E')"
    joined = f"array_join(transform({parts}, (x, i) -> if(i = 0, {quoted}, concat('(?>.*?', {quoted}, ')'))), '')"
    return f"concat('(?s)^', {joined}, if({path} like '%$', '$', ''))"


def allowed(urls: DataFrame, own: DataFrame, origin: str = "origin", target: str = "target") -> DataFrame:
    """``urls`` with ``allowed``: the longest matching rule decides, allow among equals; none, yes.

    ``target`` is path and query. Each distinct target of an origin is judged once; its rules are
    joined by origin and reduced to one value before what was denied or allowed is joined back.
    """
    path = F.expr(f"if({target} = '', '/', {target})")
    asked = urls.select(origin, target).distinct()
    pairs = asked.select(origin, target, path.alias("_t")).join(own.where("path is not null and path <> ''").select(origin, F.col("path").alias("_rule"), F.col("allow").alias("_allow")), origin)
    hit = pairs.where(F.expr(f"_t rlike {pattern_sql('_rule')}"))
    verdict = stash(hit.groupBy(origin, target).agg(F.max_by("_allow", F.struct(F.octet_length("_rule"), "_allow")).alias("allowed")), "robots")
    return urls.drop("allowed").join(verdict, [origin, target], "left").withColumn("allowed", F.coalesce("allowed", F.lit(True)))


def matches(path: str, target: str) -> str:
    """SQL: whether one robots path matches."""
    return f"({path} <> '' and {target} rlike {pattern_sql(path)})"


def sitemap_entries(body: str) -> str:
    """SQL: array of (loc, lastmod, is_index): a sitemap index, a URL set, or a line each."""
    tag = lambda name: f"trim(regexp_extract(x, '(?s)<{name}[^>]*>(.*?)</{name}>', 1))"
    entry = lambda outer, index: f"transform(regexp_extract_all({body}, '(?s)<{outer}[ >].*?</{outer}>', 0), x -> struct({tag('loc')} as loc, {tag('lastmod')} as lastmod, {index} as is_index))"
    lines = rf"transform(filter(transform(split({body}, '\n'), x -> regexp_replace(x, r'^\s+|\s+$', '')), x -> x like 'http://%' or x like 'https://%'), x -> struct(x as loc, '' as lastmod, false as is_index))"
    return f"case when {body} like '%<sitemapindex%' then filter({entry('sitemap', 'true')}, e -> e.loc <> '') when {body} like '%<urlset%' then filter({entry('url', 'false')}, e -> e.loc <> '') else {lines} end"


def sitemap_seeds(responses: DataFrame, starts: DataFrame, levels: int = 3) -> DataFrame:
    """(loc) of all pages that the sitemaps ``starts`` (loc) lead to, through indexes ``levels`` deep."""
    pages, now = None, starts.select("loc").distinct()
    for _ in range(levels):
        body = F.expr("decode(substring(body, 1, 8388608), 'UTF-8')") if dict(responses.dtypes).get("body") == "binary" else F.col("body")
        read = now.join(responses.select(F.col("url").alias("loc"), body.alias("_body")), "loc").select(F.explode(F.expr(sitemap_entries("_body"))).alias("e"))
        found = stash(read.select("e.loc", "e.is_index"), "sitemap")
        here = found.where("not is_index").select("loc")
        pages = here if pages is None else pages.union(here)
        now = found.where("is_index").select("loc").distinct()
    return pages.distinct()
