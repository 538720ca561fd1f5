"""The ordered scope rules as one cascade of expressions.

Every function takes column names with a URL's parts (``with_url`` makes them) and gives an SQL
expression; null means that nothing forbids the URL. Modes and lists are fixed when the plan is
built, so only the rules in use appear in it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import formats, urls
from tidemark.plans.config import Settings, glob


def _matches(patterns: list[str], value: str) -> str:
    return " or ".join(f"{value} rlike {urls._lit(p)}" for p in patterns) or "false"


def _listed(values: list[str]) -> str:
    return ", ".join(urls._lit(v) for v in values)


def prohibited(s: Settings, role: str, depth: str, u: str = "u_") -> str:
    """SQL: the reason of the first prohibition that holds, else null."""
    dotted = lambda xs: [x if x.startswith(".") else f".{x}" for x in (y.strip().lower() for y in xs) if x]
    ext, segs = urls.extension(f"{u}path"), urls.segments(f"{u}path")
    rules = []
    if s.block_hosts:
        rules.append((urls.any_host_matches(s.block_hosts, f"{u}host", f"{u}origin"), "blocked_host"))
    if exclude := [*s.exclude, *map(glob, s.exclude_glob)]:
        rules.append((_matches(exclude, f"{u}url"), "excluded"))
    if s.max_url_length:
        rules.append((f"octet_length({u}url) > {s.max_url_length}", "too_long"))
    if s.skip_query_urls:
        rules.append((f"{u}query <> ''", "has_query"))
    if s.max_path_depth:
        rules.append((f"size({segs}) > {s.max_path_depth}", "too_deep_path"))
    if s.max_repeat_segment:
        rules.append((f"{urls.max_repeat(segs)} > {s.max_repeat_segment}", "repeated_segment"))
    if s.max_levels:
        rules.append((f"{depth} > {s.max_levels}", "beyond_level"))
    if s.block_extensions:
        rules.append((f"{ext} in ({_listed(dotted(s.block_extensions))})", "blocked_ext"))
    if s.allow_extensions:
        rules.append((f"{ext} <> '' and {role} = 'asset' and {ext} not in ({_listed(dotted(s.allow_extensions))})", "ext_not_allowed"))
    return "case " + " ".join(f"when {test} then '{why}'" for test, why in rules) + " end" if rules else "cast(null as string)"


def _starts(s: Settings) -> list[tuple[str, str, str]]:
    """(origin, host, path) of the start URLs; plan-time, as there are a handful."""
    from urllib.parse import unquote, urlsplit

    out = []
    for raw in s.start_urls:
        p = urlsplit(raw if "://" in raw else f"https://{raw}")
        host = (p.hostname or "").rstrip(".")
        port = "" if p.port in (None, {"http": 80, "https": 443}.get(p.scheme)) else f":{p.port}"
        out.append((host + port, host, unquote(p.path) or "/"))
    return out


def _under_start(starts: list[tuple[str, str, str]], u: str) -> str:
    return "(" + (" or ".join(f"({u}host = {urls._lit(h)} and startswith({u}path, {urls._lit(p[: p.rfind('/') + 1])}))" for _, h, p in starts) or "false") + ")"


def scope_reason(s: Settings, role: str, depth: str, from_origin: str, u: str = "u_") -> str:
    """SQL: null if the URL is in scope, else why not; the prohibitions first."""
    starts = _starts(s)
    origins, hosts = [o for o, _, _ in starts], [h for _, h, _ in starts]
    permits = []
    if include := [*s.include, *map(glob, s.include_glob)]:
        permits.append(_matches(include, f"{u}url"))
    if s.hosts:
        permits.append(urls.any_host_matches(s.hosts, f"{u}host", f"{u}origin"))
    if s.asset_hosts:
        permits.append(f"{role} = 'asset' and {urls.any_host_matches(s.asset_hosts, f'{u}host', f'{u}origin')}")
    if s.supporting_files == "any":
        permits.append(f"{role} = 'asset'")
    elif s.supporting_files == "related" and hosts:
        permits.append(f"{role} = 'asset' and ({' or '.join(urls.same_site(urls._lit(h), f'{u}host') for h in hosts)})")
    on_site = f"{u}origin in ({_listed(origins)})" if origins else "false"
    domains = " or ".join(f"({urls.registrable(f'{u}host')}) = ({urls.registrable(urls._lit(h))})" for h in hosts) or "false"
    last = {
        "none": "cast(null as string)",
        "rules": "'no_include'" if include or s.hosts else "'rules_empty'",
        "host": f"if({on_site}, null, 'outside_host')",
        "subdomains": f"if({domains}, null, 'outside_domain')",
        "host+1": f"if({on_site} or coalesce({from_origin} in ({_listed(origins) or 'null'}), false), null, 'more_than_one_hop')",
        "directory": f"if({_under_start(starts, u)}, null, 'outside_directory')",
    }[s.constraint]
    allowed = f"case {' '.join(f'when {p} then null' for p in permits)} else {last} end" if permits else last
    denied = prohibited(s, role, depth, u)
    return f"coalesce({denied}, {allowed})"


def in_scope(s: Settings, u: str = "u_") -> str:
    starts = _starts(s)
    tests = [f"{u}origin in ({_listed([o for o, _, _ in starts])})", f"{u}host in ({_listed([h for _, h, _ in starts])})"] if starts else []
    tests += [urls.any_host_matches([*s.hosts, *s.asset_hosts], f"{u}host", f"{u}origin")]
    if s.constraint == "subdomains":
        tests += [f"({urls.registrable(f'{u}host')}) = ({urls.registrable(urls._lit(h))})" for _, h, _ in starts]
    return "(" + " or ".join(tests) + ")"


def expandable(s: Settings, u: str = "u_") -> str:
    """SQL: whether pages at this URL are searched for further pages."""
    starts = _starts(s)
    extra = urls.any_host_matches(s.hosts, f"{u}host", f"{u}origin")
    on_site = f"{u}origin in ({_listed([o for o, _, _ in starts])})" if starts else "false"
    if s.constraint in ("none", "rules"):
        return "true"
    if s.constraint == "directory":
        return f"({_under_start(starts, u)} or {extra})"
    if s.constraint == "subdomains":
        domains = " or ".join(f"({urls.registrable(f'{u}host')}) = ({urls.registrable(urls._lit(h))})" for _, h, _ in starts) or "false"
        return f"(({domains}) or {extra})"
    return f"({on_site} or {extra})"


def media_type(s: Settings, url: str, path: str, header: str) -> str:
    """SQL: override by pattern, else the header, else a guess from the extension."""
    bare = f"lower(trim(substring_index(coalesce({header}, ''), ';', 1)))"
    guess = formats.lookup(f"nullif({urls.extension(path)}, '')", formats.types_by_extension())
    cases = " ".join(f"when {url} rlike {urls._lit(p)} then '{t.lower()}'" for p, t in s.type_replacements)
    rest = f"if({bare} in ('', 'application/octet-stream', 'binary/octet-stream'), coalesce({guess}, nullif({bare}, ''), 'application/octet-stream'), {bare})"
    return f"case {cases} else {rest} end" if cases else rest


def type_listed(s: Settings, kind: str) -> str:
    tests = [formats.category_match(c, kind) for c in s.type_categories]
    for custom in (x.strip().lower() for x in s.type_custom):
        if custom.endswith("/*"):
            tests.append(f"startswith({kind}, '{custom[:-1]}')")
        elif custom:
            tests.append(f"{kind} = '{custom}'")
    return "(" + (" or ".join(tests) or "false") + ")"


def response_reason(s: Settings, kind: str, size: str) -> str:
    """SQL: null if a response is kept, else why not; HTML and CSS always are."""
    rules = [(f"{formats.is_html(kind)} or {formats.is_css(kind)}", None)]
    if s.min_file_size:
        rules.append((f"{size} >= 0 and {size} < {s.min_file_size}", "too_small"))
    if s.max_file_size:
        rules.append((f"{size} > {s.max_file_size}", "too_large"))
    if s.types_mode == "allow":
        rules.append((f"not {type_listed(s, kind)}", "type_not_allowed"))
    if s.types_mode == "disallow":
        rules.append((type_listed(s, kind), "type_disallowed"))
    return "case " + " ".join(f"when {t} then {'null' if w is None else repr(w)}" for t, w in rules) + " else cast(null as string) end"


def guessed_role(path: str) -> str:
    pages = ", ".join(f"'{x}'" for x in ("", *urls.PAGE_EXTENSIONS))
    return f"if({urls.extension(path)} in ({pages}), 'page', 'asset')"


def kind_role(kind: str, path: str) -> str:
    """SQL: anchors, frames and forms lead to pages; what a page loads is an asset."""
    return f"case when {kind} in ('anchor', 'frame', 'form', 'refresh') then 'page' when {kind} in ('asset', 'css', 'srcset') then 'asset' else {guessed_role(path)} end"


def queue_query(s: Settings, query: str) -> str:
    if s.ignore_query:
        return "''"
    return urls.without_params(query, list(s.drop_query_params)) if s.drop_query_params else query


#: Fragments of error texts, in the order in which they decide.
TRANSPORT_TYPED = {"context canceled": "false", "context deadline exceeded": "true", "unexpected eof": "true"}
TRANSPORT_DENY = (
    "remote error: tls", "first record does not look like a tls handshake", "tls: unknown certificate", "tls: bad certificate",
    "tls: protocol version not supported", "tls: handshake failure", "x509:", "certificate is not valid",
    "certificate signed by unknown authority", "malformed http response", "server gave http response to https client",
)
TRANSPORT_ALLOW = (
    "connection refused", "connection reset", "no such host", "network is unreachable", "host is unreachable", "no route to host",
    "i/o timeout", "tls handshake timeout", "eof", "broken pipe", "server closed", "connection aborted", "timeout awaiting",
    "proxyconnect", "http2: client conn",
)


def transport_error(err: str) -> str:
    """SQL: whether an error text speaks of the connection rather than of the request; null doesn't."""
    has = lambda words: " or ".join(f"contains(lower({err}), '{w}')" for w in words)
    typed = " ".join(f"when contains(lower({err}), '{w}') then {v}" for w, v in TRANSPORT_TYPED.items())
    return f"case {typed} when {has(TRANSPORT_DENY)} then false when {has(TRANSPORT_ALLOW)} then true else false end"


def within_limit(df: DataFrame, order: str, size: str, files: int, total: int) -> DataFrame:
    """The rows before a limit of files or bytes is reached, in ``order``.

    Totals over range partitions are summed first; no task sees more than its part.
    """
    from pyspark.sql import Window as W

    from tidemark.runtime import shuffle_width, stash

    parts = stash(df.repartitionByRange(shuffle_width(df.sparkSession), order).withColumn("_part", F.spark_partition_id()), "limit")
    sums = parts.groupBy("_part").agg(F.count(F.lit(1)).alias("n"), F.sum(size).alias("b"))
    ahead = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.select("_part", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("_n"), F.coalesce(F.sum("b").over(ahead), F.lit(0)).alias("_b"))
    own = W.partitionBy("_part").orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    run = parts.withColumn("_i", F.count(F.lit(1)).over(own)).withColumn("_s", F.coalesce(F.sum(size).over(own), F.lit(0)))
    run = run.join(F.broadcast(sums), "_part")
    return run.where((F.col("_n") + F.col("_i") < files) & (F.col("_b") + F.col("_s") < total)).select(*df.columns)
