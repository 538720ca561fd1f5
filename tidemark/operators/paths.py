"""URL to file path: segments, query suffixes, extensions, length limits, collisions, links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions import formats, urls
from tidemark.plans.config import Settings

#: Characters a file name can't hold and the look-alikes put in their place. Fixed values.
SPECIAL = '/\\:*?"<>|#%'
LOOK_ALIKE = "∕⧵：＊？”＜＞｜＃％"
#: Names some systems reserve: fixed values.
RESERVED = r"^(con|prn|aux|nul|com[1-9]|lpt[1-9])$"


def _ext(s: str) -> str:
    """SQL: the extension with its dot if it has at most 12 bytes, else ''."""
    raw = f"regexp_extract({s}, r'(\\.[^./]*)$', 1)"
    return f"if(octet_length({raw}) > 12, '', {raw})"


def _stem(s: str) -> str:
    return f"left({s}, char_length({s}) - char_length({_ext(s)}))"


def decoded_segment(s: str) -> str:
    return f"coalesce({urls.decoded(s)}, {s})"


def safe_segment(s: str, set_: Settings) -> str:
    """SQL: a file name any system accepts; never empty, . or .. for a non-empty input."""
    marks = SPECIAL.replace("\\", "\\\\")
    clean = f"translate(regexp_replace({s}, r'[\\x00-\\x08\\x0E-\\x1F\\x7F\\t\\n\\x0B\\f\\r]', ''), '{marks}', '{'_' * len(SPECIAL) if set_.replace_special else LOOK_ALIKE}')"
    clean = f"regexp_replace({clean}, r'[\\x85\\xA0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000]', '_')"
    clean = f"ltrim(regexp_replace({clean}, '[. ]+$', ''))"
    named = f"transform(array({clean}), c -> if(c in ('', '.', '..'), '_', c))"
    kept = f"transform({named}, c -> if(lower(substring_index(c, '.', 1)) rlike '{RESERVED}', concat('_', c), c))"
    return f"if({s} = '', '', transform({kept}, c -> {_short('c', set_)})[0])"


def _short(s: str, set_: Settings) -> str:
    most = set_.max_segment_length or 120
    keep = f"greatest({most} - octet_length({_ext(s)}) - 9, 8)"
    return f"if(char_length({s}) <= {most} and octet_length({s}) <= 200, {s}, concat(left({_stem(s)}, {keep}), '-', left(sha1({s}), 8), {_ext(s)}))"


def query_suffix(file: str, query: str) -> str:
    safe = f"regexp_replace({query}, '[^A-Za-z0-9._=&,-]', '-')"
    mark = f"if(octet_length({safe}) > 48, concat('h', left(sha1({query}), 8)), {safe})"
    return f"if({query} = '', {file}, concat({_stem(file)}, '@', {mark}, {_ext(file)}))"


def with_extension(file: str, kind: str) -> str:
    want = formats.lookup(f"lower(trim({kind}))", formats.EXTENSIONS)
    have = f"lower(regexp_extract({file}, r'(\\.[^./]*)$', 1))"
    known = formats.lookup(have, formats.types_by_extension())
    return (
        f"case when coalesce({kind}, '') = '' or {want} is null or {have} = {want} then {file} "
        f"when {formats.is_html(kind)} then if({have} in ('.html', '.htm', '.xhtml'), {file}, concat({file}, {want})) "
        f"when {have} = '' or {known} is null then concat({file}, {want}) else {file} end"
    )


def with_path(df: DataFrame, s: Settings, kind: str = "media_type", filename: str | None = None, u: str = "u_") -> DataFrame:
    """Adds ``path``: where the URL's file belongs, before collisions."""
    segs = urls.segments(f"{u}path")
    df = df.withColumn("_segs", F.expr(segs)).withColumn("_dir", F.expr(f"{u}path = '' or {u}path like '%/'"))
    df = df.withColumn("_folders", F.expr(f"transform(if(_dir, _segs, slice(_segs, 1, greatest(size(_segs) - 1, 0))), x -> {safe_segment(decoded_segment('x'), s)})"))
    named = f"nullif(regexp_extract({filename}, '([^/]*)$', 1), '')" if filename else "cast(null as string)"
    df = df.withColumn("_file", F.expr(f"coalesce({named}, if(_dir or size(_segs) = 0, '', {decoded_segment('_segs[size(_segs) - 1]')}))"))
    df = df.withColumn("_file", F.expr(f"if(_file = '', '{s.index_file}', _file)")).withColumn("_file", F.expr(safe_segment("_file", s)))
    if s.append_extension:
        df = df.withColumn("_file", F.expr(with_extension("_file", kind)))
    df = df.withColumn("_file", F.expr(query_suffix("_file", f"{u}query")))
    host = safe_segment(f"concat({u}host, if({u}port <> '', concat('_', {u}port), ''))", s)
    root = f"if({u}origin = {urls._lit(s.single_host.lower())}, cast(array() as array<string>), array({host}))" if s.host_folders else "cast(array() as array<string>)"
    df = df.withColumn("path", F.expr(f"array_join(concat({root}, _folders, array(_file)), '/')"))
    for pattern, replacement in s.path_rewrites:
        df = df.withColumn("path", F.regexp_replace("path", pattern, replacement))
    df = df.withColumn("path", F.expr(f"ltrim('/', {urls.cleaned_path('path')})")).withColumn("path", F.expr("if(path = '', 'index.html', path)"))
    deep = "concat(substring_index(path, '/', 1), '/_deep/', left(sha1(path), 8), '/', substring_index(path, '/', -1))"
    df = df.withColumn("path", F.expr(f"if(octet_length(path) <= {s.max_path_length or 3800} or size(split(path, '/')) < 3, path, {deep})"))
    if s.lowercase_paths:
        df = df.withColumn("path", F.lower("path"))
    return df.drop("_segs", "_dir", "_folders", "_file")


def disambiguated(df: DataFrame, key: str, order: str, path: str = "path") -> DataFrame:
    """``df`` with ``path`` unique by ``key``: the first claim keeps it, later ones get ~1, ~2, ...

    A numbered name may be taken as well, so numbering is repeated until no two keys share one;
    only rows that still collide are numbered again.
    """
    from tidemark.runtime import stash

    df = stash(df.withColumn("_want", F.col(path)).withColumn("_try", F.lit(0)), "paths")
    while True:
        rank = F.row_number().over(W.partitionBy(path).orderBy("_try", order, key)) - 1
        ranked = stash(df.withColumn("_rank", rank), "paths")
        if ranked.where("_rank > 0").isEmpty():
            return ranked.drop("_want", "_try", "_rank")
        df = ranked.withColumn("_try", F.expr("if(_rank > 0, _try + _rank, _try)")).withColumn(
            path, F.expr(f"if(_try > 0, concat({_stem('_want')}, '~', _try, {_ext('_want')}), {path})")
        ).drop("_rank")


def escaped_link(p: str) -> str:
    """SQL: percent-encode what would end or change a relative link."""
    out = p
    for char, code in (("%", "%25"), (" ", "%20"), ("?", "%3F"), ("#", "%23"), ("\\\\", "%5C")):
        out = f"replace({out}, '{char}', '{code}')"
    letters = f"transform(split({out}, ''), c -> if(ascii(c) > 127 or octet_length(c) > 1, url_encode(c), c))"
    return f"array_join({letters}, '')"


def relative_link(source: str, target: str) -> str:
    """SQL: the link from one saved file to another."""
    here = f"slice(split({source}, '/'), 1, size(split({source}, '/')) - 1)"
    there = f"split({target}, '/')"
    shared = f"aggregate(zip_with({here}, slice({there}, 1, size({there}) - 1), (x, y) -> coalesce(x = y, false)), struct(0 as n, true as go), (a, e) -> struct(a.n + int(a.go and e) as n, a.go and e as go), a -> a.n)"
    ups = f"size({here}) - {shared}"
    down = f"array_join(slice({there}, {shared} + 1, size({there}) - {shared}), '/')"
    link = f"concat(repeat('../', {ups}), {down})"
    return escaped_link(f"if({link} like '.%', {link}, concat('./', {link}))")


def contained(path: str) -> str:
    """SQL: whether a path stays inside its folder."""
    return f"(not exists(split({path}, '/'), x -> x = '..') and {path} not like '/%')"
