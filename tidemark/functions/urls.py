"""URL algebra as staged DataFrame columns and SQL expressions.

A URL is split by one anchored pattern, its path decoded, cleaned and encoded again, its query
left as it came; only the key orders it. ``with_url`` resolves references against a base and adds
the parts as columns, each stage once, so that no expression is written out twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEME = r"^([A-Za-z][A-Za-z0-9+.-]*):"
#: What a page name's extension may be: fixed values.
PAGE_EXTENSIONS = (".html", ".htm", ".xhtml", ".php", ".asp", ".aspx", ".jsp", ".cgi", ".shtml", ".do", ".action")
#: Second-level suffixes under which names are registered; a subset of the public list, fixed values.
SUFFIXES = (
    "ac.uk", "co.uk", "gov.uk", "ltd.uk", "me.uk", "net.uk", "org.uk", "plc.uk", "sch.uk",
    "com.au", "edu.au", "gov.au", "id.au", "net.au", "org.au",
    "ac.jp", "co.jp", "go.jp", "ne.jp", "or.jp",
    "ac.nz", "co.nz", "govt.nz", "net.nz", "org.nz",
    "com.br", "gov.br", "net.br", "org.br",
    "com.cn", "edu.cn", "gov.cn", "net.cn", "org.cn",
    "ac.in", "co.in", "gov.in", "net.in", "org.in",
    "co.kr", "or.kr", "com.mx", "org.mx", "com.ar", "com.tr", "com.tw", "com.hk", "com.sg",
    "co.za", "org.za", "co.il", "org.il", "com.pl", "com.ua", "github.io",
)


def encoded_path(p: str) -> str:
    """SQL: percent-encode a decoded path, leaving unreserved characters and $&+,/:;=@."""
    out = f"replace(replace(replace(url_encode({p}), '+', '%20'), '*', '%2A'), '%7E', '~')"
    for code, char in (("24", "$"), ("26", "&"), ("2B", "+"), ("2C", ","), ("2F", "/"), ("3A", ":"), ("3B", ";"), ("3D", "="), ("40", "@")):
        out = f"replace({out}, '%{code}', '{char}')"
    return out


def form_encoded(s: str) -> str:
    """SQL: form encoding with + for a space; only letters, digits and -_.~ stay."""
    return f"replace(replace(url_encode({s}), '*', '%2A'), '%7E', '~')"


def decoded(s: str) -> str:
    """SQL: percent-decoding that leaves + alone; null when malformed."""
    return f"try_url_decode(replace({s}, '+', '%2B'))"


def cleaned_path(p: str) -> str:
    """SQL: leading slash, no empty, dot or dot-dot segments; a trailing slash stays."""
    fold = (
        f"aggregate(split({p}, '/'), cast(array() as array<string>), (a, s) -> case when s in ('', '.') then a "
        "when s = '..' then slice(a, 1, greatest(size(a) - 1, 0)) else array_append(a, s) end)"
    )
    return f"transform(array({fold}), a -> concat('/', array_join(a, '/'), if(size(a) > 0 and {p} like '%/', '/', '')))[0]"


def segments(path: str) -> str:
    return f"if(trim(both '/' from {path}) = '', cast(array() as array<string>), split(trim(both '/' from {path}), '/'))"


def max_repeat(segs: str) -> str:
    return f"coalesce(array_max(transform(array_distinct({segs}), x -> size(filter({segs}, y -> y = x)))), 0)"


def extension(path: str) -> str:
    base = f"regexp_extract({path}, '([^/]*)$', 1)"
    return f"lower(regexp_extract({base}, r'^.+(\\.[^.]+)$', 1))"


def directory(path: str) -> str:
    return f"if({path} = '', '/', regexp_extract({path}, '^(.*/)', 1))"


def host_pattern(pattern: str, host: str) -> str:
    """SQL: exact name, *.x or .x for a domain and all below it, * for any."""
    p, h = f"lower(trim({pattern}))", f"lower(regexp_replace({host}, r'\\.$', ''))"
    tail = f"regexp_replace({p}, r'^\\*', '')"
    return (
        f"case when {p} = '' or {h} = '' then false when {p} = '*' then true "
        f"when {tail} like '.%' and ({p} like '.%' or {p} like '*.%') then {h} = substr({tail}, 2) or endswith({h}, {tail}) else {h} = {p} end"
    )


def host_matches(pattern: str, host: str, origin: str) -> str:
    return f"(({host_pattern(pattern, host)}) or (instr({pattern}, ':') > 0 and lower(trim({pattern})) = lower({origin})))"


def any_host_matches(patterns: list[str], host: str, origin: str) -> str:
    return "(" + (" or ".join(host_matches(_lit(p), host, origin) for p in patterns) or "false") + ")"


def registrable(host: str) -> str:
    """SQL: the registrable domain; addresses and single labels are their own."""
    h = f"lower(regexp_replace({host}, r'\\.$', ''))"
    two = f"substring_index({h}, '.', -2)"
    listed = ", ".join(_lit(s) for s in SUFFIXES)
    return (
        f"case when {h} rlike r'^[0-9.]+$|:' or instr({h}, '.') = 0 then {h} "
        f"when {two} in ({listed}) then substring_index({h}, '.', -3) else {two} end"
    )


def same_site(a: str, b: str) -> str:
    return f"(lower({a}) = lower({b}) or (({registrable(a)}) <> '' and ({registrable(a)}) = ({registrable(b)})))"


def _lit(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _split(df: DataFrame, raw: str, p: str) -> DataFrame:
    """Adds the parts of ``raw`` under the prefix ``p``; has_auth and has_query tell '' from none."""
    return (
        df.withColumn(f"{p}scheme", F.expr(f"lower(regexp_extract({raw}, r'{SCHEME}', 1))"))
        .withColumn(f"{p}rest", F.expr(f"regexp_replace(regexp_replace({raw}, r'{SCHEME}', ''), r'(?s)#.*$', '')"))
        .withColumn(f"{p}has_auth", F.expr(f"{p}rest like '//%'"))
        .withColumn(f"{p}auth", F.expr(f"if({p}has_auth, regexp_extract({p}rest, '^//([^/?]*)', 1), '')"))
        .withColumn(f"{p}after", F.expr(f"if({p}has_auth, regexp_replace({p}rest, '^//[^/?]*', ''), {p}rest)"))
        .withColumn(f"{p}has_query", F.expr(f"instr({p}after, '?') > 0"))
        .withColumn(f"{p}path", F.expr(f"substring_index({p}after, '?', 1)"))
        .withColumn(f"{p}query", F.expr(f"if({p}has_query, substr({p}after, instr({p}after, '?') + 1), '')"))
        .drop(f"{p}rest", f"{p}after")
    )


PARTS = ("scheme", "host", "port", "origin", "path", "query", "url", "key")


def with_url(df: DataFrame, ref: str, base: str | None = None, out: str = "u_") -> DataFrame:
    """Adds scheme, host, port, origin, path (decoded), query, url (canonical) and key of ``ref``.

    With ``base``, ``ref`` is resolved against it; all parts are null for fragments, other schemes
    and references without a host. Without, https:// is put before a name without a scheme.
    """
    df = df.withColumn("_r", F.expr(rf"regexp_replace(regexp_replace(coalesce({ref}, ''), r'^\s+|\s+$', ''), r'[\n\r\t]', '')"))
    if base is None:
        df = df.withColumn("_r", F.expr("if(_r <> '' and instr(_r, '://') = 0 and _r not like '//%', concat('https://', _r), _r)"))
    lead = "regexp_extract(_r, '^([^/?#:]+):', 1)"
    df = df.withColumn("_ok", F.expr(f"_r <> '' and _r not like '#%' and ({lead} = '' or lower({lead}) in ('http', 'https')) and _r not like ':%'"))
    df = _split(df, "_r", "_r_")
    if base is not None:
        df = _split(df, base, "_b_")
        own = "(_r_scheme <> '' or _r_has_auth)"
        rel = "(not _r_has_auth and _r_scheme = '')"
        merged = "concat(if(_b_path = '', '/', regexp_extract(_b_path, '^(.*/)', 1)), _r_path)"
        df = (
            df.withColumn("_scheme", F.expr("if(_r_scheme <> '', _r_scheme, _b_scheme)"))
            .withColumn("_auth", F.expr(f"if({own}, _r_auth, _b_auth)"))
            .withColumn("_query", F.expr(f"if({rel} and _r_path = '' and not _r_has_query, _b_query, _r_query)"))
            .withColumn("_p", F.expr(f"case when {own} or _r_path like '/%' then _r_path when _r_path = '' then _b_path else {merged} end"))
        )
        df = df.drop(*[c for c in df.columns if c.startswith("_b_")])
    else:
        df = df.withColumns({"_scheme": F.col("_r_scheme"), "_auth": F.col("_r_auth"), "_query": F.col("_r_query"), "_p": F.col("_r_path")})
    df = (
        df.withColumn("_hostport", F.expr("lower(regexp_replace(_auth, '^.*@', ''))"))
        .withColumn("_host", F.expr(r"regexp_replace(regexp_replace(_hostport, r':[0-9]*$', ''), r'\.$', '')"))
        .withColumn("_port", F.expr("regexp_extract(_hostport, ':([0-9]+)$', 1)"))
        .withColumn("_port", F.expr("if((_scheme = 'http' and _port = '80') or (_scheme = 'https' and _port = '443'), '', _port)"))
        .withColumn("_plain", F.expr(decoded("_p")))
        .withColumn("_path", F.expr(cleaned_path("_plain")))
        .withColumn("_ok", F.expr("_ok and _scheme in ('http', 'https') and _host <> '' and _plain is not null"))
        .withColumn("_origin", F.expr("concat(_host, if(_port <> '', concat(':', _port), ''))"))
        .withColumn("_stem", F.expr(f"concat(_scheme, '://', _origin, {encoded_path('_path')})"))
        .withColumn("_bad", F.expr("_query rlike '%(?![0-9A-Fa-f]{2})|;'"))
        .withColumn("_pairs", F.expr("transform(filter(split(if(_bad, '', _query), '&'), x -> x <> ''), x -> struct(try_url_decode(substring_index(x, '=', 1)) as k, try_url_decode(if(instr(x, '=') > 0, substr(x, instr(x, '=') + 1), '')) as v))"))
        .withColumn("_ordered", F.expr(f"if(_bad, _query, array_join(transform(array_sort(_pairs), x -> concat({form_encoded('x.k')}, '=', {form_encoded('x.v')})), '&'))"))
    )
    values = {
        "scheme": "_scheme", "host": "_host", "port": "_port", "origin": "_origin", "path": "_path", "query": "_query",
        "url": "concat(_stem, if(_query <> '', concat('?', _query), ''))", "key": "concat(_stem, if(_ordered <> '', concat('?', _ordered), ''))",
    }
    df = df.withColumns({f"{out}{k}": F.expr(f"if(_ok, {v}, null)") for k, v in values.items()})
    temporary = ["_r", "_ok", "_scheme", "_auth", "_query", "_p", "_hostport", "_host", "_port", "_plain", "_path", "_origin", "_stem", "_bad", "_pairs", "_ordered"]
    return df.drop(*temporary, *[c for c in df.columns if c.startswith("_r_")])


def without_params(query: str, names: list[str]) -> str:
    """SQL: the query without the named parameters, encoded and sorted if any was there."""
    listed = ", ".join(_lit(n.lower()) for n in names) or "null"
    key = "lower(try_url_decode(substring_index(x, '=', 1)))"
    parts = f"filter(split({query}, '&'), x -> x <> '')"
    hit = f"exists({parts}, x -> {key} in ({listed}))"
    keep = f"filter({parts}, x -> {key} not in ({listed}))"
    pair = f"concat({form_encoded('try_url_decode(substring_index(x, chr(61), 1))')}, '=', {form_encoded('try_url_decode(if(instr(x, chr(61)) > 0, substr(x, instr(x, chr(61)) + 1), chr(0)))')})".replace("chr(0)", "''")
    # Pairs are sorted by key and keep the order of a key's values.
    ordered = f"transform(array_sort(transform({keep}, (x, i) -> struct(try_url_decode(substring_index(x, '=', 1)) as k, i, {pair} as p))), x -> x.p)"
    return f"if({query} rlike '%(?![0-9A-Fa-f]{{2}})|;' or not coalesce({hit}, false), {query}, array_join({ordered}, '&'))"


#: Hosts that are asked without encryption, and ports that are asked with it. Fixed values.
PLAIN_HOSTS = ("localhost", "127.0.0.1", "0.0.0.0")
PLAIN_SUFFIXES = (".local", ".localhost")
SECURE_PORTS = ("443", "8443", "4443")


def default_scheme(host: str) -> str:
    """SQL: http for loopback and local names and unusual ports, https otherwise."""
    h = f"regexp_extract(lower({host}), '^[^/?#]*', 0)"
    name, port = f"substring_index({h}, ':', 1)", f"regexp_extract({h}, ':(.*)$', 1)"
    local = " or ".join([f"{name} = '{x}'" for x in PLAIN_HOSTS] + [f"endswith({name}, '{x}')" for x in PLAIN_SUFFIXES])
    ports = ", ".join(f"'{x}'" for x in ("", *SECURE_PORTS))
    return f"if({local} or {port} not in ({ports}), 'http', 'https')"


def started(raw: str) -> str:
    """SQL: a start URL without spaces around it and with a scheme."""
    return f"if(instr(trim({raw}), '://') > 0, trim({raw}), concat({default_scheme(f'trim({raw})')}, '://', trim({raw})))"


def start_problem(raw: str) -> str:
    """SQL: why nothing can start at a URL; null if it can."""
    url = started(raw)
    return f"""case when trim(coalesce({raw}, '')) = '' then 'empty' when regexp_extract({url}, '://([^/?#]*)', 1) = '' then 'no host'
      when lower(substring_index({url}, '://', 1)) not in ('http', 'https') then 'unsupported scheme' end"""