"""Scalar formats: durations, byte sizes, media types, error texts, backoff and pacing."""

from __future__ import annotations

#: Media type -> extension. Fixed values.
EXTENSIONS = {
    "text/html": ".html", "application/xhtml+xml": ".xhtml", "text/css": ".css", "text/javascript": ".js",
    "application/javascript": ".js", "application/x-javascript": ".js", "application/json": ".json",
    "application/manifest+json": ".webmanifest", "application/xml": ".xml", "text/xml": ".xml", "text/plain": ".txt",
    "text/csv": ".csv", "image/jpeg": ".jpg", "image/png": ".png", "image/gif": ".gif", "image/webp": ".webp",
    "image/avif": ".avif", "image/svg+xml": ".svg", "image/x-icon": ".ico", "image/vnd.microsoft.icon": ".ico",
    "image/bmp": ".bmp", "image/tiff": ".tiff", "audio/mpeg": ".mp3", "audio/ogg": ".ogg", "audio/wav": ".wav",
    "audio/webm": ".weba", "audio/aac": ".aac", "audio/flac": ".flac", "video/mp4": ".mp4", "video/webm": ".webm",
    "video/ogg": ".ogv", "video/quicktime": ".mov", "video/x-matroska": ".mkv", "application/pdf": ".pdf",
    "application/zip": ".zip", "application/gzip": ".gz", "application/x-tar": ".tar",
    "application/x-7z-compressed": ".7z", "application/vnd.rar": ".rar", "application/epub+zip": ".epub",
    "font/woff": ".woff", "font/woff2": ".woff2", "font/ttf": ".ttf", "font/otf": ".otf",
    "application/vnd.ms-fontobject": ".eot", "application/wasm": ".wasm", "application/rss+xml": ".rss",
    "application/atom+xml": ".atom", "application/x-mpegurl": ".m3u8", "application/vnd.apple.mpegurl": ".m3u8",
}
#: Extension -> media type where the table above has two or none. Fixed values.
PINNED = {
    ".html": "text/html", ".htm": "text/html", ".js": "text/javascript", ".mjs": "text/javascript",
    ".jpg": "image/jpeg", ".jpeg": "image/jpeg", ".xml": "application/xml", ".gz": "application/gzip",
    ".tgz": "application/gzip", ".mp3": "audio/mpeg", ".m4a": "audio/mp4", ".m4v": "video/mp4",
    ".avi": "video/x-msvideo", ".wmv": "video/x-ms-wmv", ".flv": "video/x-flv", ".doc": "application/msword",
    ".docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
    ".xls": "application/vnd.ms-excel",
    ".xlsx": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet",
    ".ppt": "application/vnd.ms-powerpoint",
    ".pptx": "application/vnd.openxmlformats-officedocument.presentationml.presentation",
    ".exe": "application/x-msdownload", ".dmg": "application/x-apple-diskimage",
    ".deb": "application/vnd.debian.binary-package", ".rpm": "application/x-rpm",
    ".iso": "application/x-iso9660-image", ".bz2": "application/x-bzip2", ".xz": "application/x-xz",
    ".rar": "application/vnd.rar", ".webmanifest": "application/manifest+json",
}
#: Category -> media types or prefixes. Fixed values.
CATEGORIES = {
    "images": ("image/",),
    "audio": ("audio/", "application/ogg"),
    "video": ("video/", "application/x-mpegurl", "application/vnd.apple.mpegurl", "application/dash+xml"),
    "archives": ("application/zip", "application/x-tar", "application/gzip", "application/x-7z-compressed", "application/x-rar-compressed", "application/vnd.rar", "application/x-bzip2", "application/x-xz"),
    "documents": ("application/pdf", "application/msword", "application/rtf", "text/plain", "application/vnd.openxmlformats-officedocument", "application/vnd.ms-", "application/vnd.oasis.opendocument", "application/epub+zip"),
    "fonts": ("font/", "application/font-woff", "application/vnd.ms-fontobject", "application/x-font-ttf"),
    "scripts": ("application/javascript", "text/javascript", "application/x-javascript", "application/ecmascript", "application/json", "application/wasm"),
    "styles": ("text/css",),
    "data": ("application/json", "application/xml", "text/xml", "text/csv"),
    "binaries": ("application/octet-stream", "application/x-msdownload", "application/x-executable", "application/x-apple-diskimage", "application/vnd.debian.binary-package"),
}
HTML_TYPES = ("text/html", "application/xhtml+xml", "application/xhtml", "text/x-server-parsed-html")
CSS_TYPES = ("text/css",)
LOG_LEVELS = ("debug", "info", "warn", "error")


def types_by_extension() -> dict[str, str]:
    """Extension -> media type: the first type listed for it, unless pinned."""
    out: dict[str, str] = {}
    for kind, ext in EXTENSIONS.items():
        out.setdefault(ext, kind)
    return out | PINNED


def lookup(value: str, table: dict[str, str]) -> str:
    """SQL: a map literal's value, null where there is none."""
    pairs = ", ".join(f"'{k}', '{v}'" for k, v in table.items())
    return f"try_element_at(map({pairs}), {value})"


def category_match(category: str, kind: str) -> str:
    tests = [f"startswith(lower({kind}), '{p}')" for p in CATEGORIES.get(category.lower(), ())]
    return "(" + (" or ".join(tests) or "false") + ")"


def is_html(kind: str) -> str:
    return f"lower({kind}) in ({', '.join(repr(x) for x in HTML_TYPES)})"


def is_css(kind: str) -> str:
    return f"lower({kind}) in ({', '.join(repr(x) for x in CSS_TYPES)})"


def is_text(kind: str) -> str:
    return f"({is_html(kind)} or {is_css(kind)} or startswith({kind}, 'text/') or endswith({kind}, '+xml') or contains({kind}, 'javascript') or {kind} = 'application/json')"


def parse_bytes(s: str) -> str:
    """SQL: 10MB, 512k or a number as bytes, in powers of 1024; null when malformed."""
    up = f"upper(replace({s}, ' ', ''))"
    num, unit = f"regexp_extract({up}, '^([0-9.]+)(?:[TGMK]?B?)$', 1)", f"regexp_extract({up}, '^[0-9.]+([TGMK]?)B?$', 1)"
    scale = f"case {unit} when 'T' then 1099511627776 when 'G' then 1073741824 when 'M' then 1048576 when 'K' then 1024 else 1 end"
    return f"if({s} = '', 0L, cast(floor(try_cast(nullif({num}, '') as double) * {scale}) as bigint))"


def exact_bytes(n: str) -> str:
    """SQL: the largest unit that divides the number."""
    cases = " ".join(f"when {n} >= {m} and {n} % {m} = 0 then concat(cast({n} / {m} as bigint), '{u}')" for u, m in (("TB", 1 << 40), ("GB", 1 << 30), ("MB", 1 << 20), ("KB", 1 << 10)))
    return f"case when {n} = 0 then '0' {cases} else cast({n} as string) end"


def human_bytes(n: str) -> str:
    """SQL: one decimal, rounded half to even, in units of 1024."""
    units = "array('K', 'M', 'G', 'T', 'P', 'E')"
    power = f"int(case {' '.join(f'when {n} < {1024 ** (k + 2)} then {k}' for k in range(5))} else 5 end)"
    return f"if({n} < 1024, concat({n}, ' B'), concat(cast(bround(cast({n} / pow(1024, {power} + 1) as decimal(38, 12)), 1) as decimal(20, 1)), ' ', {units}[{power}], 'B'))"


def short_duration(seconds: str) -> str:
    """SQL: 1h02m, 3m04s or 5s."""
    s = f"cast({seconds} as bigint)"
    return (
        f"case when {s} >= 3600 then concat({s} div 3600, 'h', lpad(cast({s} % 3600 div 60 as string), 2, '0'), 'm') "
        f"when {s} >= 60 then concat({s} div 60, 'm', lpad(cast({s} % 60 as string), 2, '0'), 's') else concat({s}, 's') end"
    )


def parse_seconds(s: str) -> str:
    """SQL: 5s, 500ms, 1h30m, 2 min, or a number of seconds, as seconds; null when malformed."""
    t = f"lower(replace(trim({s}), ' ', ''))"
    for unit, words in (("ms", "milliseconds|millisecond|millis|milli|msec"), ("s", "seconds|second|secs|sec"), ("m", "minutes|minute|mins|min"), ("h", "hours|hour|hrs|hr")):
        t = f"regexp_replace({t}, '({words})', '{unit}')"
    parts = f"regexp_extract_all({t}, '([0-9.]+)(ms|us|ns|h|m|s)', 0)"
    value = "cast(regexp_extract(x, '^[0-9.]+', 0) as double) * case regexp_extract(x, '[a-z]+$', 0) when 'h' then 3600 when 'm' then 60 when 's' then 1 when 'ms' then 0.001 when 'us' then 0.000001 else 0.000000001 end"
    total = f"aggregate({parts}, 0D, (a, x) -> a + {value})"
    return f"case when trim({s}) = '' then 0D when {t} rlike '^[0-9.]+$' then try_cast({t} as double) when {t} rlike '^([0-9.]+(ms|us|ns|h|m|s))+$' then {total} end"


def truncated(s: str, n: int) -> str:
    return f"if(char_length({s}) <= {n}, {s}, concat(left({s}, {n} - 1), '…'))"


def truncated_left(s: str, n: int) -> str:
    return f"if(char_length({s}) <= {n}, {s}, concat('…', right({s}, {n} - 1)))"


def short_reason(err: str) -> str:
    """SQL: what follows the first ': ', cut to 80 bytes and an ellipsis of dots."""
    tail = f"if(instr({err}, ': ') > 0, substr({err}, instr({err}, ': ') + 2), {err})"
    return f"if(octet_length({tail}) > 80, concat(decode(substr(encode({tail}, 'UTF-8'), 1, 80), 'UTF-8'), '...'), {tail})"


def short_type(kind: str) -> str:
    bare = f"trim(substring_index({kind}, ';', 1))"
    return f"regexp_replace(if(instr({bare}, '/') > 0, substr({bare}, instr({bare}, '/') + 1), {bare}), r'^(x-|vnd\\.)', '')"


def content_type(header: str) -> str:
    return f"lower(trim(substring_index({header}, ';', 1)))"


def disposition_name(header: str) -> str:
    return f"regexp_extract({header}, '(?i)filename=\"?([^\";]+)', 1)"


def backoff(base: str, attempt: str, most: str, retry_after: str = "cast(null as double)") -> str:
    """SQL: base * 2^(attempt - 1), or what the server asked for, at most ``most``."""
    return f"least(coalesce({retry_after}, {base} * pow(2, {attempt} - 1)), {most})"


def eta(remaining: str, rate: str) -> str:
    return f"if({rate} > 0.01, {remaining} / {rate}, null)"


def job_name(s: str) -> str:
    return f"trim(both '-' from regexp_replace({s}, '[^A-Za-z0-9._-]+', '-'))"


def level_rank(level: str) -> str:
    return "case " + " ".join(f"when {level} = '{x}' then {k}" for k, x in enumerate(LOG_LEVELS)) + " else 1 end"
