"""Byte scanner for HTML and CSS: links with the offsets of their values.

One pass of compiled patterns over the bytes finds comments, raw-text elements and tags; nothing
is decoded, so offsets hold for any encoding. Offsets of srcset, style and refresh values are
taken on the raw bytes of the attribute. Values are unescaped for resolving only.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.runtime import small_batches

#: Attributes that hold URLs, by tag, and the kind of link they make. Fixed values.
URL_ATTRIBUTES = {
    "a": {"href": "anchor", "ping": "asset"}, "area": {"href": "anchor"},
    "link": {"href": "asset", "imagesrcset": "asset"}, "img": {"src": "asset", "longdesc": "asset", "usemap": "asset"},
    "script": {"src": "asset"}, "iframe": {"src": "frame"}, "frame": {"src": "frame", "longdesc": "asset"},
    "embed": {"src": "asset"}, "object": {"data": "asset", "codebase": "asset"},
    "applet": {"code": "asset", "codebase": "asset", "archive": "asset"}, "source": {"src": "asset"},
    "track": {"src": "asset"}, "audio": {"src": "asset"}, "video": {"src": "asset", "poster": "asset"},
    "input": {"src": "asset", "formaction": "form"}, "button": {"formaction": "form"}, "form": {"action": "form"},
    "blockquote": {"cite": "asset"}, "q": {"cite": "asset"}, "del": {"cite": "asset"}, "ins": {"cite": "asset"},
    "base": {"href": "base"}, "body": {"background": "asset"}, "table": {"background": "asset"},
    "td": {"background": "asset"}, "th": {"background": "asset"}, "menuitem": {"icon": "asset"}, "html": {"manifest": "asset"},
}
SRCSET = ("srcset", "imagesrcset", "data-srcset")
#: Relations of <link> that name nothing to fetch. Fixed values.
DECLARATIVE = frozenset({
    "dns-prefetch", "preconnect", "alternate", "canonical", "pingback", "webmention", "search", "profile", "author", "license", "me",
    "nofollow", "noopener", "noreferrer", "external",
})

LINK = "struct<value:string,kind:string,tag:string,attr:string,start:int,end:int,nofollow:boolean,descriptor:string>"
DOCUMENT = f"links array<{LINK}>, base string, charset string, noindex boolean, nofollow_all boolean, title string, raw_title string"

_TOKEN = re.compile(rb"<!--(?P<comment>.*?)(?:-->|\Z)|<(?P<raw>script|style)\b(?P<rattrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<(?P<tag>[A-Za-z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S | re.I)
_ATTR = re.compile(rb"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]*)))?", re.S)
_CSS = re.compile(rb"/\*.*?(?:\*/|\Z)|@import\s*(?:\"((?:\\.|[^\"\\])*)\"|'((?:\\.|[^'\\])*)')|url\(\s*(?:\"((?:\\.|[^\"\\])*)\"|'((?:\\.|[^'\\])*)'|([^)]*?))\s*(?:\)|\Z)|\"(?:\\.|[^\"\\])*\"|'(?:\\.|[^'\\])*'", re.S | re.I)
_NOT_URL = re.compile(r"(?i)^(data:|about:|#|var\(|none$)")


def css_links(src: bytes, base: int = 0, tag: str = "css") -> list[tuple]:
    """url() and @import values outside comments and strings."""
    out = []
    for m in _CSS.finditer(src):
        group = next((g for g in range(1, 6) if m.group(g) is not None), 0)
        if not group:
            continue
        start, end = m.span(group)
        text = src[start:end].decode("utf-8", "replace").strip()
        if text and not (group > 2 and _NOT_URL.match(text)):
            out.append((re.sub(r"\\(.)", r"\1", text), "css", tag, "import" if group <= 2 else "url", base + start, base + end, False, None))
    return out


def srcset_links(src: bytes, base: int, tag: str, attr: str) -> list[tuple]:
    out = []
    for m in re.finditer(rb"[^,]+", src):
        if word := re.search(rb"\S+", m.group()):
            start = base + m.start() + word.start()
            rest = m.group()[word.end() :].decode("utf-8", "replace").strip()
            out.append((html.unescape(word.group().decode("utf-8", "replace")), "srcset", tag, attr, start, start + len(word.group()), False, rest))
    return out


def refresh_link(src: bytes) -> tuple[int, int] | None:
    m = re.search(rb"(?i)url=[ \t]*(?:'([^']*)'?|\"([^\"]*)\"?|([^ \t;]*))", src)
    span = next((m.span(g) for g in (1, 2, 3) if m and m.group(g)), None)
    return span


def _tag_links(tag: str, raw: bytes, base: int, doc: dict) -> Iterator[tuple]:
    attrs = []
    for m in _ATTR.finditer(raw):
        group = next((g for g in (2, 3, 4) if m.group(g) is not None), 0)
        start, end = m.span(group) if group else (m.end(), m.end())
        attrs.append((m.group(1).decode("latin-1").lower(), html.unescape(raw[start:end].decode("utf-8", "replace")), base + start, base + end, raw[start:end]))
    # Of repeated attributes the last counts.
    named = {name: value for name, value, *_ in attrs}
    rel = named.get("rel", "").lower()
    if tag == "meta":
        yield from _meta(attrs, named, doc)
        return
    for name, value, start, end, body in attrs:
        if name == "style":
            yield from ((*x[:2], tag, "style", *x[4:]) for x in css_links(body, start))
        elif not value:
            continue
        elif name in SRCSET:
            yield from srcset_links(body, start, tag, name)
        elif kind := URL_ATTRIBUTES.get(tag, {}).get(name):
            if tag == "link" and name == "href" and rel and all(t in DECLARATIVE for t in rel.split()):
                continue
            yield (value, kind, tag, name, start, end, "nofollow" in rel, None)
            if kind == "base":
                doc.setdefault("base", value)


def _meta(attrs: list, named: dict, doc: dict) -> Iterator[tuple]:
    if "charset" in named:
        doc.setdefault("charset", named["charset"].strip())
    content, equiv, name = named.get("content", ""), named.get("http-equiv", "").strip().lower(), named.get("name", "").strip().lower()
    if equiv == "content-type" and "charset=" in content.lower():
        doc.setdefault("charset", content[content.lower().index("charset=") + 8 :].strip())
    if name in ("robots", "googlebot"):
        doc["noindex"] = doc.get("noindex", False) or "noindex" in content.lower()
        doc["nofollow_all"] = doc.get("nofollow_all", False) or "nofollow" in content.lower()
    if equiv == "refresh":
        for attr, _, start, _, body in attrs:
            if attr == "content" and (span := refresh_link(body)):
                value = html.unescape(body[span[0] : span[1]].decode("utf-8", "replace")).strip()
                if value:
                    yield (value, "refresh", "meta", "content", start + span[0], start + span[1], False, None)


def scan_html(src: bytes, base: int = 0, nested: bool = False) -> dict:
    """Links by position, base, charset, robots flags and title of one document. The raw title is the
    text of the first title as written: a cut entity ("&amp") can't be told from what it stands for."""
    doc: dict = {}
    links: list[tuple] = []
    at = 0
    while m := _TOKEN.search(src, at):
        at = m.end()
        if m.group("comment") is not None:
            if not nested:
                inner = scan_html(m.group("comment"), base + m.start("comment"), True)
                links += inner["links"]
        elif m.group("raw"):
            tag = m.group("raw").decode().lower()
            links += _tag_links(tag, m.group("rattrs"), base + m.start("rattrs"), doc)
            close = re.compile(rb"</" + tag.encode() + rb"\b", re.I).search(src, at)
            end = close.start() if close else len(src)
            if tag == "style":
                links += css_links(src[at:end], base + at, "css")
            at = end
        else:
            tag = m.group("tag").decode("latin-1").lower()
            links += _tag_links(tag, m.group("attrs"), base + m.start("attrs"), doc)
            if tag == "title" and "title" not in doc:
                raw = src[at : (src.find(b"<", at) + len(src) + 1) % (len(src) + 1)].decode("utf-8", "replace")
                doc.setdefault("raw_title", raw)
                if text := html.unescape(raw).strip():
                    doc["title"] = text
    links.sort(key=lambda x: x[4])
    return {"links": links, "base": doc.get("base"), "charset": doc.get("charset"), "noindex": doc.get("noindex", False), "nofollow_all": doc.get("nofollow_all", False), "title": doc.get("title"), "raw_title": doc.get("raw_title")}


def element_ranges(src: bytes, tag: str) -> list[tuple[int, int]]:
    """Byte ranges of an element with its tags; an unclosed one runs to the end."""
    out, at = [], 0
    opening = re.compile(rb"<" + tag.encode() + rb"(?=[\s/>])", re.I)
    closing = re.compile(rb"</" + tag.encode() + rb"\s*>", re.I)
    while m := opening.search(src, at):
        end = closing.search(src, m.end())
        at = end.end() if end else len(src)
        out.append((m.start(), at))
    return out


def apply_spans(src: bytes, spans: list[tuple[int, int, bytes]]) -> bytes:
    """Replaces spans in order; one that overlaps an earlier one is left out."""
    out, at = [], 0
    for start, end, text in sorted(spans, key=lambda x: x[0]):
        if start >= at and end <= len(src):
            out += [src[at:start], text]
            at = end
    return b"".join([*out, src[at:]])


def scanned(docs: DataFrame, body: str = "body", css: bool = False) -> DataFrame:
    """``docs`` with links, base, charset, noindex, nofollow_all, title and raw_title of each body."""
    small_batches(docs.sparkSession, 256)
    kept = [c for c in docs.columns if c not in ("links", "base", "charset", "noindex", "nofollow_all", "title", "raw_title")]
    source = docs.select(*kept).withColumn("_bytes", F.col(body).cast("binary"))
    names = ["value", "kind", "tag", "attr", "start", "end", "nofollow", "descriptor"]
    types = [pa.string(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.bool_(), pa.string()]
    link = pa.struct(list(zip(names, types, strict=True)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for x in batch.column(len(kept)):
                src = x.as_py() or b""
                rows.append({"links": css_links(src), "base": None, "charset": None, "noindex": False, "nofollow_all": False, "title": None, "raw_title": None} if css else scan_html(src))
            links = pa.array([[dict(zip(names, v, strict=True)) for v in r["links"]] for r in rows], pa.list_(link))
            flat = [pa.array([r[k] for r in rows], t) for k, t in (("base", pa.string()), ("charset", pa.string()), ("noindex", pa.bool_()), ("nofollow_all", pa.bool_()), ("title", pa.string()), ("raw_title", pa.string()))]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], links, *flat], [*kept, "links", "base", "charset", "noindex", "nofollow_all", "title", "raw_title"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.select(*kept).schema) + ", " * bool(kept) + DOCUMENT
    return source.mapInArrow(run, schema)


def ranges(docs: DataFrame, tag: str, body: str = "body") -> DataFrame:
    """``docs`` without the body, one row for each element: the bytes from ``start`` to ``end``."""
    small_batches(docs.sparkSession, 256)
    kept = [c for c in docs.columns if c not in (body, "start", "end")]
    source = docs.select(*kept, F.col(body).cast("binary").alias("_bytes"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(i, *x) for i, b in enumerate(batch.column(len(kept))) for x in element_ranges(b.as_py() or b"", tag)]
            row = pa.array([i for i, _, _ in found], pa.int32())
            at = [pa.array([x[k] for x in found], pa.int32()) for k in (1, 2)]
            yield pa.RecordBatch.from_arrays([*(c.take(row) for c in batch.columns[: len(kept)]), *at], [*kept, "start", "end"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in source.select(*kept).schema), "start int", "end int"])
    return source.mapInArrow(run, schema)


def anchors(docs: DataFrame, body: str = "html") -> DataFrame:
    """The fast path, without Python: ``docs`` exploded to (pos, ref), the href values in order."""
    refs = F.regexp_extract_all(F.col(body), F.lit('(?i)<a\\b[^>]*?\\bhref="([^"]*)"'), F.lit(1))
    return docs.select(*[c for c in docs.columns if c != body], F.posexplode(refs).alias("pos", "ref"))


#: What a page that is built by its scripts looks like: fixed values.
MOUNTS = (
    r"(?is)<div[^>]+id=[\x22\x27]?(root|app|__next|___gatsby|application)[\x22\x27]?[^>]*>\s*</div>",
    r"(?is)<div[^>]+data-reactroot",
    r"(?is)<[^>]+ng-app",
    r"(?is)<noscript>[^<]*(enable|turn on)[^<]*javascript",
)
HIDDEN = ("script", "style", "template", "svg", "noscript", "head")
VISIBLE_BYTES = 200


def script_driven(body: str) -> str:
    """SQL: whether a page shows next to nothing without its scripts."""
    text = body
    for tag in HIDDEN:
        text = f"regexp_replace({text}, r'(?is)<{tag}\\b[^>]*>.*?</{tag}\\s*>', ' ')"
    text = f"regexp_replace({text}, r'(?s)<!--.*?-->', ' ')"
    text = rf"trim(regexp_replace(regexp_replace({text}, r'(?s)<[^>]*>', ' '), r'\s+', ' '))"
    mounts = " or ".join(f"{body} rlike r'{m}'" for m in MOUNTS)
    return f"({body} rlike '(?i)<script' and ({mounts} or octet_length({text}) < {VISIBLE_BYTES}))"


def wants_render(mode: str, match: list[str], skip: list[str], url: str, body: str) -> str:
    """SQL: skip patterns first, then match patterns, then the mode."""
    if mode == "never":
        return "false"
    any_of = lambda ps: " or ".join(f"{url} rlike r'{p}'" for p in ps) or "false"
    rest = "true" if mode == "always" else "false" if match else script_driven(body)
    return f"case when {any_of(skip)} then false when {any_of(match)} then true else {rest} end"
