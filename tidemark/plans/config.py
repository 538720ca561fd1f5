"""Settings of a crawl analysis: consumed when a plan is built, so modes become expressions."""

from __future__ import annotations

import json
import re
from dataclasses import asdict, dataclass, field, fields, replace
from urllib.parse import urlsplit

from tidemark.functions import urls

CONSTRAINTS = ("host", "host+1", "subdomains", "directory", "rules", "none")
SUPPORTING = ("none", "related", "any")
TYPE_MODES = ("all", "allow", "disallow")
RENDER_MODES = ("never", "auto", "always")
#: Settings that cannot change while a crawl runs.
LOCKED = frozenset({"start_urls", "constraint", "host_folders"})


@dataclass(frozen=True)
class Settings:
    start_urls: tuple[str, ...] = ()
    constraint: str = "host"
    supporting_files: str = "related"
    include: tuple[str, ...] = ()
    include_glob: tuple[str, ...] = ()
    exclude: tuple[str, ...] = ()
    exclude_glob: tuple[str, ...] = ()
    hosts: tuple[str, ...] = ()
    asset_hosts: tuple[str, ...] = ()
    block_hosts: tuple[str, ...] = ()
    max_url_length: int = 2000
    skip_query_urls: bool = False
    ignore_query: bool = False
    drop_query_params: tuple[str, ...] = ()
    ambiguous_as_dir: bool = False
    max_path_depth: int = 0
    max_repeat_segment: int = 3
    max_levels: int = 0
    allow_extensions: tuple[str, ...] = ()
    block_extensions: tuple[str, ...] = ()
    types_mode: str = "all"
    type_categories: tuple[str, ...] = ()
    type_custom: tuple[str, ...] = ()
    type_replacements: tuple[tuple[str, str], ...] = ()
    min_file_size: int = 0
    max_file_size: int = 0
    host_folders: bool = True
    single_host: str = ""
    replace_special: bool = False
    append_extension: bool = True
    lowercase_paths: bool = False
    index_file: str = "index.html"
    max_segment_length: int = 120
    max_path_length: int = 3800
    path_rewrites: tuple[tuple[str, str], ...] = ()
    follow_forms: bool = False
    respect_nofollow: bool = False
    render_mode: str = "never"
    render_match: tuple[str, ...] = ()
    render_skip: tuple[str, ...] = ()
    absolute_fallback: bool = True
    user_agent: str = "mozilla"
    retry_passes: int = 2
    attributes: tuple[str, ...] = field(default=())

    def validated(self) -> Settings:
        """Raises ValueError for values outside their domain and patterns that don't compile."""
        for name, domain in (("constraint", CONSTRAINTS), ("supporting_files", SUPPORTING), ("types_mode", TYPE_MODES), ("render_mode", RENDER_MODES)):
            if getattr(self, name) not in domain:
                raise ValueError(f"{name}: {getattr(self, name)!r} is not one of {', '.join(domain)}")
        patterns = [*self.include, *self.exclude, *self.render_match, *self.render_skip, *(p for p, _ in self.path_rewrites), *(p for p, _ in self.type_replacements)]
        for p in patterns:
            portable(p)
        return self

    def normalized(self) -> Settings:
        """What a run begins with: start URLs with schemes, lists without repeats, no negative limits."""
        if not self.start_urls:
            raise ValueError("no start URL given")
        lists = {f.name: tuple(dict.fromkeys(v)) for f in fields(self) if isinstance(v := getattr(self, f.name), tuple)}
        limits = {f.name: max(v, 0) for f in fields(self) if isinstance(v := getattr(self, f.name), int) and not isinstance(v, bool)}
        starts = tuple(dict.fromkeys(start_url(x, i) for i, x in enumerate(self.start_urls, 1)))
        return replace(self, **lists | limits | {"start_urls": starts}).validated()


def start_url(raw: str, number: int = 1) -> str:
    """A start URL with its scheme; raises where ``urls.start_problem`` names a reason."""
    url = raw.strip(" \t\r\n")
    if not url:
        raise ValueError(f"start URL {number} is empty")
    if "://" not in url:
        name, _, port = re.match("[^/?#]*", url.lower()).group().partition(":")
        plain = name in urls.PLAIN_HOSTS or name.endswith(urls.PLAIN_SUFFIXES) or port not in ("", *urls.SECURE_PORTS)
        url = f"{'http' if plain else 'https'}://{url}"
    parts = urlsplit(url)
    if not parts.netloc:
        raise ValueError(f"start URL {raw!r} has no host")
    if parts.scheme not in ("http", "https"):
        raise ValueError(f"start URL {raw!r}: unsupported scheme {parts.scheme!r}")
    return url


def portable(pattern: str) -> str:
    """The pattern, if every engine reads it alike: no lookaround, no back-references."""
    re.compile(pattern)
    if re.search(r"\(\?[=!<]|\\[1-9]", pattern):
        raise ValueError(f"{pattern!r} uses lookaround or a back-reference")
    return pattern


def glob(pattern: str) -> str:
    """A shell glob as an anchored pattern."""
    return "^" + "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in pattern) + "$"


def overlay(*layers: dict) -> Settings:
    """Later layers win; a list replaces the list before it, and an empty one clears it."""
    names = {f.name for f in fields(Settings)}
    merged: dict = {}
    for layer in layers:
        if unknown := set(layer) - names:
            raise ValueError(f"unknown settings: {', '.join(sorted(unknown))}")
        merged |= {k: tuple(map(_frozen, v)) if isinstance(v, list | tuple) else v for k, v in layer.items() if v is not None}
    return Settings(**merged).validated()


def _frozen(x):
    return tuple(x) if isinstance(x, list) else x


def load(*paths: str) -> Settings:
    """Settings from JSON or, where a parser is installed, YAML files, laid over each other."""
    layers = []
    for path in paths:
        with open(path, encoding="utf-8") as f:
            text = f.read()
        if path.endswith((".yaml", ".yml")):
            import yaml

            layers.append(yaml.safe_load(text) or {})
        else:
            layers.append(json.loads(text))
    return overlay(*layers)


def difference(old: Settings, new: Settings) -> tuple[list[str], list[str]]:
    """Names of settings that changed: those that apply to a running crawl, and those ignored."""
    a, b = asdict(old), asdict(new)
    changed = [k for k in a if json.dumps(a[k]) != json.dumps(b[k])]
    return [k for k in changed if k not in LOCKED], [k for k in changed if k in LOCKED]


def reconfigured(old: Settings, new: Settings) -> Settings:
    """``old`` with the changes that may apply; raises, leaving it as it is, if one is invalid."""
    applied, _ = difference(old, new.validated())
    return replace(old, **{k: getattr(new, k) for k in applied})


def describe(s: Settings) -> str:
    """What a run would do, in a few lines."""
    lines = [f"start: {', '.join(s.start_urls) or '-'}", f"scope: {s.constraint}; supporting files: {s.supporting_files}"]
    lines += [f"{k}: {', '.join(map(str, v))}" for k in ("include", "exclude", "hosts", "asset_hosts", "block_hosts") if (v := getattr(s, k))]
    limits = {k: getattr(s, k) for k in ("max_levels", "max_path_depth", "min_file_size", "max_file_size") if getattr(s, k)}
    return "\n".join([*lines, "limits: " + (", ".join(f"{k} {v}" for k, v in limits.items()) or "none"), f"render: {s.render_mode}"])
