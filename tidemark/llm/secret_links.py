"""Secret scans with multipart credential linking, in DataFrame operations only.

Strong spans (``assign``, ``access``, ``hex``) are always reported. Weak candidates, a labelled
account name (``id``), an unlabelled mixed token (``part``) or an endpoint (``host``), say little
alone: an interval join over the positions within a text reports one only if parts of a
complementary role stand within ``SCOPE`` code points of it. Roles are identifier, secret and
endpoint. A weak identifier or secret needs a strong part of the other kind, or both other roles;
an endpoint needs both.

Positions are code points from 0, ends exclusive. Each pattern is searched once in a text; the
lengths of its matches and of the pieces between them give every start, summed in runs of ``RUN``.
What is found is written aside without the texts, and joined by text and stretch of ``SCOPE`` code
points, so work grows with the number of parts and one text of very many parts is spread out.

Edge cases: a null or empty text has no spans; very long texts are searched whole; repeated rows
and ids are scanned one by one; spans that tie by start are listed by kind, in the order of
``KINDS``; an empty table gives an empty result; columns of ``docs`` named like an output column
(``base``, ``spans``) are replaced by ``scan`` and kept by ``redact``; any other name is safe.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.runtime import stash

#: Patterns of the base kinds; letters of the keywords in either case, spelled out so that every
#: regex engine agrees. \x22 and \x27 are the quotes.
ASSIGN = (
    r"(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
    r"[\x22\x27]?\x20*[:=]\x20*[\x22\x27]?([A-Za-z0-9+/_.=-]+)"
)
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
#: Patterns of weak candidates.
ID = r"(?:access_key_id|client_id|account_id|username|login)[\x22\x27]?\x20*[:=]\x20*[\x22\x27]?[A-Za-z0-9._@-]{4,}"
PART = r"[A-Za-z0-9+/_-]{24,}"
HOST = r"https?://[A-Za-z0-9.:-]+"

#: kind -> (pattern, condition on a match m, role, strong); in the order in which ties are listed.
KINDS = {
    "assign": (ASSIGN, f"length(regexp_extract(m, r'{ASSIGN}', 1)) >= 8", "secret", True),
    "access": (ACCESS, "true", "identifier", True),
    "hex": (HEX, "true", "secret", True),
    "id": (ID, "true", "identifier", False),
    "part": (PART, "m rlike '[0-9]' and m rlike '[A-Z]' and m rlike '[a-z]'", "secret", False),
    "host": (HOST, "true", "endpoint", False),
}
STRONG = [k for k, v in KINDS.items() if v[3]]
WEAK = [k for k, v in KINDS.items() if not v[3]]
SCOPE = 400
SPAN = "array<struct<start:int,rank:int,end:int,kind:string>>"
#: Matches whose starts are summed together, and code points that are cut together.
RUN, CUT = 256, 4096


def _let(value: str, name: str, body: str) -> str:
    """SQL: ``body`` with ``name`` bound to ``value``, evaluated once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _spans(kind: str) -> str:
    """SQL: the spans of one pattern in ``t``; texts without a match cost one search.

    Everything that is read more than once is bound: a column would be written out, and computed
    again, wherever a later projection mentions it.
    """
    pattern, keep, _, _ = KINDS[kind]
    widths = "transform(m, (x, k) -> struct(length(g[k]) as gap, length(x) as len))"
    runs = f"""transform(sequence(0, int((size(w) - 1) / {RUN})), c -> aggregate(slice(w, c * {RUN} + 1, {RUN}), struct(0 as pos, cast(array() as array<int>) as starts),
                 (a, x) -> struct(a.pos + x.gap + x.len as pos, array_append(a.starts, a.pos + x.gap) as starts)))"""
    before = "aggregate(r, struct(0 as pos, cast(array() as array<int>) as at), (a, x) -> struct(a.pos + x.pos as pos, array_append(a.at, a.pos) as at)).at"
    starts = "flatten(transform(r, (x, c) -> transform(x.starts, y -> y + b[c])))"
    out = f"""cast(transform(filter(transform(m, (x, k) -> struct(s[k] as s, x as m)), x -> {keep.replace("(m,", "(x.m,").replace("m rlike", "x.m rlike")}),
                x -> struct(x.s, {list(KINDS).index(kind)}, x.s + length(x.m), '{kind}')) as {SPAN})"""
    bound = _let(widths, "w", _let(runs, "r", _let(before, "b", _let(starts, "s", out))))
    found = _let(f"regexp_extract_all(t, r'{pattern}', 0)", "m", _let(f"split(t, r'{pattern}', -1)", "g", bound))
    return f"if(t rlike r'{pattern}', {found}, cast(array() as {SPAN}))"


def _roles(x: str = "x") -> str:
    return f"case {x}.kind " + " ".join(f"when '{k}' then '{v[2]}'" for k, v in KINDS.items()) + " end"


def _found(docs: DataFrame, text: str, columns: list[str]) -> DataFrame:
    """(row, doc, strong, weak), written: ``doc`` has ``columns``. Each text is searched once."""
    of = lambda kinds: F.expr(f"sort_array(concat({', '.join(map(_spans, kinds))}))")
    texts = docs.select(F.struct(*columns).alias("doc"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    return stash(texts.select(F.monotonically_increasing_id().alias("row"), "doc", of(STRONG).alias("strong"), of(WEAK).alias("weak")), "secret-parts")


def _scanned(docs: DataFrame, text: str, columns: list[str]) -> DataFrame:
    """(doc, base, spans). Only rows with a weak candidate and parts of several roles, which are
    few, are joined; all others keep their place and are never shuffled."""
    found = _found(docs, text, columns)
    linkable = F.expr(f"size(weak) > 0 and size(array_distinct(transform(concat(weak, strong), x -> {_roles()}))) > 1")
    plain = found.where(~linkable).select("doc", F.col("strong").alias("base"), F.col("strong").alias("spans"))
    some = found.where(linkable)
    joined = some.join(_linked(some.select("row", "strong", "weak")), "row", "left")
    spans = F.sort_array(F.concat("strong", F.coalesce("links", F.array().cast(SPAN))))
    return plain.unionByName(joined.select("doc", F.col("strong").alias("base"), spans.alias("spans")))


def scan(docs: DataFrame, text: str = "text", columns: list[str] | None = None) -> DataFrame:
    """``docs`` (or ``columns`` of it) with ``base`` (strong spans) and ``spans`` (those and the
    weak ones linked), each by start, then kind."""
    columns = [c for c in columns or docs.columns if c not in ("base", "spans")]
    return _scanned(docs, text, columns).select(*[F.col("doc")[c].alias(c) for c in columns], "base", "spans")


def _free(some: DataFrame) -> DataFrame:
    """(row, x): weak spans that touch no strong one; one that does is that one, or a piece of it."""
    covers = F.expr(f"explode(sequence(int(x.start / {SCOPE}), int((x.end - 1) / {SCOPE})))").alias("bin")
    strong = some.select("row", F.explode("strong").alias("x")).select("row", "x", covers).groupBy("row", "bin").agg(F.collect_list("x").alias("near"))
    weak = some.select("row", F.explode("weak").alias("x")).select("row", "x", covers).join(strong, ["row", "bin"], "left")
    touched = F.expr("coalesce(exists(near, s -> s.start < x.end and x.start < s.end), false)")
    return weak.groupBy("row", "x").agg(F.max(touched).alias("touched")).where("not touched").select("row", "x")


def _linked(some: DataFrame) -> DataFrame:
    """(row, links): interval join of the parts of each text, for the weak ones that complementary
    parts confirm."""
    free = _free(some)
    parts = some.select("row", F.explode("strong").alias("x"), F.lit(True).alias("strong")).unionByName(free.withColumn("strong", F.lit(False)))
    parts = parts.select("row", "x", F.expr(_roles()).alias("role"), "strong", F.expr(f"int(x.start / {SCOPE})").alias("bin"))
    # One row for each role, strength and stretch: whether a start there is near decides.
    other = parts.groupBy("row", "bin", "role", "strong").agg(F.collect_set("x.start").alias("starts"))
    weak = parts.where(~F.col("strong")).select("row", "x", F.col("role").alias("own"), F.explode(F.expr("array(bin - 1, bin, bin + 1)")).alias("bin"))
    near = weak.join(other, ["row", "bin"]).where((F.col("role") != F.col("own")) & F.expr(f"exists(starts, s -> abs(s - x.start) <= {SCOPE})"))
    votes = near.groupBy("row", "x", "own").agg(F.size(F.collect_set("role")).alias("roles"), F.max(F.col("strong") & (F.col("role") != "endpoint")).alias("pair"))
    good = votes.where((F.col("roles") == 2) | (F.col("pair") & (F.col("own") != "endpoint")))
    return good.groupBy("row").agg(F.collect_list("x").alias("links"))


def redact(docs: DataFrame, text: str = "text", mask: str = "[SECRET]") -> DataFrame:
    """``docs`` with every reported span of ``text`` replaced by ``mask``; overlapping spans are one.

    A text is cut into stretches of ``CUT`` code points, each masked by the spans that reach it.
    """
    columns = docs.columns
    quoted = mask.replace("\\", "\\\\").replace("'", "\\'")
    one = f"""aggregate(filter(w, s -> s.start >= k * {CUT}), struct(coalesce(array_max(transform(filter(w, s -> s.start < k * {CUT}), s -> s.end)), k * {CUT}) as pos, '' as out),
                (a, s) -> struct(greatest(a.pos, s.end) as pos, if(s.start >= a.pos, concat(a.out, substring(x, a.pos - k * {CUT} + 1, s.start - a.pos), '{quoted}'), a.out) as out),
                a -> concat(a.out, substring(x, a.pos - k * {CUT} + 1)))"""
    reach = f"filter(spans, s -> s.start < (k + 1) * {CUT} and s.end > k * {CUT})"
    cut = F.expr(f"array_join(transform(regexp_extract_all(t, '(?s).{{1,{CUT}}}', 0), (x, k) -> {_let(reach, 'w', one)}), '')")
    found = _scanned(docs, text, columns).select("doc", "spans", F.col("doc")[text].alias("t"))
    new = F.when(F.size("spans") > 0, cut).otherwise(F.col("t"))
    return found.select(*[new.alias(c) if c == text else F.col("doc")[c].alias(c) for c in columns])


def _listed(column: str) -> str:
    return f"concat_ws(',', transform({column}, s -> concat_ws(':', s.kind, s.start, s.end)))"


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    count = lambda k: F.expr(f"bigint(size(filter(base, s -> s.kind = '{k}')))").alias(f"n_{k}")
    return scan(docs, columns=["doc_id"]).select("doc_id", *[count(k) for k in STRONG], F.expr(f"sha2({_listed('base')}, 256)").alias("base_sha256"), F.expr(_listed("spans")).alias("spans"))


def _sql_spans(kind: str, cond: str) -> str:
    p = KINDS[kind][0]
    return f"""SELECT r, '{kind}' AS kind, {list(KINDS).index(kind)} AS k, s, s + length(m) AS e FROM (
      SELECT r, ms[i] AS m, CAST(list_sum(list_transform(gs[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS s
      FROM (SELECT r, ms, gs, unnest(range(1, len(ms) + 1)) AS i FROM (
        SELECT r, regexp_extract_all(t, '{p}') AS ms, string_split_regex(t, '{p}') AS gs FROM d WHERE regexp_matches(t, '{p}')))
    ) WHERE {cond}"""


OP2_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
strong AS (
  {_sql_spans("assign", f"length(regexp_extract(m, '{ASSIGN}', 1)) >= 8")}
  UNION ALL {_sql_spans("access", "true")}
  UNION ALL {_sql_spans("hex", "true")}
), loose AS (
  {_sql_spans("id", "true")}
  UNION ALL {_sql_spans("part", "regexp_matches(m, '[0-9]') AND regexp_matches(m, '[A-Z]') AND regexp_matches(m, '[a-z]')")}
  UNION ALL {_sql_spans("host", "true")}
), weak AS (
  SELECT * FROM loose w WHERE NOT EXISTS (SELECT 1 FROM strong s WHERE s.r = w.r AND s.s < w.e AND w.s < s.e)
), parts AS (
  SELECT *, CASE WHEN kind IN ('assign', 'hex', 'part') THEN 'secret' WHEN kind = 'host' THEN 'endpoint' ELSE 'identifier' END AS role, k < 3 AS strong
  FROM (SELECT * FROM strong UNION ALL SELECT * FROM weak)
), votes AS (
  SELECT w.r, w.kind, w.k, w.s, w.e, w.role, count(DISTINCT o.role) AS roles, bool_or(o.strong AND o.role <> 'endpoint') AS pair
  FROM parts w JOIN parts o ON o.r = w.r AND o.role <> w.role AND abs(o.s - w.s) <= {SCOPE}
  WHERE NOT w.strong GROUP BY ALL
), spans AS (
  SELECT r, kind, k, s, e FROM strong UNION ALL
  SELECT r, kind, k, s, e FROM votes WHERE roles = 2 OR (pair AND role <> 'endpoint')
), a AS (
  SELECT r, count(*) FILTER (WHERE kind = 'assign') AS n_assign, count(*) FILTER (WHERE kind = 'access') AS n_access,
         count(*) FILTER (WHERE kind = 'hex') AS n_hex,
         string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, k, e) FILTER (WHERE k < 3) AS base,
         string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, k, e) AS spans
  FROM spans GROUP BY r
)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN a USING (r)
"""
