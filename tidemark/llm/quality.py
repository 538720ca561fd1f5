"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document; the ledger keeps the measurements and one failure
bit for each rule. Policies are versioned masks over those bits, so a new policy, or the effect
of leaving a rule out, never reads a text again: both are bitwise expressions over the ledger,
and corpus-wide ablations run on one row for each distinct bit pattern. Bits depend on the rules'
bounds, so a ledger names the ``RULESET`` that it was made by, and ablations keep rulesets apart.

Edge cases: a null or blank text has no words, all measures 0, and fails ``too_few_words``.
Rows are judged one by one, so repeated rows and repeated ids give repeated results; an empty
table gives an empty ledger; a text of any length is measured whole, in one row. Columns named
like a measurement, ``failed`` or ``ruleset`` are replaced, any others carried.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.runtime import sheltered, where_computed

WORD = r"[^\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"

#: Bit of each rule, lowest first. Fixed: stored ledgers depend on the order.
RULES = (
    "too_few_words",
    "repeated_windows",
    "symbol_heavy",
    "duplicate_lines",
    "word_length",
    "shouting",
)
BIT = {name: 1 << k for k, name in enumerate(RULES)}


@dataclass(frozen=True)
class Policy:
    """A named, versioned choice of rules; a document is kept if none of them failed."""

    name: str
    version: int
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        return sum(BIT[r] for r in self.rules)


BASE = Policy("base", 1, ("too_few_words", "repeated_windows"))
STANDARD = Policy("standard", 1, RULES)


#: Columns built one on the other. A window's entry in ``_packed`` is one bigint, hash above and
#: position below; sorted as a primitive array, windows with equal hashes stand side by side. The
#: words of neighbours are compared (``_clash``); a document in which two different windows share
#: a hash finds its repeats by the windows' text instead (``_by_name``).
STEPS = (
    ("_words", f"regexp_extract_all(_body, r'({WORD})', 1)"),
    ("_n", "size(_words)"),
    ("_lines", f"filter(split(_body, '\\n'), x -> x rlike r'{WORD}')"),
    ("_width", "length(bin(_n))"),
    (
        "_packed",
        """if(_n >= 3, sort_array(transform(slice(_words, 1, _n - 2),
             (w, i) -> shiftleft(xxhash64(w, get(_words, i + 1), get(_words, i + 2)), _width) | i)), array())""",
    ),
    (
        "_twin",
        """filter(_packed, (x, k) -> shiftright(x, _width) = shiftright(get(_packed, k + 1), _width)
             or shiftright(x, _width) = shiftright(get(_packed, k - 1), _width))""",
    ),
    ("_at", "transform(_twin, x -> int(x & (shiftleft(1L, _width) - 1)))"),
    (
        "_clash",
        """exists(sequence(1, size(_twin)), k -> shiftright(get(_twin, k), _width) = shiftright(get(_twin, k - 1), _width)
             and not (get(_words, get(_at, k)) = get(_words, get(_at, k - 1))
                  and get(_words, get(_at, k) + 1) = get(_words, get(_at, k - 1) + 1)
                  and get(_words, get(_at, k) + 2) = get(_words, get(_at, k - 1) + 2)))""",
    ),
    ("_named", "if(_clash, transform(slice(_words, 1, _n - 2), (w, i) -> concat_ws(' ', w, get(_words, i + 1), get(_words, i + 2))), array())"),
    ("_sorted", "sort_array(_named)"),
    ("_often", "array_distinct(filter(_sorted, (x, k) -> x = get(_sorted, k - 1)))"),
    ("_by_name", "filter(transform(_named, (x, i) -> if(array_contains(_often, x), i, null)), i -> i is not null)"),
    ("_starts", "if(_clash, _by_name, sort_array(_at))"),
    ("n_words", "bigint(_n)"),
    ("word_chars", r"bigint(length(_body) - regexp_count(_body, r'[\x20\x09-\x0D]'))"),
    ("n_symbols", f"bigint(regexp_count(_body, r'{SYMBOLS}'))"),
    ("n_dup_lines", "bigint(size(_lines) - size(array_distinct(_lines)))"),
    ("n_repeat_words", "aggregate(transform(_starts, (s, k) -> least(3, coalesce(get(_starts, k + 1) - s, 3))), 0L, (a, x) -> a + x)"),
    ("n_lines", "bigint(size(_lines))"),
    ("n_upper", r"bigint(regexp_count(_body, r'\p{Lu}'))"),
)


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the measurements of all rules added; no shuffle, no Python."""
    docs, back = sheltered(docs, but=(text,))
    df = docs.withColumn("_body", F.coalesce(F.col(text), F.lit("")))
    for name, sql in STEPS:
        df = df.withColumn(name, F.expr(sql))
    kept = [c for c in docs.columns if c not in MEASURES]
    return back(df.select(*kept, *MEASURES))


MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper")

#: When each rule fails, over the measurements; integer arithmetic only. The last four bounds lie
#: well beyond running prose: a symbol for every five words, two fifths of the lines repeated,
#: mean word length outside 2 to 14 code points, three of five characters upper case.
FAILS = {
    "too_few_words": "n_words < 50",
    "repeated_windows": "100 * n_repeat_words > 50 * n_words",
    "symbol_heavy": "100 * n_symbols > 20 * n_words",
    "duplicate_lines": "100 * n_dup_lines > 40 * n_lines",
    "word_length": "word_chars < 2 * n_words OR word_chars > 14 * n_words",
    "shouting": "100 * n_upper > 60 * word_chars",
}


#: Changes with any rule, its bit or its bound.
RULESET = hashlib.sha256("\n".join(f"{r}: {FAILS[r]}" for r in RULES).encode()).hexdigest()[:8]


def ledger(docs: DataFrame, text: str = "text") -> DataFrame:
    """One row for each document: its columns, the measurements, ``failed``, the failure bits, and
    the ``ruleset`` that set them."""
    bits = " | ".join(f"(CASE WHEN {FAILS[r]} THEN {BIT[r]} ELSE 0 END)" for r in RULES)
    return measure(docs.drop("failed", "ruleset"), text).withColumns({"failed": F.expr(f"CAST({bits} AS BIGINT)"), "ruleset": F.lit(RULESET)})


def fails(policy: Policy, bits: str = "failed") -> Column:
    return F.col(bits).bitwiseAND(F.lit(policy.mask)) != 0


def apply_policy(book: DataFrame, policy: Policy) -> DataFrame:
    """Documents of the ledger that the policy keeps."""
    return where_computed(book, ~fails(policy))


def ablations(book: DataFrame, *policies: Policy) -> DataFrame:
    """For each ruleset and policy, and for it without each of its rules: documents kept and dropped.

    Runs over one row for each distinct bit pattern, of which there are at most 2^rules a ruleset.
    """
    patterns = book.groupBy("ruleset", "failed").agg(F.count(F.lit(1)).alias("n"))
    cases = [(p.name, p.version, "", p.mask) for p in policies] + [
        (p.name, p.version, r, p.mask & ~BIT[r]) for p in policies for r in p.rules
    ]
    masks = F.explode(F.array(*[F.struct(F.lit(a).alias("policy"), F.lit(b).alias("version"), F.lit(c).alias("without"), F.lit(d).cast("bigint").alias("mask")) for a, b, c, d in cases]))
    hit = F.col("failed").bitwiseAND(F.col("m.mask")) == 0
    return (
        patterns.select("ruleset", "failed", "n", masks.alias("m"))
        .groupBy("ruleset", "m.policy", "m.version", "m.without")
        .agg(F.sum(F.when(hit, F.col("n")).otherwise(0)).alias("kept"), F.sum(F.when(hit, 0).otherwise(F.col("n"))).alias("dropped"))
    )


def op10(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return ledger(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        fails(BASE).alias("base_failed"),
        (~fails(BASE) & ~fails(STANDARD)).alias("kept"),
        F.col("failed").alias("failed_bits"), "n_lines", "n_upper",
    )


OP10_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), l AS (
  SELECT r, count(*) AS n_lines, count(DISTINCT line) AS n_distinct
  FROM (SELECT r, unnest(string_split(t, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r
), win AS (
  SELECT r, i, list_slice(w, i, i + 2) AS g FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM d)
), rep AS (
  SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS c FROM win) WHERE c > 1
), cov AS (
  SELECT r, count(DISTINCT i + k) AS n_repeat FROM rep, (SELECT unnest([0, 1, 2]) AS k) GROUP BY r
), m AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words,
         CAST(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(coalesce(n_lines - n_distinct, 0) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(n_repeat, 0) AS BIGINT) AS n_repeat_words,
         CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines,
         CAST(length(t) - length(regexp_replace(t, '\p{Lu}', '', 'g')) AS BIGINT) AS n_upper
  FROM d LEFT JOIN l USING (r) LEFT JOIN cov USING (r)
), b AS (
  SELECT *, (n_words < 50)::INT + 2 * (100 * n_repeat_words > 50 * n_words)::INT + 4 * (100 * n_symbols > 20 * n_words)::INT
            + 8 * (100 * n_dup_lines > 40 * n_lines)::INT
            + 16 * (word_chars < 2 * n_words OR word_chars > 14 * n_words)::INT + 32 * (100 * n_upper > 60 * word_chars)::INT AS bits FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (bits & 3) <> 0 AS base_failed,
       bits = 0 AS kept, CAST(bits AS BIGINT) AS failed_bits, n_lines, n_upper FROM b
"""


def rule_ablations(spark, sf_dir: str) -> DataFrame:
    """What each rule of the two policies costs, over all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return ablations(ledger(docs), BASE, STANDARD)


_CASES = ", ".join(
    f"('{p.name}', {p.version}, '{r}', {p.mask & ~BIT.get(r, 0)})" for p in (BASE, STANDARD) for r in ("", *p.rules)
)

ABLATIONS_SQL = f"""
SELECT '{RULESET}' AS ruleset, policy, version, "without", CAST(count(*) FILTER (WHERE failed_bits & mask = 0) AS BIGINT) AS kept,
       CAST(count(*) FILTER (WHERE failed_bits & mask <> 0) AS BIGINT) AS dropped
FROM ({OP10_SQL}) b, (VALUES {_CASES}) p(policy, version, "without", mask) GROUP BY ALL
"""
