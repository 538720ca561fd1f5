"""Mixing sources to target weights along a time-varying curriculum.

Every source has a weight schedule over training time t in [0, 1], linear between its two ends.
Its integral is the source's share of the mix. A source's documents, in hash order and repeated
where the target asks for more than the source has, fill its token demand one after the other;
the position of a document is the time at which the integrated schedule reaches the token on
which the document begins. Sorting by position interleaves the sources as the schedule says.

Running sums never gather a source: rows are dealt to slices of the order hash, slice totals are
summed first, and only the rows of one slice are ordered together. A large source gets as many
slices as a small one; ``_digits`` lengthens the slice key as the table grows.

The order hash is of the id and the text, so neither null ids nor one id on very many rows gather
in a slice; only rows equal in both do.

Edge cases: null text counts 0 words and takes nothing; a very long text is one document and may
be taken in part; null is a source of its own and comes last; rows equal in id and text tie, share
one place in the order and are interchangeable; an empty table gives an empty mix; when all sizes
are 0 all targets are 0. Columns named like an output of ``mix`` (``size``, ``source_size``,
``target``, ``taken``, ``position``, ``passes``) are replaced, any others carried;
``mixed_documents`` carries all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidemark.runtime import sheltered, shuffle_width, stash, temporary

WORD = r"[^\x20\x09-\x0D]+"
REPEAT_LIMIT = 3
#: By weight class, the schedule's value at t = 0 and at t = 1; the integrals are 1, 2 and 3.
SCHEDULES = ((1.5, 0.5), (2.0, 2.0), (2.5, 3.5))
#: A plan of at most so many passes (20 bytes each) is broadcast; a longer one is joined by a shuffle.
BROADCAST_PASSES = 1_000_000
#: Rows of one slice stay near this number.
SLICE_ROWS = 4096


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def _digits(rows: int) -> int:
    """Hex digits of the order hash that name a slice: at least 256 slices a source."""
    digits = 2
    while rows > SLICE_ROWS * 16**digits and digits < 12:
        digits += 1
    return digits


def targets(totals: DataFrame, weights: list[int]) -> DataFrame:
    """Weigh and cap sources: (source, source_size) -> adds rank, class, weight and target.

    Sources above their cap are set to it and the rest is shared by weight again, until none is
    above. One row for each source; every round is one aggregate over them, whose single result
    row is all that reaches the driver.
    """
    ranked = _ranked(totals).withColumn("class", (F.col("rank") % len(weights)).cast("int"))
    ranked = ranked.withColumn("weight", F.get(F.array(*[F.lit(w).cast("bigint") for w in weights]), F.col("class")))
    ranked = stash(ranked.withColumn("cap", REPEAT_LIMIT * F.col("source_size")), "sources")
    total = ranked.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    rest, share = total, None
    while True:
        # Products of words and weights pass 2^63 where sources are many.
        capped = F.lit(False) if share is None else F.expr(f"CAST(cap AS DECIMAL(20, 0)) * CAST({share[1]} AS DECIMAL(17, 0)) < CAST(weight AS DECIMAL(17, 0)) * CAST({share[0]} AS DECIMAL(20, 0))")
        row = ranked.agg(
            F.coalesce(F.sum(F.when(capped, F.col("cap"))), F.lit(0)).alias("fixed"),
            F.coalesce(F.sum(F.when(~capped, F.col("weight"))), F.lit(0)).alias("open"),
        ).first()
        rest = total - row["fixed"]
        if share == (rest, row["open"]) or row["open"] == 0:
            break
        share = (rest, row["open"])
    if share is None:
        return ranked.withColumn("target", F.lit(0.0))
    level = F.col("weight").cast("double") * float(share[0]) / float(share[1])
    return ranked.withColumn("target", F.least(F.col("cap").cast("double"), level.cast("double")))


def _ranked(totals: DataFrame) -> DataFrame:
    """Number sources from 0 by code point, null last, without gathering them in one task."""
    spark = totals.sparkSession
    key = F.struct(F.col("source").isNull().alias("n"), F.col("source").alias("s"))
    parts = stash(
        totals.repartitionByRange(shuffle_width(spark), key).withColumn("part", F.spark_partition_id()),
        "source-ranges",
    )
    before = parts.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    before = before.withColumn("before", F.sum("n").over(W.orderBy("part")) - F.col("n")).select("part", "before")
    within = F.row_number().over(W.partitionBy("part").orderBy(key)) - 1
    return parts.join(before, "part").withColumn("rank", F.col("before") + within).drop("part", "before")


def mix(
    docs: DataFrame,
    weights: list[int] = (1, 2, 3),
    schedules: tuple[tuple[float, float], ...] = SCHEDULES,
    seed: str = "",
) -> DataFrame:
    """One row for each document of (doc_id, text, source): its size and its passes.

    ``passes`` holds, for each epoch in which the mix takes words of the document, the words
    taken and the training position. ``taken`` sums them. Other columns of ``docs`` are carried.
    """
    outputs = ("size", "source_size", "target", "taken", "position", "passes")
    docs, back = sheltered(docs.drop(*outputs), *PLAN)
    own = [c for c in docs.columns if c not in ("doc_id", "source", "text")]
    order = F.md5(F.concat(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.md5(F.coalesce(F.col("text"), F.lit("")))))
    with temporary(docs.sparkSession):
        rows = stash(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), *own, order.alias("_h")), "mix-sizes", lasting=True)
        rows = rows.withColumn("_slice", F.substring("_h", 1, _digits(rows.count())))
        starts = stash(_starts(rows, list(weights)), "mix-starts", lasting=True)
    return back(_placed(rows, starts, schedules))


#: Names of a plan's own columns.
PLAN = ("weight", "class", "n")


def _starts(rows: DataFrame, weights: list[int]) -> DataFrame:
    """For each slice of a source: the words before it, and the source's size, target and class."""
    slices = stash(rows.groupBy("source", "_slice").agg(F.sum("size").alias("n")), "mix-slices")
    shares = targets(slices.groupBy("source").agg(F.sum("n").alias("source_size")), weights)
    # Slices are summed in two steps, by their first two digits and then within those.
    slices = slices.withColumn("_first", F.substring("_slice", 1, 2))
    firsts = slices.groupBy("source", "_first").agg(F.sum("n").alias("n"))
    firsts = firsts.select("source", "_first", (F.sum("n").over(W.partitionBy("source").orderBy("_first")) - F.col("n")).alias("_a"))
    inner = F.sum("n").over(W.partitionBy("source", "_first").orderBy("_slice")) - F.col("n")
    slices = slices.withColumn("_b", inner)
    slices = slices.alias("s").join(firsts.alias("f"), [F.col("s.source").eqNullSafe(F.col("f.source")), F.col("s._first") == F.col("f._first")]).select("s.source", "s._slice", (F.col("_a") + F.col("_b")).alias("_before"))
    return slices.alias("s").join(shares.alias("t"), F.col("s.source").eqNullSafe(F.col("t.source"))).select(
        F.col("s.source").alias("_src"), F.col("_slice").alias("_sl"), "_before", "source_size", "target", "class"
    )


def _placed(rows: DataFrame, starts: DataFrame, schedules: tuple[tuple[float, float], ...]) -> DataFrame:
    within = F.sum("size").over(W.partitionBy("source", "_slice").orderBy("_h", "doc_id", "size").rowsBetween(W.unboundedPreceding, -1))
    placed = rows.withColumn("_in", F.coalesce(within, F.lit(0)))
    placed = placed.join(starts, [placed["source"].eqNullSafe(starts["_src"]), placed["_slice"] == starts["_sl"]])
    begin = F.col("_before") + F.col("_in")
    demand = F.floor("target").cast("bigint")
    lo, hi = (F.get(F.array(*[F.lit(float(s[end])) for s in schedules]), F.col("class") % len(schedules)) for end in (0, 1))
    placed = placed.withColumn("_lo", lo).withColumn("_hi", hi).withColumn("_begin", begin).withColumn("_demand", demand)
    passes = F.expr(
        f"""filter(transform(sequence(0, {REPEAT_LIMIT - 1}), e -> struct(e as epoch,
                greatest(0L, least(size, _demand - e * source_size - _begin)) as words,
                {_time_sql("try_divide(e * source_size + _begin, target)")} as position)), p -> p.words > 0)"""
    )
    placed = placed.withColumn("passes", passes)
    placed = placed.withColumn("taken", F.expr("aggregate(passes, 0L, (a, p) -> a + p.words)")).withColumn("position", F.expr("get(passes, 0).position"))
    keep = [c for c in rows.columns if c not in ("_h", "_slice")]
    return placed.select(*[placed[c] for c in keep], "source_size", "target", "taken", "position", "passes")


def _time_sql(part: str) -> str:
    """The time at which a linear schedule has used up ``part`` of its integral.

    With ends a and b the integral up to t is a t + (b - a) t^2 / 2; ``part`` of the whole,
    (a + b) / 2, is reached at t = 2c / (a + sqrt(a^2 + 2 (b - a) c)) with c = part (a + b) / 2.
    A schedule that begins at 0 has its first token at t = 0.
    """
    c = f"(({part}) * (_lo + _hi) / 2)"
    return f"round(coalesce(try_divide(2 * {c}, _lo + sqrt(greatest(0D, _lo * _lo + 2 * (_hi - _lo) * {c}))), 0D), 9)"


def training_order(mixed: DataFrame) -> DataFrame:
    """The schedule itself: a row for each pass, range-sorted by training position."""
    passes = mixed.withColumn("pass", F.explode("passes")).select("*", F.col("pass.epoch").alias("epoch"), F.col("pass.words").alias("words"), F.col("pass.position").alias("at"))
    return passes.drop("pass", "passes").orderBy("at", "doc_id", "epoch")


def mixed_documents(docs: DataFrame, weights: list[int] = (1, 2, 3)) -> DataFrame:
    """The mix itself: whole documents, once for each pass of which the mix takes at least half,
    range-sorted by training position; columns of ``docs``."""
    docs, back = sheltered(docs)
    held = stash(docs.withColumn("_row", F.monotonically_increasing_id()), "mix-docs", lasting=True)
    with temporary(docs.sparkSession):
        plan = mix(held.select("_row", "doc_id", "source", "text"), weights)
        plan = plan.select("_row", F.explode(F.expr("filter(passes, p -> 2 * p.words >= size)")).alias("p")).select("_row", F.col("p.position").alias("_at"), F.col("p.epoch").alias("_epoch"))
        plan = stash(plan, "mix-plan", lasting=True)
    plan = F.broadcast(plan) if plan.count() <= BROADCAST_PASSES else plan
    return back(held.join(plan, "_row").orderBy("_at", "_row", "_epoch").select(*docs.columns))


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    mixed = mix(docs).select("doc_id", "size", "source_size", "target", "taken", "position")
    return mixed.orderBy("position", "doc_id")


#: The same mix as one statement. Caps are found by the level at which the shares of the sources
#: below it and the caps of those above it add up.
OP1_SQL = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS size,
         md5(coalesce(CAST(doc_id AS VARCHAR), '') || md5(coalesce(text, ''))) AS h FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         CAST((row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 + 1 AS BIGINT) AS weight
  FROM d GROUP BY source
), total AS (SELECT CAST(coalesce(sum(source_size), 0) AS BIGINT) AS total FROM s),
rounds AS (
  SELECT 0 AS k, (SELECT total FROM total) AS rest, (SELECT CAST(sum(weight) AS BIGINT) FROM s) AS open
  UNION ALL
  SELECT k + 1,
         (SELECT total FROM total) - (SELECT CAST(coalesce(sum(3 * source_size) FILTER (WHERE 3 * source_size * r.open < weight * r.rest), 0) AS BIGINT) FROM s),
         (SELECT CAST(coalesce(sum(weight) FILTER (WHERE 3 * source_size * r.open >= weight * r.rest), 0) AS BIGINT) FROM s)
  FROM rounds r WHERE k < 60 AND open > 0
), last AS (SELECT rest, open FROM rounds WHERE open > 0 ORDER BY k DESC LIMIT 1),
t AS (
  SELECT source, source_size, weight,
         least(CAST(3 * source_size AS DOUBLE), CAST(weight * rest AS DOUBLE) / open) AS target,
         CASE weight WHEN 1 THEN 1.5::DOUBLE WHEN 2 THEN 2.0::DOUBLE ELSE 2.5::DOUBLE END AS lo,
         CASE weight WHEN 1 THEN 0.5::DOUBLE WHEN 2 THEN 2.0::DOUBLE ELSE 3.5::DOUBLE END AS hi
  FROM s, last
), p AS (
  SELECT d.doc_id, d.size, t.*, CAST(floor(target) AS BIGINT) AS demand,
         CAST(sum(size) OVER (PARTITION BY d.source ORDER BY h, doc_id, size ROWS UNBOUNDED PRECEDING) - size AS BIGINT) AS b
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), q AS (
  SELECT *, greatest(0, least(size, demand - b)) AS w0, greatest(0, least(size, demand - source_size - b)) AS w1,
         greatest(0, least(size, demand - 2 * source_size - b)) AS w2,
         (CAST(b AS DOUBLE) / target) * (lo + hi) / 2 AS c FROM p
)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target, CAST(w0 + w1 + w2 AS BIGINT) AS taken,
       CASE WHEN w0 > 0 THEN round(2 * c / (lo + sqrt(lo * lo + 2 * (hi - lo) * c)), 9) END AS position
FROM q
"""
