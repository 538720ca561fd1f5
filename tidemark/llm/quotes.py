"""Chat formatting by quotation linking.

Lines that begin with quote marks are parsed into passages of one nesting level. A passage is
normalised (marks, case, white space, blank lines) and hashed, as are the runs of own lines that
could equal one; the join of both finds the message a passage was quoted from: the latest earlier
one of the same conversation, else the first message anywhere that said it. A passage that nobody
said as a whole is traced to the message with most of its distinct lines, if that is more than
half of them; equal counts are decided in the same way. A message replies to the source of
its outermost passage, or, without one, to the message before it. Quotes are then dropped, and
conversations come out in reply order: each message is followed by the replies to it within its
conversation, the earliest first, each with all that was replied to it in turn. A thread is a
message that begins or branches and the run of messages that go on from it without quoting.

Sources elsewhere are aggregated before the join to two messages for each hash, the first and the
first of another conversation than that, and those of the same conversation are found in one pass
by turn, so a passage that very many messages contain joins one row. Messages that may hold most of a passage are looked up by its rarer half of lines only.

Edge cases: null text is empty; a message of quotes only keeps an empty body; a quote that
nobody wrote is dropped and links nothing; repeated (conversation, turn) rows are separate
messages with the same links and stand together, under the earliest source that one of them
quotes; messages with a null conversation or turn are kept, but neither
give nor get links; empty tables give empty results; a text of any length is
parsed whole, in one row; extra columns are carried unless named like an output, and then replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.runtime import sheltered, stash, temporary

MARK = r"^(?:[\x20\t]*>)+"
OUTPUTS = ("body", "n_quotes", "max_level", "reply_conv", "reply_turn", "quoted", "thread")


def _normal(text: str) -> str:
    """SQL: lower case, single spaces, no quote marks in front."""
    return f"trim(regexp_replace(lower(regexp_replace({text}, r'{MARK}', '')), r'\\s+', ' '))"


def parsed(messages: DataFrame, text: str = "text") -> DataFrame:
    """``messages`` with ``body``, the own lines, and ``passages``: (level, lines) in order."""
    level = f"length(regexp_replace(regexp_extract(x, r'{MARK}', 0), '[^>]', ''))"
    df = messages.withColumn("_lines", F.expr(f"transform(split(coalesce(`{text}`, ''), '\\n'), x -> struct(x as line, {level} as level))"))
    df = df.withColumn("body", F.expr("trim(both '\n' from array_join(transform(filter(_lines, x -> x.level = 0), x -> x.line), '\n'))"))
    # A passage begins where the level changes; its number is the count of changes so far.
    df = df.withColumn("_starts", F.expr("filter(sequence(0, size(_lines) - 1), k -> _lines[k].level > 0 and (k = 0 or get(_lines, k - 1).level <> _lines[k].level))"))
    run = "slice(_lines, k + 1, size(_lines) - k)"
    length = f"coalesce(nullif(array_position(transform({run}, x -> x.level <> _lines[k].level), true), 0) - 1, size(_lines) - k)"
    df = df.withColumn("passages", F.expr(f"transform(_starts, k -> struct(_lines[k].level as level, transform(slice(_lines, k + 1, int({length})), x -> {_normal('x.line')}) as lines))"))
    return df.drop("_lines", "_starts")


def link(messages: DataFrame, conv: str = "conv_id", turn: str = "turn", text: str = "text") -> DataFrame:
    """``messages`` with ``body``, the message each replies to, and its thread's first turn.

    ``quoted`` tells whether a quotation made the link. ``reply_conv`` differs from the message's
    own conversation where the source is in another one.
    """
    messages, back = sheltered(messages, "b", "c", "t", "own", "key", but=(conv, turn, text))
    kept = [c for c in messages.columns if c not in (*OUTPUTS, "passages")]
    with temporary(messages.sparkSession):
        df = parsed(messages.select(*kept), text)
        rows = stash(df.withColumns({"_row": F.monotonically_increasing_id(), "_conv": F.col(conv), "_turn": F.col(turn)}), "quotes")
        own = rows.where("_conv is not null and _turn is not null")
        quoting = own.where("size(passages) > 0")
        passage = quoting.select("_row", "_conv", "_turn", F.posexplode("passages").alias("p", "x")).selectExpr("_row", "_conv", "_turn", "p", "x.level", "filter(x.lines, l -> l <> '') as lines")
        asked = stash(passage.where("size(lines) > 0").withColumn("key", F.expr(_HASH.format("lines"))), "quote-passages")
        said = own.select("_row", "_conv", "_turn", F.expr(f"filter(transform(split(body, '\\n'), x -> {_normal('x')}), x -> x <> '')").alias("own"))
        found = stash(_sources(asked, _whole(asked, said)), "quote-sources")
        rest = asked.where("size(lines) > 1").join(found, ["_row", "p"], "left_anti")
        if not rest.isEmpty():
            found = found.unionByName(_sources(rest, _most(rest, said)))
        # The outermost traceable passage decides.
        best = found.groupBy("_row").agg(F.min(F.struct("level", "far", "p", "c", "t")).alias("b"))
        last = _so_far(own.select("_conv", "_turn").distinct(), ["_conv"], "_turn", F.col("_turn"), "_before")
        linked = rows.join(best, "_row", "left").join(last, ["_conv", "_turn"], "left")
        quoted = F.col("b").isNotNull()
        linked = linked.withColumn("quoted", quoted).withColumn("reply_conv", F.when(quoted, F.coalesce("b.c", "_conv")).when(F.col("_before").isNotNull(), F.col("_conv")))
        linked = linked.withColumn("reply_turn", F.when(quoted, F.col("b.t")).otherwise(F.col("_before")))
        linked = stash(linked.drop("b", "_before"), "quote-links", lasting=True)
    return back(_threaded(linked).select(
        *kept, "body", F.size("passages").cast("bigint").alias("n_quotes"), F.expr("bigint(coalesce(array_max(transform(passages, x -> x.level)), 0))").alias("max_level"),
        "reply_conv", "reply_turn", "quoted", "thread",
    ))


_HASH = "md5(array_join({}, '\n'))"
SLOT = 1024


def _so_far(df: DataFrame, keys: list[str], order: str, value: Column, name: str, inclusive: bool = False) -> DataFrame:
    """``df`` with ``name``, the greatest ``value`` of the rows of the same keys that come before in
    ``order``, or up to the row itself.

    Rows have different keys and numbers in ``order``. They are split in slots of ``SLOT`` numbers;
    only the greatest value of each slot is ordered by keys alone, so a long conversation is spread.
    """
    df = df.withColumn("_slot", F.floor(F.col(order) / SLOT))
    slot = [*keys, "_slot"]
    earlier = F.max("_top").over(W.partitionBy(*keys).orderBy("_slot").rowsBetween(W.unboundedPreceding, -1))
    tops = df.groupBy(*slot).agg(F.max(value).alias("_top")).select(*slot, earlier.alias("_earlier"))
    within = W.partitionBy(*slot).orderBy(order).rowsBetween(W.unboundedPreceding, 0 if inclusive else -1)
    return df.withColumn(name, F.max(value).over(within)).join(tops, slot, "left").withColumn(name, F.greatest(name, "_earlier")).drop("_slot", "_earlier")


def _whole(asked: DataFrame, said: DataFrame) -> DataFrame:
    """(key, _conv, _turn, n): messages with a run of own lines that is the passage ``key``."""
    wanted = asked.selectExpr("md5(lines[0]) as first", "size(lines) as n").distinct()
    begins = said.select("_row", F.posexplode("own").alias("i", "line")).withColumn("first", F.md5("line")).join(wanted, "first")
    begins = begins.groupBy("_row").agg(F.collect_list(F.struct("i", "n")).alias("at"))
    runs = said.join(begins, "_row").select("_conv", "_turn", F.expr("explode(transform(filter(at, a -> a.i + a.n <= size(own)), a -> " + _HASH.format("slice(own, a.i + 1, a.n)") + "))").alias("key"))
    return runs.join(asked.select("key").distinct(), "key", "left_semi").distinct().withColumn("n", F.lit(1).cast("bigint"))


def _most(asked: DataFrame, said: DataFrame) -> DataFrame:
    """(key, _conv, _turn, n): messages with n distinct lines of ``key``, more than half of them.

    Such a message has one at least of any half of the lines, so the rarer half finds them all.
    """
    lines = asked.select("key", F.expr("array_distinct(lines)").alias("lines")).distinct()
    lines = stash(lines.select("key", F.expr("size(lines)").alias("of"), F.explode("lines").alias("line")).select("key", "of", F.md5("line").alias("hash")), "quote-lines")
    told = said.select("_conv", "_turn", F.explode("own").alias("line")).select("_conv", "_turn", F.md5("line").alias("hash"))
    told = stash(told.join(lines.select("hash").distinct(), "hash", "left_semi").distinct(), "quote-told")
    often = lines.join(told.groupBy("hash").agg(F.count(F.lit(1)).alias("times")), "hash", "left")
    rank = F.row_number().over(W.partitionBy("key").orderBy(F.coalesce("times", F.lit(0)), "hash"))
    probes = often.withColumn("rank", rank).where("2 * rank <= of + 1 and times > 0")
    may = probes.join(told, "hash").select("key", "_conv", "_turn").distinct()
    held = may.join(lines, "key").join(told, ["_conv", "_turn", "hash"]).groupBy("key", "of", "_conv", "_turn").agg(F.count(F.lit(1)).alias("n"))
    return held.where("2 * n > of").select("key", "_conv", "_turn", "n")


def _sources(asked: DataFrame, offers: DataFrame) -> DataFrame:
    """(_row, p, level, far, c, t): for each passage, the message with the highest n; of equals the
    latest earlier one of its conversation, else the first of another."""
    offers = stash(offers, "quote-offers")
    turns = offers.selectExpr("key", "_conv", "_turn", "struct(n, _turn as t) as has", "false as asks").unionByName(asked.selectExpr("key", "_conv", "_turn", "true as asks"), allowMissingColumns=True)
    turns = turns.groupBy("key", "_conv", "_turn").agg(F.max("has").alias("has"), F.max("asks").alias("asks"))
    near = _so_far(turns, ["key", "_conv"], "_turn", F.col("has"), "near").where("asks and near is not null").select("key", "_conv", "_turn", "near")
    # Whoever asks, the first message or the first of another conversation is not their own.
    place = F.struct((-F.col("n")).alias("less"), "_conv", "_turn")
    by_conv = offers.groupBy("key", "_conv").agg(F.min(place).alias("one"))
    first = by_conv.groupBy("key").agg(F.min("one").alias("one"))
    second = by_conv.join(first.select("key", F.col("one._conv").alias("_conv")), ["key", "_conv"], "left_anti").groupBy("key").agg(F.min("one").alias("two"))
    both = asked.join(near, ["key", "_conv", "_turn"], "left").join(first, "key", "left").join(second, "key", "left")
    both = both.withColumn("away", F.when(F.col("one._conv") != F.col("_conv"), F.col("one")).otherwise(F.col("two")))
    far = "(near is null or near.n < -away.less)"
    return both.where("near is not null or away is not null").selectExpr(
        "_row", "p", "level", f"if(away is not null and {far}, 1, 0) as far", f"if({far}, away._conv, null) as c", f"if(away is not null and {far}, away._turn, near.t) as t"
    )


def _threaded(linked: DataFrame) -> DataFrame:
    """Adds ``thread``, the first turn of the message's thread: a message that quotes within its
    conversation branches off under its source; others go on in the thread of the one before."""
    up = linked.where("_conv is not null and _turn is not null").groupBy("_conv", "_turn").agg(
        F.min(F.when(F.col("quoted") & (F.col("reply_conv") == F.col("_conv")), F.col("_turn"))).alias("branch"),
        F.min(F.when(F.col("reply_conv") == F.col("_conv"), F.col("reply_turn"))).alias("prev"),
    )
    # A branch begins a thread of its own, as does a message without one to reply to.
    up = up.withColumn("to", F.when(F.col("branch").isNotNull() | F.col("prev").isNull(), F.col("_turn")).otherwise(F.least("prev", "_turn")))
    # Between branches threads run through consecutive turns: the latest beginning so far.
    starts = F.when(F.col("to") == F.col("_turn"), F.col("_turn"))
    up = _so_far(up, ["_conv"], "_turn", starts, "thread", inclusive=True)
    up = up.select(F.col("_conv").alias("_c"), F.col("_turn").alias("_t"), "thread")
    return linked.join(up, (F.col("_conv") == F.col("_c")) & (F.col("_turn") == F.col("_t")), "left")


def reply_order(linked: DataFrame, conv: str = "conv_id", turn: str = "turn") -> DataFrame:
    """``linked`` by conversation and depth first along the replies within it.

    A thread is a run of turns, so it stays whole, and the threads that branch off it follow: those
    under its last message first. Conversations without a branch are in order as they are.
    """
    linked, back = sheltered(linked, but=(conv, turn))
    node = linked.where(F.col(conv).isNotNull() & F.col(turn).isNotNull()).select(F.col(conv).alias("_c"), F.col(turn).alias("_t"), F.col("thread").alias("_head"), "quoted", "reply_conv", "reply_turn")
    branch = node.where("quoted and reply_conv = _c and reply_turn < _t").groupBy("_c", "_head").agg(F.min("reply_turn").alias("_at"))
    with temporary(linked.sparkSession):
        branch = stash(branch, "quote-branches")
        if branch.isEmpty():
            return back(linked.orderBy(conv, "thread", turn))
        heads = node.select("_c", "_head").distinct().join(branch.select("_c").distinct(), "_c", "left_semi")
        above = node.select("_c", F.col("_t").alias("_at"), F.col("_head").alias("_up")).distinct()
        threads = stash(heads.join(branch, ["_c", "_head"], "left").join(above, ["_c", "_at"], "left"), "quote-threads")
        left = stash(_to_the_end(threads), "quote-places", lasting=True)
    placed = linked.join(left, (F.col(conv) == F.col("_c")) & (F.col("thread") == F.col("_head")), "left")
    return back(placed.orderBy(conv, F.desc_nulls_first("_left"), "thread", turn).select(*linked.columns))


def _to_the_end(threads: DataFrame) -> DataFrame:
    """(_c, _head, _left): the steps left, on entering a thread, of a walk around the trees.

    The walk enters and leaves every thread once. Each round doubles the steps that are known of
    it, so a conversation of n threads takes log2(2 n) rounds, however deep it is, and is put
    aside after them: long conversations don't keep the short ones waiting.
    """
    side = threads.withColumns({"_under": F.coalesce(F.col("_up").cast("string"), F.lit("")), "_lo": F.coalesce("_at", F.lit(0)), "_neg": -F.col("_head")})
    # After a thread comes the next one under the same message, else the first under the branching message before.
    side = _so_far(side, ["_c", "_under", "_lo"], "_neg", F.col("_neg"), "_same")
    messages = side.groupBy("_c", "_under", "_lo").agg(F.max("_neg").alias("_one"))
    messages = _so_far(messages, ["_c", "_under"], "_lo", F.struct("_lo", "_one"), "_over").select("_c", "_under", "_lo", "_over._one")
    side = side.join(messages, ["_c", "_under", "_lo"], "left").withColumn("_next", -F.coalesce("_same", "_one"))
    first = threads.where("_up is not null").groupBy("_c", "_up").agg(F.max(F.struct("_at", -F.col("_head"))).alias("_f")).selectExpr("_c", "_up as _head", "-_f.col2 as _first")
    rounds = threads.groupBy("_c").agg(F.expr("length(bin(2 * count(1) - 1))").alias("_rounds"))
    around = side.join(first, ["_c", "_head"], "left").join(rounds, "_c")
    enter = around.selectExpr("_c", "_head", "_rounds", "0 as _e", "coalesce(_first, _head) as _to", "if(_first is null, 1, 0) as _toe", "1L as _left")
    leave = around.selectExpr("_c", "_head", "_rounds", "1 as _e", "coalesce(_next, _up) as _to", "if(_next is null, 1, 0) as _toe", "1L as _left")
    walk = stash(enter.unionByName(leave), "quote-walk")
    whole = walk.where("false")
    for done in range(1, (walk.agg(F.max("_rounds")).first()[0] or 0) + 1):
        on = walk.selectExpr("_c", "_head as _to", "_e as _toe", "_to as _to2", "_toe as _toe2", "_left as _left2")
        further = walk.join(on, ["_c", "_to", "_toe"], "left").selectExpr("_c", "_head", "_rounds", "_e", "_to2 as _to", "_toe2 as _toe", "_left + coalesce(_left2, 0) as _left")
        further = stash(further, "quote-walk")
        whole, walk = whole.unionByName(further.where(f"_rounds = {done}")), further.where(f"_rounds > {done}")
    return whole.where("_e = 0").select("_c", "_head", "_left")


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ordered(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def _ordered(messages: DataFrame) -> DataFrame:
    linked = link(messages.select("conv_id", "turn", "role", "text"))
    return reply_order(linked).select("conv_id", "turn", "role", "body", "n_quotes", "max_level", "reply_conv", "reply_turn", "quoted", "thread")


def requoted(messages: DataFrame) -> DataFrame:
    """``messages`` with quotes of others put in front of four in five texts, by a fixed rule.

    The quotes are of the whole message two turns before, of it and a line that nobody said, of
    the first message of the conversation numbered one lower, or of the message two before one
    level down under an outer line that nobody said. Where that message is not there, the text
    stays. Of repeated (conversation, turn) rows the least text is quoted.
    """
    made = messages.select("conv_id", "turn", "role", "text").withColumn("kind", F.expr("(conv_id * 7 + turn) % 5"))
    made = made.withColumns({"src_conv": F.expr("if(kind = 3, conv_id - 1, conv_id)"), "src_turn": F.expr("if(kind = 3, 0, turn - 2)")})
    said = messages.groupBy(F.col("conv_id").alias("src_conv"), F.col("turn").cast("bigint").alias("src_turn")).agg(F.min("text").alias("src"))
    quoted = made.where("kind > 0").select("src_conv", "src_turn").distinct().join(said, ["src_conv", "src_turn"])
    deep = "concat('> > ', replace(src, '\n', '\n> > '), '\n> outer ', conv_id, '.', turn)"
    flat = "concat('> ', replace(src, '\n', '\n> '), if(kind = 2, concat('\n> added ', conv_id, '.', turn), ''))"
    text = f"if(src is null or kind = 0, text, concat(if(kind = 4, {deep}, {flat}), '\n', coalesce(text, '')))"
    return made.join(quoted, ["src_conv", "src_turn"], "left").selectExpr("conv_id", "turn", "role", f"{text} as text")


def requoted_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``op9`` over ``requoted`` conversations, as the given ones may hold no quotes."""
    return _ordered(requoted(spark.read.parquet(f"{sf_dir}/conversations.parquet")))


#: Every pair of a passage and a message that may be its source is made and ranked.
OP9_SQL = r"""
WITH m AS (
  SELECT row_number() OVER () AS r, conv_id, turn, role, coalesce(text, '') AS t FROM conversations
), s AS (
  SELECT r, conv_id, turn, i, ls[i] AS line FROM (SELECT *, string_split(t, chr(10)) AS ls, unnest(range(1, len(string_split(t, chr(10))) + 1)) AS i FROM m)
), v AS (
  SELECT *, length(regexp_replace(regexp_extract(line, '^(?:[\x20\t]*>)+'), '[^>]', '', 'g')) AS level,
         trim(regexp_replace(lower(regexp_replace(line, '^(?:[\x20\t]*>)+', '')), '\s+', ' ', 'g')) AS said FROM s
), b AS (
  SELECT *, level > 0 AND coalesce(lag(level) OVER (PARTITION BY r ORDER BY i), 0) <> level AS opens FROM v
), q AS (
  SELECT *, sum(opens::INT) OVER (PARTITION BY r ORDER BY i) AS p FROM b
), own AS (
  SELECT r, coalesce(trim(string_agg(line, chr(10) ORDER BY i) FILTER (level = 0), chr(10)), '') AS body, count(*) FILTER (opens) AS n_quotes, max(level) AS max_level FROM q GROUP BY r
), asked AS (
  SELECT r, conv_id, turn, p, level, list(said ORDER BY i) AS ls FROM q WHERE level > 0 AND said <> '' AND conv_id IS NOT NULL AND turn IS NOT NULL GROUP BY ALL
), told AS (
  SELECT r, conv_id AS c, turn AS t, said, row_number() OVER (PARTITION BY r ORDER BY i) AS k FROM q WHERE level = 0 AND said <> '' AND conv_id IS NOT NULL AND turn IS NOT NULL
), lines AS (SELECT r, list(said ORDER BY k) AS said_all FROM told GROUP BY r
), passages AS (SELECT DISTINCT ls, ls[1] AS said FROM asked
), offers AS (
  SELECT DISTINCT 1 AS step, ls, c, t, 1 AS n FROM passages JOIN told USING (said) JOIN lines USING (r) WHERE said_all[k:k + len(ls) - 1] = ls
  UNION ALL
  SELECT 2, ls, c, t, count(DISTINCT said) FROM (SELECT DISTINCT ls, unnest(ls) AS said FROM passages WHERE len(ls) > 1) JOIN told USING (said) GROUP BY ls, c, t HAVING 2 * count(DISTINCT said) > len(list_distinct(ls))
), found AS (
  SELECT a.r, a.p, a.level, o.c <> a.conv_id AS far, o.c, o.t FROM asked a JOIN offers o USING (ls) WHERE o.c <> a.conv_id OR o.t < a.turn
  QUALIFY row_number() OVER (PARTITION BY a.r, a.p ORDER BY step, n DESC, o.c <> a.conv_id, CASE WHEN o.c <> a.conv_id THEN o.c END, CASE WHEN o.c <> a.conv_id THEN o.t ELSE -o.t END) = 1
), best AS (SELECT * FROM found QUALIFY row_number() OVER (PARTITION BY r ORDER BY level, far, p) = 1),
l AS (
  SELECT m.*, best.r IS NOT NULL AS quoted, c, best.t AS src,
         before FROM m LEFT JOIN best USING (r) LEFT JOIN (
    SELECT conv_id, turn, lag(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM (SELECT DISTINCT conv_id, turn FROM m WHERE conv_id IS NOT NULL AND turn IS NOT NULL)
  ) w ON w.conv_id = m.conv_id AND w.turn = m.turn
), k AS (
  SELECT *, CASE WHEN quoted THEN c WHEN before IS NOT NULL THEN conv_id END AS reply_conv, CASE WHEN quoted THEN src ELSE before END AS reply_turn FROM l
), u AS (
  SELECT conv_id, turn, bool_or(quoted AND reply_conv = conv_id) AS branch, min(reply_turn) FILTER (reply_conv = conv_id) AS prev FROM k WHERE conv_id IS NOT NULL AND turn IS NOT NULL GROUP BY ALL
), h AS (
  SELECT conv_id, turn, max(CASE WHEN branch OR prev IS NULL OR prev >= turn THEN turn END) OVER (PARTITION BY conv_id ORDER BY turn) AS thread FROM u
)
SELECT k.conv_id, k.turn, role, body, n_quotes, CAST(max_level AS BIGINT) AS max_level, reply_conv, reply_turn, quoted, thread
FROM k JOIN own USING (r) LEFT JOIN h ON h.conv_id = k.conv_id AND h.turn = k.turn
"""

_REQUOTED = r"""(
  SELECT conv_id, turn, role, CASE WHEN src IS NULL OR kind = 0 THEN text ELSE
    CASE WHEN kind = 4 THEN '> > ' || replace(src, chr(10), chr(10) || '> > ') || chr(10) || '> outer ' || conv_id || '.' || turn
         ELSE '> ' || replace(src, chr(10), chr(10) || '> ') || CASE WHEN kind = 2 THEN chr(10) || '> added ' || conv_id || '.' || turn ELSE '' END END || chr(10) || coalesce(text, '') END AS text
  FROM (SELECT *, (conv_id * 7 + turn) % 5 AS kind FROM conversations) k
  LEFT JOIN (SELECT conv_id AS src_conv, turn AS src_turn, min(text) AS src FROM conversations GROUP BY ALL) o
    ON src_conv = CASE WHEN kind = 3 THEN conv_id - 1 ELSE conv_id END AND src_turn = CASE WHEN kind = 3 THEN 0 ELSE turn - 2 END
)"""
REQUOTED_SQL = OP9_SQL.replace("FROM conversations", f"FROM {_REQUOTED}", 1)
