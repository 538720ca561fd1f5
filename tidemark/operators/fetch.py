"""A fetch as data: what a stored answer means, what to ask for, how long to wait, what to log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions import formats, urls

#: Statuses tried again at once, and the rungs of the speed ladder in bytes a second. Fixed values.
RETRY_NOW = (408, 425, 429, 500, 502, 503, 504)
SPEEDS = (0, 5 << 20, 2 << 20, 1 << 20, 512 << 10, 256 << 10, 128 << 10, 64 << 10, 32 << 10)


def result(status: str, keep_error_pages: bool = False) -> str:
    """SQL: what a status makes of a response."""
    kept = f"when {status} not in {RETRY_NOW} then 'page'" if keep_error_pages else ""
    return f"case when {status} is null then 'missing' when {status} = 304 then 'not_modified' when {status} between 200 and 299 then 'page' {kept} else 'error' end"


def conditional(prior: str = "p_") -> str:
    """SQL: the conditional headers that a row of an earlier run allows."""
    return f"named_struct('if_none_match', nullif({prior}etag, ''), 'if_modified_since', nullif({prior}last_mod, ''))"


def policy(mode: str, status: str, exists: str) -> str:
    """SQL: whether to fetch again what an earlier run has: never, newer (ask) or always."""
    have = f"({status} = 'done' and {exists})"
    return {"never": f"if({have}, 'skip', 'fetch')", "newer": f"if({have}, 'ask', 'fetch')", "always": "'fetch'"}[mode]


def body_too_large(body: str, most: int, known_length: str) -> str:
    """SQL: a known length may equal the cap, a body read without one may not."""
    return f"if({known_length} >= 0, {known_length} > {most}, octet_length({body}) >= {most})"


def credentials(host: str, pairs: list[tuple[str, str, str]]) -> str:
    """SQL: user:password of the first pattern that fits the host."""
    return "case " + " ".join(f"when {urls.host_pattern(urls._lit(p), host)} then {urls._lit(f'{u}:{w}')}" for p, u, w in pairs) + " end" if pairs else "cast(null as string)"


def followed(requests: DataFrame, redirects: DataFrame, hops: int = 10) -> DataFrame:
    """(url, final, n): ``requests`` (url) through ``redirects`` (src, dst); null after too many."""
    from tidemark.runtime import stash

    step = redirects.select(F.col("src").alias("final"), F.col("dst").alias("_next"))
    now = requests.select("url", F.col("url").alias("final"), F.lit(0).alias("n"))
    for _ in range(hops):
        now = stash(now.join(step, "final", "left").select("url", F.coalesce("_next", "final").alias("final"), F.expr("n + if(_next is null, 0, 1)").alias("n")), "hops")
    more = step.select(F.col("final").alias("final"), F.lit(True).alias("_more")).distinct()
    return now.join(more, "final", "left").select("url", F.expr("if(_more, null, final)").alias("final"), "n")


def retry_loop(attempts: DataFrame, key: str, seq: str, ok: str, outage: str, most: int) -> DataFrame:
    """``attempts`` with ``used``, the tries a request has spent, and ``given_up``.

    Failures during an outage are the network's and cost nothing; nothing counts after a success.
    """
    order = W.partitionBy(key).orderBy(seq)
    own = (~F.col(ok) & ~F.col(outage)).cast("bigint")
    done = F.coalesce(F.max(F.col(ok).cast("int")).over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)) == 1
    counted = attempts.withColumn("_n", F.when(done, 0).otherwise(own))
    counted = counted.withColumn("used", F.sum("_n").over(order)).drop("_n")
    return counted.withColumn("given_up", (F.col("used") >= most) & ~F.col(ok))


def deadline(in_scope: str, own: float = 45.0, other: float = 8.0) -> str:
    return f"if({in_scope}, {own}D, {other}D)"


def retry_after(header: str, now: str) -> str:
    """SQL: seconds a Retry-After header asks for, as a number or a date; null if malformed."""
    at = f"try_to_timestamp(regexp_replace({header}, '^[A-Za-z]+, | GMT$', ''), 'dd MMM yyyy HH:mm:ss')"
    return f"coalesce(try_cast({header} as double), cast(greatest(unix_seconds({at}) - unix_seconds({now}), 0) as double))"


def error_text(url: str, kind: str, status: str, err: str) -> str:
    return f"concat({url}, ': ', if({status} > 0, concat('status ', {status}, ' '), ''), coalesce(nullif({err}, ''), {kind}))"


def next_speed(current: str, direction: str) -> str:
    """SQL: one rung up or down the ladder; a speed not on it counts as the first rung."""
    rungs = f"array({', '.join(f'{x}L' for x in SPEEDS)})"
    at = f"greatest(array_position({rungs}, {current}) - 1, 0)"
    return f"element_at({rungs}, int(least(greatest({at} - {direction}, 0), {len(SPEEDS) - 1})) + 1)"


def log_line(status: str, millis: str, size: str, kind: str, rendered: str, attempts: str, path: str) -> str:
    """SQL: the columns of a fetched file's line in a log."""
    mark = f"case when {attempts} > 1 then concat('×', {attempts}) when {rendered} then 'js' else '' end"
    return f"concat_ws(' ', {status}, lpad(concat({millis}, 'ms'), 7, ' '), lpad({formats.human_bytes(size)}, 9, ' '), rpad({formats.short_type(kind)}, 11, ' '), rpad({mark}, 2, ' '), {path})"


def failure_message(message: str) -> str:
    """SQL: an error's message without the URL in front of it."""
    url = f"locate(': ', {message}, instr({message}, '://') + 3)"
    return f"if(instr({message}, '://') > 0 and {url} > 0 and instr(left({message}, {url}), ' ') = 0, substr({message}, {url} + 2), {message})"


def agent_token(agent: str) -> str:
    """The name under which robots files know an agent: up to the first slash or space."""
    return agent.lower().replace(" ", "/").split("/")[0]
