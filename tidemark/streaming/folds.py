"""Ordered state machines over event logs, as batch windows and folds.

Associative ones (streaks, islands, decayed rates, schedules) are windows by key. Those that are not
(paced hosts, token buckets, gates) fold one key's events in order; they run in Arrow groups whose
memory is one key's batch of state, streamed from sorted partitions.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.runtime import shuffle_width

DEAD_AFTER = 2
OUTAGE_AFTER = 3


def host_health(attempts: DataFrame, host: str = "host", seq: str = "seq", ok: str = "ok") -> DataFrame:
    """``attempts`` with failures so far, successes so far and ``dead``: DEAD_AFTER failures and
    never a success. A success is for good."""
    order = W.partitionBy(host).orderBy(seq)
    return (
        attempts.withColumn("successes", F.sum(F.col(ok).cast("bigint")).over(order))
        .withColumn("failures", F.sum((~F.col(ok)).cast("bigint")).over(order))
        .withColumn("dead", (F.col("successes") == 0) & (F.col("failures") >= DEAD_AFTER))
    )


def host_health_final(attempts: DataFrame, host: str = "host", ok: str = "ok") -> DataFrame:
    """(host, successes, failures, dead) at the end: order doesn't matter, so one aggregation."""
    out = attempts.groupBy(host).agg(F.count_if(F.col(ok)).alias("successes"), F.count_if(~F.col(ok)).alias("failures"))
    return out.withColumn("dead", (F.col("successes") == 0) & (F.col("failures") >= DEAD_AFTER))


def streaks(rows: DataFrame, key: str, seq: str, good: str) -> DataFrame:
    """``rows`` with ``streak``: bad rows in a row up to this one."""
    order = W.partitionBy(key).orderBy(seq)
    island = rows.withColumn("_island", F.sum(F.col(good).cast("bigint")).over(order))
    own = W.partitionBy(key, "_island").orderBy(seq)
    return island.withColumn("streak", F.sum((~F.col(good)).cast("bigint")).over(own)).drop("_island")


def outages(attempts: DataFrame, key: str, seq: str = "seq", ts: str = "ts", ok: str = "ok", after: int = OUTAGE_AFTER) -> DataFrame:
    """(key, outage, since, until, failures): each key's runs of at least ``after`` failures.

    A run begins with the failure that completes it and lasts until the next success, or has no
    end yet. What a whole job takes for an outage is told by ``gate``.
    """
    order = W.partitionBy(key).orderBy(seq)
    island = attempts.withColumn("_i", F.sum(F.col(ok).cast("bigint")).over(order))
    bad = island.where(~F.col(ok)).withColumn("_k", F.row_number().over(W.partitionBy(key, "_i").orderBy(seq)))
    runs = bad.groupBy(key, "_i").agg(F.count(F.lit(1)).alias("failures"), F.min(F.when(F.col("_k") == after, F.col(ts))).alias("since")).where(F.col("failures") >= after)
    ends = island.where(F.col(ok)).select(key, (F.col("_i") - 1).alias("_i"), F.col(ts).alias("until"))
    return runs.join(ends, [key, "_i"], "left").select(key, F.col("_i").alias("outage"), "since", "until", "failures")


def outage_totals(found: DataFrame, key: str) -> DataFrame:
    return found.groupBy(key).agg(F.count(F.lit(1)).alias("outages"), F.sum(F.unix_micros(F.col("until").cast("timestamp")) / 1e6 - F.unix_micros(F.col("since").cast("timestamp")) / 1e6).alias("downtime_s"))


def trusted(attempts: DataFrame, starts: list[str], host: str = "host", seq: str = "seq", ok: str = "ok") -> DataFrame:
    """``attempts`` with ``trusted``: start hosts, and hosts that have answered before."""
    before = W.partitionBy(host).orderBy(seq).rowsBetween(W.unboundedPreceding, -1)
    answered = F.coalesce(F.max(F.col(ok).cast("int")).over(before), F.lit(0)) == 1
    return attempts.withColumn("trusted", answered | F.col(host).isin(starts) if starts else answered)


def decayed_rate(samples: DataFrame, key: str, ts: str, total: str, half_life_s: float) -> DataFrame:
    """(key, rate): change of a running total per second, smoothed with a half-life.

    Each sample moves the rate by 1 - 2^(-dt / half-life) of the way to what was just seen; a
    total that falls counts as no change.
    """
    order = W.partitionBy(key).orderBy(ts)
    seconds = F.unix_micros(F.col(ts).cast("timestamp")) / 1e6
    steps = samples.withColumn("_t", seconds).withColumn("_dt", F.col("_t") - F.lag("_t").over(order)).withColumn("_dv", F.greatest(F.col(total) - F.lag(total).over(order), F.lit(0)))
    steps = steps.where("_dt > 0").withColumn("_w", F.pow(F.lit(2.0), -F.col("_dt") / half_life_s))
    # rate_n = sum of a_i x_i over the product of later weights; log-weights make it one window sum.
    later = W.partitionBy(key).orderBy(F.col(ts).desc()).rowsBetween(W.unboundedPreceding, -1)
    left = F.coalesce(F.sum(-F.col("_dt") / half_life_s).over(later), F.lit(0.0))
    steps = steps.withColumn("_share", (1 - F.col("_w")) * F.pow(F.lit(2.0), left) * F.col("_dv") / F.col("_dt"))
    return steps.groupBy(key).agg(F.sum("_share").alias("rate"))


def fold(rows: DataFrame, key: str, order: str, values: list[str], start: Callable[[], dict], step: Callable[[dict, tuple], tuple], out: str) -> DataFrame:
    """Rows of each key in order through ``step(state, values) -> outputs``; streams, one state."""
    spark = rows.sparkSession
    dealt = rows.select(key, order, *values).repartition(shuffle_width(spark), key).sortWithinPartitions(key, order)
    names = [x.strip().split(" ")[0] for x in out.split(",")]
    types = {"bigint": pa.int64(), "double": pa.float64(), "boolean": pa.bool_(), "string": pa.string(), "int": pa.int32()}
    kinds = [types[x.strip().split(" ")[1]] for x in out.split(",")]
    heads = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in (key, order))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, state = object(), start()
        for batch in batches:
            found = []
            columns = [c.to_pylist() for c in batch.columns]
            for k, _, *v in zip(*columns, strict=True):
                if k != current:
                    current, state = k, start()
                found.append(step(state, tuple(v)))
            outputs = [pa.array([f[i] for f in found], t) for i, t in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *outputs], [key, order, *names])

    return dealt.mapInArrow(run, f"{heads}, {out}")


#: Pacing in seconds and answers: the first penalty, the longest gap, and how many clean answers
#: ease it. Fixed values.
GAP_MIN, GAP_MAX, CLEAN = 0.5, 30.0, 20


def pacing(
    events: DataFrame, host: str = "host", seq: str = "seq", throttled: str = "throttled", retry_after: str | None = None,
    connections: int = 4, least: int = 1, base_delay: float = 0.0, adaptive: bool = True,
) -> DataFrame:
    """(host, seq, conns, delay): the gap and connections a host has after each answer.

    A throttled answer doubles the gap, raises it to its ``retry_after`` seconds and, if it is the
    second strike, halves the connections down to ``least``; strikes at the least number pile up.
    Every ``CLEAN`` clean answers in a row clear them, halve the gap down to ``base_delay`` and
    give one connection back. Null counts as clean, a null ``retry_after`` as none.
    """

    def step(s: dict, v: tuple) -> tuple:
        if v[0]:
            s["clean"], s["strikes"] = 0, s["strikes"] + 1
            s["delay"] = min(GAP_MAX, s["delay"] * 2 if s["delay"] > 0 else GAP_MIN)
            if len(v) > 1 and v[1] and v[1] > 0:
                s["delay"] = max(s["delay"], min(float(v[1]), GAP_MAX))
            if adaptive and s["conns"] > least and s["strikes"] >= 2:
                s["conns"], s["strikes"] = max(least, s["conns"] // 2), 0
        else:
            s["clean"] += 1
            if s["clean"] >= CLEAN:
                s["clean"], s["strikes"] = 0, 0
                s["delay"] = max(base_delay, s["delay"] / 2) if s["delay"] > base_delay else s["delay"]
                s["conns"] = min(connections, s["conns"] + 1)
        return s["conns"], s["delay"]

    values = [throttled] if retry_after is None else [throttled, retry_after]
    return fold(events, host, seq, values, lambda: {"delay": base_delay, "strikes": 0, "clean": 0, "conns": connections}, step, "conns int, delay double")


#: Seconds between probes: the first wait, which doubles, and the longest.
PROBE_MIN, PROBE_MAX = 2.0, 120.0


def gate(
    attempts: DataFrame, job: str, seq: str = "seq", ts: str = "ts", ok: str = "ok", trusted: str = "trusted",
    after: int = OUTAGE_AFTER, first_wait: float = PROBE_MIN, longest_wait: float = PROBE_MAX,
) -> DataFrame:
    """(job, seq, state, streak, outages, downtime_s): the one network gate of a job after each attempt.

    Failures on trusted hosts in a row, whatever their host, take the job offline; a success
    clears the streak. Offline, probes go out after waits that double; the first one at or after
    an attempt that went through finds the network back, adds the time to ``downtime_s`` and
    starts over. A job's attempts are folded in order by one task; jobs are independent. Null
    ``ok`` or ``trusted`` counts as false.
    """
    timed = attempts.withColumn("_ts", F.unix_micros(F.col(ts).cast("timestamp")) / 1e6)

    def start() -> dict:
        return {"streak": 0, "since": None, "back": None, "outages": 0, "down": 0.0}

    def step(s: dict, v: tuple) -> tuple:
        now, good, known = v
        if s["back"] is not None and (at := _probe(s["since"], s["back"], first_wait, longest_wait)) <= now:
            s.update(streak=0, down=s["down"] + at - s["since"], since=None, back=None)
        if good:
            s["streak"] = 0
            if s["since"] is not None and s["back"] is None:
                s["back"] = now
        elif known:
            s["streak"] += 1
            if s["streak"] >= after and s["since"] is None:
                s["since"], s["outages"] = now, s["outages"] + 1
        return "online" if s["since"] is None else "offline", s["streak"], s["outages"], s["down"]

    return fold(timed, job, seq, ["_ts", ok, trusted], start, step, "state string, streak bigint, outages bigint, downtime_s double")


def _probe(since: float, back: float, wait: float, longest: float) -> float:
    """The time of the first probe at or after ``back``."""
    at = since + wait
    while at < back:
        if wait >= longest:
            return at + -(-(back - at) // longest) * longest
        wait = min(wait * 2, longest)
        at += wait
    return at


def token_bucket(events: DataFrame, key: str, seq: str, ts: str, size: str, rate: float, burst: float = 65536.0) -> DataFrame:
    """(key, seq, wait): seconds each transfer waits for its bytes at ``rate`` a second."""
    timed = events.withColumn("_ts", F.unix_micros(F.col(ts).cast("timestamp")) / 1e6).withColumn("_n", F.col(size).cast("double"))

    def step(s: dict, v: tuple) -> tuple:
        now = max(v[0], s.get("at", v[0]))
        have = min(max(burst, rate), s.get("have", max(burst, rate)) + (now - s.get("at", now)) * rate)
        wait = max(0.0, (v[1] - have) / rate)
        s["have"], s["at"] = max(0.0, have - v[1]), now + wait
        return (wait,)

    return fold(timed, key, seq, ["_ts", "_n"], dict, step, "wait double")


#: Numbers of ``seq`` whose requests are ordered together by ``schedule``.
SLOT = 4096


def schedule(events: DataFrame, key: str, seq: str, ts: str, gap: float) -> DataFrame:
    """(key, seq, start): when each request may start, ``gap`` seconds after the one before.

    The n-th request starts at ``gap`` n past the greatest ts - ``gap`` i of those up to it. Sums
    and maxima of slots of ``seq``, a number, are taken first, so a hot key is spread. Equal
    numbers go by ts; a null ts waits for the ones before only, a null number comes first.
    """
    slot = F.coalesce(F.floor(F.col(seq) / SLOT), F.lit(-(2**62)))
    rows = events.select(F.col(key).alias("_k"), F.col(seq).alias("_s"), (F.unix_micros(F.col(ts).cast("timestamp")) / 1e6).alias("_t"), slot.alias("_slot"))
    order = W.partitionBy("_k", "_slot").orderBy("_s", "_t")
    rows = rows.withColumn("_n", F.row_number().over(order)).withColumn("_lead", F.col("_t") - gap * F.col("_n"))
    before = W.partitionBy("_k").orderBy("_slot").rowsBetween(W.unboundedPreceding, -1)
    slots = rows.groupBy("_k", "_slot").agg(F.count(F.lit(1)).alias("_c"), F.max("_lead").alias("_most"))
    slots = slots.withColumn("_base", F.coalesce(F.sum("_c").over(before), F.lit(0)))
    slots = slots.select(F.col("_k").alias("_key"), F.col("_slot").alias("_at"), "_base", F.max(F.col("_most") - gap * F.col("_base")).over(before).alias("_earlier"))
    so_far = F.max("_lead").over(order.rowsBetween(W.unboundedPreceding, 0))
    placed = rows.withColumn("_far", so_far).join(slots, F.col("_k").eqNullSafe(F.col("_key")) & (F.col("_slot") == F.col("_at")))
    start = F.greatest(F.col("_far") - gap * F.col("_base"), F.col("_earlier")) + gap * (F.col("_base") + F.col("_n"))
    return placed.select(F.col("_k").alias(key), F.col("_s").alias(seq), start.alias("start"))


def phase(state: str) -> str:
    """SQL: what a network state means for a run."""
    return f"case {state} when 'offline' then 'waiting for the network' when 'probing' then 'checking the network' else 'running' end"
