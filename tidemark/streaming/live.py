"""The same state machines over streams.

Event time and a watermark bound what a stream keeps; the crawl itself has neither, so both are
ours: ten minutes by default.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidemark.streaming.folds import DEAD_AFTER

WATERMARK = "10 minutes"
EVENTS = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def read_events(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema(EVENTS).parquet(path)


def counted(events: DataFrame, window: str = "1 hour", watermark: str = WATERMARK) -> DataFrame:
    """(start, event_type, n, total): tumbling windows, closed by the watermark."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", watermark)
    return timed.groupBy(F.window("ts", window), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


def host_health(attempts: DataFrame, host: str = "host", ok: str = "ok") -> DataFrame:
    """(host, successes, failures, dead) after each batch in which a host had answers."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        good, bad = state.get if state.exists else (0, 0)
        for frame in frames:
            good += int(frame[ok].sum())
            bad += int((~frame[ok].astype(bool)).sum())
        state.update((good, bad))
        yield pd.DataFrame({host: [key[0]], "successes": [good], "failures": [bad], "dead": [good == 0 and bad >= DEAD_AFTER]})

    kind = attempts.schema[host].dataType.simpleString()
    return attempts.select(host, ok).groupBy(host).applyInPandasWithState(
        step, f"{host} {kind}, successes bigint, failures bigint, dead boolean", "good bigint, bad bigint", "update", GroupStateTimeout.NoTimeout
    )


def drained(stream: DataFrame, name: str, mode: str = "update") -> DataFrame:
    """Runs a stream over what is there and gives its last output; for files and tests."""
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.table(name)
