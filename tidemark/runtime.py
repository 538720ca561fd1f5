"""Session and scratch-storage helpers shared by every subpackage."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SCRATCH_CONF = "spark.checkpoint.dir"


def session(app: str = "tidemark", master: str = "local[*]", **conf: str) -> SparkSession:
    """A session with the settings the plans are written for: UTC, AQE, Arrow."""
    builder = (
        SparkSession.builder.appName(app)
        .master(master)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def scratch(spark: SparkSession) -> str:
    """The folder shared by all executors. Where none is configured, a temporary one serves a local
    session; a cluster has to name one, as its executors could not read each other's."""
    base = spark.conf.get(SCRATCH_CONF, None)
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError(f"set {SCRATCH_CONF} to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="tidemark-")
        spark.conf.set(SCRATCH_CONF, base)
    return base.rstrip("/")


def stash(df: DataFrame, name: str, lasting: bool = False) -> DataFrame:
    """Cut lineage: write ``df`` as Parquet in the shared folder and read it back.

    Inside ``temporary`` the table goes when the block ends; a ``lasting`` one outlives it, and
    goes with the block around it, if there is one.
    """
    spark = df.sparkSession
    path = f"{scratch(spark)}/tidemark/{name}-{uuid.uuid4().hex}"
    blocks = getattr(_open, "blocks", [])[: -1 if lasting else None]
    if blocks:
        blocks[-1].append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_open = threading.local()


@contextmanager
def temporary(spark: SparkSession) -> Iterator[None]:
    """Tables stashed in the block are deleted at its end; what leaves it must be lasting."""
    blocks = _open.__dict__.setdefault("blocks", [])
    blocks.append([])
    try:
        yield
    finally:
        for path in blocks.pop():
            _delete(spark, path)


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def drop_stash(*frames: DataFrame) -> None:
    """Delete stashed tables that no later plan reads."""
    for df in frames:
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if "/tidemark/" in folder:
                _delete(df.sparkSession, folder)


def where_computed(df: DataFrame, condition: Column) -> DataFrame:
    """``df.where(condition)`` over columns as computed.

    Catalyst would push the filter below the projections that compute its columns and write them
    out again inside the condition, once for each mention; a row number in between stops that.
    """
    once = "_once"
    while once in map(str.lower, df.columns):
        once += "_"
    return df.withColumn(once, F.monotonically_increasing_id()).where(condition & (F.col(once) >= 0)).drop(once)


def sheltered(df: DataFrame, *names: str, but: tuple[str, ...] = ()) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """``df`` with the columns that begin with an underscore, or are called one of ``names``, out of
    the way of a plan's own columns, and the function that gives them their names back.

    Columns in ``but`` stay as they are.
    """
    taken = {c.lower() for c in df.columns}
    away = {}
    for c in df.columns:
        if (c.startswith("_") or c.lower() in names) and c not in but:
            name = f"own{c}"
            while name.lower() in taken:
                name = f"own_{name}"
            taken.add(name.lower())
            away[c] = name
    return df.withColumnsRenamed(away), lambda out: out.withColumnsRenamed({v: k for k, v in away.items()})


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Whole texts go to Python in batches of at most ``rows`` rows: the default of ten thousand
    holds tens of megabytes of text in each of several buffers of every task."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, str(rows))


def shuffle_width(spark: SparkSession) -> int:
    """The number of shuffle partitions the session asks for."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
