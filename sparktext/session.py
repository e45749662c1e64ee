"""Session helpers: settings, the shared scratch folder and lineage cuts."""

from __future__ import annotations

import os
import tempfile
import uuid
import weakref
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    "spark.serializer": "org.apache.spark.serializer.KryoSerializer",
}


def get_session(app_name: str = "sparktext", master: str | None = None, **extra: str) -> SparkSession:
    """Return a session with the library's defaults; ``extra`` overrides single settings.

    On a cluster the master, memory and ``spark.sql.shuffle.partitions`` come from
    spark-submit; nothing here pins them.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


_FALLBACK: dict[str, str] = {}
_STORED: weakref.WeakSet = weakref.WeakSet()


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, as named by ``spark.checkpoint.dir``.

    In local mode a temporary folder stands in for an absent setting. On a cluster every machine
    would have its own, so there the setting is required.
    """
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if path:
        return path
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _FALLBACK:
        _FALLBACK[app] = spark.sparkContext.getCheckpointDir() or tempfile.mkdtemp(prefix="sparktext-")
    return _FALLBACK[app]


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return os.path.join(shared_dir(spark), f"{name}-{uuid.uuid4().hex}")


def remove(spark: SparkSession, path: str) -> None:
    """Delete a path below the shared folder, if the session still runs."""
    jsc = spark.sparkContext._jsc
    if jsc is not None and not jsc.sc().isStopped():
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(jsc.hadoopConfiguration()).delete(target, True)


def materialize(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint, so that a lost executor costs no recomputation.

    A table stored before is returned as it is.
    """
    if df in _STORED:
        return df
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    stored = df.checkpoint(eager=True)
    _STORED.add(stored)
    return stored


def parallelism(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


# A task of text work gets about this much of a table's files, up to a table size above which nothing is moved.
TASK_BYTES = 16 * 1024 * 1024
SPREAD_BYTES = 64 * 1024 * 1024 * 1024
# A shuffle has a file index entry for every pair of tasks.
MOST_PARTS = 20_000


def table_bytes(df: DataFrame) -> int:
    """Spark's own estimate, for a table read from files the bytes of these."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


@contextmanager
def sized_shuffles(df: DataFrame, times: int = 1) -> Iterator[int]:
    """While open, a shuffle has a part for each ``TASK_BYTES`` of ``times`` the table, and no fewer than set.

    For steps that store their result at once: a fixed number of parts would let the groups of a part, and a
    task's memory with them, grow with the table.
    """
    conf, name = df.sparkSession.conf, "spark.sql.shuffle.partitions"
    before = parallelism(df.sparkSession)
    parts = max(before, min(-(-table_bytes(df) * times // TASK_BYTES), MOST_PARTS))
    conf.set(name, str(parts))
    try:
        yield parts
    finally:
        conf.set(name, str(before))


def spread(df: DataFrame, key: str) -> DataFrame:
    """Hash-repartition a table by ``key``, into more parts the larger it is.

    A file with a single row group would otherwise run CPU-heavy text work in one task. Aggregates by
    ``key`` need no further shuffle then, and the texts are smaller than the terms made of them.
    """
    size = table_bytes(df)
    if size >= SPREAD_BYTES:
        return df
    return df.repartition(max(parallelism(df.sparkSession), -(-size // TASK_BYTES)), key)
