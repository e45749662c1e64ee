"""Helpers shared by the operators of this package.

A document is one row. Operators that join results back to texts identify it by its id and a hash
of its text, so that ids may repeat or be NULL: rows with the same id and the same text get the
same result, rows with the same id and another text are other documents.
"""

from __future__ import annotations

import atexit
import ctypes
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparktext.session import parallelism, scratch_path

__all__ = ["identified", "keep_documents", "parallelism", "same_document", "scoped", "slices", "stored", "table", "with_decisions"]

# Bytes of text that a Python worker turns into objects at once.
SLICE_BYTES = 4 << 20
_STORED: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def identified(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text, text_hash), a NULL text read as empty; other columns are left out."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("text_hash"))


def same_document(left: str, right: str) -> Column:
    """Join condition of two aliased tables with ``doc_id`` and ``text_hash``; NULL ids are equal."""
    return F.col(f"{left}.doc_id").eqNullSafe(F.col(f"{right}.doc_id")) & (
        F.col(f"{left}.text_hash") == F.col(f"{right}.text_hash")
    )


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again: computed once, safe against lost executors.

    The table is removed when the driver ends.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    _STORED.append(path)
    atexit.register(_remove, spark, path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scoped(spark: SparkSession):
    """Removes the tables that ``stored`` has written inside the block, but the last one, the block's result."""
    before = len(_STORED)
    yield
    for path in _STORED[before:-1]:
        _remove(spark, path)
    del _STORED[before:]


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Batches cut into slices of about ``most`` bytes of ``column``, one row at least.

    When a task ends, freed memory goes back to the system: the worker lives on for other stages.
    """
    for batch in batches:
        upto = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < len(upto):
            end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + most, "right")))
            yield batch.slice(at, end - at)
            at = end
    release_memory()


def release_memory() -> None:
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:  # not every C library has it
        trim(0)


def _remove(spark: SparkSession, path: str) -> None:
    jsc = spark.sparkContext._jsc
    if jsc is not None and not jsc.sc().isStopped():
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(jsc.hadoopConfiguration()).delete(target, True)


def with_decisions(docs: DataFrame, decided: DataFrame, how: str = "left", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` as alias d joined with ``decided`` (doc_id, text_hash, ...) as alias k, so that columns of
    the same name stay apart."""
    text_hash = F.xxhash64(F.coalesce(F.col(f"d.`{text_col}`"), F.lit("")))
    same = F.col(f"d.`{id_col}`").eqNullSafe(F.col("k.doc_id")) & (text_hash == F.col("k.text_hash"))
    return docs.alias("d").join(decided.alias("k"), same, how)


def keep_documents(docs: DataFrame, kept: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of ``docs`` named in ``kept`` (doc_id, text_hash); of rows that repeat an id and a text, one."""
    counted = kept.groupBy("doc_id", "text_hash").agg(F.count(F.lit(1)).alias("n"))
    joined = with_decisions(docs, counted.hint("shuffle_hash"), "inner", id_col, text_col).withColumn("_times", F.col("k.n"))
    columns = [F.col(f"d.`{c}`") for c in docs.columns]
    once = joined.where("_times = 1").select(*columns)
    return once.unionByName(joined.where("_times > 1").select(*columns).dropDuplicates([id_col, text_col]))
