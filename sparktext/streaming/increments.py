"""Incremental, resumable jobs: file source, availableNow trigger, append sink, checkpoint.

Only stateless transformations run here, so the rows written do not depend on how files fall
into micro-batches.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def _files(spark: SparkSession, source_format: str, schema: str | StructType, files_per_trigger: int | None):
    reader = spark.readStream.format(source_format).schema(schema)
    return reader.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else reader


def process_increments(
    spark: SparkSession,
    source: str,
    schema: str | StructType,
    transform: Callable[[DataFrame], DataFrame],
    sink: str,
    checkpoint: str,
    source_format: str = "parquet",
    sink_format: str = "parquet",
    files_per_trigger: int | None = None,
    source_options: dict | None = None,
) -> None:
    """Transform all files not seen before and append the result. A rerun continues where it stopped.

    All files go into one batch unless ``files_per_trigger`` is given.
    """
    stream = _files(spark, source_format, schema, files_per_trigger).options(**(source_options or {})).load(source)
    writer = transform(stream).writeStream.format(sink_format).outputMode("append")
    if sink_format == "csv":
        writer = writer.option("header", True)
    writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start(sink).awaitTermination()


def process_batches(
    spark: SparkSession,
    source: str,
    schema: str | StructType,
    transform: Callable[[DataFrame], DataFrame],
    sink: str,
    checkpoint: str,
    source_format: str = "parquet",
    files_per_trigger: int | None = None,
) -> None:
    """Like process_increments for transformations that need batch operators (joins, model scoring).

    Each micro-batch overwrites its own ``batch_id`` partition, so a batch replayed after a
    failure leaves no duplicates.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        transform(batch).write.mode("overwrite").parquet(f"{sink}/batch_id={batch_id}")

    stream = _files(spark, source_format, schema, files_per_trigger).load(source)
    (
        stream.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
        .awaitTermination()
    )


def annotate_corpus(spark: SparkSession, annotator, source: str, schema: str | StructType, sink: str, checkpoint: str, threshold: float = 0.8, files_per_trigger: int | None = None) -> None:
    """Annotate a growing folder of documents in increments."""
    process_batches(
        spark, source, schema, lambda batch: annotator.annotate(batch, threshold=threshold), sink, checkpoint, files_per_trigger=files_per_trigger
    )
