"""Run statistics of encoding jobs."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


def encoding_counts(encoded: DataFrame, is_error: Column) -> DataFrame:
    """One row: total, successful samples and error rate."""
    failed = F.sum(is_error.cast("bigint"))
    return encoded.agg(
        F.count(F.lit(1)).alias("total_samples"),
        (F.count(F.lit(1)) - failed).alias("successful_samples"),
        (failed / F.count(F.lit(1))).alias("error_rate"),
    )


def observed_run(encoded: DataFrame, is_error: Column, action: Callable[[DataFrame], None]) -> DataFrame:
    """Run ``action`` (a write) once and return its statistics as a one-row table.

    The counts come from an observation inside the same job, so no second pass is made.
    """
    seen = Observation()
    watched = encoded.observe(
        seen, F.count(F.lit(1)).alias("total"), F.sum(is_error.cast("bigint")).alias("failed")
    )
    started = time.time()
    action(watched)
    seconds = time.time() - started
    total, failed = seen.get["total"], seen.get["failed"] or 0
    row = (seconds, total - failed, total, failed / total if total else 0.0, (total - failed) / seconds, time.strftime("%Y-%m-%d %H:%M:%S"))
    schema = "processing_time_seconds double, successful_samples bigint, total_samples bigint, error_rate double, samples_per_second double, timestamp string"
    return encoded.sparkSession.createDataFrame([row], schema)
