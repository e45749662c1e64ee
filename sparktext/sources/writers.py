"""Writers."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """CSV with header per file; arrays become JSON text; append adds files."""
    flat = df.select(
        *[F.to_json(c).alias(c) if t.startswith(("array", "map", "struct")) else F.col(c) for c, t in df.dtypes]
    )
    flat.write.mode(mode).options(header=True, quote='"', escape='"', nullValue="", emptyValue="").csv(path)


def write_parquet(df: DataFrame, path: str, mode: str = "overwrite", partition_by: list[str] | None = None) -> None:
    writer = df.write.mode(mode)
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def write_json_lines(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).json(path)


def write_json_array(df: DataFrame, path: str) -> None:
    """Files that each hold one JSON array with the rows of one partition."""

    def bracketed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lead = "["
        for pdf in batches:
            if len(pdf):
                marks = [lead] + [","] * (len(pdf) - 1)
                yield pd.DataFrame({"value": [m + v for m, v in zip(marks, pdf["value"], strict=True)]})
                lead = ","
        if lead == ",":
            yield pd.DataFrame({"value": ["]"]})

    lines = df.select(F.to_json(F.struct(*df.columns)).alias("value"))
    lines.mapInPandas(bracketed, "value string").write.mode("overwrite").text(path)


def write_metrics(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Small metric tables as one JSON file."""
    df.coalesce(1).write.mode(mode).json(path)


def write_sections(df: DataFrame, path: str, group: str, order: str, label: str, text: str = "text") -> None:
    """Sectioned text: ``###group`` header, then ``label<tab>text`` lines in order.

    Rows are range-partitioned by group and sorted, so each section lies whole in one file.
    """
    one_line = F.regexp_replace(F.col(text), r"[\r\n]+", " ")
    first = F.min(order).alias("_first")
    heads = df.groupBy(group).agg(first).select(group, F.col("_first").alias(order), F.lit(0).alias("_kind"), F.concat(F.lit("###"), F.col(group).cast("string")).alias("value"))
    lines = df.select(group, order, F.lit(1).alias("_kind"), F.concat(F.col(label), F.lit("\t"), one_line).alias("value"))
    both = heads.unionByName(lines).repartitionByRange(group).sortWithinPartitions(group, order, "_kind")
    both.select("value").write.mode("overwrite").text(path)


def write_word_vectors(df: DataFrame, path: str) -> None:
    df.select(
        F.concat_ws(" ", "word", F.transform("vector", lambda x: x.cast("string"))).alias("value")
    ).write.mode("overwrite").text(path)
