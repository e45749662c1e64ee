"""Readers. Schemas are explicit; only read_metrics infers one, from small metric files."""

from __future__ import annotations

import os
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from sparktext.session import spread

CORPUS_SCHEMA = "text string, label int, label_text string"
# Sentence labels of abstract files and their codes.
SECTION_LABELS = {"BACKGROUND": 0, "RESULTS": 1, "CONCLUSIONS": 2, "METHODS": 3, "OBJECTIVE": 4}
BLANKS = " \t\r\n\f\v"


def read_table(spark: SparkSession, directory: str, name: str, key: str | None = None) -> DataFrame:
    """One parquet table of a directory; with ``key``, spread over the cores if it has few splits."""
    df = spark.read.parquet(os.path.join(directory, f"{name}.parquet"))
    return spread(df, key) if key else df


def read_csv(spark: SparkSession, path: str, schema: str | StructType = CORPUS_SCHEMA) -> DataFrame:
    """CSV with header and quoted multi-line text; an empty cell is NULL."""
    options = {"header": True, "multiLine": True, "quote": '"', "escape": '"', "nullValue": "", "mode": "FAILFAST"}
    return spark.read.schema(schema).options(**options).csv(path)


def read_parquet(spark: SparkSession, path: str, partition: Mapping[str, str] | None = None) -> DataFrame:
    """Parquet tree; ``partition`` restricts hive partition columns, which prunes directories."""
    df = spark.read.option("recursiveFileLookup", "false").parquet(path)
    for column, value in (partition or {}).items():
        df = df.where(F.col(column) == value)
    return df


def read_json_lines(spark: SparkSession, path: str, schema: str | StructType = CORPUS_SCHEMA) -> DataFrame:
    return spark.read.schema(schema).json(path)


def read_json_array(spark: SparkSession, path: str, schema: str | StructType = CORPUS_SCHEMA) -> DataFrame:
    """Files that each hold one JSON array: a row per element."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def _sections(spark: SparkSession, path: str) -> DataFrame:
    # A header is ### at the start of a line; the first of a file has no line end before it.
    raw = spark.read.option("lineSep", "\n###").text(path).select(F.regexp_replace("value", "^(\ufeff)?###", "").alias("value")).where(F.trim("value") != "")
    lines = F.filter(F.split("value", "\r?\n"), lambda x: F.trim(x) != "")
    return raw.select(lines.alias("_lines")).where(F.size("_lines") > 0).select(
        F.btrim(F.col("_lines")[0], F.lit(BLANKS)).alias("id"), F.slice("_lines", 2, F.size("_lines")).alias("_lines")
    )


def read_sections(spark: SparkSession, path: str, labels: Mapping[str, int] = SECTION_LABELS) -> DataFrame:
    """Sectioned text (``###id``, then ``LABEL<tab>text`` lines) -> (id, text, label, label_text).

    One record per section comes straight from the line separator, so no header has to be
    carried from line to line. Lines of other labels are dropped; tabs inside the text stay.
    """
    rows = _sections(spark, path).select("id", F.explode("_lines").alias("_line"))
    name = F.substring_index("_line", "\t", 1)
    body = F.expr("substring(_line, instr(_line, '\t') + 1)")
    codes = F.create_map(*[F.lit(x) for kv in labels.items() for x in kv])
    return (
        rows.where(F.instr("_line", "\t") > 0)
        .select("id", F.btrim(body, F.lit(BLANKS)).alias("text"), F.try_element_at(codes, name).alias("label"), name.alias("label_text"))
        .where(F.col("label").isNotNull())
    )


def read_positioned_lines(spark: SparkSession, path: str) -> DataFrame:
    """The same files as (group_id, target, text, line_number, total_lines), text lower-cased."""
    rows = _sections(spark, path).select(
        F.col("id").alias("group_id"), (F.size("_lines") - 1).alias("total_lines"), F.posexplode("_lines").alias("line_number", "_line")
    )
    return rows.select(
        "group_id",
        F.substring_index("_line", "\t", 1).alias("target"),
        F.lower(F.btrim(F.expr("substring(_line, instr(_line, '\t') + 1)"), F.lit(BLANKS))).alias("text"),
        "line_number",
        "total_lines",
    )


def read_word_vectors(spark: SparkSession, path: str) -> DataFrame:
    """Word-vector text (``word v1 ... vd``) -> (word, vector); a count header is dropped."""
    parts = spark.read.text(path).select(F.split(F.trim("value"), " ").alias("_p"))
    header = (F.size("_p") == 2) & F.col("_p")[0].rlike("^[0-9]+$") & F.col("_p")[1].rlike("^[0-9]+$")
    return parts.where(~header & (F.size("_p") > 1)).select(
        F.col("_p")[0].alias("word"), F.slice("_p", 2, F.size("_p") - 1).cast("array<float>").alias("vector")
    )


def read_metrics(spark: SparkSession, directory: str) -> DataFrame:
    """All JSON metric files of a directory, one row each, tagged by file name; missing fields are NULL."""
    df = spark.read.option("multiLine", True).json(directory)
    return df.select("*", F.col("_metadata.file_name").alias("file_name"))


def split_path(config: dict, mode: str) -> str:
    """Path of the split a mode works on: train, encode (test) or val (falls back to test)."""
    data = config["dataset"]
    if mode == "train":
        return data["train"]
    if mode == "encode":
        return data["test"]
    if mode == "val":
        return data.get("val") or data["test"]
    raise ValueError(f"unknown mode {mode!r}; expected train, encode or val")
