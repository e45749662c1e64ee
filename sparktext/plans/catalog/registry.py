"""Registration of queries and the SQL fragments they share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparktext.functions import text
from sparktext.functions.words import ENGLISH_STOP_WORDS
from sparktext.sources.readers import read_table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return read_table(spark, sf, "documents", "doc_id")


# Class names of the language label in sorted order; the code of a name is its position.
LANGS = ("de", "en", "es", "fr")


def corpus(spark: SparkSession, sf: str) -> DataFrame:
    """documents as a labelled corpus: the language is the class."""
    names = F.array(*[F.lit(x) for x in LANGS])
    label = (F.array_position(names, F.col("lang")) - 1).cast("int")
    return documents(spark, sf).select("doc_id", "text", F.col("lang").alias("label_text"), label.alias("label"))


def sized(spark: SparkSession, sf: str) -> DataFrame:
    """(doc_id, label_text, n_words) of all documents."""
    return documents(spark, sf).select("doc_id", F.col("lang").alias("label_text"), text.word_count("text").alias("n_words"))


def quoted(items) -> str:
    return ", ".join("'" + str(i).replace("'", "''") + "'" for i in items)


STOPS = quoted(ENGLISH_STOP_WORDS)
SQL_LABEL = "list_position(['de', 'en', 'es', 'fr'], lang) - 1"
SQL_CORPUS = f"corpus AS (SELECT doc_id, text, lang AS label_text, CAST({SQL_LABEL} AS INTEGER) AS label FROM documents)"
SQL_WORDS = f"regexp_extract_all(text, '{text.WORDS}')"
SQL_SIZED = f"sized AS (SELECT doc_id, lang AS label_text, CAST(len({SQL_WORDS}) AS BIGINT) AS n_words FROM documents)"


def sql_replace(expr: str, pattern: str, new: str = "") -> str:
    return f"regexp_replace({expr}, '{pattern}', '{new}', 'g')"


def sql_clean_chars(expr: str) -> str:
    out = f"lower({expr})"
    for pattern in (text.PUNCTUATION, text.DIGITS, text.NOT_LETTERS):
        out = sql_replace(out, pattern)
    out = f"trim({sql_replace(out, text.SPACES, ' ')})"
    return sql_replace(out, text.TAG)


def sql_clean(expr: str) -> str:
    words = f"regexp_extract_all({sql_clean_chars(expr)}, '{text.WORDS}')"
    return f"array_to_string(list_filter({words}, lambda w: w NOT IN ({STOPS})), ' ')"


# Long table (doc_id, label, term, tf) over whole texts.
SQL_TOKENS = f"tokens AS (SELECT doc_id, {SQL_LABEL} AS label, unnest(regexp_extract_all(lower(text), '{text.TERM}')) AS term FROM documents)"
SQL_COUNTS = f"{SQL_TOKENS}, counts AS (SELECT doc_id, label, term, count(*) AS tf FROM tokens GROUP BY ALL)"
