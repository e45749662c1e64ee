"""Corpus pipeline: stages over documents, each written as Parquet and read again.

Every stage takes all rows that the one before kept and returns the columns of documents, but for
the last, which returns the place of each document in padded batches. Ids or texts may be NULL; a
row that repeats an id and a text is dropped by the dedup stages.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparktext.llm import exact_dedup, jaccard_join, length_buckets, mil_quality, suffix_dedup
from sparktext.llm.common import identified, keep_documents, scoped, stored, table, with_decisions
from sparktext.llm.queries import QUALITY_AT_LEAST

# A passage that goes when it is repeated has more than fifty words.
PASSAGE_WORDS = 51


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the classifier scores below the threshold."""
    model = mil_quality.train(docs, table(spark, sf_dir, "labels"))
    return docs.where(mil_quality.score_column(model, F.col("text")) >= QUALITY_AT_LEAST)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest id stays."""
    return keep_documents(docs, exact_dedup.exact_duplicates(docs).where("kept").select("doc_id", "text_hash"))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every component of near duplicates the document with the smallest id stays."""
    joined = jaccard_join.linked_components(docs)
    return keep_documents(docs, joined.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select("doc_id", "text_hash"))


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of PASSAGE_WORDS words or more found in more than one place go, in all their copies; every
    document stays. Words are compared as they stand, whatever blanks are between them; a character of a
    script without blanks counts as a word."""
    found = suffix_dedup.windows_by_document(docs, length=PASSAGE_WORDS, unit="words")
    joined = with_decisions(docs, found.hint("shuffle_hash"))
    cut = joined.withColumn("_cut", suffix_dedup.cut_column(F.col("d.text"), F.col("k.windows"), PASSAGE_WORDS, "words"))
    changed = F.col("k.windows").isNotNull()
    new = {"text": F.when(changed, F.col("_cut")).otherwise(F.col("d.text")), "n_chars": F.when(changed, F.char_length("_cut").cast("bigint")).otherwise(F.col("d.n_chars"))}
    return cut.select(*[new[c].alias(c) if c in new else F.col(f"d.`{c}`") for c in docs.columns])


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, bucket, bucket_length, padding, batch, slot."""
    path = public_tokenizers.path("word_bpe_49k.json")
    lengths = length_buckets.token_lengths(identified(docs), str(path))
    return length_buckets.pack(lengths, buckets=16, token_budget=65_536).drop("text_hash")


STAGES = [
    ("quality classifier", quality),
    ("exact dedup", exact),
    ("n-gram Jaccard join", near),
    ("suffix-array dedup", passages),
    ("packing", packing),
]
# A trained classifier decides which rows reach the other stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        with scoped(spark):  # what a stage has set aside goes when its result is written
            docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
