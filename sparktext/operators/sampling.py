"""Seeded samples, splits, folds and chunks. All are exact and repeat for one seed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparktext.operators.ranking import hash_key, hash_split, ranked


def sample_n(df: DataFrame, n: int, key: str = "doc_id", seed: int = 42) -> DataFrame:
    """``n`` rows without replacement (all rows if there are fewer)."""
    return hash_split(df, key, lambda t: t.withColumn("take", F.least(F.lit(n), "total")), seed=seed).where(
        "taken"
    ).drop("taken")


def sample_fraction(df: DataFrame, fraction: float, key: str = "doc_id", seed: int = 42) -> DataFrame:
    """Keep a row when its hash falls below the fraction; needs no shuffle."""
    place = F.conv(F.substring(hash_key(key, seed=seed), 1, 8), 16, 10).cast("double") / float(2**32)
    return df.where(place < fraction)


def train_test_split(df: DataFrame, test_size: float = 0.2, key: str = "doc_id", seed: int = 42) -> DataFrame:
    """Add ``split``: exactly ceil(test_size * n) rows are ``test``."""
    flagged = hash_split(df, key, lambda t: t.withColumn("take", F.ceil(F.col("total") * test_size)), seed=seed)
    return flagged.withColumn("split", F.when(F.col("taken"), "test").otherwise("train")).drop("taken")


def train_test_split_fast(df: DataFrame, test_size: float = 0.2, key: str = "doc_id", seed: int = 42) -> DataFrame:
    """Like train_test_split, but the share is met only in expectation: one scan, no shuffle."""
    place = F.conv(F.substring(hash_key(key, seed=seed), 1, 8), 16, 10).cast("double") / float(2**32)
    return df.withColumn("split", F.when(place < test_size, "test").otherwise("train"))


def balanced_sample(
    df: DataFrame, per_class: int, label: str = "label", key: str = "doc_id", seed: int = 42
) -> DataFrame:
    """Up to ``per_class`` rows of every class, drawn uniformly."""
    return hash_split(
        df, key, lambda t: t.withColumn("take", F.least(F.lit(per_class), "total")), [label], seed
    ).where("taken").drop("taken")


def balance_to_smallest(
    df: DataFrame, cap: int, label: str = "label", key: str = "doc_id", seed: int = 42
) -> DataFrame:
    """The same number of rows from every class: the smallest class size, at most ``cap``."""

    def take(totals: DataFrame) -> DataFrame:
        least = totals.agg(F.least(F.min("total"), F.lit(cap)).alias("take"))
        return totals.crossJoin(F.broadcast(least))

    return hash_split(df, key, take, [label], seed).where("taken").drop("taken")


def training_sample(
    df: DataFrame, per_label: int = 1000, label: str = "label", key: str = "doc_id", seed: int = 42
) -> DataFrame:
    """min(per_label * number of labels, n) rows."""
    labels = df.agg(F.count_distinct(label).alias("_labels"))
    return hash_split(
        df,
        key,
        lambda t: t.crossJoin(F.broadcast(labels)).withColumn(
            "take", F.least(F.col("_labels") * per_label, F.col("total"))
        ),
        seed=seed,
    ).where("taken").drop("taken")


def mini_corpus(df: DataFrame, k: int, key: str = "doc_id", seed: int = 42) -> DataFrame:
    """Exactly ``k`` rows, numbered by ``slot``; a smaller input is cycled."""
    picked = sample_n(df, k, key, seed).withColumn("_hash", hash_key(key, seed=seed))
    numbered = ranked(picked.withColumn("_one", F.lit(1)), "_hash", totals={"_n": "_one"})
    slots = F.sequence(F.col("row_number"), F.lit(k).cast("bigint"), F.col("_n").cast("bigint"))
    return numbered.withColumn("slot", F.explode(slots)).drop("_hash", "_one", "_n", "row_number")


def stratified_folds(
    df: DataFrame, k: int, label: str = "label", key: str = "doc_id", fold: str = "fold"
) -> DataFrame:
    """Fold number 0..k-1; classes are dealt out evenly in key order."""
    return (
        ranked(df, key, [label]).withColumn(fold, ((F.col("row_number") - 1) % k).cast("int")).drop("row_number")
    )


def first_n_per_class(df: DataFrame, n: int, label: str = "label", key: str = "doc_id") -> DataFrame:
    """First ``n`` rows of each class in key order.

    A salted top-n runs before the final one, so that a hot class reaches no task whole.
    """
    salts = 64
    near = W.partitionBy(label, "_salt").orderBy(key)
    final = W.partitionBy(label).orderBy(key)
    return (
        df.withColumn("_salt", F.pmod(F.xxhash64(key), F.lit(salts)))
        .withColumn("_rn", F.row_number().over(near))
        .where(F.col("_rn") <= n)
        .withColumn("_rn", F.row_number().over(final))
        .where(F.col("_rn") <= n)
        .drop("_salt", "_rn")
    )


def shuffled(df: DataFrame, key: str = "doc_id", seed: int = 42) -> DataFrame:
    """All rows in seeded random order (a range-partitioned sort)."""
    return df.orderBy(hash_key(key, seed=seed), key)


def row_chunks(df: DataFrame, size: int, key: str = "doc_id") -> DataFrame:
    """Chunk number of consecutive blocks of ``size`` rows in key order."""
    return (
        ranked(df, key)
        .withColumn("chunk_id", F.floor((F.col("row_number") - 1) / size).cast("bigint"))
        .drop("row_number")
    )


def head_and_next(df: DataFrame, n: int, skip: int = 0, key: str = "doc_id") -> DataFrame:
    """``n`` rows after the first ``skip`` in key order."""
    return df.orderBy(key).offset(skip).limit(n) if skip else df.orderBy(key).limit(n)


def with_positions(df: DataFrame, group: str, order: str) -> DataFrame:
    """``line_number`` from 0 and ``total_lines`` = last line number, per group."""
    numbered = ranked(df.withColumn("_one", F.lit(1)), order, [group], totals={"_n": "_one"})
    return (
        numbered.withColumn("line_number", F.col("row_number") - 1)
        .withColumn("total_lines", F.col("_n") - 1)
        .drop("_one", "_n", "row_number")
    )
