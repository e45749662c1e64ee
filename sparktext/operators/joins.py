"""Joins: lookups that survive hot keys, and the pairings built on them."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparktext.session import materialize

# A lookup side is broadcast only after its size was measured and found below this bound.
BROADCAST_BYTES = 64 * 1024 * 1024
HOT_PARTS = 1_000


def require_columns(df: DataFrame, *names: str) -> DataFrame:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing required columns: {', '.join(missing)}; have {', '.join(df.columns)}")
    return df


def measure(table: DataFrame) -> tuple[int, int]:
    """(rows, estimated bytes) of a stored table: one aggregate over it."""
    width = F.lit(16)
    for name, kind in table.dtypes:
        if kind in ("string", "binary"):
            width = width + F.coalesce(F.octet_length(name), F.lit(0)) + 16
        elif kind.startswith(("array", "map")):
            width = width + F.greatest(F.size(name), F.lit(0)) * (8 if kind.startswith("array") else 24) + 32
        else:
            width = width + 16
    row = table.agg(F.count(F.lit(1)).alias("n"), F.sum(width.cast("bigint")).alias("b")).first()
    return row["n"], row["b"] or 0


def lookup(
    facts: DataFrame,
    table: DataFrame,
    keys: Sequence[str],
    how: str = "inner",
    spread_on: str | None = None,
    table_bytes: int | None = None,
    frequency: str | None = None,
) -> DataFrame:
    """Join ``facts`` with a table that has one row per key.

    The table is stored and measured, unless its size is passed in, and broadcast up to
    ``BROADCAST_BYTES``. Beyond that the join shuffles, with the hot keys spread over several
    partitions. ``frequency`` names a column of the table that tells how often each key occurs
    in ``facts``; it saves counting them, and is not part of the result.
    """
    keys = list(keys)
    if table_bytes is None:
        table = materialize(table)
        table_bytes = measure(table)[1]
    if table_bytes <= BROADCAST_BYTES:
        return facts.join(F.broadcast(table.drop(frequency) if frequency else table), keys, how)
    return salted_join(facts, table, keys, how, spread_on, frequency)


def salted_join(
    facts: DataFrame,
    table: DataFrame,
    keys: Sequence[str],
    how: str = "inner",
    spread_on: str | None = None,
    frequency: str | None = None,
    hot_parts: int = HOT_PARTS,
) -> DataFrame:
    """Equi-join in which a key with many rows is split into parts of about n/hot_parts rows.

    At most ``hot_parts`` keys can hold more than n/hot_parts rows each, so the list of hot
    keys is small by construction and is the only thing broadcast. Rows with a NULL key match
    nothing and are spread as well.
    """
    keys = list(keys)
    if frequency:
        sizes = table.select(*keys, F.col(frequency).alias("_n"))
        table = table.drop(frequency)
    else:
        sizes = facts.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    total = sizes.agg(F.sum("_n").alias("_total"))
    hot = (
        sizes.crossJoin(F.broadcast(total))
        .where(F.col("_n") * hot_parts > F.col("_total"))
        .select(*keys, F.ceil(F.col("_n") * hot_parts / F.col("_total")).cast("int").alias("_parts"))
    )
    spread = F.xxhash64(spread_on) if spread_on else F.xxhash64(*[c for c in facts.columns if c not in keys] or keys)
    no_key = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in keys])
    parts = F.when(no_key, F.lit(hot_parts)).otherwise(F.coalesce("_parts", F.lit(1)))
    left = (
        facts.join(F.broadcast(hot), keys, "left")
        .withColumn("_salt", F.pmod(spread, parts.cast("bigint")))
        .drop("_parts")
    )
    right = (
        table.join(F.broadcast(hot), keys, "left")
        .withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.coalesce("_parts", F.lit(1)).cast("bigint") - 1)))
        .drop("_parts")
    )
    return left.join(right, [*keys, "_salt"], how).drop("_salt")


def group_join(left: DataFrame, right: DataFrame, groups: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on group columns with NULL as a group like any other; they come once, from the left."""
    on = reduce(lambda a, b: a & b, [F.col(f"_l.`{g}`").eqNullSafe(F.col(f"_r.`{g}`")) for g in groups])
    rest = [F.col(f"_r.`{c}`") for c in right.columns if c not in groups]
    return left.alias("_l").join(right.alias("_r"), on, how).select("_l.*", *rest)


def common_column_join(left: DataFrame, right: DataFrame, null_safe: bool = True) -> DataFrame:
    """Inner equi-join on every column both sides share; NULL keys match unless told otherwise."""
    common = [c for c in left.columns if c in right.columns]
    if not common:
        raise ValueError("the two sides share no column")
    if not null_safe:
        return left.join(right, common, "inner")
    l, r = left.alias("l"), right.alias("r")
    on: Column = F.lit(True)
    for c in common:
        on = on & F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}"))
    extra = [F.col(f"r.{c}") for c in right.columns if c not in common]
    return l.join(r, on, "inner").select("l.*", *extra)


def common_rows(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows found on both sides, once each, with their multiplicities ``left_rows`` and ``right_rows``.

    The compact form of common_column_join: both sides are counted before they meet, so a row
    with many copies costs one record and not the product of the copies.
    """
    common = [c for c in left.columns if c in right.columns]
    a = left.groupBy(*common).agg(F.count(F.lit(1)).alias("left_rows"))
    b = right.groupBy(*common).agg(F.count(F.lit(1)).alias("right_rows"))
    return common_column_join(a, b)


def pair_predictions(truth: DataFrame, predicted: DataFrame, key: str = "doc_id") -> DataFrame:
    """Match predictions with true labels by row id, never by position."""
    require_columns(truth, key, "label")
    require_columns(predicted, key, "prediction")
    return truth.select(key, "label").join(predicted, key, "inner")
