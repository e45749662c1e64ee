"""Corpus profiles: counts, describe, histograms, box plots, density."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparktext.operators.joins import group_join
from sparktext.operators.ranking import exact_percentiles, percentiles_of_counts, value_counts


def label_counts(df: DataFrame, label: str = "label", by_label: bool = False) -> DataFrame:
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    return counts.orderBy(label) if by_label else counts.orderBy(F.desc("n"), label)


def class_shares(df: DataFrame, label: str = "label") -> DataFrame:
    """Rows and share of all rows per class."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("_all"))
    return counts.crossJoin(F.broadcast(total)).withColumn("share", F.col("n") / F.col("_all")).drop("_all")


def set_counts(df: DataFrame, column: str) -> DataFrame:
    """Count rows by a set-valued column; sets compare sorted."""
    return df.groupBy(F.array_sort(column).alias(column)).agg(F.count(F.lit(1)).alias("n"))


def null_counts(df: DataFrame) -> DataFrame:
    """One row per column with its number of NULLs."""
    sums = df.agg(*[F.sum(F.col(c).isNull().cast("bigint")).alias(c) for c in df.columns])
    return sums.unpivot([], df.columns, "column_name", "nulls")


def smallest_class(df: DataFrame, label: str = "label") -> DataFrame:
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("n")).agg(F.min("n").alias("smallest"))


_QUARTILES = ((0.25, "q25"), (0.5, "q50"), (0.75, "q75"))


def _quartiles(counts: DataFrame, value: str, groups: list[str]) -> DataFrame:
    found = percentiles_of_counts(counts, value, [p for p, _ in _QUARTILES], groups)
    picked = [F.max(F.when(F.col("p") == p, F.col("value"))).alias(n) for p, n in _QUARTILES]
    return found.groupBy(*groups).agg(*picked)


def _moments(counts: DataFrame, value: str, groups: list[str]) -> DataFrame:
    """count, mean, sample std, min and max from value counts; deviations are taken from the mean."""
    v, n = F.col(value), F.col("_n")
    means = counts.groupBy(*groups).agg(
        F.sum(n).alias("n"), (F.sum(v * n) / F.sum(n)).alias("mean"), F.min(v).alias("min"), F.max(v).alias("max")
    )
    both = group_join(counts, means, groups) if groups else counts.crossJoin(F.broadcast(means))
    off = v - F.col("mean")
    total = F.first("n")
    std = F.when(total > 1, F.sqrt(F.sum(n * off * off) / (total - 1)))
    picked = [F.first(c).alias(c) for c in ("n", "mean", "min", "max")]
    return both.groupBy(*groups).agg(*picked, std.alias("std"))


def describe(df: DataFrame, value: str, groups: Sequence[str] = ()) -> DataFrame:
    """count, mean, sample std, min, exact quartiles, max; per group if asked. One pass over the input."""
    groups = list(groups)
    counts = value_counts(df, value, groups)
    stats, wide = _moments(counts, value, groups), _quartiles(counts, value, groups)
    return group_join(stats, wide, groups) if groups else stats.crossJoin(F.broadcast(wide))


def percentiles(df: DataFrame, value: str, ps: Sequence[float], groups: Sequence[str] = ()) -> DataFrame:
    return exact_percentiles(df, value, ps, groups)


def histogram(df: DataFrame, value: str, bins: int, groups: Sequence[str] = ()) -> DataFrame:
    """Equal-width bins over the (group's) range, empty ones included; the last bin holds its right edge.

    Values are counted first, so the join with the ranges sees distinct values only.
    """
    groups = list(groups)
    counts = value_counts(df, value, groups)
    spans = counts.groupBy(*groups).agg(
        F.min(value).cast("double").alias("_low"), F.max(value).cast("double").alias("_high")
    )
    flat = F.col("_low") == F.col("_high")
    spans = spans.select(
        *groups,
        F.when(flat, F.col("_low") - 0.5).otherwise(F.col("_low")).alias("_low"),
        F.when(flat, F.col("_high") + 0.5).otherwise(F.col("_high")).alias("_high"),
    )
    wide = group_join(counts, spans, groups) if groups else counts.crossJoin(F.broadcast(spans))
    width = (F.col("_high") - F.col("_low")) / bins
    place = F.least(F.floor((F.col(value) - F.col("_low")) / width), F.lit(bins - 1))
    filled = wide.groupBy(*groups, place.cast("bigint").alias("bin")).agg(F.sum("_n").alias("_n"))
    every = spans.withColumn("bin", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(bins - 1).cast("bigint"))))
    left = F.col("_low") + F.col("bin") * (F.col("_high") - F.col("_low")) / bins
    return group_join(every, filled, [*groups, "bin"], "left").select(
        *groups, "bin", left.alias("left_edge"), F.coalesce("_n", F.lit(0)).alias("n")
    )


def box_plot(df: DataFrame, value: str, groups: Sequence[str]) -> DataFrame:
    """Quartiles, whiskers at the last values within 1.5 IQR, and the number of outliers."""
    groups = list(groups)
    counts = value_counts(df, value, groups)
    wide = _quartiles(counts, value, groups)
    reach = 1.5 * (F.col("q75") - F.col("q25"))
    inside = F.col(value).between(F.col("q25") - reach, F.col("q75") + reach)
    return (
        group_join(counts, wide, groups)
        .groupBy(*groups, "q25", "q50", "q75")
        .agg(
            F.min(F.when(inside, F.col(value))).alias("whisker_low"),
            F.max(F.when(inside, F.col(value))).alias("whisker_high"),
            F.sum(F.when(inside, 0).otherwise(F.col("_n"))).alias("outliers"),
        )
    )


def density(df: DataFrame, value: str, points: int = 200) -> DataFrame:
    """Gaussian kernel density (Scott bandwidth) on an even grid from min to max.

    The sum runs over distinct values with their counts.
    """
    counts = value_counts(df, value)
    stats = _moments(counts, value, []).select(
        F.col("n").alias("_all"), F.col("std").alias("_std"), F.col("min").alias("_low"), F.col("max").alias("_high")
    )
    width = F.col("_std") * F.pow(F.col("_all").cast("double"), F.lit(-0.2))
    at: Column = F.col("_low") + F.col("point") * (F.col("_high") - F.col("_low")) / (points - 1)
    grid = counts.crossJoin(F.broadcast(stats)).withColumn("point", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
    z = (at - F.col(value)) / width
    weight = F.col("_n") * F.exp(-0.5 * z * z) / (F.col("_all") * width * F.sqrt(F.lit(2.0) * F.pi()))
    return grid.groupBy(F.col("point").cast("bigint").alias("point"), at.alias("x")).agg(F.sum(weight).alias("density"))


def matrix_shape(weights: DataFrame, rows: DataFrame, columns: DataFrame, key: str = "doc_id") -> DataFrame:
    """Rows, columns, non-zeros and density of a long (row, term, weight) table."""
    nnz = weights.agg(F.count(F.lit(1)).alias("nonzeros"))
    n = rows.agg(F.count_distinct(key).alias("n_rows"))
    m = columns.agg(F.count(F.lit(1)).alias("n_columns"))
    one = n.crossJoin(F.broadcast(m)).crossJoin(F.broadcast(nnz))
    return one.withColumn("density", F.col("nonzeros") / (F.col("n_rows") * F.col("n_columns")))
