"""Exact ranks, running sums, percentiles and hash samples without a single-task sort.

A plain ``row_number() over (partition by g order by k)`` puts a whole group into one task.
Here the order key is cut into ranges first: rows are ranked inside (group, range), and the
number of rows in earlier ranges, taken from a small count table, is added. The cut points
come from a sample of keys and only balance the work; the result is exact for any cut.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparktext.functions.text import keep_if
from sparktext.operators.joins import group_join, lookup
from sparktext.session import materialize, parallelism

SAMPLES_PER_RANGE = 16
HASH_DIGITS = 5
ONE_TASK_ROWS = 500_000


def _cut_points(df: DataFrame, key: str, ranges: int, groups: Sequence[str] = ()) -> DataFrame:
    """One row holding the sorted cut points, as a list of lists of about equal length.

    Keys are unique within a group only, so rows are sampled by a hash of group and key: a key that
    many groups share weighs as many rows, and is not sampled alone.
    """
    known = df.select(*groups, key).where(F.col(key).isNotNull())
    sample = known.orderBy(F.xxhash64(*groups, key), key).limit(ranges * SAMPLES_PER_RANGE).select(key)
    keys = F.array_sort(F.collect_list(key))
    picked = sample.agg(keys.alias("_keys")).select(
        F.filter("_keys", lambda _x, i: (i > 0) & (i % SAMPLES_PER_RANGE == 0)).alias("_cuts")
    )
    width = max(2, int(ranges**0.5))
    blocks = F.when(
        F.size("_cuts") > 0,
        F.transform(
            F.sequence(F.lit(1), F.size("_cuts"), F.lit(width)), lambda i: F.slice("_cuts", i, F.lit(width))
        ),
    )
    return picked.select(blocks.alias("_cuts"))


def _range_of(key: Column, cuts: Column) -> Column:
    """Number of cut points <= key, found block first, then inside the block."""
    below = F.size(F.filter(cuts, lambda block: block[0] <= key))
    block = F.get(cuts, below - 1)
    inside = F.size(F.filter(block, lambda c: c <= key))
    return F.when(
        cuts.isNull() | key.isNull() | (below == 0), F.lit(0)
    ).otherwise((below - 1) * F.size(cuts[0]) + inside)


def ranked(
    df: DataFrame,
    order: str,
    groups: Sequence[str] = (),
    number: str | None = "row_number",
    running: Mapping[str, str] | None = None,
    totals: Mapping[str, str] | None = None,
    descending: bool = False,
    one_task: bool = False,
) -> DataFrame:
    """Add exact per-group row numbers, running sums and totals along ``order``.

    ``running`` and ``totals`` map a new column to the numeric column summed. ``order`` must be
    unique within a group. NULL order keys come first. ``one_task`` says that the input is known
    to fit one task, so plain windows do.
    """
    groups = list(groups)
    running, totals = dict(running or {}), dict(totals or {})
    direction = F.col(order).desc_nulls_last() if descending else F.col(order).asc_nulls_first()
    if one_task:
        along = W.partitionBy(*groups).orderBy(direction)
        upto = along.rowsBetween(W.unboundedPreceding, W.currentRow)
        sums = [F.sum(c).over(W.partitionBy(*groups)).alias(n) for n, c in totals.items()]
        sums += [F.sum(c).over(upto).alias(n) for n, c in running.items()]
        if number:
            sums.append(F.row_number().over(along).cast("bigint").alias(number))
        return df.select("*", *sums)
    ranges = max(2, parallelism(df.sparkSession))
    wide = df.crossJoin(F.broadcast(_cut_points(df, order, ranges, groups)))
    sign = -1 if descending else 1
    wide = wide.withColumn("_range", F.lit(sign) * _range_of(F.col(order), F.col("_cuts"))).drop("_cuts")

    summed = sorted({*running.values(), *totals.values()})
    parts = wide.groupBy(*groups, "_range").agg(
        F.count(F.lit(1)).alias("_rows"), *[F.sum(c).alias(f"_sum_{c}") for c in summed]
    )
    before = W.partitionBy(*groups).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy(*groups)
    offsets = parts.select(
        *groups,
        "_range",
        F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_rows_before"),
        *[F.coalesce(F.sum(f"_sum_{c}").over(before), F.lit(0)).alias(f"_before_{n}") for n, c in running.items()],
        *[F.sum(f"_sum_{c}").over(whole).alias(n) for n, c in totals.items()],
    )
    inside = W.partitionBy(*groups, "_range").orderBy(direction)
    upto = inside.rowsBetween(W.unboundedPreceding, W.currentRow)
    out = group_join(wide, offsets, [*groups, "_range"])
    added = [(F.sum(c).over(upto) + F.col(f"_before_{n}")).alias(n) for n, c in running.items()]
    if number:
        added.append((F.row_number().over(inside) + F.col("_rows_before")).cast("bigint").alias(number))
    return out.select(*[F.col(c) for c in df.columns], *totals, *added)


def ranked_table(df: DataFrame, order: str, groups: Sequence[str] = (), **kw) -> DataFrame:
    """``ranked`` for an aggregated input: stored first, so that it is computed once, and counted.

    Up to ``ONE_TASK_ROWS`` rows are ranked by plain windows, more by key ranges; the result is the same.
    """
    stored = materialize(df)
    small = stored.limit(ONE_TASK_ROWS + 1).count() <= ONE_TASK_ROWS
    return ranked(stored, order, groups, one_task=small, **kw)


def value_counts(df: DataFrame, value: str, groups: Sequence[str] = ()) -> DataFrame:
    """Stored table (groups..., value, _n) of the distinct non-NULL values: one pass over the input."""
    kept = df.select(*groups, keep_if(F.col(value), lambda v: v.isNotNull()).alias(value))
    counted = kept.groupBy(*groups, value).agg(F.count(F.lit(1)).alias("_n"))
    return materialize(counted.withColumn(value, F.col(value).cast("double")))


def exact_percentiles(
    df: DataFrame, value: str, probabilities: Sequence[float], groups: Sequence[str] = ()
) -> DataFrame:
    """Linear-interpolated percentiles, one row per (group, p).

    Equal values are counted first, so the ranked table has one row per distinct value; then at
    most two rows per percentile are kept and interpolated.
    """
    return percentiles_of_counts(value_counts(df, value, groups), value, probabilities, groups)


def percentiles_of_counts(
    counts: DataFrame, value: str, probabilities: Sequence[float], groups: Sequence[str] = ()
) -> DataFrame:
    groups = list(groups)
    cum = ranked_table(counts, value, groups, number=None, running={"_upto": "_n"}, totals={"_all": "_n"})
    first, last = F.col("_upto") - F.col("_n"), F.col("_upto") - 1

    def place(p: Column) -> Column:
        return p * (F.col("_all") - 1)

    def touched(p: Column) -> Column:
        return (F.floor(place(p)).between(first, last)) | (F.ceil(place(p)).between(first, last))

    hits = cum.withColumn("p", F.explode(F.filter(F.array(*[F.lit(float(p)) for p in probabilities]), touched)))
    at = place(F.col("p"))
    low = F.max(F.when(F.floor(at).between(first, last), F.col(value)))
    high = F.max(F.when(F.ceil(at).between(first, last), F.col(value)))
    share = F.max(at - F.floor(at))
    return hits.groupBy(*groups, "p").agg((low + (high - low) * share).alias("value"))


def hash_key(*cols: str, seed: int = 42) -> Column:
    """Engine-neutral pseudo-random order: md5 of ``seed:id``."""
    return F.md5(F.concat(F.lit(f"{seed}:"), *[F.col(c).cast("string") for c in cols]))


# Stands for the hash of a NULL id; sorts before every hash.
NO_ID = "-" * 32


def _places(key: str, seed: int) -> Column:
    return F.coalesce(hash_key(key, seed=seed), F.lit(NO_ID))


def hash_cuts(df: DataFrame, key: str, take: Callable[[DataFrame], DataFrame], groups: Sequence[str] = (), seed: int = 42) -> DataFrame:
    """Stored table with one row per group: ``_cut``, and ``_tie`` with ``_left``.

    The wanted rows are those whose hash is at most ``_cut``, plus any ``_left`` of the rows that share the hash
    ``_tie`` (NULL unless ids repeat just there). Hash prefixes are counted first; only the one prefix that holds
    the last wanted row (one millionth of the rows) is looked at hash by hash.
    """
    groups = list(groups)
    known = df.where(" AND ".join(f"`{g}` IS NOT NULL" for g in groups)) if groups else df
    hashes = materialize(known.select(*groups, _places(key, seed).alias("_hash")))
    prefix = F.substring("_hash", 1, HASH_DIGITS)
    hist = hashes.groupBy(*groups, prefix.alias("_range")).agg(F.count(F.lit(1)).alias("_n"))
    totals = take(hist.groupBy(*groups).agg(F.sum("_n").alias("total")))
    upto = W.partitionBy(*groups).orderBy("_range").rowsBetween(W.unboundedPreceding, W.currentRow)
    cum = hist.withColumn("_upto", F.sum("_n").over(upto))
    wanted = totals.select(*groups, F.col("take").cast("bigint").alias("_take"))
    joined = cum.join(wanted, groups, "inner") if groups else cum.crossJoin(F.broadcast(wanted))
    left = (F.col("_take") - F.col("_upto") + F.col("_n")).alias("left")
    edges = joined.groupBy(*groups).agg(F.min(F.when(F.col("_upto") > F.col("_take"), F.struct("_range", left))).alias("_edge"))
    edges = materialize(edges)
    marked = lookup(hashes, edges, groups, spread_on="_hash") if groups else hashes.crossJoin(F.broadcast(edges))
    near = marked.where((prefix == F.col("_edge._range")) & (F.col("_edge.left") > 0))
    counted = near.groupBy(*groups, "_hash").agg(F.count(F.lit(1)).alias("_n"), F.first("_edge.left").alias("_want"))
    inside = W.partitionBy(*groups).orderBy("_hash").rowsBetween(W.unboundedPreceding, W.currentRow)
    ranks = counted.withColumn("_upto", F.sum("_n").over(inside))
    tie = F.min(F.when((F.col("_upto") > F.col("_want")) & (F.col("_upto") - F.col("_n") < F.col("_want")), F.struct("_hash", (F.col("_want") - F.col("_upto") + F.col("_n")).alias("left"))))
    found = ranks.groupBy(*groups).agg(F.max(F.when(F.col("_upto") <= F.col("_want"), F.col("_hash"))).alias("_last"), tie.alias("_t"))
    both = edges.join(found, groups, "left") if groups else edges.crossJoin(F.broadcast(found))
    # Past every hash if all rows are wanted; the bare prefix, below the hashes that start with it, if none of them is.
    cut = F.when(F.col("_edge").isNull(), F.lit("g")).otherwise(F.coalesce("_last", "_edge._range"))
    return materialize(both.select(*groups, cut.alias("_cut"), F.col("_t._hash").alias("_tie"), F.col("_t.left").alias("_left")))


def hash_split(
    df: DataFrame,
    key: str,
    take: Callable[[DataFrame], DataFrame],
    groups: Sequence[str] = (),
    seed: int = 42,
    flag: str = "taken",
) -> DataFrame:
    """Flag, per group, exactly the ``take`` rows that come first in hash order.

    ``take`` gets a table (groups..., total) and adds a column ``take``. The cut hash of each group is found on
    the hashes alone; then a comparison per row decides, so the input is evaluated once after that. Only if
    ids repeat just at a cut are the rows of that id told apart by a sort. Rows of a NULL group are left out; NULL
    ids come first.
    """
    groups = list(groups)
    cuts = hash_cuts(df, key, take, groups, seed)
    placed = df.withColumn("_hash", _places(key, seed))
    marked = lookup(placed, cuts, groups, spread_on=key) if groups else placed.crossJoin(F.broadcast(cuts))
    full = F.col("_hash") <= F.col("_cut")
    if cuts.where("_tie IS NOT NULL").isEmpty():
        return marked.select(*df.columns, full.alias(flag))
    tied = F.col("_hash").eqNullSafe(F.col("_tie"))
    sure = marked.where(~tied).select(*df.columns, full.alias(flag))
    order = W.partitionBy(*groups, "_hash").orderBy(F.xxhash64(*df.columns))
    return sure.unionByName(marked.where(tied).select(*df.columns, (F.row_number().over(order) <= F.col("_left")).alias(flag)))


def carry_forward(df: DataFrame, order: str, value: str, output: str) -> DataFrame:
    """Last non-NULL ``value`` at or before each row along ``order``, which must be unique.

    Inside a key range by window; across ranges from a table with one row per range.
    """
    ranges = max(2, parallelism(df.sparkSession))
    wide = df.crossJoin(F.broadcast(_cut_points(df, order, ranges)))
    wide = wide.withColumn("_range", _range_of(F.col(order), F.col("_cuts"))).drop("_cuts")
    last = wide.groupBy("_range").agg(F.max_by(value, F.when(F.col(value).isNotNull(), F.col(order))).alias("_last"))
    before = W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    carried = last.select("_range", F.last("_last", ignorenulls=True).over(before).alias("_carried"))
    inside = W.partitionBy("_range").orderBy(order).rowsBetween(W.unboundedPreceding, W.currentRow)
    out = wide.join(F.broadcast(carried), "_range")
    return out.withColumn(output, F.coalesce(F.last(value, ignorenulls=True).over(inside), "_carried")).drop("_range", "_carried")
