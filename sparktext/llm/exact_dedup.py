"""Exact duplicates by a tree merge of sorted digest runs, in DataFrame operations alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FAN_IN_BITS = 3
ROUNDS = 3
KEY = ("text_sha256", "n_bytes", "check")


def _digests(docs: DataFrame, id_col: str, text_col: str, run: Column) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(
        F.col(id_col).alias("doc_id"),
        run.alias("run"),
        F.sha2(text.cast("binary"), 256).alias("text_sha256"),
        F.octet_length(text).alias("n_bytes"),
        F.xxhash64(text).alias("check"),
    )


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "largest") -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256, text_hash.

    Ids are dealt into 8**3 runs. A run is reduced to one entry per digest, sorted by it; in each
    round eight neighbouring runs merge, every level keeping the smallest (or largest) id and the
    number of rows per digest, until one run is left. An entry is a digest verified by byte length
    and a second hash; entries that differ in any of them never merge. The result of a group goes
    back through the first runs, so that a text in a third of all rows meets at most 512 entries in
    one merge and its rows are dealt over 512 keys on the way back.

    NULL text equals the empty text. NULL ids count in ``group_size`` but a NULL id is kept only if
    the group has no other. Rows that repeat an id and a text are one row: all kept or all dropped.
    """
    if keep not in ("largest", "smallest"):
        raise ValueError(f"keep must be largest or smallest, not {keep!r}")
    best = F.max if keep == "largest" else F.min
    runs = 1 << (FAN_IN_BITS * ROUNDS)
    run = F.pmod(F.xxhash64(F.col(id_col)), F.lit(runs)).cast("int")
    rows = _digests(docs, id_col, text_col, run)
    # The struct makes Spark merge by sorting: each run is in digest order.
    known = F.when(F.col("doc_id").isNotNull(), F.struct("doc_id"))
    first = rows.groupBy("run", *KEY).agg(best(known).alias("best"), F.count(F.lit(1)).alias("n"))
    level = first
    for _ in range(ROUNDS):
        level = level.groupBy(F.shiftright("run", FAN_IN_BITS).alias("run"), *KEY).agg(
            best("best").alias("best"), F.sum("n").alias("n")
        )
    groups = level.where("n > 1").select(*KEY, F.col("best.doc_id").alias("keep_id"), F.col("n").alias("group_size"))
    down = first.select("run", *KEY).join(groups, list(KEY))
    out = rows.alias("d").join(down.alias("g"), ["run", *KEY], "left")
    keep_id = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    return out.select(
        "doc_id",
        keep_id.alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("bigint").alias("group_size"),
        F.col("doc_id").eqNullSafe(keep_id).alias("kept"),
        "text_sha256",
        F.col("check").alias("text_hash"),
    )

