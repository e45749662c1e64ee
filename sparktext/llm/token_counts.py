"""Exact histogram of encoded lengths; suffix sums answer totals for every context limit."""

from __future__ import annotations

import base64
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparktext.llm.common import slices, stored

# Rows of the histogram that one window handles; blocks of it are offset by a second, small window.
BLOCK = 4096


@lru_cache(maxsize=4)
def _encoding(path: str, pattern: str) -> tiktoken.Encoding:
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("counts", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def _lengths(path: str, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding, seen = _encoding(path, pattern), Counter()
        for batch in slices(batches):
            for text in batch.column(0).to_pylist():
                seen[len(encoding.encode_ordinary(text))] += 1
        rows = [pa.array(list(seen), pa.int64()), pa.array(list(seen.values()), pa.int64())]
        yield pa.RecordBatch.from_arrays(rows, ["n_tokens", "docs"])

    return run


def length_histogram(docs: DataFrame, path: str, pattern: str, text_col: str = "text") -> DataFrame:
    """(n_tokens, docs): number of documents of each encoded length.

    ``path`` names a rank file and ``pattern`` the split pattern of a byte-level vocabulary; the file
    must be at that path on every executor. Each task counts its own documents first, so that at
    most one row per task and length is shuffled; the histogram is stored, as its readers would encode
    the texts anew. A NULL or empty text has length 0; a long text is encoded in one piece.
    """
    texts = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    counted = texts.mapInArrow(_lengths(path, pattern), "n_tokens bigint, docs bigint")
    return stored(counted.groupBy("n_tokens").agg(F.sum("docs").alias("docs")), "token-lengths")


def context_limits(histogram: DataFrame, length: str = "n_tokens", count: str = "docs") -> DataFrame:
    """Totals for every limit that is an encoded length, one row per length.

    Columns: n_tokens, docs, docs_above (longer documents), tokens_above (their tokens),
    docs_upto, tokens_upto, truncated_tokens (tokens left when every document is cut to n_tokens),
    share_upto (the length is the quantile of any share in (share of the row before, this one]).
    Limits between two lengths follow from the row below: truncated tokens grow by ``docs_above``
    per token. Sums over blocks of lengths are added to sums inside a block, so no task sorts the
    whole histogram. An empty histogram gives an empty table.
    """
    rows = histogram.select(F.col(length).alias("n_tokens"), F.col(count).alias("docs"))
    rows = rows.withColumn("block", F.floor(F.col("n_tokens") / BLOCK)).withColumn("tokens", F.col("n_tokens") * F.col("docs"))
    blocks = rows.groupBy("block").agg(F.sum("docs").alias("block_docs"), F.sum("tokens").alias("block_tokens"))
    after = W.orderBy(F.col("block").desc()).rowsBetween(W.unboundedPreceding, -1)
    before = W.orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    offsets = blocks.select(
        "block",
        *[F.coalesce(F.sum(f"block_{c}").over(after), F.lit(0)).alias(f"{c}_after") for c in ("docs", "tokens")],
        *[F.coalesce(F.sum(f"block_{c}").over(before), F.lit(0)).alias(f"{c}_before") for c in ("docs", "tokens")],
    )
    above = W.partitionBy("block").orderBy(F.col("n_tokens").desc()).rowsBetween(W.unboundedPreceding, -1)
    upto = W.partitionBy("block").orderBy("n_tokens").rowsBetween(W.unboundedPreceding, W.currentRow)
    joined = rows.join(offsets, "block")
    sums = joined.select(
        "n_tokens",
        "docs",
        *[(F.coalesce(F.sum(c).over(above), F.lit(0)) + F.col(f"{c}_after")).alias(f"{c}_above") for c in ("docs", "tokens")],
        *[(F.sum(c).over(upto) + F.col(f"{c}_before")).alias(f"{c}_upto") for c in ("docs", "tokens")],
    )
    truncated = F.col("tokens_upto") + F.col("n_tokens") * F.col("docs_above")
    share = F.col("docs_upto") / (F.col("docs_upto") + F.col("docs_above"))
    return sums.select("*", truncated.alias("truncated_tokens"), share.alias("share_upto"))
