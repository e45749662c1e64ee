"""Optimal length buckets: least padding by dynamic programming, then batches under a token budget."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparktext.llm.bpe import vocabulary
from sparktext.llm.common import slices, stored

# Documents of one length that one task numbers; longer lists are cut into slices by id hash.
SLICE_ROWS = 50_000


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        counts = [len(text.encode().split()) + 1 for text in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_hash"), pa.array(counts, pa.int64())], ["doc_id", "text_hash", "n_tokens"])


def word_lengths(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, n_tokens) of identified documents: words between blanks plus one end token."""
    return docs.mapInArrow(_words, "doc_id bigint, text_hash bigint, n_tokens bigint")


def _tokens(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabulary(path)
        for batch in slices(batches):
            counts = [known.count(text) + 1 for text in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_hash"), pa.array(counts, pa.int64())], ["doc_id", "text_hash", "n_tokens"])

    return run


def token_lengths(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, text_hash, n_tokens) of identified documents: encoded tokens plus one end token.

    ``path`` names a vocabulary's JSON file, as in ``bpe.encode``.
    """
    return docs.mapInArrow(_tokens(path), "doc_id bigint, text_hash bigint, n_tokens bigint")


def best_boundaries(lengths: np.ndarray, counts: np.ndarray, buckets: int) -> list[int]:
    """Upper lengths of at most ``buckets`` buckets with the least padding in all.

    ``lengths`` ascend. Padding of lengths i+1..j in one bucket is L[j]*(C[j]-C[i]) - (S[j]-S[i]) with
    running counts C and tokens S. The best last cut does not move left as j grows, so each layer is
    filled by halving: the middle column is searched, its cut bounds both halves. All columns of one
    depth are searched together.
    """
    n = len(lengths)
    if n == 0:
        return []
    count = np.concatenate([[0], np.cumsum(counts)]).astype(np.float64)
    total = np.concatenate([[0], np.cumsum(lengths * counts)]).astype(np.float64)
    size = np.asarray(lengths, np.float64)
    best = np.full(n + 1, np.inf)
    best[0] = 0.0
    cuts = []
    for _ in range(min(buckets, n)):
        layer, cut = np.full(n + 1, np.inf), np.zeros(n + 1, np.int64)
        spans = [(1, n, 0, n - 1)]
        while spans:
            low, high, left, right = spans.pop()
            if low > high:
                continue
            mid = (low + high) // 2
            i = np.arange(left, min(mid - 1, right) + 1)
            cost = best[i] + size[mid - 1] * (count[mid] - count[i]) - (total[mid] - total[i])
            at = int(np.argmin(cost))
            layer[mid], cut[mid] = cost[at], i[at]
            spans += [(low, mid - 1, left, int(i[at])), (mid + 1, high, int(i[at]), right)]
        layer[0] = 0.0
        cuts.append(cut)
        best = layer
    ends, j = [], n
    for cut in reversed(cuts):
        if j == 0:
            break
        ends.append(int(lengths[j - 1]))
        j = int(cut[j])
    return sorted(ends)


def pack(lengths: DataFrame, buckets: int = 16, token_budget: int = 65_536, length_col: str = "n_tokens") -> DataFrame:
    """``lengths`` (doc_id, text_hash, length) with bucket, bucket_length, padding, batch and slot.

    Bucket boundaries minimise the padding of the whole table: the histogram of lengths goes to the
    driver (distinct lengths d need at least d*d/2 tokens, so a corpus of 10**13 tokens has at most
    4.5 million and in practice far fewer), and dynamic programming picks the boundaries. Inside a
    bucket documents are ordered by length and id; each run of floor(token_budget / bucket_length)
    of them, at least one, is a batch, so a padded batch holds at most ``token_budget`` tokens unless
    one document is longer. Only the last batch of a bucket may be smaller.

    Rows are numbered inside slices of one length and shifted by the sizes of earlier slices, so a
    length shared by a third of all documents is numbered by many tasks. Rows with a NULL length have
    NULL results; rows that repeat an id and a text take one slot each. An empty table gives one.
    """
    rows = stored(lengths.withColumnRenamed(length_col, "n_tokens"), "lengths")
    histogram = rows.where("n_tokens IS NOT NULL").groupBy("n_tokens").agg(F.count(F.lit(1)).alias("docs")).orderBy("n_tokens").toPandas()
    ends = best_boundaries(histogram["n_tokens"].to_numpy(np.int64), histogram["docs"].to_numpy(np.int64), buckets)
    bounds = F.array(*[F.lit(e).cast("bigint") for e in ends]) if ends else F.array().cast("array<bigint>")
    slices = {int(n): -(-int(c) // SLICE_ROWS) for n, c in zip(histogram["n_tokens"], histogram["docs"], strict=True) if c > SLICE_ROWS}
    parts = F.lit(1)
    if slices:  # at most rows / SLICE_ROWS lengths
        table = F.create_map(*[F.lit(x).cast("bigint") for pair in slices.items() for x in pair])
        parts = F.coalesce(F.get(F.map_values(F.map_filter(table, lambda k, _v: k == F.col("n_tokens"))), F.lit(0)), F.lit(1))
    at = F.size(F.filter(bounds, lambda b: b < F.col("n_tokens")))
    placed = rows.where("n_tokens IS NOT NULL").select(
        "*",
        at.cast("int").alias("bucket"),
        F.get(bounds, at).alias("bucket_length"),
        F.pmod(F.xxhash64("doc_id", "text_hash"), parts).alias("_slice"),
    )
    sizes = placed.groupBy("bucket", "n_tokens", "_slice").agg(F.count(F.lit(1)).alias("_rows"))
    along = W.partitionBy("bucket").orderBy("n_tokens", "_slice").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select("bucket", "n_tokens", "_slice", F.coalesce(F.sum("_rows").over(along), F.lit(0)).alias("_before"))
    inside = W.partitionBy("n_tokens", "_slice", "bucket").orderBy("doc_id", "text_hash")
    numbered = placed.withColumn("_number", F.row_number().over(inside)).join(offsets, ["bucket", "n_tokens", "_slice"])
    number = F.col("_before") + F.col("_number") - 1
    room = F.greatest(F.lit(1), F.floor(F.lit(token_budget) / F.greatest(F.col("bucket_length"), F.lit(1)))).cast("bigint")
    packed = numbered.select(
        *[F.col(c) for c in rows.columns],
        "bucket",
        "bucket_length",
        (F.col("bucket_length") - F.col("n_tokens")).alias("padding"),
        F.floor(number / room).cast("bigint").alias("batch"),
        F.pmod(number, room).cast("bigint").alias("slot"),
    )
    missing = rows.where("n_tokens IS NULL").select(
        "*", *[F.lit(None).cast(t).alias(c) for c, t in (("bucket", "int"), ("bucket_length", "bigint"), ("padding", "bigint"), ("batch", "bigint"), ("slot", "bigint"))]
    )
    return packed.unionByName(missing)
