"""Ranked lexical search as blocked dense matrix products.

Items are dealt to tiles with a compact vocabulary of their own. A slice of documents becomes, for each
tile, a dense matrix of term impacts; a BLAS product with the tile's weights gives all scores of the
slice. Weights and impacts are whole numbers held as float64: products and sums are exact while they
stay below 2**53, so a tile's vocabulary is cut where a sum could reach that, and the parts are added
as 64-bit integers. Each task keeps the best k documents of every item, ties by id.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparktext.llm.common import identified, slices, stored
from sparktext.llm.terms import TOGETHER, batch_terms

# Items of one tile, documents of one product, and bytes of item terms sent to the executors at once.
TILE_ITEMS = 64
TILE_DOCS = 512
ITEM_BYTES = 8 << 20
# Impacts stay below this: (1e9 * tf) div (1000 * tf + 8 * m) with m of 25 or more.
MOST_IMPACT = 1_000_000
EXACT = 1 << 53
COUNTED = "doc_ids array<bigint>, docs bigint, words bigint, lengths binary, rows binary, terms binary, times binary"
BEST = "item int, doc_id bigint, score bigint"


@dataclass
class Tile:
    """Items of a tile by number, their distinct terms as places in the block's vocabulary, and the number
    of times each item has each."""

    items: np.ndarray
    terms: np.ndarray
    times: np.ndarray


@dataclass
class Block:
    vocabulary: np.ndarray
    tiles: list[Tile]

    @classmethod
    def of(cls, items: list[tuple[int, bytes]], together: int = TILE_ITEMS) -> Block:
        words = [(i, np.frombuffer(blob, np.uint64)) for i, blob in items if blob]
        vocabulary = np.unique(np.concatenate([w for _, w in words])) if words else np.zeros(0, np.uint64)
        tiles = []
        for at in range(0, len(words), together):
            some = words[at : at + together]
            terms, of = np.unique(np.concatenate([w for _, w in some]), return_inverse=True)
            times = np.zeros((len(some), len(terms)))
            np.add.at(times, (np.repeat(np.arange(len(some)), [len(w) for _, w in some]), of.reshape(-1)), 1)
            tiles.append(Tile(np.array([i for i, _ in some], "i4"), np.searchsorted(vocabulary, terms), times))
        return cls(vocabulary, tiles)


def _count(vocabulary: np.ndarray):
    """A row per slice of texts: their numbers of terms, and how often each has the vocabulary's terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, most=TOGETHER):
            terms, firsts = batch_terms(batch.column("text"))
            lengths = np.diff(firsts)
            at = np.searchsorted(vocabulary, terms)
            known = np.flatnonzero(vocabulary[np.minimum(at, len(vocabulary) - 1)] == terms)
            doc = np.repeat(np.arange(len(lengths)), lengths)[known]
            pair, times = np.unique(doc * len(vocabulary) + at[known], return_counts=True)
            blobs = [lengths.astype("i8"), (pair // len(vocabulary)).astype("i4"), (pair % len(vocabulary)).astype("i4"), times.astype("i4")]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([batch.column("doc_id").to_pylist()], pa.list_(pa.int64())),
                    pa.array([int((lengths > 0).sum())], pa.int64()),
                    pa.array([int(lengths.sum())], pa.int64()),
                    *[pa.array([b.tobytes()], pa.binary()) for b in blobs],
                ],
                ["doc_ids", "docs", "words", "lengths", "rows", "terms", "times"],
            )

    return run


def _document_frequencies(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in slices(batches, "terms"):
            for blob in batch.column("terms"):
                total += np.bincount(np.frombuffer(blob.as_py(), "i4"), minlength=size)
        met = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(met), pa.array(total[met])], ["term", "df"])

    return run


def impacts(times: np.ndarray, lengths: np.ndarray, docs: int, words: int) -> np.ndarray:
    """(1e9 * tf) div (1000 * tf + 8 * m), m = 100 - 75 + (75 * n * docs) div words."""
    if 75 * int(lengths.max(initial=0)) * docs < 1 << 63:
        relative = 75 * lengths * docs // words
    else:  # beyond 64 bits before the division
        relative = np.array([75 * int(n) * docs // words for n in lengths], np.int64)
    return 1_000_000_000 * times // (1000 * times + 8 * (25 + relative))


def exact_parts(weights: np.ndarray) -> list[slice]:
    """Cuts of a tile's vocabulary inside which no item's sum of weights times impacts reaches 2**53."""
    upto = np.cumsum(weights, axis=1)
    parts, at = [], 0
    while at < weights.shape[1]:
        before = upto[:, at - 1] if at else np.zeros(len(weights))
        full = ((upto - before[:, None]).max(0) * MOST_IMPACT >= EXACT) & (np.arange(weights.shape[1]) >= at)
        end = int(np.argmax(full)) if full.any() else weights.shape[1]
        if end == at:
            raise ValueError("one term's weight alone exceeds exact arithmetic")
        parts.append(slice(at, end))
        at = end
    return parts


class Best:
    """The k best documents of each item so far: highest score, then smallest id, a NULL id last."""

    def __init__(self, items: int, k: int):
        self.k, self.least = k, np.ones(items, np.int64)
        self.rows = [np.zeros(0, t) for t in ("i4", "i8", bool, "i8")]

    def add(self, item: np.ndarray, doc: np.ndarray, no_id: np.ndarray, score: np.ndarray) -> None:
        """Every score of ``least`` or more, ties with the k-th included, has to be offered."""
        item, doc, no_id, score = (np.concatenate(x) for x in zip(self.rows, (item, doc, no_id, score), strict=True))
        order = np.lexsort((doc, no_id, -score, item))
        item, doc, no_id, score = item[order], doc[order], no_id[order], score[order]
        first = np.searchsorted(item, item)
        kept = np.arange(len(item)) - first < self.k
        self.rows = [x[kept] for x in (item, doc, no_id, score)]
        last = np.flatnonzero(np.arange(len(item)) - first == self.k - 1)
        self.least[item[last]] = score[last]


def _search(block: Block, weights: np.ndarray, docs: int, words: int, items: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(items, k)
        places, left = [], []
        for tile in block.tiles:
            own = np.full(len(block.vocabulary), -1, np.int64)
            own[tile.terms] = np.arange(len(tile.terms))
            places.append(own)
            weighted = tile.times * weights[tile.terms]
            left.append((weighted, exact_parts(weighted)))
        for batch in slices(batches, "terms"):
            for i in range(batch.num_rows):
                ids = batch.column("doc_ids")[i].values
                no_id = ids.is_null().to_numpy(zero_copy_only=False)
                id_of = ids.fill_null(0).to_numpy()
                lengths, row, term, times = (np.frombuffer(batch.column(c)[i].as_py(), t).astype(np.int64) for c, t in (("lengths", "i8"), ("rows", "i4"), ("terms", "i4"), ("times", "i4")))
                impact = impacts(times, lengths[row], docs, words).astype(np.float64)
                for low in range(0, len(id_of), TILE_DOCS):
                    cut = slice(*np.searchsorted(row, [low, low + TILE_DOCS]))
                    here = slice(low, low + TILE_DOCS)
                    for tile, own, (weighted, parts) in zip(block.tiles, places, left, strict=True):
                        at = own[term[cut]]
                        met = at >= 0
                        dense = np.zeros((len(tile.terms), len(id_of[here])))
                        dense[at[met], row[cut][met] - low] = impact[cut][met]
                        score = sum((weighted[:, p] @ dense[p]).astype(np.int64) for p in parts)
                        y, x = np.nonzero(score >= best.least[tile.items][:, None])
                        if len(y):
                            best.add(tile.items[y], id_of[here][x], no_id[here][x], score[y, x])
        item, doc, no_id, score = best.rows
        yield pa.RecordBatch.from_arrays([pa.array(item), pa.array(doc, mask=no_id), pa.array(score)], ["item", "doc_id", "score"])

    return run


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, most=TOGETHER):
        terms, firsts = batch_terms(batch.column("text"))
        blobs = [terms[i:j].tobytes() for i, j in zip(firsts[:-1], firsts[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("item_id"), pa.array(blobs, pa.binary())], ["item_id", "terms"])


def top_documents(docs: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", item_bytes: int = ITEM_BYTES) -> DataFrame:
    """item_id, rank (from 1), doc_id, score: the ``k`` best documents of every item with a score above 0.

    Terms are longest runs of digits, letters and characters beyond ASCII, A-Z lower-cased, compared by
    64-bit hashes. With N documents that have terms, L their terms, n those of one document, df the documents
    with a term and tf its occurrences in one: weight w = floor(1000 * ln((2N + 2) / (2df + 1))), m = 25 +
    (75 * n * N) div L, and a document scores the sum of w * ((1e9 * tf) div (1000 * tf + 8 * m)) over
    the item's terms, repeats included. Equal scores rank by ascending id, NULL ids last.

    Every row of ``items`` is an item, repeated ids included; one without terms, or without a term that
    any document has, has no rows. A NULL text has no terms; a repeated document ranks as often as it is there. A
    long text is counted in one task. Items beyond ``item_bytes`` are searched a block at a time.
    """
    own = identified(docs, id_col, text_col)
    asked = items.select(F.col(item_col).alias("item_id"), F.coalesce(F.col(item_text_col), F.lit("")).alias("text"))
    kind = dict(asked.dtypes)["item_id"]
    asked = stored(asked.mapInArrow(_item_terms, f"item_id {kind}, terms binary"), "search-items").where(F.octet_length("terms") > 0)
    total = asked.agg(F.sum(F.octet_length("terms") + 64)).first()[0] or 0
    blocks = -(-total // item_bytes) or 1
    out = None
    for number in range(blocks):
        mine = asked.where(F.pmod(F.xxhash64("item_id", "terms"), F.lit(blocks)) == number).collect()
        found = _best_of(own, [(i, bytes(r["terms"])) for i, r in enumerate(mine)], k)
        names = docs.sparkSession.createDataFrame([(i, r["item_id"]) for i, r in enumerate(mine)], f"item int, item_id {kind}")
        named = found.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")
        named = stored(named, "search-block") if blocks > 1 else named
        out = named if out is None else out.unionByName(named)
    return out


def _best_of(own: DataFrame, items: list[tuple[int, bytes]], k: int) -> DataFrame:
    block = Block.of(items)
    size = len(block.vocabulary)
    if not size:
        return own.sparkSession.createDataFrame([], "item int, rank int, doc_id bigint, score bigint")
    counted = stored(own.mapInArrow(_count(block.vocabulary), COUNTED), "term-counts")
    sums = counted.agg(F.sum("docs").alias("docs"), F.sum("words").alias("words")).first()
    n, words = sums["docs"] or 0, sums["words"] or 0
    if not words:
        return own.sparkSession.createDataFrame([], "item int, rank int, doc_id bigint, score bigint")
    df = counted.select("terms").mapInArrow(_document_frequencies(size), "term bigint, df bigint").groupBy("term").agg(F.sum("df").alias("df")).collect()
    weights = np.full(size, math.floor(1000 * math.log(2 * n + 2)), np.float64)
    for row in df:
        weights[row["term"]] = math.floor(1000 * math.log((2 * n + 2) / (2 * row["df"] + 1)))
    found = counted.select("doc_ids", "lengths", "rows", "terms", "times").mapInArrow(_search(block, weights, n, words, len(items), k), BEST)
    order = W.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
