"""Benchmark contamination by a positional inverted index of the training documents.

The index is partitioned by document: a segment holds the postings of about one megabyte of whole
texts, sorted by term and place, so every list that an intersection needs lies in one row and no
term, however common, gathers its postings in one task. Windows of the test items are looked up
rarest term first: its places, moved back by its offset in the window, are the possible starts; each
further list, moved by its own offset, strikes out starts until the most common term is left.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparktext.llm.common import identified, slices, stored
from sparktext.llm.terms import TOGETHER, batch_terms

# Bytes of item terms that are sent to the executors at once; more items take another pass.
ITEM_BYTES = 16 << 20
INDEX = "segment string, doc_ids array<bigint>, text_hashes array<bigint>, firsts binary, terms binary, counts binary, places binary"
HITS = "array<struct<item_id:string, first:array<int>, length:int>>"
FOUND = f"segment string, row int, doc_id bigint, text_hash bigint, n_words bigint, hits {HITS}"


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, most=TOGETHER):
        terms, firsts = batch_terms(batch.column("text"))
        order = np.argsort(terms, kind="stable")
        own = terms[order]
        start = np.flatnonzero(np.append(True, own[1:] != own[:-1])) if len(own) else np.zeros(0, np.int64)
        counts = np.diff(np.append(start, len(own))).astype("i4")
        blobs = [x.tobytes() for x in (firsts.astype("i8"), own[start], counts, order.astype("i4"))]
        ids = [pa.array([batch.column(c).to_pylist()], pa.list_(pa.int64())) for c in ("doc_id", "text_hash")]
        yield pa.RecordBatch.from_arrays(
            [pa.array([uuid.uuid4().hex]), *ids, *[pa.array([b], pa.binary()) for b in blobs]],
            ["segment", "doc_ids", "text_hashes", "firsts", "terms", "counts", "places"],
        )


def index_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The positional index of whole texts, written to the shared folder: a row per segment.

    A segment holds texts of about one megabyte together, or one longer text; places count its terms.
    A NULL or empty text has no terms but is listed; repeated rows are listed each; no rows, no segments.
    """
    return stored(identified(docs, id_col, text_col).mapInArrow(_index, INDEX), "positional-index")


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, most=TOGETHER):
        terms, firsts = batch_terms(batch.column("text"))
        blobs = [terms[i:j].tobytes() for i, j in zip(firsts[:-1], firsts[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("item_id"), pa.array(blobs, pa.binary())], ["item_id", "terms"])


@dataclass
class Windows:
    """Distinct windows of a block of items as rows of term numbers, padded with -1, and the items of each."""

    terms: np.ndarray
    slots: np.ndarray
    length: np.ndarray
    first_owner: np.ndarray
    owners: np.ndarray
    item_ids: list[str]

    @classmethod
    def of(cls, items: list[tuple[str, bytes]], size: int) -> Windows:
        ids = sorted({i for i, _ in items})
        number = {x: i for i, x in enumerate(ids)}
        rows, owner = [np.zeros((0, size), np.uint64)], [np.zeros(0, np.int64)]
        lengths = [np.zeros(0, np.int64)]
        for item, blob in items:
            words = np.frombuffer(blob, np.uint64)
            if not len(words):
                continue
            wide = min(size, len(words))
            block = np.zeros((len(words) - wide + 1, size), np.uint64)
            block[:, :wide] = np.lib.stride_tricks.sliding_window_view(words, wide)
            rows.append(block)
            owner.append(np.full(len(block), number[item]))
            lengths.append(np.full(len(block), wide))
        every, owner, lengths = np.concatenate(rows), np.concatenate(owner), np.concatenate(lengths)
        used = np.arange(size) < lengths[:, None]
        terms = np.unique(every[used])
        slots = np.where(used, np.searchsorted(terms, every), -1).astype(np.int64)
        distinct, of = np.unique(slots, axis=0, return_inverse=True)
        pairs = np.unique(np.column_stack([of.reshape(-1), owner]), axis=0)
        first = np.searchsorted(pairs[:, 0], np.arange(len(distinct) + 1))
        return cls(terms, distinct, (distinct >= 0).sum(1), first, pairs[:, 1], ids)


def segment_matches(w: Windows, firsts: np.ndarray, terms: np.ndarray, counts: np.ndarray, places: np.ndarray, slack: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(window, text, start) of all places in a segment where a window stands.

    Term i of a window may stand up to ``slack`` places before or after place start + i; all its
    places, from start to start + length - 1 without slack, lie in one text.
    """
    none = tuple(np.zeros(0, np.int64) for _ in range(3))
    if not len(terms) or not len(w.terms):
        return none
    n = len(places)
    begin = np.concatenate([[0], np.cumsum(counts)])
    at = np.minimum(np.searchsorted(terms, w.terms), len(terms) - 1)
    times = np.where(terms[at] == w.terms, counts[at], 0)
    frequency = np.where(w.slots >= 0, times[w.slots], n + 1)
    live = np.flatnonzero(frequency.min(1, initial=n + 1) > 0)
    if not len(live):
        return none
    order = np.argsort(frequency[live], axis=1, kind="stable")  # padding comes last
    window, slots = live, w.slots[live]
    rarest = order[:, 0]
    term = at[slots[np.arange(len(live)), rarest]]
    many = counts[term].astype(np.int64)
    row = np.repeat(np.arange(len(live)), many)
    which = np.repeat(begin[term] - np.cumsum(many) + many, many) + np.arange(many.sum())
    start = places[which].astype(np.int64) - rarest[row]
    if slack:
        start = (start[:, None] + np.arange(-slack, slack + 1)).reshape(-1)
        row = np.repeat(row, 2 * slack + 1)
    text = np.searchsorted(firsts, start, "right") - 1
    length = w.length[window]
    fits = (start >= 0) & (text < len(firsts) - 1) & (start + length[row] <= firsts[np.minimum(text + 1, len(firsts) - 1)])
    row, start, text = row[fits], start[fits], text[fits]
    listed = np.repeat(np.arange(len(terms)) * n, counts) + places  # all lists, one after the other
    for k in range(0 if slack else 1, w.slots.shape[1]):
        more = k < length[row]
        slot = order[row, k]
        base = at[slots[row, slot]] * n
        low = base + np.maximum(start + slot - slack, firsts[text])
        high = base + np.minimum(start + slot + slack, firsts[text + 1] - 1)
        near = np.searchsorted(listed, low)
        kept = ~more | ((near < n) & (listed[np.minimum(near, n - 1)] <= high))
        row, start, text = row[kept], start[kept], text[kept]
    found = np.unique(np.column_stack([window[row], text, start]), axis=0) if slack else np.column_stack([window[row], text, start])
    return found[:, 0], found[:, 1], found[:, 2]


def _lookup(w: Windows, slack: int):
    def hits(firsts, window, text, start) -> list[list[dict]]:
        out: list[list[dict]] = [[] for _ in range(len(firsts) - 1)]
        many = w.first_owner[window + 1] - w.first_owner[window]
        at = np.repeat(np.arange(len(window)), many)
        owner = w.owners[np.repeat(w.first_owner[window] - np.cumsum(many) + many, many) + np.arange(many.sum())]
        length = w.length[window][at]
        text, start = text[at], start[at] - firsts[text[at]]
        order = np.lexsort((start, length, owner, text))
        text, start, owner, length = (x[order] for x in (text, start, owner, length))
        if not len(text):
            return out
        new = np.ones(len(text), bool)
        new[1:] = (text[1:] != text[:-1]) | (owner[1:] != owner[:-1]) | (length[1:] != length[:-1])
        for i, j in zip(np.flatnonzero(new), np.append(np.flatnonzero(new)[1:], len(text)), strict=True):
            out[text[i]].append({"item_id": w.item_ids[owner[i]], "first": np.unique(start[i:j]).tolist(), "length": int(length[i])})
        return out

    kind = pa.list_(pa.struct([("item_id", pa.string()), ("first", pa.list_(pa.int32())), ("length", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "places"):
            for i in range(batch.num_rows):
                firsts, terms, counts, places = (np.frombuffer(batch.column(c)[i].as_py(), t) for c, t in (("firsts", "i8"), ("terms", "u8"), ("counts", "i4"), ("places", "i4")))
                found = hits(firsts, *segment_matches(w, firsts, terms, counts, places, slack))
                rows = len(found)
                ids = [batch.column(c)[i].values for c in ("doc_ids", "text_hashes")]
                columns = [pa.array([batch.column("segment")[i].as_py()] * rows, pa.string()), pa.array(np.arange(rows, dtype="i4")), *ids, pa.array(np.diff(firsts)), pa.array(found, kind)]
                yield pa.RecordBatch.from_arrays(columns, ["segment", "row", "doc_id", "text_hash", "n_words", "hits"])

    return run


def match_items(index: DataFrame, items: DataFrame, window: int = 10, slack: int = 0, item_col: str = "item_id", text_col: str = "text", item_bytes: int = ITEM_BYTES) -> DataFrame:
    """doc_id, text_hash, n_words, hits: where windows of the items stand in each document.

    ``hits`` has an entry per item found: its id as a string, the first words of its windows in the
    document, and their length. A window is ``window`` consecutive words of an item, or all words of a
    shorter one; with ``slack`` each word may stand up to that many words off its place (proximity
    match), else the phrase is exact, up to 64-bit hashes of words. Items of one id count as one, a
    NULL id as an empty one; items without words have no window. A document without hits has an empty
    list; repeated rows are answered each.

    Item terms beyond ``item_bytes`` are looked up in several passes over the index, a block at a time.
    """
    own = items.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("item_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    terms = stored(own.mapInArrow(_item_terms, "item_id string, terms binary"), "item-terms")
    total = terms.agg(F.sum(F.octet_length("terms") + F.octet_length("item_id") + 16)).first()[0] or 0
    blocks = -(-total // item_bytes) or 1
    found = None
    for block in range(blocks):
        mine = terms.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block).collect()
        part = index.mapInArrow(_lookup(Windows.of([tuple(r) for r in mine], window), slack), FOUND)
        if blocks == 1:
            return part.drop("segment", "row")
        part = stored(part, "item-block")
        found = part if found is None else found.unionByName(part)
    ids = [F.first(c).alias(c) for c in ("doc_id", "text_hash", "n_words")]
    merged = found.groupBy("segment", "row").agg(*ids, F.flatten(F.collect_list("hits")).alias("hits"))
    return merged.drop("segment", "row")


def covered_words(hits: Column) -> Column:
    """Number of words of a document that lie inside any window of ``hits``."""
    spans = F.array_sort(F.flatten(F.transform(hits, lambda h: F.transform(h["first"], lambda s: F.struct(s.alias("start"), (s + h["length"]).alias("stop"))))))
    nothing = F.struct(F.lit(0).alias("upto"), F.lit(0).cast("bigint").alias("n"))

    def add(now: Column, span: Column) -> Column:
        fresh = F.greatest(F.lit(0), span["stop"] - F.greatest(now["upto"], span["start"]))
        return F.struct(F.greatest(now["upto"], span["stop"]).alias("upto"), (now["n"] + fresh).alias("n"))

    return F.aggregate(spans, nothing, add, lambda now: now["n"])


def item_ids(hits: Column) -> Column:
    """Distinct ids of the items found, sorted as strings."""
    return F.array_sort(F.array_distinct(F.transform(hits, lambda h: h["item_id"])))
