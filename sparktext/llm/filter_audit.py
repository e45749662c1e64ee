"""What each of several filters removes, alone, after others, and in every order.

Rows are counted into cells by the set of filters they fail, a mask. All 2**k subsets of k filters are
then visited in Gray-code order: each move switches one filter on or off, changes the number of active
failures of the cells with that bit, and moves the cells whose number leaves or reaches zero out of or
back into the survivors. What a filter removes after others is the difference of two states.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparktext.functions.text import let
from sparktext.llm.common import stored

# All orders of the filters are listed: eight have 40,320.
MOST_FILTERS = 8
STEPS = "part string, filter_order string, step int, kept bigint, removed bigint, redundant bigint, unique_fails bigint, good_lost bigint, toxic_lost bigint, shapley bigint"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def walk(cells: np.ndarray) -> np.ndarray:
    """Sums of the surviving cells for every subset of filters.

    ``cells`` (2**k, m): counts by mask. Row s of the result: the cells that fail none of the filters in s.
    """
    masks = np.arange(len(cells))
    failures = np.zeros(len(cells), np.int64)
    states = np.zeros_like(cells)
    survivors = cells.sum(0)
    states[0] = survivors
    subset = 0
    for move in range(1, len(cells)):
        bit = move & -move  # the bit that a Gray code changes at this move
        subset ^= bit
        touched = (masks & bit) > 0
        if subset & bit:
            failures[touched] += 1
            survivors = survivors - cells[touched & (failures == 1)].sum(0)
        else:
            failures[touched] -= 1
            survivors = survivors + cells[touched & (failures == 0)].sum(0)
        states[subset] = survivors
    return states


def steps(cells: np.ndarray, names: Sequence[str]) -> Iterator[tuple]:
    """(order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) for all orders.

    The columns of ``cells`` are rows, good rows and toxic rows.
    """
    states = walk(cells)
    fails = [int(states[0, 0] - states[1 << f, 0]) for f in range(len(names))]
    orders = list(permutations(range(len(names))))
    moves = []
    shapley = [0] * len(names)
    for order in orders:
        subset = 0
        for step, f in enumerate(order, 1):
            lost = states[subset] - states[subset | 1 << f]
            subset |= 1 << f
            shapley[f] += int(lost[0])
            moves.append((order, step, f, int(states[subset, 0]), lost.tolist()))
    for order, step, f, kept, (removed, good, toxic) in moves:
        yield "".join(names[i] for i in order), step, kept, removed, fails[f] - removed, int(cells[1 << f, 0]), good, toxic, shapley[f]


def _audit(names: Sequence[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), pa.string(), pa.int32(), *[pa.int64()] * 7]
        labels = [c.split()[0] for c in STEPS.split(", ")]
        for batch in batches:
            for part, listed in zip(*[batch.column(c).to_pylist() for c in ("part", "cells")], strict=True):
                cells = np.zeros((1 << len(names), 3), np.int64)
                for c in listed:
                    cells[c["mask"]] += (c["n"], c["good"], c["toxic"])
                columns = zip(*[(part, *row) for row in steps(cells, names)], strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], labels)

    return run


def audit_orders(cells: DataFrame, names: Sequence[str]) -> DataFrame:
    """What every filter removes at every step of every order, per part.

    ``cells``: part, mask (bit i: the row fails filter i of ``names``), n, good, toxic; they may repeat.
    Columns: part, filter_order, step (from 1), kept (after the step), removed (in it), redundant (failing
    the step's filter but removed before), unique_fails (failing that filter alone), good_lost, toxic_lost
    (of the removed), shapley (removed by the filter at its step, summed over all orders). A part has at
    most 2**k cells; a table without rows gives none.
    """
    if len(names) > MOST_FILTERS:
        raise ValueError(f"at most {MOST_FILTERS} filters; given {len(names)}")
    summed = cells.groupBy("part", "mask").agg(*[F.sum(c).cast("bigint").alias(c) for c in ("n", "good", "toxic")])
    listed = summed.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))
    return listed.mapInArrow(_audit(names), STEPS)


def text_failures(text: Column) -> Column:
    """Mask of the four conditions on a text alone: few words (1), few distinct words (2), capitals (4), signs (8)."""
    words = F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    counts = let(words, lambda w: F.struct(F.size(w).alias("n"), F.size(F.array_distinct(w)).alias("distinct")))
    few = let(counts, lambda c: (c["n"] < 50).cast("int") + F.when(100 * c["distinct"] < 65 * c["n"], 2).otherwise(0))
    length = F.char_length(text)
    capitals = length - F.char_length(F.translate(text, UPPER, ""))
    return few + F.when(100 * capitals > 5 * length, 4).otherwise(0) + F.when(text.rlike(r"[#$%&*|]"), 8).otherwise(0)


def document_cells(docs: DataFrame, labels: DataFrame, part_col: str = "source", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(part, mask, n, good, toxic): documents counted by the failures of ``text_failures`` and, as bit 16,
    by being a copy of a text with a smaller id anywhere in the table.

    A NULL text is empty, a NULL part the empty string. A row without an id is never a copy, has no
    labels, and makes no other a copy; rows that repeat an id and a text are copies only if a smaller id has
    the text. Of several labels of one id, any that says 1 counts. A long text is one value in one task.

    Copies share a mask, so a text is counted per (part, labels) before it is shuffled: of each count,
    the rows with the smallest id are told apart, and they stay unless another part has a smaller one.
    """
    own = docs.select(
        F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), F.coalesce(F.col(text_col), F.lit("")).alias("text")
    )
    marked = own.select("doc_id", "part", F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("digest"), text_failures(F.col("text")).alias("mask"))
    no_id = F.col("doc_id").isNull()
    # Rows without an id are spread by their digest; the flag keeps them from meeting a label.
    marked = marked.withColumn("_key", F.coalesce("doc_id", F.xxhash64("digest"))).withColumn("_named", ~no_id)
    known = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("bigint").alias("_key")).agg(
        F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic")
    )
    joined = marked.join(known.withColumn("_named", F.lit(True)), ["_key", "_named"], "left")
    kinds = ["digest", "part", "mask", "good", "toxic"]
    labelled = joined.select("_key", "_named", "doc_id", "digest", "part", "mask", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("good", "toxic")])
    by_id = labelled.groupBy("_key", "_named", "doc_id", *kinds).agg(F.count(F.lit(1)).alias("k"))
    least = F.min(F.when(~no_id, F.struct(F.col("doc_id").alias("id"), F.col("k").alias("k"))))
    counted = by_id.groupBy(*kinds).agg(F.sum("k").alias("n"), F.sum(F.when(no_id, F.col("k")).otherwise(0)).alias("free"), least.alias("least"))
    by_kind = stored(counted, "texts-by-part")  # read twice; the texts are not
    first = by_kind.groupBy("digest").agg(F.min("least.id").alias("first_id"))
    placed = by_kind.join(first, "digest")
    stay = F.col("free") + F.when(F.col("least.id") == F.col("first_id"), F.col("least.k")).otherwise(0)
    split = F.array(F.struct(F.col("mask").alias("mask"), stay.alias("n")), F.struct((F.col("mask") + 16).alias("mask"), (F.col("n") - stay).alias("n")))
    cells = placed.select("part", "good", "toxic", F.explode(split).alias("c")).select("part", "c.mask", "c.n", *[(F.col(c) * F.col("c.n")).alias(c) for c in ("good", "toxic")])
    return cells.groupBy("part", "mask").agg(*[F.sum(c).alias(c) for c in ("n", "good", "toxic")])
