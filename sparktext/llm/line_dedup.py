"""Lines that recur across documents, found by a range-partitioned, sorted stream of line hashes."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparktext.llm.common import identified, same_document, stored

BLANKS = b" \t\n\v\f\r"
LINE = "h1 bigint, h2 bigint, doc_id bigint, text_hash bigint, pos int"
FOUND = f"kind int, {LINE}, part int, docs bigint, leads boolean"
DROPPED, PENDING, SUMMARY = 0, 1, 2


def line_keys(text: str) -> list[bytes]:
    """Keys of the lines of a text: blanks stripped at both ends, A-Z lower-cased."""
    return [line.strip(BLANKS) for line in text.encode().lower().split(b"\n")]


def _lines(min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, hashes = batch.column("doc_id"), batch.column("text_hash")
            digests, rows, places = [], [], []
            for row, text in enumerate(batch.column("text").to_pylist()):
                for pos, key in enumerate(line_keys(text)):
                    if len(key) >= min_chars and (min_chars < 2 or len(key.decode()) >= min_chars):
                        digests.append(xxhash.xxh3_128_digest(key))
                        rows.append(row)
                        places.append(pos)
            both = np.frombuffer(b"".join(digests), ">i8").astype("i8").reshape(-1, 2)
            taken = pa.array(rows, pa.int64())
            columns = [pa.array(both[:, 0]), pa.array(both[:, 1]), ids.take(taken), hashes.take(taken), pa.array(places, pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, ["h1", "h2", "doc_id", "text_hash", "pos"])

    return run


def _stream(min_docs: int, keep_first: bool):
    """Follow the sorted rows of one range; runs at its two ends may go on in the neighbours."""

    def found(kind: int, rows: pa.Table, docs: int, part: int, leads=None) -> pa.RecordBatch:
        n = len(rows)
        columns = [pa.array(np.full(n, kind, "i4")), *[rows[c].combine_chunks() for c in ("h1", "h2", "doc_id", "text_hash", "pos")]]
        columns += [pa.array(np.full(n, part, "i4")), pa.array(np.full(n, docs, "i8")), pa.array(np.zeros(n, bool) if leads is None else leads)]
        return pa.RecordBatch.from_arrays([c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in columns], ["kind", "h1", "h2", "doc_id", "text_hash", "pos", "part", "docs", "leads"])

    def edge(rows: pa.Table, part: int):
        docs = _documents(rows)
        leads = np.zeros(len(rows), bool)
        leads[0] = True
        yield found(PENDING, rows, docs, part, leads)
        yield found(SUMMARY, rows.slice(0, 1), docs, part)

    def inner(rows: pa.Table, part: int):
        """Whole runs: (starts of runs, numbers of documents) by comparing neighbours."""
        run, doc = _changes(rows)
        starts = np.flatnonzero(run)
        docs = np.add.reduceat(doc.astype("i8"), starts)
        drop = np.repeat(docs >= min_docs, np.diff(np.append(starts, len(rows))))
        if keep_first:
            drop &= ~run
        if drop.any():
            yield found(DROPPED, rows.filter(pa.array(drop)), 0, part)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, first, open_run = TaskContext.get().partitionId(), True, None
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches([batch])
            if open_run is not None:
                rows = pa.concat_tables([open_run, rows]).combine_chunks()
            starts = np.flatnonzero(_changes(rows)[0])
            last = int(starts[-1])
            open_run, whole = rows.slice(last), rows.slice(0, last)
            if len(whole) and first:
                end = int(starts[1])
                yield from edge(whole.slice(0, end), part)
                whole, first = whole.slice(end), False
            if len(whole):
                yield from inner(whole, part)
        if open_run is not None:
            yield from edge(open_run, part)

    return run


def _changes(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Where a new key and where a new (key, document) begins."""
    n = len(rows)
    run, doc = np.ones(n, bool), np.ones(n, bool)
    ids = rows["doc_id"].combine_chunks()
    values = [rows[c].to_numpy() for c in ("h1", "h2", "text_hash")]
    values += [ids.fill_null(0).to_numpy(zero_copy_only=False), np.asarray(ids.is_null())]
    run[1:] = (values[0][1:] != values[0][:-1]) | (values[1][1:] != values[1][:-1])
    doc[1:] = run[1:]
    for v in values[2:]:
        doc[1:] |= v[1:] != v[:-1]
    return run, doc


def _documents(rows: pa.Table) -> int:
    return int(_changes(rows)[1].sum())


def _bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        dropped = [sorted(set(p)) for p in batch.column("dropped").to_pylist()]
        maps = []
        for places in dropped:
            keep = np.ones(places[-1] // 8 * 8 + 8, bool)
            keep[places] = False
            maps.append(zlib.compress(np.packbits(keep).tobytes()))
        columns = [batch.column("doc_id"), batch.column("text_hash"), pa.array([len(p) for p in dropped], pa.int64()), pa.array(maps, pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "text_hash", "n_dropped", "keep_bitmap"])


def line_bitmaps(
    docs: DataFrame, min_docs: int = 10, min_chars: int = 1, keep: str = "none", id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(doc_id, text_hash, n_dropped, keep_bitmap) of the documents that lose lines.

    A line whose key has ``min_chars`` code points and is found in ``min_docs`` documents is
    dropped: everywhere, or with ``keep="first"`` everywhere but at its first place by document and
    position. Line hashes (128 bits) are range-partitioned by (hash, document), so that a line in a
    third of all documents is spread over many tasks, and sorted by document and position inside.
    Each task streams its range once; only the runs at its two ends wait for the document counts
    of the neighbours, a table of two rows per task. Bit i of the zlib-compressed bitmap is 0 if
    line i goes; lines after its end stay.

    A NULL text is one empty line; empty keys never go. Ids must be integers; rows that repeat an id
    and a text count as one document.
    """
    if keep not in ("none", "first"):
        raise ValueError(f"keep must be none or first, not {keep!r}")
    rows = identified(docs, id_col, text_col).mapInArrow(_lines(min_chars), LINE)
    order = ["h1", "h2", "doc_id", "text_hash"]
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order, "pos")
    found = stored(dealt.mapInArrow(_stream(min_docs, keep == "first"), FOUND), "line-runs")
    ends = found.where(F.col("kind") == SUMMARY).groupBy("h1", "h2").agg(F.sum("docs").alias("all_docs"), F.min("part").alias("first_part"))
    waiting = found.where(F.col("kind") == PENDING).join(F.broadcast(ends), ["h1", "h2"]).where(F.col("all_docs") >= min_docs)
    if keep == "first":
        waiting = waiting.where(~(F.col("leads") & (F.col("part") == F.col("first_part"))))
    place = ["doc_id", "text_hash", "pos"]
    dropped = found.where(F.col("kind") == DROPPED).select(*place).unionByName(waiting.select(*place))
    listed = dropped.groupBy("doc_id", "text_hash").agg(F.collect_list("pos").alias("dropped"))
    return listed.mapInArrow(_bitmaps, "doc_id bigint, text_hash bigint, n_dropped bigint, keep_bitmap binary")


def _kept_text(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, counts = [], []
        for text, bitmap in zip(batch.column("text").to_pylist(), batch.column("keep_bitmap").to_pylist(), strict=True):
            if bitmap is None:
                texts.append(text)
                counts.append(text.count("\n") + 1)
                continue
            lines = text.split("\n")
            keep = np.unpackbits(np.frombuffer(zlib.decompress(bitmap), "u1"))
            counts.append(len(lines))
            texts.append("\n".join(line for i, line in enumerate(lines) if i >= len(keep) or keep[i]))
        columns = [batch.column("doc_id"), pa.array(counts, pa.int64()), batch.column("n_dropped"), pa.array(texts, pa.string())]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_lines", "n_dropped", "kept_text"])


def keep_lines(docs: DataFrame, bitmaps: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept_text) of every document, as ``line_bitmaps`` decides.

    Bits after the bitmap's last line pad its last byte; they are ones and stand for kept lines.
    """
    own = identified(docs, id_col, text_col)
    joined = own.alias("d").join(bitmaps.hint("shuffle_hash").alias("b"), same_document("d", "b"), "left")
    wanted = joined.select("d.doc_id", "d.text", F.coalesce("b.n_dropped", F.lit(0)).cast("bigint").alias("n_dropped"), "b.keep_bitmap")
    return wanted.mapInArrow(_kept_text, "doc_id bigint, n_lines bigint, n_dropped bigint, kept_text string")
