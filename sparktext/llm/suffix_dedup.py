"""Repeated byte strings across documents, by column-wise construction of their sorted suffixes.

Inserting one symbol per document and round into one Burrows-Wheeler transform of the whole corpus
takes as many passes over all data as the longest document has bytes. Here the rounds run inside
bounded collections that cannot miss a match: every ``length``-byte window is keyed by its smallest
32-byte gram (rightmost among equals), so equal windows meet under one key, at the same distance
from that gram. A segment is the stretch of neighbouring windows with one gram. The segments of a
key, aligned at the gram, are the documents of a collection: from the last column to the first,
each round inserts one symbol per segment, takes the next order of all suffixes from the column
read in the present order (the transform of that column) and carries the common prefix of
neighbours along. A window is repeated if it shares ``length`` bytes with a neighbour.

The symbols may also be words (``unit="words"``): windows, grams, segments and columns then count
words by their 64-bit hashes, and the bytes from the first to the last word of a run go.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparktext.llm.common import identified, same_document, slices, stored
from sparktext.llm.words import BASE, MIX, mixed, powers, unspaced_bounds, word_hashes

GRAM = 32
# Symbols of a gram, and the type of a symbol, by unit.
UNITS = {"bytes": (GRAM, np.uint8), "words": (8, np.uint64)}
# Segments built in one go, and of one key before it is refined.
TOGETHER = 4_000
KEY_SEGMENTS = 50_000
# Window starts per refined key: 2**5, then single windows.
LEVELS = (5, 0)
SEGMENTS = "gram bigint, doc_id bigint, text_hash bigint, firsts array<int>, lead int, width int, content bigint"
BYTES = "gram bigint, doc_id bigint, text_hash bigint, first int, lead int, width int, content bigint, whole boolean, bytes binary"
WINDOWS = "doc_id bigint, text_hash bigint, firsts array<int>, width int"


def _sums(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    up, down = powers(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[: len(raw)], out=sums[1:])
    return sums, down


def _hashes(sums: np.ndarray, down: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return mixed((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64) * MIX[0])


def symbols(text: str, unit: str) -> np.ndarray:
    raw = np.frombuffer(text.encode(), np.uint8)
    return raw if unit == "bytes" else word_hashes(raw, *unspaced_bounds(raw))


def segments(raw: np.ndarray, length: int, size: int = GRAM) -> tuple[np.ndarray, ...]:
    """(gram hash, first window, distance of the gram from it, number of windows, content hash).

    Windows are blocked by their number of grams; the smallest gram of a window is the smaller of
    a block's suffix minimum and the next block's prefix minimum. The low bits of a hash give way
    to its place in the block, so that equal grams rank by place.
    """
    windows = len(raw) - length + 1
    if windows < 1:
        return tuple(np.zeros(0, np.int64) for _ in range(5))
    span = length - size + 1
    bits = np.uint64(max(1, int(span - 1).bit_length()))
    sums, down = _sums(raw)
    n = len(raw) - size + 1
    grams = mixed((sums[size:] - sums[:n]) * down[:n])
    blocks = -(-n // span)
    ranked = np.full(blocks * span, np.iinfo(np.uint64).max, np.uint64)
    ranked[:n] = (grams >> bits << bits) | np.tile(np.arange(span - 1, -1, -1, dtype=np.uint64), blocks)[:n]
    ranked = ranked.reshape(blocks, span)
    left = np.minimum.accumulate(ranked[:, ::-1], axis=1)[:, ::-1].reshape(-1)[:windows]
    right = np.minimum.accumulate(ranked, axis=1).reshape(-1)[span - 1 : span - 1 + windows]
    at = np.arange(windows)
    take_right = (right >> bits) <= (left >> bits)
    low = (np.uint64(1) << bits) - np.uint64(1)
    block = np.where(take_right, (at + span - 1) // span, at // span)
    place = block * span + span - 1 - (np.where(take_right, right, left) & low).astype(np.int64)
    first = np.flatnonzero(np.append(True, place[1:] != place[:-1]))
    last = np.append(first[1:], windows)
    gram = place[first]
    content = _hashes(sums, down, first, last - 1 + length)
    return grams[gram].astype(np.int64), first, gram - first, last - first, content.astype(np.int64)


def _segments(length: int, unit: str):
    """A row per distinct segment of a document, with all places where it stands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows, found = [], []
            for row, text in enumerate(batch.column("text").to_pylist()):
                own = segments(symbols(text, unit), length, UNITS[unit][0])
                if len(own[0]):
                    rows.append(np.full(len(own[0]), row))
                    found.append(own)
            if found:
                gram, first, lead, width, content = (np.concatenate(x) for x in zip(*found, strict=True))
                row = np.concatenate(rows)
                order = np.lexsort((first, content, width, lead, gram, row))
                gram, first, lead, width, content, row = (x[order] for x in (gram, first, lead, width, content, row))
                new = np.ones(len(row), bool)
                new[1:] = np.logical_or.reduce([x[1:] != x[:-1] for x in (gram, lead, width, content, row)])
                start = np.flatnonzero(new)
                firsts = pa.ListArray.from_arrays(pa.array(np.append(start, len(row)).astype("i4")), pa.array(first.astype("i4")))
                at = pa.array(row[start])
                columns = [pa.array(gram[start]), batch.column("doc_id").take(at), batch.column("text_hash").take(at), firsts]
                columns += [*[pa.array(x[start].astype("i4")) for x in (lead, width)], pa.array(content[start])]
                yield pa.RecordBatch.from_arrays(columns, ["gram", "doc_id", "text_hash", "firsts", "lead", "width", "content"])

    return run


def _with_bytes(length: int, unit: str):
    """One row per wanted segment of a document, with its bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):  # a document at a time: its segments overlap
                raw = symbols(batch.column("text")[i].as_py(), unit)
                wanted = batch.column("wanted")[i].values
                first, width = (wanted.field(c).to_numpy(zero_copy_only=False) for c in ("first", "width"))
                cut = [raw[s : s + w - 1 + length].tobytes() for s, w in zip(first.tolist(), width.tolist(), strict=True)]
                at = pa.array(np.full(len(first), i))
                fields = {c: wanted.field(c) for c in ("gram", "first", "lead", "width", "content", "whole")}
                fields |= {c: batch.column(c).take(at) for c in ("doc_id", "text_hash")} | {"bytes": pa.array(cut, pa.binary())}
                names = ["gram", "doc_id", "text_hash", "first", "lead", "width", "content", "whole", "bytes"]
                yield pa.RecordBatch.from_arrays([fields[c] for c in names], names)

    return run


def repeated_windows(keys: np.ndarray, lead: np.ndarray, width: np.ndarray, texts: list[bytes], length: int, unit: str = "bytes") -> np.ndarray:
    """Flags (segment, window): whether the window's string is also in another segment of its key.

    ``keys`` ascend. Columns count from the gram; a segment holds columns -lead to its end.
    """
    n = len(keys)
    begin, size = -lead.astype(np.int64), width.astype(np.int64) - 1 + length
    low, high = int(begin.min()), int((begin + size).max())
    values = [np.frombuffer(t, UNITS[unit][1]) for t in texts]
    none = 256
    if unit != "bytes":  # numbers of the distinct symbols of this collection
        distinct, codes = np.unique(np.concatenate(values), return_inverse=True)
        none = len(distinct)
        values = np.split(codes, np.cumsum([len(v) for v in values])[:-1])
    column = np.zeros((high - low, n), np.uint8 if unit == "bytes" else np.int32)
    for i, value in enumerate(values):
        column[begin[i] - low : begin[i] - low + len(value), i] = value
    found = np.zeros((n, int(width.max())), bool)
    order = np.arange(n)
    group = np.cumsum(np.append(0, keys[1:] != keys[:-1])) * (none + 1)
    same = np.append(False, keys[1:] == keys[:-1])  # groups stay in place: the order changes inside them
    common = np.zeros(n + 1, np.int32)
    end = begin + size
    for c in range(high - 1, low - 1, -1):
        held = (begin <= c) & (c < end)
        transform = np.where(held, column[c - low], none)[order]
        moved = np.argsort(group + transform, kind="stable")
        after, before = moved[1:], moved[:-1]
        least = common[after]
        far = np.flatnonzero(after != before + 1)
        if len(far):
            spans = np.column_stack([before[far] + 1, after[far] + 1]).ravel()
            spans = np.where(spans > n, n, spans)
            ranges = np.flatnonzero(before[far] < after[far])
            least[far] = 0
            if len(ranges):
                pairs = spans.reshape(-1, 2)[ranges].ravel()
                least[far[ranges]] = np.minimum.reduceat(common, pairs)[::2]
        order, inserted = order[moved], transform[moved]
        joined = same[1:] & (inserted[1:] == inserted[:-1]) & (inserted[1:] < none)
        common = np.zeros(n + 1, np.int32)
        common[1:n] = np.where(joined, least + 1, 0)
        hit = np.maximum(common[:n], common[1:]) >= length
        if hit.any():
            who = order[hit]
            window = c - begin[who]
            own = (window >= 0) & (window < width[who])
            found[who[own], window[own]] = True
    return found


def _runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, first, number) of the runs of set flags."""
    padded = np.zeros((flags.shape[0], flags.shape[1] + 2), np.int8)
    padded[:, 1:-1] = flags
    step = np.diff(padded, axis=1)
    row, first = np.nonzero(step == 1)
    return row, first, np.nonzero(step == -1)[1] - first


def _construct(length: int, unit: str):
    def build(rows: pa.Table) -> pa.RecordBatch:
        lead, width = (rows[c].to_numpy().astype(np.int64) for c in ("lead", "width"))
        flags = repeated_windows(rows["gram"].to_numpy(), lead, width, rows["bytes"].to_pylist(), length, unit)
        flags[rows["whole"].to_numpy()] = False  # known already
        row, first, number = _runs(flags)
        at = pa.array(row)
        picked = [rows[c].combine_chunks().take(at) for c in ("doc_id", "text_hash")]
        first = rows["first"].to_numpy()[row] + first
        firsts = pa.ListArray.from_arrays(pa.array(np.arange(len(first) + 1, dtype="i4")), pa.array(first.astype("i4")))
        return pa.RecordBatch.from_arrays([*picked, firsts, pa.array(number.astype("i4"))], ["doc_id", "text_hash", "firsts", "width"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            held = rows if held is None else pa.concat_tables([held, rows])
            if len(held) >= TOGETHER:  # all keys but the last are complete
                key = held["gram"].to_numpy()
                cut = int(np.searchsorted(key, key[-1]))
                if cut:
                    yield build(held.slice(0, cut).combine_chunks())
                    held = held.slice(cut)
        if held is not None and len(held):
            yield build(held.combine_chunks())

    return run


def _refine(length: int, level: int, unit: str):
    """Cut segments into blocks of 2**level window starts, counted from the gram, and key each piece
    also by the bytes that all windows of its block share. Equal windows stay under one key."""
    step = 1 << level
    kind = UNITS[unit][1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lead, width, grams = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("lead", "width", "gram"))
            first = batch.column("first").to_numpy(zero_copy_only=False)
            rows, out = [], []
            for i, raw in enumerate(batch.column("bytes").to_pylist()):
                value = np.frombuffer(raw, kind)
                sums, down = _sums(value)
                begin = length - lead[i]  # of the first window; never negative
                for block in range(begin // step, (begin + width[i] - 1) // step + 1):
                    low, high = max(begin, block * step), min(begin + width[i], block * step + step)
                    core = np.array([block * step + step - 1 - begin, block * step + length - begin])
                    piece = np.array([low - begin, high - 1 - begin + length])
                    key, content = (_hashes(sums, down, x[:1], x[1:])[0] for x in (core, piece))
                    key = mixed(np.array([key]) ^ np.uint64(int(grams[i]) & (2**64 - 1)) * np.uint64(BASE) + np.uint64(block))[0]
                    rows.append(i)
                    out.append((int(key.astype(np.int64)), int(first[i] + low - begin), int(length - low), int(high - low), int(content.astype(np.int64)), value[piece[0] : piece[1]].tobytes()))
            at = pa.array(rows, pa.int64())
            kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.binary())
            gram, start, ahead, wide, content, raws = (pa.array([x[j] for x in out], kinds[j]) for j in range(6))
            columns = [gram, *[batch.column(c).take(at) for c in ("doc_id", "text_hash")], start, ahead, wide, content, batch.column("whole").take(at), raws]
            yield pa.RecordBatch.from_arrays(columns, ["gram", "doc_id", "text_hash", "first", "lead", "width", "content", "whole", "bytes"])

    return run


ALIKE = ["gram", "lead", "width", "content"]
PLACE = ["doc_id", "text_hash", "first"]


def _alike(rows: DataFrame) -> DataFrame:
    """Equal segments of a key: how many, and the first of them."""
    listed = "firsts" in rows.columns
    n = F.sum(F.size("firsts")) if listed else F.count(F.lit(1))
    place = F.struct("doc_id", "text_hash", F.get("firsts", F.lit(0)).alias("first")) if listed else F.struct(*PLACE)
    return rows.groupBy(*ALIKE).agg(n.alias("n"), F.min(place).alias("one"))


def repeated_strings(docs: DataFrame, length: int = 400, id_col: str = "doc_id", text_col: str = "text", key_segments: int = KEY_SEGMENTS, unit: str = "bytes") -> DataFrame:
    """(doc_id, text_hash, firsts, width): windows of ``length`` bytes, ``width`` neighbouring starts from
    each byte of ``firsts`` on, whose string starts at another place of the corpus too. With
    ``unit="words"`` length, starts and widths count words, whatever blanks stand between them.

    1. Segments and their hashes are written (about one per 185 bytes at length 400, one row for all
       equal ones of a document); keys met once go.
    2. Equal segments of a key are counted: all windows of two equal ones are repeated, and one stays.
    3. Of keys with different segments the bytes are fetched and their columns built, key by key.
       A key with more than ``key_segments`` of them is first cut into keys of 32 window starts that
       also hash the bytes shared by these windows, then into single windows, where only equal
       ones meet; equal pieces again leave one. So no task holds an unbounded key.

    Matches are exact up to 64-bit hashes of segments under one key. A NULL text is empty; texts
    shorter than ``length`` have no windows; repeated rows repeat each other; NULL ids are ids.
    """
    if unit not in UNITS:
        raise ValueError(f"unknown unit {unit!r}; expected bytes or words")
    if length < UNITS[unit][0] + 2:
        raise ValueError(f"length must be at least {UNITS[unit][0] + 2}")
    own = identified(docs, id_col, text_col)
    found = stored(own.mapInArrow(_segments(length, unit), SEGMENTS), "segments")
    # Written first: a join of two shuffles is split where a key is hot, one on top of an aggregate is not.
    met = stored(found.groupBy("gram").agg(F.sum(F.size("firsts")).alias("times")).where("times > 1").select("gram"), "met-keys")
    again = stored(found.join(met, "gram"), "repeated-segments")
    alike = stored(_alike(again), "equal-segments")
    windows = ["doc_id", "text_hash", "firsts", "width"]
    whole = again.join(alike.where("n > 1").select(*ALIKE), ALIKE).select(*windows)
    kinds = alike.groupBy("gram").agg(F.count(F.lit(1)).alias("kinds")).where("kinds > 1")
    unlike = alike.join(kinds, "gram").select(*ALIKE, "kinds", (F.col("n") > 1).alias("whole"), "one.*")
    listed = unlike.groupBy("doc_id", "text_hash").agg(F.collect_list(F.struct("gram", "first", "lead", "width", "content", "whole")).alias("wanted"))
    fetched = own.alias("d").join(listed.hint("shuffle_hash").alias("w"), same_document("d", "w")).select("d.doc_id", "d.text_hash", "d.text", "w.wanted")
    rows = fetched.mapInArrow(_with_bytes(length, unit), BYTES)
    crowded = stored(kinds.where(F.col("kinds") > key_segments).select("gram"), "crowded-keys")
    parts = [whole]
    if crowded.isEmpty():
        parts.append(_built(rows, length, unit))
    else:
        rows = stored(rows, "segment-bytes")
        for level in [x for x in LEVELS if 1 << x <= length]:  # windows of a block must share symbols
            parts.append(_built(rows.join(crowded, "gram", "left_anti"), length, unit))
            pieces = stored(rows.join(crowded, "gram").select(*rows.columns).mapInArrow(_refine(length, level, unit), BYTES), "pieces")
            equal = stored(_alike(pieces), "equal-pieces")
            # A piece of a whole segment stands for at least two places.
            parts.append(pieces.join(equal.where("n > 1").select(*ALIKE), ALIKE).where(~F.col("whole")).withColumn("firsts", F.array("first")).select(*windows))
            kinds = equal.groupBy("gram").agg(F.count(F.lit(1)).alias("kinds")).where("kinds > 1")
            left = equal.join(kinds.select("gram"), "gram").select(*ALIKE, "one", (F.col("n") > 1).alias("several"))
            named = pieces.withColumn("one", F.struct(*PLACE)).join(left, [*ALIKE, "one"])
            rows = stored(named.select(*[F.col(c) for c in pieces.columns if c not in ("whole", "bytes")], (F.col("whole") | F.col("several")).alias("whole"), "bytes"), "segment-bytes")
            crowded = stored(kinds.where(F.col("kinds") > key_segments).select("gram"), "crowded-keys")
            if rows.isEmpty():
                break
        else:
            parts.append(_built(rows, length, unit))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _built(rows: DataFrame, length: int, unit: str) -> DataFrame:
    return rows.repartition("gram").sortWithinPartitions("gram").mapInArrow(_construct(length, unit), WINDOWS)


def covered(n: int, windows: list[dict], length: int) -> np.ndarray:
    """Flags of the symbols, of ``n``, that lie in a window."""
    edge = np.zeros(n + 1, np.int32)
    first = np.concatenate([np.asarray(w["firsts"], np.int64) for w in windows])
    width = np.repeat([w["width"] for w in windows], [len(w["firsts"]) for w in windows])
    np.add.at(edge, first, 1)
    np.add.at(edge, first + width - 1 + length, -1)
    return np.cumsum(edge[:-1]) > 0


def kept_bytes(raw: bytes, windows: list[dict], length: int, unit: str = "bytes") -> tuple[np.ndarray, bytes]:
    """(flags of the bytes that go, the other bytes)."""
    if unit == "bytes":
        gone = covered(len(raw), windows, length)
    else:
        starts, ends = unspaced_bounds(np.frombuffer(raw, np.uint8))
        _, first, number = _runs(covered(len(starts), windows, length)[None, :])
        gone = np.zeros(len(raw), bool)
        for a, b in zip(starts[first], ends[first + number - 1], strict=True):
            gone[a:b] = True
    return gone, np.frombuffer(raw, np.uint8)[~gone].tobytes()


def _cut(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out = []
            for text, windows in zip(batch.column("text").to_pylist(), batch.column("windows").to_pylist(), strict=True):
                raw = text.encode()
                if windows is None:
                    out.append((len(raw), 0, [], raw))
                    continue
                gone, kept = kept_bytes(raw, windows, length)
                _, start, size = _runs(gone[None, :])
                spans = [{"start": int(a), "end": int(a + b)} for a, b in zip(start, size, strict=True)]
                out.append((len(raw), int(gone.sum()), spans, kept))
            span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
            n, removed, spans, kept = (pa.array([x[i] for x in out], t) for i, t in enumerate((pa.int64(), pa.int64(), span, pa.binary())))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_hash"), n, removed, spans, kept], ["doc_id", "text_hash", "n_bytes", "n_removed", "spans", "kept"])

    return run


def windows_by_document(docs: DataFrame, length: int = 400, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """(doc_id, text_hash, windows array<struct<firsts, width>>) of the documents with repeated strings."""
    windows = repeated_strings(docs, length, id_col, text_col, **options)
    return windows.groupBy("doc_id", "text_hash").agg(F.collect_set(F.struct("firsts", "width")).alias("windows"))


def cut_column(text: Column, windows: Column, length: int, unit: str = "bytes") -> Column:
    """The text without its repeated strings; a character cut apart goes with them. Blanks at the ends of
    a run of words stay."""

    @F.arrow_udf("string")
    def cut(texts: pa.Array, found: pa.Array) -> pa.Array:
        out = []
        for batch in slices([pa.RecordBatch.from_arrays([texts, found], ["text", "windows"])]):
            rows = zip(batch.column("text").to_pylist(), batch.column("windows").to_pylist(), strict=True)
            out += [t if t is None or w is None else kept_bytes(t.encode(), w, length, unit)[1].decode(errors="ignore") for t, w in rows]
        return pa.array(out, pa.string())

    return cut(text, windows)


def remove_repeated(docs: DataFrame, length: int = 400, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """doc_id, text_hash, n_bytes, n_removed, spans array<struct<start, end>>, kept binary per row of ``docs``.

    Every byte covered by a repeated string goes, in all its copies; ``spans`` are the maximal removed
    runs in bytes, ``kept`` is what is left of the UTF-8 text, which may end inside a character.
    """
    own = identified(docs, id_col, text_col)
    listed = windows_by_document(docs, length, id_col, text_col, **options)
    joined = own.alias("d").join(listed.hint("shuffle_hash").alias("w"), same_document("d", "w"), "left")
    wanted = joined.select("d.doc_id", "d.text_hash", "d.text", "w.windows")
    return wanted.mapInArrow(_cut(length), "doc_id bigint, text_hash bigint, n_bytes bigint, n_removed bigint, spans array<struct<start:int,end:int>>, kept binary")
