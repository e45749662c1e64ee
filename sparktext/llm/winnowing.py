"""Document fingerprints by winnowing, in DataFrame operations alone."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparktext.llm.common import identified, parallelism

# A unit of text: up to eight characters without a blank, counted from the start of a word.
UNIT_CHARS = 8
UNIT = rf"\S{{1,{UNIT_CHARS}}}"
# A unit at every character; the match itself is one character long.
EVERY_UNIT = rf"(?=({UNIT}))\S"
STEP_BITS = 4
LAST = (1 << 31) - 1
FIRST_KEY = -(1 << 63)
# Ranges are dealt to tasks by hash; several for each even the tasks out.
RANGES_PER_TASK = 4


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over a value that is evaluated once, not once per element that refers to it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _packed(value: Column, place: Column) -> Column:
    return F.shiftleft(F.shiftrightunsigned(value, 32), 31).bitwiseOR((F.lit(LAST) - place).cast("bigint"))


def _minima(hashes: Column, window: int) -> Column:
    if window == 1:
        return hashes
    n = F.greatest(F.size(hashes) - (window - 1), F.least(F.size(hashes), F.lit(1)))
    least = F.transform(F.slice(hashes, F.lit(1), n), lambda h, i: F.least(h, *[F.get(hashes, i + j) for j in range(1, window)]))
    return F.array_distinct(least)


def selected_everywhere(text: Column, gram: int = 3, window: int = 4) -> Column:
    """As ``selected``, with a unit at every character of each blank-free run longer than a unit.

    A run of up to UNIT_CHARS characters is one unit. In a longer one a unit starts at every
    character and has UNIT_CHARS characters, or what is left of the run. A gram is a unit and the
    ``gram`` - 1 that follow end to start, so inside a long run it is gram * UNIT_CHARS characters,
    taken at every character. ``window`` counts places where grams start, and a place is the number
    of such places before it. Two texts that share gram * UNIT_CHARS + window - 1 characters inside
    long runs, at whatever offsets, or any gram + window - 1 units of whole runs, select a gram in
    both. A text without a whole gram has one of all its units.
    """

    def packed_unit(unit: Column, step: Column) -> Column:
        return F.shiftleft(F.xxhash64(unit), STEP_BITS).bitwiseOR(step.cast("bigint"))

    def units_of(run: Column) -> Column:
        every = F.transform(F.regexp_extract_all(run, F.lit(EVERY_UNIT), F.lit(1)), lambda unit: packed_unit(unit, F.char_length(unit)))
        return F.when(F.char_length(run) > UNIT_CHARS, every).otherwise(F.array(packed_unit(run, F.lit(1))))

    def next_of(unit: Column, i: Column) -> Column:
        return i + unit.bitwiseAND(F.lit((1 << STEP_BITS) - 1).cast("bigint")).cast("int")

    def longer(units: Column, left: int, grams: Column) -> Column:
        if left == 0:
            return grams
        # NULL once the text ends inside the gram; such places come last.
        step = F.transform(units, lambda u, i: _let(F.get(grams, next_of(u, i)), lambda g: F.when(g.isNotNull(), F.xxhash64(F.shiftright(u, STEP_BITS), g))))
        return _let(step, lambda g: longer(units, left - 1, g))

    def picked(units: Column) -> Column:
        first = F.transform(units, lambda u: F.shiftright(u, STEP_BITS))
        whole = _let(first, lambda g: F.filter(longer(units, gram - 1, g), lambda h: h.isNotNull()))
        short = F.when(F.size(units) > 0, F.array(F.xxhash64(units))).otherwise(F.array().cast("array<bigint>"))
        hashes = _let(whole, lambda g: F.transform(F.when(F.size(g) > 0, g).otherwise(short), lambda h, i: _packed(h, i)))
        return _let(hashes, lambda h: _minima(h, window))

    runs = F.regexp_extract_all(text, F.lit(r"\S+"), F.lit(0))
    return _let(F.flatten(F.transform(runs, units_of)), picked)


def selected(text: Column, gram: int = 3, window: int = 4) -> Column:
    """array<long> of the selected grams of a text in order: hash in the high 32 bits, place below.

    A gram is ``gram`` units in a row (all units of a shorter text); its hash is taken at every
    place. From every ``window`` grams in a row (all grams of a shorter text) the smallest hash is
    selected, the rightmost one among equals. So any gram + window - 1 units in a row that two
    texts share select a gram in both, and no shared stretch below ``gram`` units is seen. Units
    are counted from the start of a run without blanks: a stretch shared inside runs at offsets that differ
    by anything but a multiple of UNIT_CHARS is seen by ``selected_everywhere`` alone. The place is stored as its distance from 2**31 - 1, which makes the plain minimum the rightmost.
    NULL gives NULL, a text without units an empty array.
    """

    def grams(units: Column) -> Column:
        n = F.greatest(F.size(units) - (gram - 1), F.least(F.size(units), F.lit(1)))
        return F.transform(
            F.slice(units, F.lit(1), n),
            lambda unit, i: _packed(F.xxhash64(unit, *[F.get(units, i + j) for j in range(1, gram)]), i),
        )

    units = F.transform(F.regexp_extract_all(text, F.lit(UNIT), F.lit(0)), lambda unit: F.xxhash64(unit))
    return _let(units, lambda u: _let(grams(u), lambda h: _minima(h, window)))


def hash_of(packed: Column) -> Column:
    return F.shiftrightunsigned(packed, 31)


def place_of(packed: Column) -> Column:
    return F.lit(LAST) - packed.bitwiseAND(F.lit(LAST).cast("bigint"))


def written(picked: Column) -> Column:
    """A fingerprint as a string: hash:place of each selected gram, joined by a space."""
    return F.lower(F.array_join(F.transform(picked, lambda p: F.concat(F.hex(hash_of(p)), F.lit(":"), place_of(p).cast("string"))), " "))


def hashes(picked: Column) -> Column:
    """The different hashes of selected grams, places left aside."""
    return F.array_distinct(F.transform(picked, hash_of))


def share(left: Column, right: Column) -> Column:
    """``likeness`` of two results of ``hashes``; their union is counted, not made, as each holds a hash once."""

    def counted(pair: Column) -> Column:
        either = F.size(pair["l"]) + F.size(pair["r"]) - pair["both"]
        return F.when(either == 0, F.lit(1.0)).otherwise(pair["both"] / either)

    def met(pair: Column) -> Column:
        both = F.size(F.array_intersect(pair["l"], pair["r"]))
        return _let(F.struct(pair["l"].alias("l"), pair["r"].alias("r"), both.alias("both")), counted)

    return _let(F.struct(left.alias("l"), right.alias("r")), met)


def likeness(left: Column, right: Column) -> Column:
    """Shared share of all selected hashes, places left aside; 1 for two texts without units."""
    return share(hashes(left), hashes(right))


def fingerprints(docs: DataFrame, gram: int = 3, window: int = 4, id_col: str = "doc_id", text_col: str = "text", select: Callable[..., Column] = selected) -> DataFrame:
    """(doc_id, fingerprint array<struct<hash, place>>) of whole texts; NULL counts as empty. No shuffle.

    ``select`` is ``selected`` or ``selected_everywhere``, which ``compare_edited`` uses.
    """
    own = identified(docs, id_col, text_col)
    picked = select(F.col("text"), gram, window)
    return own.select("doc_id", F.transform(picked, lambda p: F.struct(hash_of(p).alias("hash"), place_of(p).cast("int").alias("place"))).alias("fingerprint"))


def _range_of(key: Column, cuts: list[int]) -> Column:
    """Number of cut points <= key, searched in two steps of about the square root of their number."""
    if not cuts:
        return F.lit(0)
    width = max(1, int(len(cuts) ** 0.5))
    blocks = F.array(*[F.array(*[F.lit(c).cast("bigint") for c in cuts[i : i + width]]) for i in range(0, len(cuts), width)])
    before = F.size(F.filter(blocks, lambda b: b[0] <= key))
    inside = F.size(F.filter(F.get(blocks, before - 1), lambda c: c <= key))
    return F.when(before == 0, F.lit(0)).otherwise((before - 1) * width + inside)


def in_ranges(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(key, text_hash, doc_id, text, range, guest) dealt to ranges of the id.

    Each range also gets, as a guest that comes last, the first document of the next range that has
    any (the last range: of the first), so the successor of every document is in its own range.
    Cut points are approximate quantiles, four numbers per task; any cuts give the same successors.
    """
    own = identified(docs, id_col, text_col).withColumn("key", F.coalesce("doc_id", F.lit(FIRST_KEY)))
    n = RANGES_PER_TASK * parallelism(docs.sparkSession)
    cuts = own.agg(F.percentile_approx("key", [i / n for i in range(1, n)] or [0.5], 10_000)).first()[0] or []
    ranged = own.withColumn("range", _range_of(F.col("key"), sorted(set(cuts))))
    firsts = ranged.groupBy("range").agg(F.min("key").alias("key"))
    order = W.orderBy("range")  # one row per range
    previous = F.coalesce(F.lag("range").over(order), F.max("range").over(order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)))
    firsts = firsts.select("key", previous.alias("range"))
    met = own.join(F.broadcast(firsts), "key").groupBy("range", "key").agg(F.min_by(F.struct("text_hash", "doc_id", "text"), "text_hash").alias("f"))
    columns = ["key", "text_hash", "doc_id", "text", "range", "guest"]
    guests = met.select("key", "f.text_hash", "f.doc_id", "f.text", "range", F.lit(True).alias("guest")).select(*columns)
    return ranged.withColumn("guest", F.lit(False)).select(*columns).unionByName(guests)


def compare_edited(docs: DataFrame, gram: int = 3, window: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text, of its edited text, and their likeness, one row per row of ``docs``.

    The edited text has its last floor(n_chars / 4) code points replaced by the first as many (or
    all) of the next document by ascending id; after the last comes the first. NULL text counts as
    empty, NULL ids come first, repeated ids follow each other by the hash of their text. Columns:
    doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next. A text
    without units has an empty fingerprint. Texts are shuffled once, by range of the id.
    """
    dealt = in_ranges(docs, id_col, text_col).repartition("range")
    # The hashes of a text are compared with two others and serve its predecessor too; they are found once.
    picked = dealt.withColumn("picked", selected_everywhere(F.col("text"), gram, window)).withColumn("hashes", hashes(F.col("picked")))
    along = W.partitionBy("range").orderBy("guest", "key", "text_hash")
    follows = picked.select("*", F.lead(F.struct("text", "hashes")).over(along).alias("next")).where(~F.col("guest"))
    n_chars = F.char_length("text")
    cut = F.floor(n_chars / 4).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n_chars - cut), F.substring(F.col("next.text"), F.lit(1), cut))
    changed = follows.withColumn("edited", edited)
    both = changed.select(
        "doc_id",
        n_chars.cast("bigint").alias("n_chars"),
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        "picked",
        "hashes",
        selected_everywhere(F.col("edited"), gram, window).alias("edited_picked"),
        F.col("next.hashes").alias("next_hashes"),
    )
    return both.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        written(F.col("picked")).alias("fingerprint"),
        written(F.col("edited_picked")).alias("edited_fingerprint"),
        share(F.col("hashes"), hashes(F.col("edited_picked"))).alias("near_edited"),
        share(F.col("hashes"), F.col("next_hashes")).alias("near_next"),
    )
