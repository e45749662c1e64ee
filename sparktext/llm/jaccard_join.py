"""Exact Jaccard join of word shingles over regions around pivots, and the components of its links.

Jaccard distances between unrelated texts are all 1 or nearly so: nearest-pivot regions over all
texts would have windows that hold every text. Two exact bounds therefore come first. A text can
only link if enough of its shingles are shared with any other text; and of two that link, the
shingles that may be missing are so few that both have one in common among their rarest. The texts
with one rare shingle in common form the region of its smallest text, the pivot; a text on the
border of several regions is in each. Inside a region, distances are metric and informative:
``region_components`` takes pivots of its own and skips by the triangle inequality.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparktext.llm.common import identified, parallelism, release_memory, slices, stored
from sparktext.llm.words import shingles

# Texts sampled for the shingles that many texts have, and how many of those are set apart.
SAMPLE = 2_000
COMMON = 4_096
COMMON_SHARE = 0.01
# Shingles a task gathers before it deals them out.
GATHERED = 1_000_000
# Distinct sets that a task remembers as dealt; one met again later is dealt again, and counted once.
REMEMBERED = 100_000
# Bytes of text behind one part of the shingles.
PART_BYTES = 64 << 20
# Passes over a part, each counting its share of the shingles.
PASSES = 8
# Members of a region that one task joins; a larger region is joined in slices.
REGION = 5_000
PIVOTS = 8
OFTEN = (1 << 31) - 1
DEALT = "part int, is_doc boolean, doc_id bigint, text_hash bigint, set_id binary, n int, tokens binary, owners binary, sizes binary, counts binary"
SHARED = "is_doc boolean, doc_id bigint, text_hash bigint, set_id binary, n int, tokens array<bigint>, often array<int>"
EDGES = "a binary, b binary"


def least_overlap(n, percent: int):
    """Fewest shingles that a set of n has in common with a set it links to."""
    return -(-percent * n // 100)


def _common_tokens(docs: DataFrame, words: int, rows: int) -> np.ndarray:
    """Shingles found in at least one in a hundred texts of a bounded sample, at most COMMON. Which
    ones they are changes the amount of work only, not the result."""
    share = min(1.0, SAMPLE / max(1, rows))
    sample = docs.where(F.pmod(F.xxhash64("text_hash", F.lit("common")), F.lit(1 << 20)) < int(share * (1 << 20)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sets = [shingles(t, words).astype(np.int64) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sets) if sets else np.zeros(0, np.int64))], ["token"])

    counted = sample.select("text").distinct().mapInArrow(run, "token bigint").groupBy("token").count()
    least = max(10, int(COMMON_SHARE * min(rows, SAMPLE)))
    most = counted.where(F.col("count") >= least).orderBy(F.col("count").desc(), "token").limit(COMMON).select("token").collect()
    return np.sort(np.array([r[0] for r in most], np.int64).astype(np.uint64))


def _deal(parts: int, words: int, common: np.ndarray):
    """Texts as sets: a row per text, and the shingles of each distinct set dealt to parts by value."""

    def doc_rows(batch, ids, sets):
        hashes = batch.column("text_hash")
        n = len(ids)
        at = ((np.arange(n) + TaskContext.get().partitionId()) % parts).astype("i4")  # copies of a text apart
        blank = pa.nulls(n, pa.binary())
        size = pa.array([len(s) for s in sets], pa.int32())
        return pa.RecordBatch.from_arrays([pa.array(at), pa.array(np.ones(n, bool)), batch.column("doc_id"), hashes, pa.array(ids, pa.binary()), size, blank, blank, blank, blank], NAMES)

    def dealt(ids: list[bytes], sets: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        sizes = np.array([len(s) for s in sets], "i4")
        tokens, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
        names = np.frombuffer(b"".join(ids), "V16")
        apart = np.isin(tokens, common)
        rows = []
        if apart.any():  # known to be shared: they skip the counting; equal sets of other tasks meet them
            home = (np.frombuffer(b"".join(ids), "u8")[::2] % np.uint64(parts)).astype(np.int64)
            rows += [(int(at), *blobs(tokens[pick], owner[pick], names, sizes), True) for at, pick in spread(home[owner], np.flatnonzero(apart))]
        rest = np.flatnonzero(~apart)
        rows += [(int(at), *blobs(tokens[pick], owner[pick], names, sizes), False) for at, pick in spread((tokens % np.uint64(parts)).astype(np.int64), rest)]
        n = len(rows)
        columns = [pa.array([r[0] for r in rows], pa.int32()), pa.array(np.zeros(n, bool)), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary())]
        columns += [pa.array([int(r[5]) for r in rows], pa.int32()), *[pa.array([r[i] for r in rows], pa.binary()) for i in range(1, 5)]]
        yield pa.RecordBatch.from_arrays(columns, NAMES)

    def spread(at: np.ndarray, rows: np.ndarray):
        """(part, its rows in order of owner)."""
        if not len(rows):
            return
        order = rows[np.argsort(at[rows], kind="stable")]
        cut = np.flatnonzero(np.diff(at[order])) + 1
        for pick in np.split(order, cut):
            yield at[pick[0]], pick

    def blobs(tokens, owner, names, sizes):
        own, counts = np.unique(owner, return_counts=True)
        return tokens.tobytes(), names[own].tobytes(), sizes[own].tobytes(), counts.astype("i4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        ids, sets, held = [], [], 0
        for batch in slices(batches):
            found = [shingles(t, words) for t in batch.column("text").to_pylist()]
            names = [xxhash.xxh3_128_digest(s.tobytes()) for s in found]
            yield doc_rows(batch, names, found)
            for name, own in zip(names, found, strict=True):
                if len(own) and name not in seen:
                    if len(seen) >= REMEMBERED:
                        seen.clear()
                    seen.add(name)
                    ids.append(name)
                    sets.append(own)
                    held += len(own)
                    if held >= GATHERED:
                        yield from dealt(ids, sets)
                        ids, sets, held = [], [], 0
        if sets:
            yield from dealt(ids, sets)

    return run


NAMES = ["part", "is_doc", "doc_id", "text_hash", "set_id", "n", "tokens", "owners", "sizes", "counts"]


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of the shingles of a part, those of two sets or more, listed by set; rows of texts pass."""
    names = ["is_doc", "doc_id", "text_hash", "set_id", "n", "tokens", "often"]
    blocks: dict[bool, list[tuple[bytes, ...]]] = {True: [], False: []}
    for batch in batches:
        docs = batch.filter(batch.column("is_doc"))
        if docs.num_rows:
            nothing = [pa.nulls(docs.num_rows, pa.list_(pa.int64())), pa.nulls(docs.num_rows, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays([*[docs.column(c) for c in names[:5]], *nothing], names)
        lists = batch.filter(pc.invert(batch.column("is_doc")))
        for row in zip(*[lists.column(c).to_pylist() for c in ("n", "tokens", "owners", "sizes", "counts")], strict=True):
            blocks[bool(row[0])].append(row[1:])
    for apart in (True, False):
        rows = blocks.pop(apart)
        if not rows:
            continue
        tokens, sizes, counts = (np.frombuffer(b"".join(r[i] for r in rows), t) for i, t in ((0, "u8"), (2, "i4"), (3, "i4")))
        owners, first, block = np.unique(np.frombuffer(b"".join(r[1] for r in rows), "V16"), return_index=True, return_inverse=True)
        rows.clear()
        keep = np.zeros(len(block), bool)
        keep[first] = True  # a set that several tasks have met counts once
        keep = np.repeat(keep, counts)
        owner = np.repeat(block.astype("i4"), counts)
        found = []
        for step in range(PASSES):  # equal shingles are in one pass
            at = np.flatnonzero(keep & (tokens >> np.uint64(56) & np.uint64(PASSES - 1) == step))
            own, of = tokens[at], owner[at]
            if apart:
                found.append((own, of, np.full(len(own), OFTEN, "i4")))
                continue
            order = np.argsort(own)
            own, of = own[order], of[order]
            starts = np.flatnonzero(np.append(True, own[1:] != own[:-1])) if len(own) else np.zeros(0, np.int64)
            times = np.diff(np.append(starts, len(own)))
            often = np.repeat(times, times).astype("i4")
            some = often > 1
            found.append((own[some], of[some], often[some]))
        tokens, owner, often = (np.concatenate(x) for x in zip(*found, strict=True))
        found.clear()
        order = np.argsort(owner, kind="stable")
        tokens, owner, often = tokens[order].astype(np.int64), owner[order], often[order]
        own, starts = np.unique(owner, return_index=True)
        offsets = pa.array(np.append(starts, len(owner)).astype("i4"))
        n = len(own)
        columns = [pa.array(np.zeros(n, bool)), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.array([x.tobytes() for x in owners[own]], pa.binary()), pa.array(sizes[first[own]])]
        columns += [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (tokens, often)]
        yield pa.RecordBatch.from_arrays(columns, names)
    release_memory()


class Region:
    """Sets of one region: sizes in full, and the shingles that are shared with any other text."""

    def __init__(self, sizes: np.ndarray, tokens: list[np.ndarray], percent: int):
        self.n, self.percent = sizes.astype(np.int64), percent
        self.kept = np.array([len(t) for t in tokens], np.int64)
        _, self.codes = np.unique(np.concatenate(tokens), return_inverse=True)
        self.ends = np.cumsum(self.kept)
        member = np.repeat(np.arange(len(tokens)), self.kept)
        self.members = member[np.argsort(self.codes, kind="stable")]
        self.often = np.bincount(self.codes)
        self.first = np.cumsum(self.often) - self.often
        self.central = np.bincount(member, self.often[self.codes], len(tokens)) / self.n

    def overlaps(self, x: int) -> np.ndarray:
        """Number of shingles that member x shares with every member."""
        own = self.codes[self.ends[x] - self.kept[x] : self.ends[x]]
        times = self.often[own]
        at = np.repeat(self.first[own] - np.cumsum(times) + times, times) + np.arange(times.sum())
        return np.bincount(self.members[at], minlength=len(self.n))

    def may_link(self, x: int) -> np.ndarray:
        """Members whose sizes and numbers of shared shingles allow a link to x."""
        most = np.minimum(self.kept, self.kept[x])
        return 100 * most >= self.percent * (self.n + self.n[x] - most)

    def links(self, x: int, overlap: np.ndarray) -> np.ndarray:
        return 100 * overlap >= self.percent * (self.n + self.n[x] - overlap)


def region_components(region: Region, queries: np.ndarray | None = None) -> np.ndarray:
    """Component of each member, as the place of one of its members.

    Central members go first. The distances of the first few to all members are kept as pivots: a
    member y can link to x only if their distances to every pivot differ by no more than the
    threshold (triangle inequality). A member whose window holds no member of another component
    has nothing to add and is not compared. Every link between components is found, by whichever
    of its ends comes first.
    """
    m = len(region.n)
    component = np.arange(m)
    reach = 1 - region.percent / 100 + 1e-9
    pivots: list[np.ndarray] = []
    order = np.argsort(-region.central, kind="stable") if queries is None else queries
    for x in order.tolist():
        open_ = component != component[x]
        if not open_.any():
            break
        open_ &= region.may_link(x)
        for d in pivots:
            open_ &= np.abs(d - d[x]) <= reach
        if not open_.any():
            continue
        overlap = region.overlaps(x)
        if len(pivots) < PIVOTS:
            pivots.append(1 - overlap / (region.n + region.n[x] - overlap))
        joined = np.unique(component[region.links(x, overlap)])
        if len(joined) > 1:
            component[np.isin(component, joined)] = component[x]
    return component


def _whole_regions(percent: int):
    def edges(ids: list[bytes], region: Region, queries=None) -> tuple[list[bytes], list[bytes]]:
        component = region_components(region, queries)
        moved = np.flatnonzero(component != np.arange(len(ids)))
        return [ids[i] for i in moved], [ids[i] for i in component[moved]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in (*batches, None):
            if batch is not None and not batch.num_rows:
                continue
            rows = held if batch is None else pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            if rows is None:
                return
            keys = rows["region"].to_numpy()
            starts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
            ends = np.append(starts[1:], len(rows))
            if batch is not None:  # the last region may go on
                starts, ends, held = starts[:-1], ends[:-1], rows.slice(int(starts[-1]))
            left, right = [], []
            for i, j in zip(starts.tolist(), ends.tolist(), strict=True):
                if j - i < 2:
                    continue
                part = rows.slice(i, j - i)
                tokens = [np.asarray(t, np.int64) for t in part["tokens"].to_pylist()]
                asked = np.flatnonzero(part["asks"].to_numpy())
                a, b = edges(part["set_id"].to_pylist(), Region(part["n"].to_numpy(), tokens, percent), None if len(asked) == j - i else asked)
                left += a
                right += b
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.binary()), pa.array(right, pa.binary())], ["a", "b"])

    return run


def _to_pivot(percent: int):
    """Distance bound of each member of a crowded region to its most central one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, size = (batch.column(c).to_numpy() for c in ("n", "pivot_n"))
            common = np.array([len(np.intersect1d(a, b)) for a, b in zip(batch.column("tokens").to_pylist(), batch.column("pivot_tokens").to_pylist(), strict=True)], np.int64)
            near = 100 * common >= percent * (n.astype(np.int64) + size - common)
            yield pa.RecordBatch.from_arrays([batch.column("region"), batch.column("set_id"), batch.column("pivot_id"), pa.array(near)], ["region", "set_id", "pivot_id", "near"])

    return run


def _crowded(members: DataFrame, crowded: DataFrame, percent: int, limit: int) -> DataFrame:
    """Links of regions above ``limit`` members, joined to components by a central pivot first.

    Members near the pivot are linked to it. The others are asked against all members, in slices of
    at most ``limit`` members and as many askers, unless even the best case of sizes rules a link out.
    """
    rows = stored(members.join(crowded, "region"), "crowded-regions")
    best = rows.groupBy("region").agg(
        F.max_by(F.struct("set_id", "n", "tokens"), F.col("weight") / F.col("n")).alias("p"), F.min("n").alias("least_n"), F.max(F.size("tokens")).alias("most_kept")
    )
    met = rows.join(best.select("region", F.col("p.set_id").alias("pivot_id"), F.col("p.n").alias("pivot_n"), F.col("p.tokens").alias("pivot_tokens")), "region")
    near = stored(met.select("region", "set_id", "n", "tokens", "pivot_id", "pivot_n", "pivot_tokens").mapInArrow(_to_pivot(percent), "region bigint, set_id binary, pivot_id binary, near boolean"), "near-pivots")
    most = F.least(F.size("tokens"), F.col("most_kept"))
    best_case = 100 * most >= percent * (F.col("n") + F.greatest(F.col("least_n"), most) - most)
    asks = rows.join(near.where("NOT near").select("region", "set_id"), ["region", "set_id"]).join(best.select("region", "least_n", "most_kept"), "region").where(best_case)
    slices = crowded.select("region", F.ceil(F.col("members") / limit).cast("int").alias("slices"))
    asks = asks.groupBy("region").agg(F.count(F.lit(1)).alias("askers")).join(slices, "region").join(asks.select("region", "set_id", "n", "tokens"), "region")
    blocks = F.ceil(F.col("askers") / limit).cast("int")
    asks = asks.withColumn("block", F.pmod(F.xxhash64("set_id", F.lit("block")), blocks))
    own = rows.join(asks.groupBy("region").agg(F.max("slices").alias("slices"), F.max(blocks).alias("blocks")), "region")
    own = own.withColumn("slice", F.pmod(F.xxhash64("set_id"), F.col("slices"))).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    asked = asks.withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)))
    columns = [F.xxhash64("region", F.col("slice").cast("int"), F.col("block").cast("int")).alias("region"), "set_id", "n", "tokens"]
    both = own.join(asks.select("region", "set_id"), ["region", "set_id"], "left_anti").select(*columns, F.lit(False).alias("asks"))
    both = both.unionByName(asked.select(*columns, F.lit(True).alias("asks")))
    # Askers of other blocks, as plain members of their slice.
    others = own.alias("o").join(asks.select("region", "set_id", F.col("block").alias("own_block")), ["region", "set_id"]).where("block <> own_block")
    both = both.unionByName(others.select(*columns, F.lit(False).alias("asks")))
    found = both.repartition("region").sortWithinPartitions("region").mapInArrow(_whole_regions(percent), EDGES)
    return found.unionByName(near.where("near AND set_id <> pivot_id").select(F.col("set_id").alias("a"), F.col("pivot_id").alias("b")))


def components(edges: DataFrame, rounds: int = 50) -> DataFrame:
    """(node, root) of all nodes of the edges (a, b), the root being the smallest node that is reached.

    Alternates two steps until nothing changes: every node hands its larger neighbours to its
    smallest one, then its smaller neighbours and itself to the smallest. Smallest neighbours are
    aggregated before the shuffle, so a node with very many neighbours is no hot group; joins on
    such a node are split at run time. A round is written and read again.
    """
    now = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    for _ in range(rounds):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        small = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(small, "a")
        turned = joined.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        after = stored(turned.unionByName(small.select("a", F.col("m").alias("b"))).distinct(), "edges")
        total = [F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))]
        same = now.agg(*total).first() == after.agg(*total).first()
        now = after
        if same:
            break
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def linked_components(docs: DataFrame, percent: int = 80, words: int = 5, id_col: str = "doc_id", text_col: str = "text", region_limit: int = REGION) -> DataFrame:
    """doc_id, text_hash, n_shingles, component_id of every row of ``docs``.

    Texts link when 100 * |shared shingles| >= ``percent`` * |all their shingles|; component_id is the
    smallest id reachable by links. Shingles are 64-bit hashes, equal sets one node.

    1. One pass hashes all texts and deals the shingles of distinct sets to parts by value; each part
       lists per set the shingles that others have too. Very common shingles, found in a sample, skip
       the counting as shared, so none gathers in one part.
    2. Sets with fewer shared shingles than a link needs go. The rest list as many of their rarest
       shingles as can be missing from a link, plus one; each with two sets or more is a region.
    3. Regions are joined exactly, larger ones than ``region_limit`` in slices; links become components.

    A NULL text has no shingles and links with nothing, nor does a text without words; fewer words
    than ``words`` are one shingle. NULL ids are ignored as component_id unless a component has no other.
    """
    own = identified(docs, id_col, text_col)
    size = own.agg(F.count(F.lit(1)).alias("rows"), F.sum(F.octet_length("text")).alias("bytes")).first()
    parts = max(parallelism(docs.sparkSession), (size["bytes"] or 0) // PART_BYTES)
    dealt = own.mapInArrow(_deal(parts, words, _common_tokens(own, words, size["rows"])), DEALT)
    found = stored(dealt.repartitionById(parts, F.col("part")).mapInArrow(_shared, SHARED), "shared-shingles")
    members = found.where("is_doc").select("doc_id", "text_hash", "set_id", "n")
    lists = found.where("NOT is_doc").select("set_id", "n", "tokens", "often")
    need = F.ceil(F.col("n") * percent / F.lit(100.0))
    gathered = lists.groupBy("set_id").agg(
        F.max("n").alias("n"), F.flatten(F.collect_list("tokens")).alias("tokens"), F.flatten(F.collect_list("often")).alias("often")
    )
    gathered = gathered.where(F.size("tokens") >= need)
    ranked = F.array_sort(F.arrays_zip(F.col("often"), F.col("tokens")))
    sets = stored(gathered.select("set_id", "n", ranked.alias("ranked")), "linkable-sets")
    missing = (F.size("ranked") - need + 1).cast("int")
    rare = sets.select("set_id", "n", F.explode(F.transform(F.slice("ranked", F.lit(1), missing), lambda t: t["tokens"])).alias("token"))
    pivots = rare.groupBy("token").agg(F.min(F.struct("n", "set_id")).alias("pivot"), F.count(F.lit(1)).alias("sets")).where("sets > 1")
    regions = stored(rare.select("token", "set_id").join(pivots.select("token", F.xxhash64("pivot.set_id").alias("region")), "token").select("region", "set_id").distinct(), "regions")
    sized = regions.groupBy("region").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
    crowded = stored(sized.where(F.col("members") > region_limit), "crowded")
    weight = F.aggregate("ranked", F.lit(0.0), lambda a, t: a + t["often"])
    full = regions.join(sized, "region").join(sets.select("set_id", "n", F.transform("ranked", lambda t: t["tokens"]).alias("tokens"), weight.alias("weight")), "set_id")
    whole = full.where(F.col("members") <= region_limit).select("region", "set_id", "n", "tokens", F.lit(True).alias("asks"))
    edges = whole.repartition("region").sortWithinPartitions("region").mapInArrow(_whole_regions(percent), EDGES)
    if not crowded.isEmpty():
        edges = edges.unionByName(_crowded(full.select("region", "set_id", "n", "tokens", "weight"), crowded, percent, region_limit))
    roots = components(edges)
    smallest = members.where("n > 0").groupBy("set_id").agg(F.min("doc_id").alias("least_id"), F.count(F.lit(1)).alias("docs"))
    grouped = smallest.join(roots, smallest["set_id"] == roots["node"], "left").select("set_id", "least_id", "docs", F.coalesce("root", "set_id").alias("root"), F.col("root").isNotNull().alias("linked"))
    least = grouped.where("linked").groupBy("root").agg(F.min("least_id").alias("component_id"))
    answers = grouped.where("linked").join(least, "root").select("set_id", "component_id").unionByName(grouped.where("NOT linked AND docs > 1").select("set_id", F.col("least_id").alias("component_id")))
    out = members.alias("m").join(answers.alias("a"), "set_id", "left")
    alone = F.coalesce(F.col("a.component_id"), F.col("m.doc_id"))
    return out.select("m.doc_id", "m.text_hash", F.col("m.n").cast("bigint").alias("n_shingles"), F.when(F.col("m.n") > 0, alone).otherwise(F.col("m.doc_id")).alias("component_id"))
