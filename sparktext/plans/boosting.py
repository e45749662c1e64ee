"""Gradient-boosted trees for several classes: one softmax objective, trees grown from shared histograms.

Features are cut at quantiles once and kept as one byte each, in blocks of rows. A round grows one
tree per class, all of them together: for a level, every task sums the gradients and Hessians of its
rows per (feature, open node, bin), the sums of a feature meet in one task, which finds its best
splits, and the driver gets one row per feature chunk and node. So a round takes a job per
level, whatever the number of classes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparktext.plans.saving import Parts, Saved
from sparktext.session import materialize, parallelism

# Bytes of binned features in one block; rounds after which the margins of all rows are stored anew.
BLOCK_BYTES = 2 << 20
STORE_ROUNDS = 25
# Features whose sums travel in one row.
CHUNK = 8
LEAST_GAIN = 1e-6
# Bytes of sums whose splits are sought at once.
SPLIT_BYTES = 1 << 20
BLOCKS = "labels binary, bins binary, margins binary"
SUMS = "chunk int, sums binary"
SPLITS = "slot int, gain double, feature int, bin int, left_g double, left_h double, g double, h double"


@dataclass(frozen=True)
class BoostingOptions:
    """``gamma`` is the least gain of a split that has no better one below it."""

    n_estimators: int = 100
    max_depth: int = 3
    learning_rate: float = 0.1
    gamma: float = 0.0
    reg_lambda: float = 1.0
    min_child_weight: float = 1.0
    bins: int = 64


def cut_points(df: DataFrame, column: str, bins: int) -> list[np.ndarray]:
    """Ascending upper bounds of the bins of every feature: approximate quantiles, taken without NaN."""
    shares = F.array(*[F.lit(i / bins) for i in range(1, bins)])
    long = df.select(F.posexplode(vector_to_array(column)).alias("feature", "x")).where(~F.isnan("x"))
    rows = long.groupBy("feature").agg(F.percentile_approx("x", shares, 20 * bins).alias("cuts")).collect()
    width = len(df.select(vector_to_array(column).alias("v")).first()["v"])
    found = {r["feature"]: np.unique(np.array(r["cuts"], np.float64)) for r in rows}
    return [found.get(f, np.zeros(0)) for f in range(width)]


def binned(x: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
    """Bin of every value: the number of cuts below it; NaN is below all."""
    x = np.where(np.isnan(x), -np.inf, x)
    out = np.empty(x.shape, np.uint8)
    for f, own in enumerate(cuts):
        out[:, f] = np.searchsorted(own, x[:, f], "left")
    return out


def leaves(bins: np.ndarray, feature: np.ndarray, split: np.ndarray, depth: int) -> np.ndarray:
    """(row, class): node of each row after ``depth`` steps. Children of node i are 2i+1 and 2i+2; a node
    without a feature (-1) keeps its rows."""
    classes = np.arange(len(feature))
    rows = np.arange(len(bins))[:, None]
    node = np.zeros((len(bins), len(feature)), np.int64)
    for _ in range(depth):
        f = feature[classes, node]
        right = bins[rows, np.maximum(f, 0)] > split[classes, node]
        node = np.where(f >= 0, 2 * node + 1 + right, node)
    return node


def gradients(margins: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """(gradient, Hessian bound 2p(1-p), sum of the losses) of the softmax loss."""
    p = np.exp(margins - margins.max(1, keepdims=True))
    p /= p.sum(1, keepdims=True)
    at = np.arange(len(labels))
    loss = -np.log(np.maximum(p[at, labels], 1e-15)).sum()
    g = p.copy()
    g[at, labels] -= 1
    return g, np.maximum(2 * p * (1 - p), 1e-16), float(loss)


def histogram(bins: np.ndarray, node: np.ndarray, g: np.ndarray, h: np.ndarray, slots: np.ndarray, n_bins: int) -> np.ndarray:
    """Sums (feature, slot, bin, gradient or Hessian); ``slots`` (class, node) numbers the open nodes, -1 for others."""
    width, count = bins.shape[1], int(slots.max(initial=-1)) + 1
    slot = slots[np.arange(len(slots)), node]
    row, k = np.nonzero(slot >= 0)
    out = np.zeros((width, count, n_bins, 2))
    if len(row):
        base = slot[row, k] * n_bins
        values = g[row, k], h[row, k]
        columns = np.ascontiguousarray(bins.T)
        for f in range(width):
            at = base + columns[f].take(row)
            for i, value in enumerate(values):
                out[f, :, :, i] = np.bincount(at, value, count * n_bins).reshape(count, n_bins)
    return out


def best_splits(sums: np.ndarray, reg: float, least_h: float) -> tuple[np.ndarray, ...]:
    """Per slot: gain, feature, bin, left gradient and Hessian, those of the node. Among equal gains the first
    feature and bin count; without a split the gain is -inf. A few slots at a time, as slots do not meet and the
    sums of all of them are read from memory again by each step."""
    step = max(1, SPLIT_BYTES // max(1, sums[:, :1].nbytes))
    parts = [_best_splits(sums[:, at : at + step], reg, least_h) for at in range(0, max(1, sums.shape[1]), step)]
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def _best_splits(sums: np.ndarray, reg: float, least_h: float) -> tuple[np.ndarray, ...]:
    left = np.cumsum(sums, axis=2)
    total = left[:1, :, -1:, :]
    right = total - left
    score = lambda s: s[..., 0] ** 2 / (s[..., 1] + reg)
    gain = score(left) + score(right) - score(total)
    gain[(left[..., 1] < least_h) | (right[..., 1] < least_h)] = -np.inf
    width, count, n_bins = gain.shape
    flat = gain.transpose(1, 0, 2).reshape(count, width * n_bins)
    at, s = flat.argmax(1), np.arange(count)
    f, b = at // n_bins, at % n_bins
    chosen = left[f, s, b]
    return flat[s, at], f, b, chosen[:, 0], chosen[:, 1], total[0, :, 0, 0], total[0, :, 0, 1]


class Round:
    """The trees of one round while they grow, a row per class."""

    def __init__(self, classes: int, options: BoostingOptions):
        nodes = (2 << options.max_depth) - 1
        self.options = options
        self.feature = np.full((classes, nodes), -1, np.int32)
        self.split = np.zeros((classes, nodes), np.int32)
        self.value = np.zeros((classes, nodes))
        self.gain = np.zeros((classes, nodes))
        self.weight = np.full((classes, nodes), np.inf)

    def slots(self, level: int) -> np.ndarray:
        """(class, node): numbers of the nodes of a level that may be split, -1 for all others."""
        at = np.arange((1 << level) - 1, (2 << level) - 1)
        open_ = self.weight[:, at] >= 2 * self.options.min_child_weight
        if level:
            open_ &= self.feature[:, (at - 1) // 2] >= 0
        out = np.full(self.feature.shape, -1, np.int64)
        k, n = np.nonzero(open_)
        out[k, at[n]] = np.arange(len(k))
        return out

    def grow(self, slots: np.ndarray, gain, feature, split, left_g, left_h, g, h) -> None:
        """Take the best split of every open node; arrays by slot."""
        k, at = np.nonzero(slots >= 0)  # in order of their numbers
        worth = lambda g, h: -self.options.learning_rate * g / (h + self.options.reg_lambda)
        root = at == 0
        self.value[k[root], 0] = worth(g[root], h[root])
        taken = gain > LEAST_GAIN
        k, at, gain, feature, split, left_g, left_h, g, h = (x[taken] for x in (k, at, gain, feature, split, left_g, left_h, g, h))
        self.feature[k, at], self.split[k, at], self.gain[k, at] = feature, split, gain
        for child, own_g, own_h in ((2 * at + 1, left_g, left_h), (2 * at + 2, g - left_g, h - left_h)):
            self.value[k, child], self.weight[k, child] = worth(own_g, own_h), own_h

    def prune(self) -> None:
        """From the leaves up, undo splits below ``gamma`` that have no split beneath them."""
        for at in range(self.feature.shape[1] // 2 - 1, -1, -1):
            kept = self.feature[:, 2 * at + 1] >= 0
            kept |= self.feature[:, 2 * at + 2] >= 0
            self.feature[(self.gain[:, at] < self.options.gamma) & ~kept, at] = -1

    def margins(self, bins: np.ndarray) -> np.ndarray:
        node = leaves(bins, self.feature, self.split, self.options.max_depth)
        return self.value[np.arange(len(self.value)), node]


def fit_in_memory(bins: np.ndarray, labels: np.ndarray, classes: int, options: BoostingOptions) -> Iterator[Round]:
    """The rounds of rows that one task holds, by the same steps; for grids of many small models."""
    margins = np.zeros((len(bins), classes))
    n_bins = int(bins.max(initial=0)) + 1
    for _ in range(options.n_estimators):
        g, h, _ = gradients(margins, labels)
        now = Round(classes, options)
        for level in range(options.max_depth):
            slots = now.slots(level)
            if slots.max() < 0:
                break
            node = leaves(bins, now.feature, now.split, level)
            now.grow(slots, *best_splits(histogram(bins, node, g, h, slots, n_bins), options.reg_lambda, options.min_child_weight))
        now.prune()
        margins += now.margins(bins)
        yield now


def _packed(cuts: list[np.ndarray], classes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = max(64, BLOCK_BYTES // max(1, len(cuts)))
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                x = part.column("x").flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1)
                labels = part.column("label").to_numpy(zero_copy_only=False).astype("i4")
                blobs = [labels.tobytes(), binned(x, cuts).tobytes(), np.zeros((len(labels), classes)).tobytes()]
                yield pa.RecordBatch.from_arrays([pa.array([b], pa.binary()) for b in blobs], ["labels", "bins", "margins"])

    return run


def _blocks(batches: Iterator[pa.RecordBatch], width: int, classes: int, rounds: list[Round]):
    for batch in batches:
        for i in range(batch.num_rows):
            labels = np.frombuffer(batch.column("labels")[i].as_py(), "i4")
            bins = np.frombuffer(batch.column("bins")[i].as_py(), "u1").reshape(-1, width)
            margins = np.frombuffer(batch.column("margins")[i].as_py(), "f8").reshape(-1, classes).copy()
            for r in rounds:
                margins += r.margins(bins)
            yield batch.slice(i, 1), labels, bins, margins


def _advanced(width: int, classes: int, rounds: list[Round]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, _, _, margins in _blocks(batches, width, classes, rounds):
            yield pa.RecordBatch.from_arrays([row.column("labels"), row.column("bins"), pa.array([margins.tobytes()], pa.binary())], ["labels", "bins", "margins"])

    return run


def _level_sums(width: int, classes: int, rounds: list[Round], now: Round, level: int, n_bins: int):
    """Sums of a task's rows, a row per chunk of features; chunk -1 holds (loss, rows)."""
    slots = now.slots(level)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, loss, n = None, 0.0, 0
        for _, labels, bins, margins in _blocks(batches, width, classes, rounds):
            g, h, own = gradients(margins, labels)
            sums = histogram(bins, leaves(bins, now.feature, now.split, level), g, h, slots, n_bins)
            total = sums if total is None else total + sums
            loss, n = loss + own, n + len(labels)
        if total is not None:
            parts = [(-1, np.array([loss, n]))] + [(c, total[c * CHUNK : (c + 1) * CHUNK]) for c in range(-(-width // CHUNK))]
            yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in parts], pa.int32()), pa.array([x.tobytes() for _, x in parts], pa.binary())], ["chunk", "sums"])

    return run


def _chunk_splits(slots: int, n_bins: int, options: BoostingOptions):
    """Adds the sums of each chunk, which come together, and finds its best splits; chunk -1 is passed on
    as (slot -1, gain loss, left_h rows)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            for chunk, blob in zip(*[batch.column(c).to_pylist() for c in ("chunk", "sums")], strict=True):
                own = np.frombuffer(blob)
                totals[chunk] = own if chunk not in totals else totals[chunk] + own
        rows = []
        for chunk, sums in sorted(totals.items()):
            if chunk < 0:
                rows.append((-1, sums[0], 0, 0, 0.0, sums[1], 0.0, 0.0))
                continue
            gain, f, *rest = best_splits(sums.reshape(-1, slots, n_bins, 2), options.reg_lambda, options.min_child_weight)
            rows += zip(range(slots), gain, f + chunk * CHUNK, *rest, strict=True)
        if rows:
            kinds = [pa.int32(), pa.float64(), pa.int32(), pa.int32(), *[pa.float64()] * 4]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], [c.split()[0] for c in SPLITS.split(", ")])

    return run


@dataclass
class Trees:
    """All trees of a model: arrays (round, class, node); ``threshold`` is the largest value that goes left."""

    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray
    losses: list[float] = field(default_factory=list)

    @classmethod
    def of(cls, rounds: list[Round], cuts: list[np.ndarray], losses: list[float]) -> Trees:
        feature = np.stack([r.feature for r in rounds])
        threshold = np.zeros(feature.shape)
        for at in np.argwhere(feature >= 0):
            r, k, n = at
            own = cuts[feature[r, k, n]]
            split = rounds[r].split[k, n]
            threshold[r, k, n] = own[split] if split < len(own) else np.inf
        return cls(feature, threshold, np.stack([r.value for r in rounds]), losses)

    def staged(self, x: np.ndarray) -> Iterator[np.ndarray]:
        """Margins (row, class) after each round."""
        x = np.where(np.isnan(x), -np.inf, x)
        depth = int(self.feature.shape[2] + 1).bit_length() - 2
        margins = np.zeros((len(x), self.feature.shape[1]))
        classes = np.arange(self.feature.shape[1])
        for feature, threshold, value in zip(self.feature, self.threshold, self.value, strict=True):
            margins = margins + value[classes, leaves(x, feature, threshold, depth)]
            yield margins

    def margins(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros((len(x), self.feature.shape[1]))
        for out in self.staged(x):  # noqa: B007
            pass
        return out


def _matrix(v: pa.Array) -> np.ndarray:
    return v.flatten().to_numpy(zero_copy_only=False).reshape(len(v), -1) if len(v) else np.zeros((0, 1))


class SoftmaxBoosting(Estimator):
    """Boosted trees on a vector column; labels are whole numbers from 0.

    A row with a NULL label or vector is left out; NaN counts as the smallest value. A task holds the sums of
    one level: features x open nodes of all classes x bins x 16 bytes. ``cuts``: bounds of the bins, if known.
    """

    def __init__(self, options: BoostingOptions = BoostingOptions(), features_col: str = "features", label_col: str = "label", cuts: list[np.ndarray] | None = None):
        super().__init__()
        self.options, self.features_col, self.label_col, self.cuts = options, features_col, label_col, cuts

    def setFeaturesCol(self, name: str) -> SoftmaxBoosting:
        self.features_col = name
        return self

    def _fit(self, dataset: DataFrame) -> BoostedTrees:
        o = self.options
        if o.bins > 256:
            raise ValueError("a bin is kept in one byte; at most 256 bins")
        known = dataset.where(F.col(self.label_col).isNotNull() & F.col(self.features_col).isNotNull())
        size = known.agg(F.max(F.col(self.label_col).cast("int")).alias("last"), F.count(F.lit(1)).alias("rows")).first()
        if size["last"] is None:
            raise ValueError("no labelled rows to fit on")
        classes = size["last"] + 1
        cuts = cut_points(known, self.features_col, o.bins) if self.cuts is None else self.cuts
        rows = known.select(F.col(self.label_col).cast("int").alias("label"), vector_to_array(self.features_col).alias("x"))
        # No more tasks than there are blocks to fill.
        rows = rows.coalesce(max(1, size["rows"] * len(cuts) // BLOCK_BYTES))
        data = materialize(rows.mapInArrow(_packed(cuts, classes), BLOCKS))
        self.tasks = data.rdd.getNumPartitions()
        rounds: list[Round] = []
        fresh: list[Round] = []
        losses: list[float] = []
        n_bins = max(len(c) for c in cuts) + 1
        for _ in range(o.n_estimators):
            now = Round(classes, o)
            for level in range(o.max_depth):
                slots = now.slots(level)
                if slots.max() < 0:
                    break
                loss, best = self._level(data, len(cuts), classes, fresh, now, level, n_bins)
                if level == 0:
                    losses.append(loss)
                now.grow(slots, *best)
            now.prune()
            rounds.append(now)
            fresh.append(now)
            if len(fresh) == STORE_ROUNDS:
                data, fresh = materialize(data.mapInArrow(_advanced(len(cuts), classes, fresh), BLOCKS)), []
        trees = Trees.of(rounds, cuts, losses)
        return BoostedTrees(trees, self.features_col, self.label_col)

    def _level(self, data: DataFrame, width: int, classes: int, fresh: list[Round], now: Round, level: int, n_bins: int) -> tuple[float, tuple[np.ndarray, ...]]:
        """(mean loss before the round, the best splits by slot)."""
        add = _level_sums(width, classes, fresh, now, level, n_bins)
        choose = _chunk_splits(int(now.slots(level).max()) + 1, n_bins, self.options)
        if self.tasks > 1:
            sums = data.mapInArrow(add, SUMS).repartition(min(-(-width // CHUNK), parallelism(data.sparkSession)), "chunk")
            splits = sums.mapInArrow(choose, SPLITS).toPandas()
        else:
            splits = data.mapInArrow(lambda batches: choose(add(batches)), SPLITS).toPandas()
        loss = splits[splits["slot"] < 0].iloc[0]
        best = splits[splits["slot"] >= 0].sort_values(["slot", "gain", "feature"], ascending=[True, False, True]).drop_duplicates("slot")
        return float(loss["gain"] / loss["left_h"]), tuple(best[c].to_numpy() for c in best.columns[1:])


class BoostedTrees(Model, Saved):
    """Adds ``probability`` (a vector) and ``prediction``, the first class with the largest margin."""

    def __init__(self, trees: Trees, features_col: str = "features", label_col: str = "label"):
        super().__init__()
        self.trees, self.features_col, self.label_col = trees, features_col, label_col

    def parts(self) -> Parts:
        t = self.trees
        arrays = {"feature": t.feature, "threshold": t.threshold, "value": t.value, "losses": np.array(t.losses, float)}
        return Parts({"features_col": self.features_col, "label_col": self.label_col}, arrays)

    @classmethod
    def of_parts(cls, parts: Parts) -> BoostedTrees:
        a = parts.arrays
        return cls(Trees(a["feature"], a["threshold"], a["value"], a["losses"].tolist()), **parts.settings)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        trees = self.trees

        @F.arrow_udf("array<double>")
        def scored(v: pa.Array) -> pa.Array:
            margins = trees.margins(_matrix(v))
            p = np.exp(margins - margins.max(1, keepdims=True, initial=-np.inf))
            p /= p.sum(1, keepdims=True)
            return pa.FixedSizeListArray.from_arrays(pa.array(p.ravel()), p.shape[1]).cast(pa.list_(pa.float64()))

        wide = dataset.withColumn("_p", scored(vector_to_array(self.features_col)))
        best = (F.array_position("_p", F.array_max("_p")) - 1).cast("double")
        return wide.withColumn("probability", array_to_vector("_p")).withColumn("prediction", best).drop("_p")

    def staged_losses(self, df: DataFrame) -> DataFrame:
        """(class -1, round from 1, loss): mean softmax loss on labelled rows after each round, in one pass."""
        trees, classes = self.trees, self.trees.feature.shape[1]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            losses, n = np.zeros(len(trees.feature)), 0
            for batch in batches:
                labels = batch.column("label").to_numpy(zero_copy_only=False)
                known = labels < classes
                own = labels[known]
                for i, margins in enumerate(trees.staged(_matrix(batch.column("x"))[known])):
                    losses[i] += gradients(margins, own)[2]
                losses += (~known).sum() * -np.log(1e-15)  # a class never met
                n += len(labels)
            at = np.arange(1, len(losses) + 1, dtype="i4")
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(losses), pa.array(np.full(len(at), n))], ["round", "loss", "n"])

        rows = df.where(F.col(self.label_col).isNotNull()).select(F.col(self.label_col).cast("int").alias("label"), vector_to_array(self.features_col).alias("x"))
        summed = rows.mapInArrow(run, "round int, loss double, n bigint").groupBy("round").agg(F.sum("loss").alias("loss"), F.sum("n").alias("n"))
        return summed.where("n > 0").select(F.lit(-1).alias("class"), "round", (F.col("loss") / F.col("n")).alias("loss"))
