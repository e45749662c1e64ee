"""Kernel features from landmarks, and linear machines with calibrated probabilities."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pyarrow as pa
from pyspark.ml import Estimator, Model
from pyspark.ml.classification import LinearSVC
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparktext.plans.saving import Parts, Saved
from sparktext.session import materialize

# One row in so many is held out to calibrate on.
HELD_OUT = 5
NEWTON_STEPS = 60


def _matrix(v: pa.Array) -> np.ndarray:
    return v.flatten().to_numpy(zero_copy_only=False).reshape(len(v), -1) if len(v) else np.zeros((0, 1))


def _lists(x: np.ndarray) -> pa.Array:
    ends = np.arange(len(x) + 1, dtype="i4") * x.shape[1]
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.ascontiguousarray(x, float).ravel()))


def rbf(x: np.ndarray, y: np.ndarray, gamma: float) -> np.ndarray:
    gaps = (x**2).sum(1)[:, None] + (y**2).sum(1)[None, :] - 2 * x @ y.T
    return np.exp(-gamma * np.maximum(gaps, 0.0))


def _width(vectors: DataFrame, gamma: float | str, dim: int) -> float:
    if gamma == "auto":
        return 1.0 / dim
    if gamma != "scale":
        return float(gamma)
    spread = vectors.select(F.explode("v").alias("x")).agg(F.var_pop("x")).first()[0]
    return 1.0 / (dim * spread) if spread else 1.0


def landmarks(vectors: DataFrame, count: int) -> np.ndarray:
    """``count`` distinct vectors of column ``v`` (all, if fewer), those of the smallest hashes: a sample that
    does not depend on order or partitions. Only hashes are shuffled; the driver gets ``count`` vectors."""
    hashed = vectors.where("v IS NOT NULL").withColumn("h", F.xxhash64("v"))
    least = hashed.select("h").distinct().orderBy("h").limit(count)
    found = hashed.join(F.broadcast(least), "h").groupBy("h").agg(F.min("v").alias("v")).orderBy("h")
    return np.array([r["v"] for r in found.collect()], float)


class NystroemMap(Estimator):
    """Adds ``mapped``: features whose dot products approach the RBF kernel of an input vector.

    The kernel among ``components`` landmarks of the data is inverted, so the features are exact on the landmarks
    and follow the data elsewhere. ``gamma`` is a number, "auto" for 1/dim, or "scale" for
    1/(dim * variance of all entries). The model holds components x dim numbers.
    """

    def __init__(self, gamma: float | str = "scale", components: int = 256, source: str = "features"):
        super().__init__()
        self.gamma, self.components, self.source = gamma, components, source

    def _fit(self, dataset: DataFrame) -> FittedNystroem:
        vectors = dataset.select(vector_to_array(self.source).alias("v"))
        points = landmarks(vectors, self.components)
        if not len(points):
            raise ValueError("no vectors to draw landmarks from")
        gamma = _width(vectors, self.gamma, points.shape[1])
        values, axes = np.linalg.eigh(rbf(points, points, gamma))
        held = values > values.max() * 1e-10
        return FittedNystroem(gamma, points, axes[:, held] / np.sqrt(values[held]), self.source)


class FittedNystroem(Model, Saved):
    """A NULL vector gives a NULL ``mapped``."""

    def __init__(self, gamma: float, points: np.ndarray, axes: np.ndarray, source: str = "features"):
        super().__init__()
        self.gamma, self.points, self.axes, self.source = gamma, points, axes, source

    def parts(self) -> Parts:
        return Parts({"gamma": float(self.gamma), "source": self.source}, {"points": self.points, "axes": self.axes})

    @classmethod
    def of_parts(cls, parts: Parts) -> FittedNystroem:
        return cls(**parts.settings, **parts.arrays)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        gamma, points, axes = self.gamma, self.points, self.axes

        @F.arrow_udf("array<double>")
        def mapped(v: pa.Array) -> pa.Array:
            known = np.asarray(v.is_valid())
            out = np.zeros((len(v), axes.shape[1]))
            if known.any():
                out[known] = rbf(_matrix(v.drop_null()), points, gamma) @ axes
            return _lists(out)

        wide = dataset.withColumn("_m", mapped(vector_to_array(self.source)))
        return wide.withColumn("mapped", F.when(F.col(self.source).isNotNull(), array_to_vector("_m"))).drop("_m")


def calibrate(scores: DataFrame, classes: int) -> np.ndarray:
    """(class, 2): slope and offset per class, so that 1/(1+exp(-(slope*z+offset))) is the chance of class.

    ``scores`` has columns label and z (one margin per class). Maximum likelihood with smoothed targets, by
    Newton steps; all classes share one aggregate a step, and a step that raises a class's loss is halved.
    """
    long = materialize(scores.select("label", F.posexplode("z").alias("c", "z")).withColumn("y", (F.col("label") == F.col("c")).cast("int")))
    sizes = {r["c"]: (r["n"], r["k"]) for r in long.groupBy("c").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("k")).collect()}
    n, k = (np.array([sizes.get(c, (0, 0))[i] for c in range(classes)], float) for i in (0, 1))
    high, low = (k + 1) / (k + 2), 1 / (n - k + 2)
    best = np.column_stack([np.zeros(classes), np.log((k + 1) / (n - k + 1))])
    trial, least = best.copy(), np.full(classes, np.inf)

    def of(values: np.ndarray):
        return F.get(F.array(*[F.lit(float(x)) for x in values]), F.col("c"))

    for _ in range(NEWTON_STEPS):
        line = of(trial[:, 0]) * F.col("z") + of(trial[:, 1])
        target = F.when(F.col("y") == 1, of(high)).otherwise(of(low))
        rows = long.select("c", "z", line.alias("l"), target.alias("t")).withColumn("p", 1 / (1 + F.exp(-F.col("l"))))
        loss = F.greatest("l", F.lit(0.0)) - F.col("l") * F.col("t") + F.log1p(F.exp(-F.abs("l")))
        w, off = F.col("p") * (1 - F.col("p")), F.col("p") - F.col("t")
        sums = [loss, off * F.col("z"), off, w * F.col("z") * F.col("z"), w * F.col("z"), w]
        got = rows.groupBy("c").agg(*[F.sum(s).alias(f"s{i}") for i, s in enumerate(sums)]).collect()
        moved = 0.0
        for r in got:
            c = r["c"]
            if r["s0"] <= least[c] + 1e-12 * abs(least[c] if np.isfinite(least[c]) else 0.0):
                best[c], least[c] = trial[c], r["s0"]
                hessian = np.array([[r["s3"], r["s4"]], [r["s4"], r["s5"]]]) + 1e-9 * np.eye(2)
                step = -np.linalg.solve(hessian, [r["s1"], r["s2"]])
            else:
                step = (trial[c] - best[c]) / 2
            trial[c] = best[c] + step
            moved = max(moved, float(np.abs(step).max() / (1 + np.abs(best[c]).max())))
        if moved < 1e-6:
            break
    return best


class CalibratedSVM(Estimator):
    """One-vs-rest linear machines whose margins are read as probabilities.

    A fifth of the rows, by a hash of the vector so that equal vectors stay together, is held out: machines fitted on
    the others give it margins, and a logistic curve per class is fitted to these. The machines of the model
    are fitted on all rows. ``prediction`` is the class of the largest margin, which need not be that of the
    largest probability. If no row or every row is held out, the curves are fitted to the training margins.
    """

    def __init__(self, machine: LinearSVC, features_col: str = "features", label_col: str = "label"):
        super().__init__()
        self.machine, self.features_col, self.label_col = machine, features_col, label_col

    def setFeaturesCol(self, name: str) -> CalibratedSVM:
        self.features_col = name
        return self

    def _machines(self, df: DataFrame, classes: int) -> tuple[np.ndarray, np.ndarray]:
        """(class, feature) weights and (class) offsets. A class without rows has margin -1 everywhere, the
        only class that has rows margin 1."""
        known = sorted(int(r[0]) for r in df.select(self.label_col).distinct().collect())
        width = len(df.select(vector_to_array(self.features_col)).first()[0])
        weights, offsets = np.zeros((classes, width)), np.full(classes, -1.0)
        if len(known) == 1:
            offsets[known[0]] = 1.0
            return weights, offsets
        machine = self.machine.copy().setFeaturesCol(self.features_col).setLabelCol("_own")

        def fit(c: int):
            return machine.fit(df.withColumn("_own", (F.col(self.label_col) == c).cast("double")))

        with ThreadPoolExecutor(4) as pool:
            for c, fitted in zip(known, pool.map(fit, known), strict=True):
                weights[c], offsets[c] = fitted.coefficients.toArray(), fitted.intercept
        return weights, offsets

    def _fit(self, dataset: DataFrame) -> CalibratedSVMModel:
        label = F.col(self.label_col)
        rows = dataset.where(label.isNotNull() & F.col(self.features_col).isNotNull())
        part = F.pmod(F.xxhash64(vector_to_array(self.features_col)), F.lit(HELD_OUT))
        rows = materialize(rows.select(label.cast("double").alias(self.label_col), self.features_col, part.alias("_part")))
        size = rows.agg(F.max(self.label_col).alias("last"), F.sum((F.col("_part") == 0).cast("long")).alias("held"), F.count(F.lit(1)).alias("n")).first()
        if size["last"] is None:
            raise ValueError("no labelled rows to fit on")
        classes = max(2, int(size["last"]) + 1)
        train, held = (rows, rows) if size["held"] in (0, size["n"]) else (rows.where("_part <> 0"), rows.where("_part = 0"))
        first = CalibratedSVMModel(*self._machines(train, classes), np.zeros((classes, 2)), self.features_col)
        curves = calibrate(held.select(F.col(self.label_col).cast("int").alias("label"), first.margins().alias("z")), classes)
        return CalibratedSVMModel(*self._machines(rows, classes), curves, self.features_col)


class CalibratedSVMModel(Model, Saved):
    """Adds ``probability`` (a vector that sums to one) and ``prediction``."""

    def __init__(self, weights: np.ndarray, offsets: np.ndarray, curves: np.ndarray, features_col: str = "features"):
        super().__init__()
        self.weights, self.offsets, self.curves, self.features_col = weights, offsets, curves, features_col

    def parts(self) -> Parts:
        return Parts({"features_col": self.features_col}, {"weights": self.weights, "offsets": self.offsets, "curves": self.curves})

    @classmethod
    def of_parts(cls, parts: Parts) -> CalibratedSVMModel:
        return cls(**parts.settings, **parts.arrays)

    def margins(self):
        weights, offsets = self.weights, self.offsets

        @F.arrow_udf("array<double>")
        def margin(v: pa.Array) -> pa.Array:
            return _lists(_matrix(v) @ weights.T + offsets if len(v) else np.zeros((0, len(offsets))))

        return margin(vector_to_array(self.features_col))

    def _transform(self, dataset: DataFrame) -> DataFrame:
        slopes, starts = (F.array(*[F.lit(float(x)) for x in self.curves[:, i]]) for i in (0, 1))
        wide = dataset.withColumn("_z", self.margins())
        chance = F.transform("_z", lambda z, i: 1 / (1 + F.exp(-(F.get(slopes, i) * z + F.get(starts, i)))))
        wide = wide.withColumn("_p", chance)
        total = F.aggregate("_p", F.lit(0.0), lambda a, x: a + x)
        wide = wide.withColumn("_t", total)
        even = F.lit(1.0 / len(self.offsets))
        shares = F.transform("_p", lambda p: F.when(F.col("_t") > 0, p / F.col("_t")).otherwise(even))
        best = (F.array_position("_z", F.array_max("_z")) - 1).cast("double")
        return wide.withColumn("probability", array_to_vector(shares)).withColumn("prediction", best).drop("_z", "_p", "_t")
