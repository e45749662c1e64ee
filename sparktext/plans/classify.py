"""Training, tuning and prediction on vector columns with MLlib."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from itertools import product

import numpy as np
import pandas as pd
from pyspark.ml import Estimator, Model, Pipeline
from pyspark.ml.classification import (
    LinearSVC,
    LogisticRegression,
    MultilayerPerceptronClassifier,
    NaiveBayes,
    OneVsRest,
    OneVsRestModel,
    RandomForestClassifier,
)
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparktext.functions.arrays import one_hot
from sparktext.operators.sampling import stratified_folds, train_test_split
from sparktext.plans import grids
from sparktext.plans.boosting import BoostedTrees, BoostingOptions, SoftmaxBoosting
from sparktext.plans.kernel import CalibratedSVM, CalibratedSVMModel, NystroemMap
from sparktext.plans.saving import Parts, Saved

# Accepted classifier names, and the tuning grids by name.
ALIASES = {"xgboost": "XGBClassifier", "logistic_regression": "LogisticRegression", "svm": "SVM"}
GRIDS = {
    "LogisticRegression": {"max_iter": [100, 1000, 4000], "C": [0.5, 0.7, 0.9, 1], "tol": [1e-3, 1e-4, 1e-5]},
    "SVM": {"C": [0.5, 0.7, 0.9, 1], "kernel": ["linear", "rbf"], "gamma": ["scale", "auto"], "tol": [1e-2, 1e-3, 1e-4]},
    "XGBClassifier": {"learning_rate": [0.01, 0.1, 0.2], "max_depth": [3, 5, 7], "n_estimators": [100, 300, 600], "gamma": [0, 0.1, 0.2]},
}
TUNING_GRID = {"learning_rate": [0.01, 0.1, 0.2], "max_depth": [3, 5, 7], "n_estimators": [50, 100, 200]}


# MLlib makes dense sums of features by classes for every block of rows and every task, whatever their rows hold.
BLOCK_MB = 64.0


def dealt(df: DataFrame) -> DataFrame:
    """Stored training rows in one partition for each core at most: an iteration moves a model's sums per partition."""
    return df.coalesce(df.sparkSession.sparkContext.defaultParallelism)


def dense_vectors(df: DataFrame, column: str = "embedding", output: str = "features") -> DataFrame:
    return df.withColumn(output, array_to_vector(F.col(column).cast("array<double>")))


PARAMETERS = {
    "LogisticRegression": {"max_iter", "C", "tol"},
    "SVM": {"max_iter", "C", "tol", "kernel", "gamma", "n_components", "kernel_map"},
    "XGBClassifier": {"learning_rate", "max_depth", "n_estimators", "gamma"},
    "RandomForest": {"n_estimators", "criterion", "max_depth"},
    "NaiveBayes": {"alpha"},
    "NeuralNetwork": {"hidden", "max_iter"},
}
# Settings of a run, and those that restate what a classifier here does anyway.
RUN_PARAMETERS = {"normalize", "grid_search", "grid", "folds", "random_state", "probability", "num_class"}
IMPLIED = {"penalty": "l2", "solver": "lbfgs", "objective": "multi:softmax", "eval_metric": "mlogloss"}


def _checked(name: str, params: Mapping | None) -> tuple[str, dict]:
    name = ALIASES.get(name, name)
    if name not in PARAMETERS:
        raise ValueError(f"unknown classifier {name!r}")
    given = {k: v for k, v in (params or {}).items() if IMPLIED.get(k, _checked) != v}
    unknown = set(given) - PARAMETERS[name] - RUN_PARAMETERS
    if unknown:
        raise ValueError(f"{name} has no parameter {', '.join(sorted(unknown))}")
    return name, dict(params or {})


class FourierMap(Estimator):
    """Adds ``mapped``, features whose dot products approach the RBF kernel of an input vector.

    ``gamma`` is a number, "auto" for 1/dim, or "scale" for 1/(dim * variance of all entries), which
    ``fit`` measures. The projection is seeded.
    """

    def __init__(self, gamma: float | str = "scale", components: int = 256, source: str = "features", seed: int = 42):
        super().__init__()
        self.gamma, self.components, self.source, self.seed = gamma, components, source, seed

    def _fit(self, dataset: DataFrame) -> FittedFourierMap:
        vectors = dataset.select(vector_to_array(self.source).alias("v"))
        dim, gamma = len(vectors.first()["v"]), self.gamma
        if gamma == "scale":
            gamma = scale_gamma(vectors, "v", dim)
        return FittedFourierMap(1.0 / dim if gamma == "auto" else float(gamma), dim, self.components, self.source, self.seed)


class FittedFourierMap(Model, Saved):
    def __init__(self, gamma: float, dim: int, components: int, source: str, seed: int):
        super().__init__()
        self.gamma, self.dim, self.components, self.source, self.seed = gamma, dim, components, source, seed

    def parts(self) -> Parts:
        return Parts({"gamma": self.gamma, "dim": self.dim, "components": self.components, "source": self.source, "seed": self.seed})

    @classmethod
    def of_parts(cls, parts: Parts) -> FittedFourierMap:
        return cls(**parts.settings)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        wide = dataset.withColumn("_dense", vector_to_array(self.source))
        out = random_fourier_features(wide, "_dense", self.dim, self.components, self.gamma, self.seed, "_mapped")
        return out.withColumn("mapped", array_to_vector("_mapped")).drop("_dense", "_mapped")


def make_classifier(name: str, n_rows: int, params: Mapping | None = None, n_features: int = 0, n_classes: int = 2) -> Estimator:
    """Unfitted classifier by name; a parameter it does not have raises.

    ``C`` is the inverse penalty per data set, hence 1/(C*n) here. An SVM has the RBF kernel unless
    ``kernel="linear"``: a linear SVM on ``n_components`` features, from landmarks of the data
    (``kernel_map="nystroem"``) or random Fourier ones ("fourier", the default). With ``probability`` it is
    calibrated on a held-out fifth of the rows.
    """
    name, p = _checked(name, params)
    stages: list[Estimator] = []
    source = "features"
    if p.get("normalize"):
        source = "scaled"
        stages.append(StandardScaler(withMean=False, withStd=True, inputCol="features", outputCol=source))
    if name == "LogisticRegression":
        model: Estimator = LogisticRegression(
            family="multinomial",
            maxIter=p.get("max_iter", 100),
            tol=p.get("tol", 1e-4),
            regParam=1.0 / (p.get("C", 1.0) * max(1, n_rows)),
            elasticNetParam=0.0,
            standardization=False,
            maxBlockSizeInMB=BLOCK_MB,
        )
    elif name == "SVM":
        kernel = p.get("kernel", "rbf")
        if kernel not in ("linear", "rbf"):
            raise ValueError(f"unknown kernel {kernel!r}; expected linear or rbf")
        machine = LinearSVC(
            maxIter=p.get("max_iter", 100), tol=p.get("tol", 1e-3), regParam=1.0 / (p.get("C", 1.0) * max(1, n_rows)), standardization=False
        )
        model = CalibratedSVM(machine) if p.get("probability") else OneVsRest(classifier=machine, parallelism=4)
        if kernel == "rbf":
            kernel_map = p.get("kernel_map", "fourier")
            if kernel_map not in ("fourier", "nystroem"):
                raise ValueError(f"unknown kernel map {kernel_map!r}; expected fourier or nystroem")
            kind = NystroemMap if kernel_map == "nystroem" else FourierMap
            stages.append(kind(p.get("gamma", "scale"), p.get("n_components", 256), source))
            source = "mapped"
    elif name == "XGBClassifier":
        model = SoftmaxBoosting(
            BoostingOptions(p.get("n_estimators", 100), p.get("max_depth", 3), p.get("learning_rate", 0.1), p.get("gamma", 0.0))
        )
    elif name == "RandomForest":
        model = RandomForestClassifier(
            numTrees=p.get("n_estimators", 300), impurity=p.get("criterion", "entropy"), maxDepth=p.get("max_depth", 10), seed=42
        )
    elif name == "NaiveBayes":
        model = NaiveBayes(modelType="multinomial", smoothing=p.get("alpha", 1.0))
    else:
        hidden = list(p.get("hidden", [512]))
        model = MultilayerPerceptronClassifier(layers=[n_features, *hidden, n_classes], maxIter=p.get("max_iter", 100), seed=42)
    model.setFeaturesCol(source)
    return Pipeline(stages=[*stages, model]) if stages else model


def random_fourier_features(df: DataFrame, column: str, dim: int, n_features: int = 256, gamma: float | None = None, seed: int = 42, output: str = "features_array") -> DataFrame:
    """Feature map whose dot products approach the RBF kernel; one seeded projection, Arrow batches.

    ``gamma=None`` means 1/dim.
    """
    rng = np.random.default_rng(seed)
    g = 1.0 / dim if gamma is None else gamma
    weights = rng.normal(0.0, np.sqrt(2 * g), (dim, n_features))
    shift = rng.uniform(0, 2 * np.pi, n_features)

    @F.pandas_udf("array<double>")
    def project(v: pd.Series) -> pd.Series:
        x = np.vstack(v.to_numpy()) if len(v) else np.zeros((0, dim))
        return pd.Series(list(np.sqrt(2.0 / n_features) * np.cos(x @ weights + shift)))

    return df.withColumn(output, project(F.col(column).cast("array<double>")))


def scale_gamma(df: DataFrame, column: str, dim: int) -> float:
    """Kernel width ``scale``: 1 / (dim * variance over all entries)."""
    row = df.select(F.explode(column).alias("x")).agg(F.var_pop(F.col("x").cast("double")).alias("v")).first()
    return 1.0 / (dim * row["v"]) if row["v"] else 1.0


def predict(model: Model, df: DataFrame, key: str = "doc_id", keep: Sequence[str] = ()) -> DataFrame:
    return model.transform(df).select(key, *keep, F.col("prediction").cast("int").alias("prediction"))


def has_probabilities(model: Model) -> bool:
    stage = model.stages[-1] if hasattr(model, "stages") else model
    own = isinstance(stage, (BoostedTrees, CalibratedSVMModel))
    return own or (hasattr(stage, "setProbabilityCol") and not isinstance(stage, OneVsRestModel))


def predict_probabilities(model: Model, df: DataFrame, key: str = "doc_id", keep: Sequence[str] = ()) -> DataFrame:
    """(key, prediction, probabilities array, confidence)."""
    out = model.transform(df).select(
        key, *keep, F.col("prediction").cast("int").alias("prediction"), vector_to_array("probability").alias("probabilities")
    )
    return out.withColumn("confidence", F.array_max("probabilities"))


def grid_search(df: DataFrame, name: str, options: Mapping[str, Sequence] | None = None, params: Mapping | None = None, folds: int = 5, key: str = "doc_id", parallelism: int = 4, n_features: int = 0, n_classes: int = 2):
    """Cross-validated search by accuracy over every point of a grid, on the same stratified folds.

    ``df`` (key, label, features) is a training set that MLlib can hold in the cluster's memory.
    Returns the model of the best point, fitted on all rows, with ``points`` (a list of parameters
    and mean accuracy, in grid order), ``best_point`` and ``avgMetrics``. Logistic points share their passes
    over the data, boosted ones their models (see ``grids``); points of other
    classifiers are fitted ``parallelism`` at a time. An unknown option raises.
    """
    n = df.count()
    options = dict(options if options is not None else GRIDS[ALIASES.get(name, name)])
    points = [{**(params or {}), **dict(zip(options, values, strict=True))} for values in product(*options.values())]
    for point in points:
        _checked(name, point)
    kind = ALIASES.get(name, name)
    plain = not any(p.get("normalize") for p in points)
    if plain and kind == "LogisticRegression":
        scores = grids.logistic_points(df, points, folds, key)
    elif plain and kind == "XGBClassifier":
        scores = grids.boosted_points(df, points, folds, key)
    else:
        scores = _fitted_points(df, name, points, folds, key, parallelism, n, n_features, n_classes)
    best = int(np.argmax(scores))
    model = make_classifier(name, n, points[best], n_features, n_classes).fit(df)
    model.avgMetrics, model.best_point = scores, points[best]
    model.points = list(zip(points, scores, strict=True))
    return model


def _fitted_points(df: DataFrame, name: str, points: Sequence[dict], folds: int, key: str, parallelism: int, n: int, n_features: int, n_classes: int) -> list[float]:
    """Mean held-out accuracy of every point, each fitted by itself on every fold."""
    folded = stratified_folds(df, folds, "label", key).persist()
    evaluator = MulticlassClassificationEvaluator(metricName="accuracy")

    def accuracy(point: dict) -> float:
        found = []
        for fold in range(folds):
            train, held = folded.where(F.col("fold") != fold), folded.where(F.col("fold") == fold)
            found.append(evaluator.evaluate(make_classifier(name, n, point, n_features, n_classes).fit(train).transform(held)))
        return float(np.mean(found))

    try:
        with ThreadPoolExecutor(parallelism) as pool:
            return list(pool.map(accuracy, points))
    finally:
        folded.unpersist()


def tune(df: DataFrame, name: str = "XGBClassifier", options: Mapping[str, Sequence] | None = None, folds: int = 3, key: str = "doc_id"):
    """Search on 80 % of the rows; returns (model, accuracy on the held-out 20 %)."""
    split = train_test_split(df, 0.2, key)
    search = grid_search(split.where("split = 'train'").drop("split"), name, TUNING_GRID if options is None else options, folds=folds, key=key)
    held = search.transform(split.where("split = 'test'"))
    return search, MulticlassClassificationEvaluator(metricName="accuracy").evaluate(held)


def training_curve(model: Model, df: DataFrame) -> DataFrame:
    """(class, round, loss): per boosting round on ``df``, or per iteration of the optimiser. Class -1 stands
    for a loss of all classes together."""
    spark = df.sparkSession
    if hasattr(model, "stages"):
        for stage in model.stages[:-1]:
            df = stage.transform(df)
        model = model.stages[-1]
    if isinstance(model, BoostedTrees):
        return model.staged_losses(df)
    rows: list[tuple[int, int, float]] = []
    if hasattr(model, "models"):
        for c, part in enumerate(model.models):
            rows += [(c, i, float(x)) for i, x in enumerate(part.summary().objectiveHistory)]
    else:
        rows += [(-1, i, float(x)) for i, x in enumerate(model.summary.objectiveHistory)]
    return spark.createDataFrame(rows, "class int, round int, loss double")


def fuse_features(df: DataFrame, vectors: Sequence[str], codes: Mapping[str, int], output: str = "features") -> DataFrame:
    """Concatenate vector columns with one-hot codes; a code beyond its depth gives zeros.

    The result has no attribute for each feature: every task of every later pass would carry them all.
    """
    hot = {f"_{c}": array_to_vector(one_hot(c, depth).cast("array<double>")) for c, depth in codes.items()}
    wide = df.withColumns(hot)
    joined = VectorAssembler(inputCols=[*vectors, *hot], outputCol=output).transform(wide).drop(*hot)
    return joined.withColumn(output, F.col(output).alias(output, metadata={"ml_attr": {}}))
