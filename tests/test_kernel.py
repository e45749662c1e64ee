"""Landmark features against the kernel, and calibrated machines on planted classes."""

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from sparktext.plans import classify, kernel


def table(spark, x, labels):
    rows = [(i, [float(a) for a in v], int(y)) for i, (v, y) in enumerate(zip(x, labels, strict=True))]
    return spark.createDataFrame(rows, "doc_id bigint, v array<double>, label int").select("doc_id", "label", array_to_vector("v").alias("features"))


@pytest.fixture(scope="module")
def rings(spark):
    """Three rings around one centre: no line parts them."""
    rng = np.random.default_rng(1)
    labels = rng.integers(0, 3, 600)
    angle, radius = rng.uniform(0, 2 * np.pi, 600), labels + 0.5 + rng.normal(0, 0.12, 600)
    return table(spark, np.column_stack([radius * np.cos(angle), radius * np.sin(angle)]), labels).persist()


def test_landmark_features_are_nearer_the_kernel_than_fourier_ones(rings):
    x = np.array([r.v for r in rings.orderBy("doc_id").select(vector_to_array("features").alias("v")).collect()])
    exact = kernel.rbf(x, x, 0.5)

    def error(maker):
        out = maker(0.5, 32).fit(rings).transform(rings).orderBy("doc_id").select(vector_to_array("mapped").alias("m"))
        m = np.array([r.m for r in out.collect()])
        return np.abs(m @ m.T - exact).mean()

    assert error(kernel.NystroemMap) < 0.2 * error(classify.FourierMap)


def test_landmarks_depend_on_values_alone(spark, rings):
    vectors = rings.select(vector_to_array("features").alias("v"))
    once = kernel.landmarks(vectors, 20)
    again = kernel.landmarks(vectors.unionByName(vectors).repartition(7), 20)
    assert once.shape == (20, 2) and (once == again).all()
    assert len(kernel.landmarks(spark.createDataFrame([([1.0, 2.0],)] * 5 + [(None,)], "v array<double>"), 20)) == 1


def test_calibration_is_the_maximum_of_the_likelihood(spark):
    rng = np.random.default_rng(2)
    z = rng.normal(0, 2, 3000)
    y = (rng.uniform(size=3000) < 1 / (1 + np.exp(-(1.5 * z - 0.7)))).astype(int)
    scores = spark.createDataFrame([(int(1 - b), [float(a), float(-a)]) for a, b in zip(z, y, strict=True)], "label int, z array<double>")
    curves = kernel.calibrate(scores, 2)
    assert np.allclose(curves[0], [1.5, -0.7], atol=0.25) and np.allclose(curves[1], [curves[0][0], -curves[0][1]], atol=1e-3)
    k = y.sum()
    target = np.where(y == 1, (k + 1) / (k + 2), 1 / (3000 - k + 2))
    off = 1 / (1 + np.exp(-(curves[0][0] * z + curves[0][1]))) - target
    assert abs(off.sum()) < 1e-3 and abs((off * z).sum()) < 1e-3


def test_probabilities_of_a_kernel_machine(rings):
    train, test = rings.where("doc_id % 4 <> 0"), rings.where("doc_id % 4 = 0")
    model = classify.make_classifier("SVM", 450, {"kernel_map": "nystroem", "probability": True, "n_components": 64, "C": 10.0, "max_iter": 20}).fit(train)
    assert classify.has_probabilities(model)
    rows = classify.predict_probabilities(model, test, keep=["label"]).collect()
    p = np.array([r.probabilities for r in rows])
    labels = np.array([r.label for r in rows])
    assert np.allclose(p.sum(1), 1) and (p >= 0).all()
    assert np.mean([r.prediction == r.label for r in rows]) > 0.9
    # As sure as it is right, and far better than the shares of the classes.
    assert abs(p.max(1).mean() - (p.argmax(1) == labels).mean()) < 0.1
    assert -np.log(p[np.arange(len(p)), labels]).mean() < 0.5 * np.log(3)


def test_odd_rows(spark):
    with pytest.raises(ValueError, match="kernel map"):
        classify.make_classifier("SVM", 1, {"kernel_map": "other"})
    df = table(spark, [[0.0, 1.0], [1.0, 0.0]] * 10, [0, 2] * 10)  # no row of class 1, two distinct vectors
    odd = df.unionByName(df.limit(1).select("doc_id", F.lit(None).cast("int").alias("label"), "features"))
    rows = classify.predict_probabilities(classify.make_classifier("SVM", 20, {"probability": True, "max_iter": 10}).fit(odd), df, keep=["label"]).collect()
    assert all(r.prediction == r.label and abs(sum(r.probabilities) - 1) < 1e-9 for r in rows)
