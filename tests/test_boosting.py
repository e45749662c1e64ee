"""Boosted trees and shared grids, against brute force and models fitted one by one."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparktext.plans import boosting, classify, grids
from sparktext.session import materialize


@pytest.fixture(scope="module")
def points(spark):
    rng = random.Random(9)
    rows = [(i, i % 3, [round(rng.gauss(1.5 * (d == i % 3), 1.0), 2) for d in range(4)]) for i in range(300)]
    rows[5][2][1] = float("nan")
    df = spark.createDataFrame([*rows, (1000, None, [0.0] * 4)], "vec_id bigint, label int, embedding array<double>")
    return rows, materialize(classify.dense_vectors(df))


def brute_gain(x, g, h, cut):
    left = x <= cut
    if h[left].sum() < 1 or h[~left].sum() < 1:
        return -np.inf
    score = lambda m: g[m].sum() ** 2 / (h[m].sum() + 1)
    return score(left) + score(~left) - g.sum() ** 2 / (h.sum() + 1)


def test_first_tree_equals_brute_force(points):
    rows, df = points[0][:200], points[1].where("vec_id < 200")  # fewer rows than cuts: every value is one
    x = np.nan_to_num(np.array([r[2] for r in rows]), nan=-np.inf)
    y = np.array([r[1] for r in rows])
    model = boosting.SoftmaxBoosting(boosting.BoostingOptions(n_estimators=1, max_depth=2, bins=256)).fit(df)
    for k in range(3):
        g, h = 1 / 3 - (y == k), np.full(len(y), 4 / 9)
        rest = [(0, np.ones(len(y), bool))]
        while rest:
            node, inside = rest.pop()
            gains = {(f, c): brute_gain(x[inside, f], g[inside], h[inside], c) for f in range(4) for c in np.unique(x[inside, f])}
            most = max(gains.values())
            f, c = int(model.trees.feature[0, k, node]), model.trees.threshold[0, k, node]
            if node > 2 or most <= boosting.LEAST_GAIN:
                assert f < 0
                assert model.trees.value[0, k, node] == pytest.approx(-0.1 * g[inside].sum() / (h[inside].sum() + 1))
                continue
            assert brute_gain(x[inside, f], g[inside], h[inside], c) == pytest.approx(most)
            rest += [(2 * node + 1, inside & (x[:, f] <= c)), (2 * node + 2, inside & (x[:, f] > c))]


def test_losses_fall_and_many_tasks_change_nothing(points, monkeypatch):
    _, df = points
    options = boosting.BoostingOptions(n_estimators=30, bins=32)
    one = boosting.SoftmaxBoosting(options)
    model = one.fit(df)
    assert one.tasks == 1
    assert all(b < a for a, b in zip(model.trees.losses, model.trees.losses[1:], strict=False)) and len(model.trees.losses) == 30
    staged = [r["loss"] for r in model.staged_losses(df).orderBy("round").collect()]
    assert staged[:-1] == pytest.approx(model.trees.losses[1:]) and staged[-1] < staged[-2]
    monkeypatch.setattr(boosting, "BLOCK_BYTES", 300)
    monkeypatch.setattr(boosting, "STORE_ROUNDS", 7)
    many = boosting.SoftmaxBoosting(options)
    other = many.fit(df.repartition(5))
    assert many.tasks > 1 and np.array_equal(model.trees.feature, other.trees.feature)
    assert np.allclose(model.trees.value, other.trees.value)
    got = model.transform(df).where("label IS NOT NULL")
    assert got.where("prediction = label").count() / got.count() > 0.8


def test_trees_in_memory_equal_the_distributed_ones(points):
    rows, df = points
    options = boosting.BoostingOptions(n_estimators=5, max_depth=4, gamma=1.0, bins=16)
    model = boosting.SoftmaxBoosting(options).fit(df)
    cuts = boosting.cut_points(df.where("label IS NOT NULL"), "features", 16)
    bins = boosting.binned(np.array([r[2] for r in rows]), cuts)
    own = list(boosting.fit_in_memory(bins, np.array([r[1] for r in rows]), 3, options))
    assert np.array_equal(np.stack([r.feature for r in own]), model.trees.feature)


def test_gamma_prunes(points):
    _, df = points
    sizes = []
    for gamma in (0.0, 5.0, 1e9):
        model = boosting.SoftmaxBoosting(boosting.BoostingOptions(n_estimators=3, gamma=gamma)).fit(df)
        sizes.append(int((model.trees.feature >= 0).sum()))
    assert sizes[0] > sizes[1] > sizes[2] == 0


def test_no_labels_raise(points):
    with pytest.raises(ValueError):
        boosting.SoftmaxBoosting().fit(points[1].where("label IS NULL"))
    with pytest.raises(ValueError):
        boosting.SoftmaxBoosting(boosting.BoostingOptions(bins=300)).fit(points[1])


def test_shared_logistic_grid_equals_single_fits(points):
    df = points[1].where("label IS NOT NULL AND vec_id <> 5")
    settings = [{"C": c, "tol": t, "max_iter": m} for c in (0.001, 1) for t in (0.05, 1e-5) for m in (1, 100)]
    shared = grids.logistic_points(df, settings, 3, "vec_id")
    single = classify._fitted_points(df, "LogisticRegression", settings[3::4], 3, "vec_id", 4, 200, 0, 3)
    assert [shared[3], shared[7]] == pytest.approx(single, abs=0.02)
    assert shared[0] == shared[2]  # one step is one step, whatever the tolerance


def test_boosted_grid_reads_smaller_models_from_larger_ones(points):
    df = points[1].where("label IS NOT NULL")
    settings = [{"n_estimators": n, "max_depth": d, "learning_rate": 0.3} for d in (1, 2) for n in (2, 10)]
    found = grids.boosted_points(df, settings, 2, "vec_id")
    alone = [grids.boosted_points(df, [s], 2, "vec_id")[0] for s in settings]
    assert found == alone and max(found) > 0.75
    search = classify.grid_search(df, "XGBClassifier", {"n_estimators": [2, 5], "max_depth": [2]}, folds=2, key="vec_id")
    assert [p["n_estimators"] for p, _ in search.points] == [2, 5] and search.transform(df).where(F.col("prediction").isNull()).count() == 0


def test_boosted_grid_is_trained_on_all_rows(points, monkeypatch):
    """Rows were sampled above a bound; now a table too large for a task is passed over in blocks."""
    df = points[1].where("label IS NOT NULL")
    settings = [{"n_estimators": n, "max_depth": 2, "learning_rate": 0.3} for n in (1, 4)]
    seen = []

    def watched(data, cuts, classes, models, folds, inner=grids._in_tasks):
        seen.append(data.count())
        return inner(data, cuts, classes, models, folds)

    monkeypatch.setattr(grids, "_in_tasks", watched)
    in_tasks = grids.boosted_points(df, settings, 3, "vec_id")
    monkeypatch.setattr(grids, "TASK_BYTES", 0)
    in_passes = grids.boosted_points(df, settings, 3, "vec_id")
    assert seen == [df.count()] and in_passes == pytest.approx(in_tasks, abs=0.02)
