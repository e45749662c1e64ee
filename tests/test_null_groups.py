"""NULL groups are groups; plans for small and large tables give the same rows; settings that must raise."""

import pytest
from pyspark.sql import functions as F

from sparktext import session
from sparktext.operators import profile, ranking, sampling
from sparktext.plans import classify, experiment


@pytest.fixture(scope="module")
def rows(spark):
    data = [(i, None if i % 4 == 0 else i % 3, float(i % 7)) for i in range(400)]
    return spark.createDataFrame(data, "doc_id bigint, label int, value double")


def test_both_ranking_paths_keep_null_groups(rows):
    kw = {"running": {"upto": "value"}, "totals": {"total": "value"}}
    small = ranking.ranked(rows, "doc_id", ["label"], one_task=True, **kw)
    large = ranking.ranked(rows, "doc_id", ["label"], **kw)
    assert sorted(map(str, small.collect())) == sorted(map(str, large.collect()))
    assert large.count() == 400


def test_ranges_stay_even_when_groups_share_keys(spark):
    df = spark.range(20_000).select((F.col("id") / 500).cast("int").alias("g"), (F.col("id") % 500).alias("k"))
    cuts = ranking._cut_points(df, "k", 8, ["g"])
    placed = df.crossJoin(F.broadcast(cuts)).groupBy(ranking._range_of(F.col("k"), F.col("_cuts")).alias("r")).count()
    counts = [r["count"] for r in placed.collect()]
    assert len(counts) >= 7 and max(counts) < 3 * 20_000 / 8


def test_profiles_keep_the_null_group(rows):
    described = {r["label"]: r["n"] for r in profile.describe(rows, "value", ["label"]).collect()}
    assert described[None] == 100 and sum(described.values()) == 400
    assert {r["label"] for r in profile.box_plot(rows, "value", ["label"]).collect()} == {None, 0, 1, 2}
    bins = profile.histogram(rows, "value", 5, ["label"]).groupBy("label").agg(F.sum("n").alias("n"), F.count("*").alias("bins")).collect()
    assert {r["label"]: (r["n"], r["bins"]) for r in bins}[None] == (100, 5)


def test_folds_and_positions_keep_rows_without_a_group(rows):
    folds = sampling.stratified_folds(rows, 5)
    assert folds.count() == 400
    assert {r["count"] for r in folds.where("label IS NULL").groupBy("fold").count().collect()} == {20}
    placed = sampling.with_positions(rows, "label", "doc_id").where("label IS NULL")
    assert placed.agg(F.max("line_number"), F.min("total_lines"), F.count("*")).first() == (99, 99, 100)


class _Cluster:
    """A session on a cluster without the setting."""

    master = "spark://host:7077"

    @property
    def sparkContext(self):
        return self

    @property
    def conf(self):
        return self

    def getConf(self):
        return self

    def get(self, *_):
        return None


def test_a_cluster_needs_a_shared_folder():
    with pytest.raises(ValueError, match="checkpoint"):
        session.shared_dir(_Cluster())


def test_unknown_parameters_raise():
    with pytest.raises(ValueError, match="no parameter"):
        classify.make_classifier("LogisticRegression", 10, {"learning_rate": 0.1})
    with pytest.raises(ValueError, match="kernel"):
        classify.make_classifier("SVM", 10, {"kernel": "poly"})
    classify.make_classifier("LogisticRegression", 10, {"penalty": "l2", "random_state": 42})


def test_default_kernel_separates_rings(spark):
    import math
    import random

    rng = random.Random(1)
    data = []
    for i in range(240):
        r, a = (0.5 if i % 2 else 2.0) + rng.gauss(0, 0.1), rng.uniform(0, 2 * math.pi)
        data.append((i, i % 2, [r * math.cos(a), r * math.sin(a)]))
    df = classify.dense_vectors(spark.createDataFrame(data, "doc_id bigint, label int, embedding array<double>"))

    def right(params):
        fitted = classify.make_classifier("SVM", 240, {"max_iter": 30, **params}).fit(df)
        return classify.predict(fitted, df, keep=["label"]).where("label = prediction").count() / 240

    assert right({}) > 0.95 > 0.8 > right({"kernel": "linear"})


def test_grids_are_whole():
    size = {k: len(list(__import__("itertools").product(*v.values()))) for k, v in classify.GRIDS.items()}
    assert size == {"LogisticRegression": 36, "SVM": 48, "XGBClassifier": 81}


def test_text_labels_area_and_chosen_point(spark):
    data = [(i, f"{'alpha beta' if i % 2 else 'gamma delta'} word{i % 5}", "odd" if i % 2 else "even") for i in range(60)]
    df = spark.createDataFrame(data, "doc_id bigint, text string, label string")
    config = {
        "embeddings": {"type": "tfidf", "params": {}},
        "model": {"classifier": "LogisticRegression", "params": {"grid_search": True, "grid": {"C": [0.5, 1]}, "folds": 2}},
    }
    out = experiment.run_experiment(spark, config, df.where("doc_id < 40"), test=df.where("doc_id >= 40")).collect()
    area = {r["split"]: r["f1"] for r in out if r["class"] == "roc_auc"}
    assert area["test"] == pytest.approx(1.0)
    assert '"C": ' in out[0]["params"]


def test_unseen_and_missing_text_labels_are_counted(spark):
    data = [(i, f"{'alpha beta' if i % 2 else 'gamma delta'} word{i % 5}", "odd" if i % 2 else "even") for i in range(60)]
    data += [(100 + i, "alpha beta", label) for i, label in enumerate(["rare", "rare", "also", None, None, None])] + [(-1, "alpha beta", None)]
    df = spark.createDataFrame(data, "doc_id bigint, text string, label string")
    config = {"embeddings": {"type": "tfidf", "params": {}}, "model": {"classifier": "LogisticRegression", "params": {}}}
    out = experiment.run_experiment(spark, config, df.where("doc_id < 40"), test=df.where("doc_id >= 40")).collect()
    got = {(r["split"], r["class"]): r for r in out}
    assert got["test", "accuracy"]["support"] == 23 and got["test", "accuracy"]["f1"] == pytest.approx(20 / 23)
    assert {c: got["test", c]["support"] for c in "0123"} == {"0": 10, "1": 10, "2": 1, "3": 2}
    assert got["test", "1"]["precision"] == pytest.approx(10 / 13) and got["test", "3"]["recall"] == 0
    assert got["test", "roc_auc"]["support"] == 23 and got["test", "roc_auc"]["f1"] < 1
    assert got["test", "unlabelled"]["support"] == 3 and got["train", "unlabelled"]["support"] == 1
    assert got["train", "accuracy"]["support"] == 40
