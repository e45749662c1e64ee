"""Training, tuning, annotation and experiments on data with a planted signal."""

import random

import pytest
from pyspark.sql import functions as F

from sparktext.operators import catfreq, evaluate, tfidf, wordvec
from sparktext.operators.sampling import train_test_split
from sparktext.operators.vectors import principal_components
from sparktext.plans import classify
from sparktext.plans.annotate import Annotator
from sparktext.plans.experiment import ExperimentConfig, run_experiment
from sparktext.session import materialize
from sparktext.sources.vectors import as_vectors
from sparktext.streaming.increments import annotate_corpus


@pytest.fixture(scope="module")
def points(spark):
    rng = random.Random(3)
    rows = [(i, i % 3, [rng.gauss(3.0 * (d == i % 3), 1.0) for d in range(4)]) for i in range(240)]
    df = spark.createDataFrame(rows, "doc_id bigint, label int, embedding array<double>")
    return materialize(classify.dense_vectors(df))


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(5)
    topics = (["cat", "dog", "paw", "fur"], ["stock", "bond", "bank", "fund"])
    shared = ["the", "and", "with", "very"]
    rows = [(i, " ".join(rng.choice(topics[i % 2] if rng.random() < 0.6 else shared) for _ in range(12)), i % 2) for i in range(120)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, label int")


def accuracy(df):
    return evaluate.accuracy(df).first()["accuracy"]


@pytest.mark.parametrize(
    "name, params",
    [
        ("LogisticRegression", {"max_iter": 20}),
        ("LogisticRegression", {"max_iter": 20, "normalize": True}),
        ("SVM", {"max_iter": 5}),
        ("xgboost", {"n_estimators": 3, "max_depth": 2}),
        ("RandomForest", {"n_estimators": 10}),
        ("NeuralNetwork", {"hidden": [8], "max_iter": 40}),
    ],
)
def test_classifiers_find_the_signal(points, name, params):
    model = classify.make_classifier(name, points.count(), params, 4, 3).fit(points)
    assert accuracy(classify.predict(model, points, keep=["label"])) > 0.8


def test_unknown_classifier():
    with pytest.raises(ValueError):
        classify.make_classifier("Oracle", 1)


def test_probabilities_sum_to_one(points):
    model = classify.make_classifier("LogisticRegression", points.count()).fit(points)
    total = F.aggregate("probabilities", F.lit(0.0), lambda a, x: a + x)
    rows = classify.predict_probabilities(model, points).select(total.alias("t"), "confidence", "probabilities").collect()
    assert all(abs(r["t"] - 1) < 1e-9 and r["confidence"] == max(r["probabilities"]) for r in rows)


def test_random_fourier_features_approach_the_kernel(spark):
    df = spark.createDataFrame([(1, [0.1, 0.2]), (2, [0.4, -0.3])], "doc_id bigint, v array<double>")
    a, b = (r["f"] for r in classify.random_fourier_features(df, "v", 2, 4096, 0.5, output="f").orderBy("doc_id").collect())
    want = 2.718281828 ** (-0.5 * (0.3**2 + 0.5**2))
    assert sum(x * y for x, y in zip(a, b, strict=True)) == pytest.approx(want, abs=0.05)


def test_grid_search_and_tuning(points):
    found = classify.grid_search(points, "LogisticRegression", {"C": [0.0001, 1.0], "max_iter": [5]}, folds=2)
    assert len(found.avgMetrics) == 2 and max(found.avgMetrics) > 0.8
    search, held = classify.tune(points, "RandomForest", {"max_depth": [2], "n_estimators": [5]}, folds=2)
    assert held > 0.7
    svm = classify.grid_search(points, "SVM", {"C": [1.0], "max_iter": [1], "kernel": ["linear"]}, folds=2)
    assert svm.best_point == {"C": 1.0, "max_iter": 1, "kernel": "linear"}


def test_same_seed_same_result(points):
    runs = []
    for _ in range(2):
        model = classify.make_classifier("RandomForest", points.count(), {"n_estimators": 5}).fit(points)
        runs.append(sorted(map(tuple, classify.predict(model, points).collect())))
    assert runs[0] == runs[1]


def test_training_curve_falls(points):
    model = classify.make_classifier("LogisticRegression", points.count()).fit(points)
    losses = [r["loss"] for r in classify.training_curve(model, points).orderBy("round").collect()]
    assert losses[-1] < losses[0]
    boosted = classify.make_classifier("XGBClassifier", points.count(), {"n_estimators": 2, "max_depth": 2}).fit(points)
    curve = classify.training_curve(boosted, points).orderBy("round").collect()
    assert [(r["class"], r["round"]) for r in curve] == [(-1, 1), (-1, 2)] and curve[1]["loss"] < curve[0]["loss"]


def test_fused_features(spark, points):
    df = points.withColumn("line_number", F.lit(2)).withColumn("total_lines", F.lit(99))
    fused = classify.fuse_features(df.withColumnRenamed("features", "f"), ["f"], {"line_number": 3, "total_lines": 4})
    v = fused.first()["features"].toArray().tolist()
    assert len(v) == 11 and v[4:] == [0, 0, 1, 0, 0, 0, 0]


def test_principal_components_are_centred(points):
    rows = principal_components(points, "embedding", 4, 2).collect()
    assert abs(sum(r["components"][0] for r in rows) / len(rows)) < 1e-9


def test_word_and_paragraph_vectors(corpus):
    options = wordvec.WordVectorOptions(vector_size=8, epochs=2, max_vocab_size=6, partitions=1)
    model = wordvec.train_word_vectors(corpus, options)
    again = wordvec.train_word_vectors(corpus, options)
    assert sorted(map(str, wordvec.vector_table(model).collect())) == sorted(map(str, wordvec.vector_table(again).collect()))
    assert wordvec.vector_table(model).count() == 6
    docs = corpus.limit(3).unionByName(corpus.limit(1).withColumn("text", F.lit("")))
    assert wordvec.infer_paragraph_vectors(docs, model).count() == 3
    more = wordvec.continue_training(corpus.limit(10), corpus, wordvec.WordVectorOptions(vector_size=8, epochs=1))
    assert wordvec.vector_table(more).count() > 6


@pytest.fixture(scope="module")
def annotator(corpus):
    model = catfreq.fit_category_model(corpus, tfidf.TermOptions())
    vecs = materialize(as_vectors(model.tfidf.encode(corpus, keep=["label"]), model.tfidf.size))
    return Annotator(model, classify.make_classifier("LogisticRegression", vecs.count()).fit(vecs))


def test_annotation(spark, corpus, annotator):
    new = corpus.select("doc_id", "text").unionByName(spark.createDataFrame([(999, None)], "doc_id bigint, text string"))
    out = annotator.annotate(new)
    assert out.count() == 121
    joined = out.join(corpus.select("doc_id", "label"), "doc_id")
    for name in ("hard", "prob", "maxcf"):
        assert accuracy(joined.withColumn("prediction", F.col(f"predicted_class_{name}"))) > 0.9
    assert {"initial_class", "initial_confidence", "consensus", "high_confidence", "avg_confidence"} <= set(out.columns)


def test_annotation_moves_the_documents_once(annotator, corpus):
    annotator.annotate(corpus.limit(1).select("doc_id", "text")).collect()  # stores the lookup table
    plan = annotator.annotate(corpus.select("doc_id", "text"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "doc_id" in plan.split("Exchange hashpartitioning")[1][:20]


def test_annotation_weights_equal_the_single_operators(spark, corpus, annotator):
    docs = corpus.select("doc_id", "text").limit(30)
    rows = materialize(annotator.model.tfidf.transform(docs))

    def classified(weights):
        terms = weights.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("term_id", "weight"))).alias("terms"))
        return classify.predict_probabilities(annotator.classifier, as_vectors(terms, annotator.model.tfidf.size))

    first = materialize(classified(rows))
    chances = first.select("doc_id", F.map_from_arrays(F.sequence(F.lit(0), F.size("probabilities") - 1), "probabilities").alias("probabilities"))
    cf = annotator.model.cf
    single = {
        "hard": classified(catfreq.weight_hard(rows, first, cf)),
        "prob": classified(catfreq.weight_probabilistic(rows, chances, cf)),
        "maxcf": classified(catfreq.weight_max(rows, cf)),
    }
    got = {r["doc_id"]: r for r in annotator.annotate(docs.withColumn("weight", F.lit(1)).withColumn("features", F.lit(2))).collect()}
    assert all(r["weight"] == 1 and r["features"] == 2 for r in got.values())
    for name, df in single.items():
        for r in df.collect():
            assert got[r["doc_id"]][f"predicted_class_{name}"] == r["prediction"]
            assert abs(got[r["doc_id"]][f"confidence_{name}"] - r["confidence"]) < 1e-9


def test_streamed_annotation_equals_batch(spark, corpus, annotator, tmp_path):
    source, sink, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    docs = corpus.select("doc_id", "text")
    docs.repartition(2).write.parquet(source)
    annotate_corpus(spark, annotator, source, docs.schema, sink, state)
    pick = ["doc_id", "predicted_class_hard", "predicted_class_prob", "predicted_class_maxcf", "consensus"]
    assert sorted(map(str, spark.read.parquet(sink).select(*pick).collect())) == sorted(map(str, annotator.annotate(docs).select(*pick).collect()))


CONFIG = {
    "experiment_name": "topics",
    "dataset": {"label_column": "label"},
    "embeddings": {"type": "tfidf", "params": {"max_features": 50, "ngram_range": "1,2"}, "pre_process": {"lemmatize": False}},
    "model": {"classifier": "LogisticRegression", "params": {"max_iter": 20, "C": 0.6}},
}


@pytest.mark.parametrize("kind, params", [("tfidf", {"max_features": 50}), ("tfidf_cf", {}), ("fasttext", {"vector_size": 8, "epochs": 2}), ("doc2vec", {"vector_size": 8, "dm": 1})])
def test_experiments(spark, corpus, kind, params):
    split = train_test_split(corpus)
    config = {**CONFIG, "embeddings": {"type": kind, "params": params}}
    report = run_experiment(spark, config, split.where("split = 'train'"), test=split.where("split = 'test'"))
    got = {(r["split"], r["class"]): r for r in report.collect()}
    assert got[("test", "macro avg")]["support"] == 24 and got[("train", "macro avg")]["support"] == 96
    if kind.startswith("tfidf"):
        assert got[("test", "accuracy")]["f1"] > 0.8


def test_config_checks():
    ok = ExperimentConfig.from_dict(CONFIG)
    assert ok.clean.lemma is False and ok.embedding_params["ngram_range"] == "1,2"
    with pytest.raises(ValueError):
        ExperimentConfig.from_dict({**CONFIG, "model": {"classifier": "LogisticRegression", "params": {"tol": "0.00001tr"}}})
    with pytest.raises(ValueError):
        ExperimentConfig.from_dict({**CONFIG, "embeddings": {"type": "nope"}})
    assert ExperimentConfig.from_dict({**CONFIG, "model": {"classifier": "xgboost"}}).classifier == "XGBClassifier"
