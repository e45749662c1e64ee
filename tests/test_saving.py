"""Saved models and experiments give the predictions they gave before."""

import os

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from sparktext.operators import vectors
from sparktext.plans import classify, experiment, saving
from sparktext.plans.kernel import CalibratedSVMModel

WORDS = [["goal", "match", "team", "score", "coach"], ["stock", "market", "bank", "share", "profit"]]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, " ".join(WORDS[i % 2][(i * 7 + j * (1 + i % 3)) % 5] for j in range(6 + i % 4)), ("sport", "trade")[i % 2]) for i in range(60)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, topic string")


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(3)
    rows = [(i, i % 3, (rng.normal(0, 0.4, 4) + np.eye(4)[i % 3] * 2).tolist()) for i in range(90)]
    return classify.dense_vectors(spark.createDataFrame(rows, "doc_id bigint, label int, embedding array<double>")).cache()


def config(kind, params=None, **model):
    return {
        "experiment_name": "topics",
        "dataset": {"label_column": "topic"},
        "embeddings": {"type": kind, "params": params or {}, "pre_process": {"lemmatize": False}},
        "model": {"classifier": "LogisticRegression", "params": {"max_iter": 20}, **model},
    }


def rows(df):
    return sorted(map(str, df.collect()))


@pytest.mark.parametrize(
    "kind, params",
    [
        ("tfidf", {"ngram_range": "1,2", "max_features": 40}),
        ("tfidf_cf", {}),
        ("fasttext", {"vector_size": 8, "epochs": 2, "min_count": 1, "buckets": 500}),
        ("doc2vec", {"vector_size": 8, "epochs": 2, "min_count": 1}),
        ("encoder", {"dim": 32, "truncate_dim": 16, "quantization": "int8"}),
    ],
)
def test_experiment_round_trip(spark, docs, tmp_path, kind, params):
    fitted = experiment.fit_experiment(config(kind, params), docs)
    path = str(tmp_path / "model")
    fitted.save(path)
    loaded = saving.load(spark, path)
    new = docs.select("doc_id", "text").unionByName(spark.createDataFrame([(900, None), (901, "")], "doc_id bigint, text string"))
    assert rows(loaded.transform(new)) == rows(fitted.transform(new))
    assert loaded.transform(new).count() == 62
    assert loaded.config == fitted.config or kind == "tfidf"
    if kind != "doc2vec" and kind != "fasttext":
        right = loaded.transform(docs).join(docs, "doc_id").where("label_text = topic").count()
        assert right >= 57


def test_loaded_word_vectors_can_be_trained_on(spark, docs, tmp_path):
    from sparktext.operators import embedding

    fitted = experiment.fit_experiment(config("fasttext", {"vector_size": 8, "epochs": 1, "min_count": 1, "buckets": 100}), docs)
    saving.save(fitted.encoder, str(tmp_path / "words"))
    model = saving.load(spark, str(tmp_path / "words")).model
    more = embedding.train(docs.withColumn("text", F.lit("harbour ship")), model.options, base=model)
    assert {"harbour", "goal"} <= {r["word"] for r in more.word_vectors().collect()}


@pytest.mark.parametrize(
    "name, params",
    [
        ("LogisticRegression", {"max_iter": 10, "normalize": True}),
        ("XGBClassifier", {"n_estimators": 3, "normalize": True}),
        ("SVM", {"kernel": "linear", "max_iter": 5}),
        ("SVM", {"n_components": 16, "max_iter": 5}),
        ("SVM", {"n_components": 16, "max_iter": 5, "kernel_map": "nystroem", "probability": True}),
        ("RandomForest", {"n_estimators": 3}),
        ("NeuralNetwork", {"hidden": [4], "max_iter": 5}),
    ],
)
def test_classifier_round_trip(spark, points, tmp_path, name, params):
    model = classify.make_classifier(name, 90, params, 4, 3).fit(points)
    saving.save(model, str(tmp_path / "m"))
    loaded = saving.load(spark, str(tmp_path / "m"))
    give = classify.predict_probabilities if classify.has_probabilities(model) else classify.predict
    assert classify.has_probabilities(loaded) == classify.has_probabilities(model)
    assert rows(give(loaded, points)) == rows(give(model, points))
    assert loaded.uid == model.uid
    if params.get("probability"):
        assert isinstance(loaded, PipelineModel) and isinstance(loaded.stages[-1], CalibratedSVMModel)


def test_folders_appear_whole(spark, points, tmp_path):
    path = str(tmp_path / "m")
    first = classify.make_classifier("LogisticRegression", 90, {"max_iter": 1}).fit(points)
    second = classify.make_classifier("LogisticRegression", 90, {"max_iter": 20}).fit(points)
    saving.save(first, path)
    with pytest.raises(FileExistsError):
        saving.save(second, path)
    assert rows(classify.predict_probabilities(saving.load(spark, path), points)) == rows(classify.predict_probabilities(first, points))
    saving.save(second, path, overwrite=True)
    assert rows(classify.predict_probabilities(saving.load(spark, path), points)) == rows(classify.predict_probabilities(second, points))
    assert os.listdir(tmp_path) == ["m"]

    class Broken:
        def write(self):
            raise RuntimeError("no")

    with pytest.raises(RuntimeError):
        saving.save(Broken(), path, overwrite=True)
    assert saving.load(spark, path).uid == second.uid


def test_incomplete_or_later_folders_raise(spark, points, tmp_path):
    path = tmp_path / "m"
    saving.save(classify.make_classifier("XGBClassifier", 90, {"n_estimators": 2}).fit(points), str(path))
    part = next(p for p in (path / "arrays").iterdir() if p.suffix == ".parquet")
    kept = part.read_bytes()
    part.unlink()
    with pytest.raises(ValueError, match="lacks"):
        saving.load(spark, str(path))
    part.write_bytes(kept)
    saving.load(spark, str(path))
    text = next((path / "manifest").glob("part-*"))
    for crc in (path / "manifest").glob(".*.crc"):
        crc.unlink()
    text.write_text(text.read_text().replace('"format": 1', '"format": 2'))
    with pytest.raises(ValueError, match="format 2"):
        saving.load(spark, str(path))


def test_encoder_from_config_equals_direct_calls(spark, docs):
    texts = docs.select("doc_id", "text").unionByName(spark.createDataFrame([(900, None), (901, "word " * 1200)], "doc_id bigint, text string"))
    direct = {r["doc_id"]: r["embedding"] for r in vectors.encode_texts(texts, lambda: vectors.hashing_encoder(32), 32).collect()}
    batched = {r["doc_id"]: r["embedding"] for r in vectors.encode_batches(texts, lambda: vectors.hashing_encoder(32), 32, batch_size=5).collect()}
    assert batched.keys() == direct.keys() and all(np.allclose(batched[k], direct[k]) for k in direct)
    for quantization in ("float", "binary", "int8"):
        fitted = experiment.EncoderEmbedding({"dim": 32, "truncate_dim": 8, "quantization": quantization}).fit(texts)
        got = {r["doc_id"]: r["embedding"] for r in fitted.quantized(texts).collect()}
        assert fitted.size == 8
        for k, v in direct.items():
            unit = np.array(v[:8]) / (np.linalg.norm(v[:8]) or 1)
            want = unit if quantization == "float" else (unit > 0).astype(int) if quantization == "binary" else np.clip(np.trunc(unit / fitted.scale), -127, 127)
            assert np.allclose(got[k], want, atol=1e-9 if quantization != "int8" else 1), (quantization, k)


def test_encoder_config_is_checked():
    for params in ({"encoder": "nope"}, {"quantization": "int4"}, {"dim": 16, "truncate_dim": 17}):
        with pytest.raises(ValueError):
            experiment.EncoderEmbedding(params)


def test_registered_encoder(spark, docs):
    experiment.register_encoder("lengths", lambda p: ((lambda: lambda texts: np.array([[len(t), t.count(" ")] for t in texts], float)), 2))
    fitted = experiment.EncoderEmbedding({"encoder": "lengths", "normalize": False}).fit(docs)
    got = {r["doc_id"]: r["embedding"] for r in fitted.encode(docs).collect()}
    assert all(got[r["doc_id"]] == [len(r["text"]), r["text"].count(" ")] for r in docs.collect())


def test_texts_of_a_batch_have_similar_lengths(spark, docs):
    def maker():
        return lambda texts: np.array([[max(map(len, texts)) - min(map(len, texts))] for _ in texts], float)

    texts = spark.createDataFrame([(i, "a" * (1 + i * 37 % 100)) for i in range(100)], "doc_id bigint, text string").coalesce(1)
    gaps = [r["embedding"][0] for r in vectors.encode_batches(texts, maker, 1, batch_size=10).collect()]
    assert max(gaps) <= 10
