"""Training and prediction. Most results depend on an optimiser and have no SQL counterpart."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparktext.functions import text
from sparktext.operators import bayes, blocks, tfidf
from sparktext.operators.joins import lookup
from sparktext.operators.sampling import train_test_split, with_positions
from sparktext.plans import annotate, classify, experiment, saving
from sparktext.plans.catalog.registry import corpus, query
from sparktext.plans.catalog.vectorising import SQL_TFIDF, options
from sparktext.plans.catalog.weighting import model as category_model
from sparktext.session import materialize, scratch_path
from sparktext.sources.readers import read_table
from sparktext.sources.vectors import as_vectors, stored_vectors

DIM = 64


def _vectors(spark, sf):
    df = read_table(spark, sf, "embeddings", "vec_id")
    return materialize(classify.dense_vectors(df).select("vec_id", "label", "features"))


def _predictions(spark, sf, name, params=None, n_features=DIM):
    """Predictions for all rows by a model fitted on four fifths of them; ``split`` tells which."""
    df = materialize(train_test_split(_vectors(spark, sf), 0.2, "vec_id"))
    train = classify.dealt(df.where("split = 'train'"))
    model = classify.make_classifier(name, train.count(), params, n_features, 10).fit(train)
    return classify.predict(model, df, "vec_id", ["label", "split"])


@query("c1_logistic_regression")
def logistic_regression(spark, sf):
    return _predictions(spark, sf, "LogisticRegression")


@query("c2_linear_svm")
def linear_svm(spark, sf):
    return _predictions(spark, sf, "SVM", {"kernel": "linear"})


@query("c2b_rbf_svm")
def rbf_svm(spark, sf):
    return _predictions(spark, sf, "SVM")


@query("c2b_kernel_svm_with_probabilities")
def kernel_svm_with_probabilities(spark, sf):
    df = materialize(train_test_split(_vectors(spark, sf), 0.2, "vec_id"))
    train = classify.dealt(df.where("split = 'train'"))
    model = classify.make_classifier("SVM", train.count(), {"kernel_map": "nystroem", "probability": True}).fit(train)
    return classify.predict_probabilities(model, df, "vec_id", ["label", "split"])


@query("c3_gradient_boosted_trees")
def gradient_boosted_trees(spark, sf):
    return _predictions(spark, sf, "XGBClassifier")


@query("c4_random_forest")
def random_forest(spark, sf):
    return _predictions(spark, sf, "RandomForest")


@query(
    "c5_naive_bayes",
    f"""WITH {SQL_TFIDF}, g AS (SELECT label AS c, count(*) AS n FROM (SELECT list_position(['de', 'en', 'es', 'fr'], lang) - 1 AS label FROM documents) GROUP BY 1),
t AS (SELECT DISTINCT term FROM tfidf), w AS (SELECT label AS c, term, sum(weight) AS w FROM tfidf GROUP BY ALL), k AS (SELECT c, term, coalesce(w, 0) AS w FROM g CROSS JOIN t LEFT JOIN w USING (c, term)),
l AS (SELECT c, term, ln(w + 1) - ln(sum(w) OVER (PARTITION BY c) + count(*) OVER (PARTITION BY c)) AS s FROM k),
d AS (SELECT doc_id, c, sum(weight * s) AS s FROM tfidf JOIN l USING (term) GROUP BY ALL),
j AS (SELECT doc_id, g.c, coalesce(s, 0) + ln(n / CAST(sum(n) OVER (PARTITION BY doc_id) AS DOUBLE)) AS s FROM documents CROSS JOIN g LEFT JOIN d USING (doc_id, c))
SELECT doc_id, CAST(c AS INTEGER) AS prediction FROM j QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY s DESC, c) = 1""",
)
def naive_bayes(spark, sf):
    docs = blocks.counted(corpus(spark, sf), options(), keep=["label"])
    weights = docs.weights()
    return bayes.fit_bayes(docs.rows(), docs.summed(weights, "label"), [0, 1, 2, 3]).predict_blocks(docs, weights)


@query("c5b_naive_bayes_on_vectors")
def naive_bayes_on_vectors(spark, sf):
    df = corpus(spark, sf)
    docs = blocks.counted(df, options(), keep=["label"])
    model = tfidf.fitted_terms(docs.terms(), df, options())
    vecs = stored_vectors(docs.encoded(model.vocabulary), model.size)
    return classify.predict(classify.make_classifier("NaiveBayes", 0).fit(vecs), vecs, "doc_id", ["label"])


@query("c6_feed_forward_network")
def feed_forward_network(spark, sf):
    return _predictions(spark, sf, "NeuralNetwork", {})


@query("c7_scaled_classifier")
def scaled_classifier(spark, sf):
    return _predictions(spark, sf, "LogisticRegression", {"normalize": True})


@query("c8_grid_search")
def grid_search(spark, sf):
    found = classify.grid_search(_vectors(spark, sf), "LogisticRegression", folds=5, key="vec_id")
    points = [(i, float(m)) for i, m in enumerate(found.avgMetrics)]
    return spark.createDataFrame(points, "point int, accuracy double")


@query("c9_tuning_with_held_out_split")
def tuning_with_held_out_split(spark, sf):
    found, accuracy = classify.tune(_vectors(spark, sf), folds=3, key="vec_id")
    points = [(i, *(float(p[c]) for c in ("learning_rate", "max_depth", "n_estimators")), float(m), float(accuracy)) for i, (p, m) in enumerate(found.points)]
    return spark.createDataFrame(points, "point int, learning_rate double, max_depth double, n_estimators double, accuracy double, held_out_accuracy double")


@query("c10_c11_predictions_with_probabilities")
def predictions_with_probabilities(spark, sf):
    df = _vectors(spark, sf)
    model = classify.make_classifier("LogisticRegression", df.count()).fit(df)
    return classify.predict_probabilities(model, df, "vec_id", ["label"])


@query("c17_annotated_documents")
def annotated_documents(spark, sf):
    df = corpus(spark, sf)
    m = category_model(spark, sf)
    vecs = materialize(as_vectors(m.tfidf.encode(df, keep=["label"]), m.tfidf.size))
    lr = classify.make_classifier("LogisticRegression", vecs.count()).fit(classify.dealt(vecs))
    return annotate.Annotator(m, lr).annotate(df.select("doc_id", "text")).drop("text")


def _character_counts(df):
    """(doc_id, term, tf) of the characters of the lower-cased text, blanks left out."""
    shown = F.filter(F.split(text.spaced_characters(F.lower("text")), " "), lambda c: c != "")
    counted = df.select("doc_id", F.explode(text.term_counts(shown)).alias("_t"))
    return counted.select("doc_id", "_t.term", F.col("_t.tf").cast("bigint").alias("tf"))


@query("c18_text_and_position_features")
def text_and_position_features(spark, sf):
    turns = read_table(spark, sf, "conversations", "conv_id")
    placed = with_positions(turns, "conv_id", "turn").withColumn("doc_id", F.col("conv_id") * 1000 + F.col("turn"))
    placed = placed.withColumn("label", (F.col("role") == "assistant").cast("int"))
    words = tfidf.fit_tfidf(placed, tfidf.TermOptions())
    # Characters are terms of their own: TF-IDF over all of them, whatever their script.
    keep = ["label", "line_number", "total_lines"]
    chars = tfidf.fitted(_character_counts(placed), placed, tfidf.TermOptions())
    weighted = lookup(_character_counts(placed), chars.vocabulary.select("term", "term_id", "idf"), ["term"], spread_on="doc_id", table_bytes=chars.table_bytes)
    rows = weighted.select("doc_id", "term_id", (F.col("tf") * F.col("idf")).alias("weight"))
    alone = placed.select("doc_id", F.lit(None).cast("int").alias("term_id"), F.lit(0.0).alias("weight"))
    own = as_vectors(tfidf.unit_rows(rows.unionByName(alone)), chars.size, output="chars")
    vecs = as_vectors(words.encode(placed, keep=keep), words.size, output="words")
    both = vecs.join(own, "doc_id")
    fused = materialize(classify.fuse_features(both, ["words", "chars"], {"line_number": 15, "total_lines": 20}))
    model = classify.make_classifier("LogisticRegression", fused.count()).fit(classify.dealt(fused))
    return classify.predict(model, fused, "doc_id", ["label"])


@query("e7_training_curve")
def training_curve(spark, sf):
    df = _vectors(spark, sf)
    boosted = classify.make_classifier("XGBClassifier", df.count()).fit(df)
    return classify.training_curve(boosted, df)


@query("e7b_optimiser_history")
def optimiser_history(spark, sf):
    df = _vectors(spark, sf)
    return classify.training_curve(classify.make_classifier("LogisticRegression", df.count()).fit(df), df)


@query("x6_experiment_report")
def experiment_report(spark, sf):
    split = train_test_split(corpus(spark, sf))
    config = {
        "experiment_name": "language",
        "embeddings": {"type": "tfidf", "params": {}, "pre_process": {"remove_stopwords": False}},
        "model": {"classifier": "LogisticRegression", "params": {"C": 1.0}},
    }
    return experiment.run_experiment(spark, config, split.where("split = 'train'"), test=split.where("split = 'test'"))


@query("x4_saved_experiment")
def saved_experiment(spark, sf):
    """Fitted on four fifths of the rows, saved, loaded and applied to all of them."""
    df = corpus(spark, sf)
    config = {
        "experiment_name": "language",
        "dataset": {"label_column": "label_text"},
        "embeddings": {"type": "tfidf", "params": {}, "pre_process": {"remove_stopwords": False}},
        "model": {"classifier": "LogisticRegression", "params": {"C": 1.0}},
    }
    path = scratch_path(spark, "experiment")
    experiment.fit_experiment(config, train_test_split(df).where("split = 'train'")).save(path)
    return saving.load(spark, path).transform(df.select("doc_id", "text"))


@query("x5_encoder_experiment")
def encoder_experiment(spark, sf):
    split = train_test_split(corpus(spark, sf))
    config = {
        "experiment_name": "language",
        "embeddings": {"type": "encoder", "params": {"encoder": "hashing", "dim": 256, "truncate_dim": 128, "quantization": "int8"}},
        "model": {"classifier": "LogisticRegression", "params": {"C": 1.0}},
    }
    return experiment.run_experiment(spark, config, split.where("split = 'train'"), test=split.where("split = 'test'"))
