"""Category weights made inside blocks of documents against those of long rows."""

import pytest
from pyspark.sql import functions as F

from sparktext.operators import blocks, catfreq, joins, tfidf
from sparktext.plans.catalog import storage, weighting

ROWS = [
    (1, "aa bb bb cc", 0),
    (1, "aa dd", 0),
    (1, "ee", 1),
    (2, None, 1),
    (3, "", 0),
    (4, "cc cc ee ff", None),
    (None, "aa gg", 1),
    (None, "gg hh", 1),
    (5, "hh ii jj kk", 1),
    (6, "ii aa", 0),
]


@pytest.fixture(params=[1, 10**6])
def docs(request, spark, monkeypatch):
    monkeypatch.setattr(blocks, "BLOCK_TOKENS", request.param)
    monkeypatch.setattr(blocks, "BATCH_ROWS", 3)
    return spark.createDataFrame(ROWS, "doc_id bigint, text string, label int")


def listed(df):
    scores = F.array_sort(F.map_entries("cf_scores")) if "cf_scores" in df.columns else F.lit(None)
    df = df.withColumn("cf_scores", scores.cast("string"))
    return sorted(str([round(r[c], 9) if isinstance(r[c], float) else r[c] for c in sorted(df.columns)]) for r in df.collect())


def test_weights_equal_those_of_long_rows(spark, docs):
    m = catfreq.fit_category_model(docs, tfidf.TermOptions(stop_words=["kk"]))
    cf = m.cf.where("term <> 'hh'")  # a term without frequencies
    # Two guesses for a document, none, one that is NULL and one of an unknown class.
    guess = spark.createDataFrame([(1, 0), (1, 1), (4, None), (5, 1), (6, 7), (None, 1)], "doc_id bigint, prediction int")
    chance = spark.createDataFrame([(1, {0: 0.25, 1: 0.75}), (4, None), (5, {1: None, 9: 0.5}), (6, {0: 0.0, 1: 0.0})], "doc_id bigint, probabilities map<int,double>")
    icf = catfreq.inverse_category_frequency(tfidf.doc_terms(docs, m.tfidf.options, keep=["label"]))
    found = blocks.counted(docs, m.tfidf.options, keep=["label"])
    assert set(found.pairs("label").collect()) == set(tfidf.doc_terms(docs, m.tfidf.options, keep=["label"]).select("label", "term").collect())
    long, made = m.tfidf.transform(docs), blocks.unit_rows(m.tfidf, docs)
    assert listed(made.frame()) == listed(long)
    for weigh in (
        lambda rows: catfreq.weight_hard(rows, guess, cf),
        lambda rows: catfreq.weight_hard(rows, guess.withColumn("prediction", F.col("prediction").cast("double")), cf),
        lambda rows: catfreq.weight_probabilistic(rows, chance, cf),
        lambda rows: catfreq.weight_max(rows, cf),
        lambda rows: catfreq.weight_by_inverse_cf(rows, icf.where("term <> 'aa'")),
        lambda rows: catfreq.explain_terms(rows, guess, cf),
    ):
        assert listed(weigh(made)) == listed(weigh(long))


def test_encoded_documents_equal_those_of_the_model(docs):
    model = tfidf.fit_tfidf(docs)
    found = blocks.counted(docs, keep=["label"]).encode(model.vocabulary)
    pairs = [{str((r["doc_id"], r["label"])): [(t["term_id"], round(t["weight"], 9)) for t in r["terms"]] for r in df.collect()} for df in (found, model.encode(docs, keep=["label"]))]
    assert pairs[0] == pairs[1]


def test_no_rows(docs):
    m = catfreq.fit_category_model(docs)
    none = blocks.unit_rows(m.tfidf, docs.limit(0))
    guess = docs.select("doc_id", F.lit(1).alias("prediction"))
    assert none.frame().count() == 0 == catfreq.explain_terms(none, guess, m.cf).count()


@pytest.mark.parametrize(
    "query",
    [weighting.weights_of_predicted_class, weighting.probabilistic_weights, weighting.maximum_weights, weighting.inverse_category_rows, weighting.term_explanation, weighting.top_terms_of_document, storage.sparse_vector_round_trip],
)
def test_no_lookup_per_document_and_term(spark, monkeypatch, query):
    """Rows met their values once per document and term, over shuffles of all of them."""

    def refused(*_args, **_more):
        raise AssertionError("terms of documents are looked up one by one")

    monkeypatch.setattr(tfidf, "lookup", refused)
    monkeypatch.setattr(tfidf, "normalize_rows", refused)
    monkeypatch.setattr(tfidf, "unit_rows", refused)
    monkeypatch.setattr(joins, "salted_join", refused)
    query(spark, "/root/testdata/sf0.001")
