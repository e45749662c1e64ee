"""Category weights beyond the size that is broadcast."""

import pytest

from sparktext.operators import catfreq, joins
from sparktext.operators.tfidf import TermOptions


@pytest.fixture
def corpus(spark):
    words = ["wort", "haus", "baum", "tier", "wald", "berg"]
    rows = [(i, " ".join(["alle", words[i % 6], words[(i * 5 + 1) % 6]]), i % 2) for i in range(40)] + [(40, None, 0), (41, "", 1)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, label int")


def weighted(spark, corpus):
    m = catfreq.fit_category_model(corpus, TermOptions())
    rows = m.tfidf.transform(corpus)
    guess = corpus.selectExpr("doc_id", "cast(doc_id % 3 as int) as prediction")
    chance = corpus.selectExpr("doc_id", "map(0, 0.25D, 1, 0.75D) as probabilities")
    icf = catfreq.inverse_category_frequency(m.tfidf.weights(corpus, keep=["label"])).join(m.tfidf.vocabulary.select("term", "df"), "term")
    found = {
        "hard": catfreq.weight_hard(rows, guess, m.cf),
        "max": catfreq.weight_max(rows, m.cf),
        "probabilistic": catfreq.weight_probabilistic(rows, chance, m.cf),
        "explained": catfreq.explain_terms(rows, guess, m.cf).drop("cf_scores"),
        "own": m.encode_with_labels(corpus),
        "inverse": catfreq.weight_by_inverse_cf(rows, icf, frequency="df"),
    }
    return {k: sorted(str([round(x, 9) if isinstance(x, float) else x for x in r]) for r in df.collect()) for k, df in found.items()}


def test_weights_beyond_the_broadcast_size_are_the_same_and_count_no_rows(spark, corpus, monkeypatch):
    want = weighted(spark, corpus)
    plain, given = joins.salted_join, []

    def watched(facts, table, keys, how="inner", spread_on=None, frequency=None, hot_parts=joins.HOT_PARTS):
        given.append((tuple(keys), frequency))
        return plain(facts, table, keys, how, spread_on, frequency, hot_parts)

    monkeypatch.setattr(joins, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(joins, "salted_join", watched)
    assert weighted(spark, corpus) == want
    by_weights = [f for keys, f in given if "term" in keys and f is not None]
    # One per weighting beside the vocabulary's own lookups; without a frequency the rows were made twice.
    assert by_weights.count("_often") == 5 and "df" in by_weights
