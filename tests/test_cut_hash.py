"""Samples by cut hash: repeated and missing ids, and how often the input is read."""

import hashlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from sparktext.operators import ranking, sampling
from sparktext.plans.catalog.registry import corpus
from sparktext.plans.catalog.vectorising import options


def place(i):
    return hashlib.md5(f"42:{i}".encode()).hexdigest()


@pytest.mark.parametrize("take", [0, 1, 7, 250, 499, 500, 900])
def test_exactly_the_first_hashes(spark, take):
    df = spark.range(500).withColumnRenamed("id", "doc_id")
    got = {r["doc_id"] for r in sampling.sample_n(df, take).collect()}
    assert got == set(sorted(range(500), key=place)[:take])


@pytest.mark.parametrize("take", [1, 40, 41, 119, 120, 200, 240])
def test_repeated_and_null_ids_are_counted_exactly(spark, take):
    ids = [None] * 40 + [7] * 80 + list(range(100, 220))
    df = spark.createDataFrame([(x, n) for n, x in enumerate(ids)], "doc_id bigint, n int")
    got = sampling.sample_n(df, take)
    rows = got.collect()
    assert len(rows) == take and len({r["n"] for r in rows}) == take
    order = sorted(ids, key=lambda i: "" if i is None else place(i))[:take]
    assert Counter(r["doc_id"] for r in rows) == Counter(order)


def test_groups_with_a_tie_in_one_of_them(spark):
    rows = [(1, "a")] * 30 + [(i, "b") for i in range(30)] + [(i, None) for i in range(5)]
    df = spark.createDataFrame(rows, "doc_id bigint, label string")
    got = sampling.balanced_sample(df, 10).collect()
    assert Counter(r["label"] for r in got) == {"a": 10, "b": 10}
    assert {r["doc_id"] for r in got if r["label"] == "b"} == set(sorted(range(30), key=place)[:10])


def test_input_is_read_once_after_the_hashes(spark):
    df = spark.range(100).select(F.col("id").alias("doc_id"), (F.col("id") % 3).alias("label"))
    for out in (sampling.train_test_split(df), sampling.balanced_sample(df, 5)):
        assert out._jdf.queryExecution().optimizedPlan().toString().count("Range (0, 100") == 1


def test_no_rows(spark):
    df = spark.range(0).withColumnRenamed("id", "doc_id").withColumn("label", F.lit(1))
    assert sampling.sample_n(df, 5).count() == 0 and sampling.balanced_sample(df, 5).count() == 0
    assert ranking.hash_cuts(df, "doc_id", lambda t: t.withColumn("take", F.lit(3)), ["label"]).count() == 0


def test_category_model_counts_pairs_once(spark):
    from sparktext.operators import catfreq, tfidf

    df = corpus(spark, "/root/testdata/sf0.001")
    model = catfreq.fit_category_model(df, options())
    terms = tfidf.fit_tfidf(df, options())
    pick = ["term", "term_id", "df", "corpus_count", "idf"]
    assert sorted(map(str, model.tfidf.vocabulary.select(*pick).collect())) == sorted(map(str, terms.vocabulary.select(*pick).collect()))


def test_padded_sequences_keep_documents_without_tokens(spark):
    from sparktext.operators import tfidf

    df = spark.createDataFrame([(1, "b a a"), (2, None), (3, ""), (4, "a")], "doc_id bigint, text string")
    got = {r["doc_id"]: r["sequence"] for r in tfidf.padded_sequences(df, 4).collect()}
    assert got == {1: [3, 2, 2, 0], 2: [0] * 4, 3: [0] * 4, 4: [2, 0, 0, 0]}
    plan = tfidf.padded_sequences(df, 4)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate [doc_id") == 1 and "Join LeftOuter, (doc_id" not in plan


def test_rare_references_are_decoded(spark):
    from html import unescape

    from sparktext.functions.html import NAMED, decode_entities

    names = sorted(NAMED)[::9] + ["&nosuchname;"]
    df = spark.createDataFrame([(n,) for n in names], "t string")
    assert all(r["v"] == unescape(r["t"]) for r in df.select("t", decode_entities("t").alias("v")).collect())
