"""Headline timings: prints one JSON line. Embedding jobs are run twice and the faster run counts.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8).
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F

from sparktext.functions import text
from sparktext.operators import catfreq, cleaning, tfidf, wordvec
from sparktext.plans.catalog import QUERIES
from sparktext.plans.catalog.dense import word_vectors
from sparktext.plans.catalog.registry import corpus, documents
from sparktext.session import get_session, materialize

SF = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
# Catalog queries timed besides the embedding jobs.
CATALOG = [
    "a8_describe_per_class", "a12_histogram_per_class", "v3_train_test_split", "v4_balanced_sample", "v8_stratified_folds",
    "w1_positions_in_group", "t22_cosine_similarity", "t24_quantisation_fan_out", "e3_classification_report", "e6_auc",
    "c5_naive_bayes", "p23_clean_web_pages", "f11_padded_sequences",
]


def run(df):
    df.write.format("noop").mode("overwrite").save()


def main():
    spark = get_session(
        "bench",
        f"local[{CPUS}]",
        **{
            "spark.sql.shuffle.partitions": CPUS,
            "spark.driver.memory": os.environ.get("BENCH_MEMORY", "12g"),
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    timings, rates = {}, {}

    def timed(name, fn, docs=None, runs=1):
        seconds = float("inf")
        for _ in range(runs):
            started = time.time()
            out = fn()
            seconds = min(seconds, time.time() - started)
        timings[name] = round(seconds, 3)
        if docs:
            rates[name] = round(docs / seconds, 1)
        return out

    df = corpus(spark, SF)
    n = df.count()
    run(df)  # start the JVM's warm state; not timed
    options = tfidf.TermOptions(max_features=10_000)
    timed("clean_text", lambda: run(cleaning.clean_text(documents(spark, SF).select("doc_id", "text"))), n, runs=2)
    model = timed("tfidf_fit", lambda: tfidf.fit_tfidf(df, options), n, runs=2)
    timed("tfidf_encode", lambda: run(model.encode(df, keep=["label"])), n, runs=2)
    timed("tfidf_fit_transform", lambda: run(tfidf.fit_tfidf(df, options).encode(df, keep=["label"])), n, runs=2)
    category = timed("tfidf_cf_fit", lambda: catfreq.fit_category_model(df, options), n, runs=2)
    timed("tfidf_cf_encode", lambda: run(category.encode_with_labels(df)), n, runs=2)
    timed("tfidf_cf_max_encode", lambda: run(catfreq.weight_max(category.tfidf.transform(df), category.cf)), n, runs=2)
    wide = tfidf.TermOptions(ngram_range=(1, 3), max_features=10_000)
    timed("tfidf_1_3_grams_fit_transform", lambda: run(tfidf.fit_tfidf(df, wide).encode(df, keep=["label"])), n, runs=2)
    vectors = materialize(word_vectors(spark, SF))
    lowered = df.select("doc_id", F.lower("text").alias("text"))
    timed("word_vector_encode", lambda: run(wordvec.document_vectors(lowered, vectors, 64)), n, runs=2)
    tiny = wordvec.WordVectorOptions(vector_size=32, window=3, min_count=5, epochs=1, max_vocab_size=5000, partitions=int(CPUS))
    skipgram = timed("word_vector_train", lambda: wordvec.train_word_vectors(lowered, tiny), n)
    timed("paragraph_vector_infer", lambda: run(wordvec.infer_paragraph_vectors(lowered, skipgram)), n, runs=2)
    timed("word_count", lambda: run(df.select("doc_id", text.word_count("text"))), n, runs=2)
    for name in CATALOG:
        timed(name, lambda name=name: run(QUERIES[name](spark, SF)))
    print(
        json.dumps(
            {
                "metric": "total_seconds",
                "value": round(sum(timings.values()), 3),
                "unit": "sec",
                "queries": timings,
                "docs_per_second": rates,
                "docs": n,
                "sf": SF.rsplit("sf", 1)[-1],
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
