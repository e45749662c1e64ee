"""Steps that many queries share: tasks that follow the table's size, cheaper sums."""

import numpy as np
from pyspark.sql import functions as F

from sparktext import session
from sparktext.llm import winnowing
from sparktext.plans import boosting, classify
from sparktext.plans.catalog import QUERIES


def test_tasks_grow_with_the_table(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t.parquet")
    spark.range(20_000).select(F.col("id").alias("doc_id"), F.sha2(F.col("id").cast("string"), 256).alias("text")).coalesce(1).write.parquet(path)
    monkeypatch.setattr(session, "TASK_BYTES", 50_000)
    table = session.spread(spark.read.parquet(path), "doc_id")
    assert table.rdd.getNumPartitions() > session.parallelism(spark)
    assert table.count() == 20_000


def test_ngram_counts_merge_rows_of_one_id_without_exploding_terms(spark, tmp_path):
    rows = [(1, "aa bb aa"), (1, "cc"), (2, None), (3, ""), (None, "dd dd")]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    out = QUERIES["t1_ngram_counts"](spark, str(tmp_path))
    assert sorted((r["doc_id"] or 0, r["grams"], r["distinct_grams"], r["last_gram"]) for r in out.collect()) == [(0, 3, 2, "dd dd"), (1, 7, 6, "cc")]
    assert "Generate explode(term" not in out._jdf.queryExecution().executedPlan().toString()


def test_training_rows_are_not_in_more_parts_than_cores(spark):
    cores = spark.sparkContext.defaultParallelism
    assert classify.dealt(spark.range(100).repartition(4 * cores)).rdd.getNumPartitions() == cores


def test_hashes_of_a_text_are_found_once(spark):
    docs = spark.createDataFrame([(1, "a b c d e f"), (2, "a b c d x y"), (3, "")], "doc_id bigint, text string")
    out = winnowing.compare_edited(docs)
    assert "array_union" not in out._jdf.queryExecution().executedPlan().toString()
    same = docs.select(winnowing.selected_everywhere(F.col("text")).alias("p"))
    assert [r[0] for r in same.select(winnowing.likeness(F.col("p"), F.col("p"))).collect()] == [1.0, 1.0, 1.0]


def test_splits_are_sought_a_few_slots_at_a_time(monkeypatch):
    rng = np.random.default_rng(1)
    sums = rng.normal(size=(5, 9, 8, 2)) ** 2
    whole = boosting.best_splits(sums, 1.0, 0.5)
    sizes = []
    plain = boosting._best_splits
    monkeypatch.setattr(boosting, "_best_splits", lambda s, *rest: sizes.append(s.shape[1]) or plain(s, *rest))
    monkeypatch.setattr(boosting, "SPLIT_BYTES", 2 * sums[:, :1].nbytes)
    for a, b in zip(whole, boosting.best_splits(sums, 1.0, 0.5), strict=True):
        assert np.array_equal(a, b)
    assert max(sizes) == 2 and sum(sizes) == 9
