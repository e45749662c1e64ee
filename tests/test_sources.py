"""Readers, writers, vector storage and incremental jobs."""

import os
import uuid

import pytest
from pyspark.sql import functions as F

from sparktext.operators import catfreq, tfidf
from sparktext.plans.statistics import observed_run
from sparktext.sources import readers, vectors, writers
from sparktext.streaming import increments

CORPUS = "doc_id bigint, text string, label int"


@pytest.fixture
def path(tmp_path):
    return lambda: str(tmp_path / uuid.uuid4().hex)


def test_csv_quotes_newlines_and_empty(spark, path):
    rows = [(1, 'a "quoted", text\nwith lines', 0), (2, None, 1), (3, "plain", None)]
    df = spark.createDataFrame(rows, CORPUS)
    p = path()
    writers.write_csv(df, p)
    writers.write_csv(df.limit(1), p, "append")
    got = readers.read_csv(spark, p, CORPUS)
    assert got.count() == 4
    assert set(map(tuple, got.collect())) == set(rows)


def test_csv_writes_vectors_as_json_text(spark, path):
    p = path()
    writers.write_csv(spark.createDataFrame([(1, [0.5, 1.0])], "doc_id bigint, embeddings array<double>"), p)
    back = readers.read_csv(spark, p, "doc_id bigint, embeddings string")
    assert back.select(vectors.from_json_text("embeddings")).first()[0] == [0.5, 1.0]


def test_partition_pruning(spark, path):
    p = path()
    df = spark.createDataFrame([(1, "eng"), (2, "deu")], "doc_id bigint, language string")
    writers.write_parquet(df, p, partition_by=["language"])
    pruned = readers.read_parquet(spark, p, {"language": "eng"})
    assert [r["doc_id"] for r in pruned.collect()] == [1]
    assert "PartitionFilters: [isnotnull(language" in pruned._jdf.queryExecution().executedPlan().toString()


def test_json_array_file(spark, path):
    p = path()
    with open(p, "w") as f:
        f.write('[\n {"doc_id": 1, "text": "a", "label": 0},\n {"doc_id": 2, "text": "b", "label": 1}\n]')
    assert readers.read_json_array(spark, p, CORPUS).count() == 2
    df = spark.createDataFrame([(i, f"t{i}", 0) for i in range(50)], CORPUS).repartition(3)
    q = path()
    writers.write_json_array(df, q)
    assert {r["doc_id"] for r in readers.read_json_array(spark, q, CORPUS).collect()} == set(range(50))


SECTIONS = "###123\nBACKGROUND\tFirst\tpart.\nODD\tdropped\nRESULTS\tSecond.\n\n###124\nMETHODS\tOnly.\n\n"


def test_sectioned_text(spark, path):
    p = path()
    with open(p, "w") as f:
        f.write(SECTIONS)
    got = {(r["id"], r["text"], r["label"], r["label_text"]) for r in readers.read_sections(spark, p).collect()}
    assert got == {("123", "First\tpart.", 0, "BACKGROUND"), ("123", "Second.", 1, "RESULTS"), ("124", "Only.", 3, "METHODS")}
    lines = {(r["group_id"], r["target"], r["text"], r["line_number"], r["total_lines"]) for r in readers.read_positioned_lines(spark, p).collect()}
    assert ("123", "BACKGROUND", "first\tpart.", 0, 2) in lines and ("124", "METHODS", "only.", 0, 0) in lines


def test_section_marks_inside_text_and_windows_line_ends(spark, path):
    p = path()
    with open(p, "w", newline="") as f:
        f.write("###7\r\nBACKGROUND\tlevel ### of sig \r\nMETHODS\t### here\r\n\r\n###8\r\nOBJECTIVE\tend\r\nCONCLUSIONS\tlast\r\n")
    got = {(r["id"], r["text"], r["label"]) for r in readers.read_sections(spark, p).collect()}
    assert got == {("7", "level ### of sig", 0), ("7", "### here", 3), ("8", "end", 4), ("8", "last", 2)}


def test_word_vector_text_with_header(spark, path):
    p = path()
    with open(p, "w") as f:
        f.write("2 3\ncat 0.5 1 -2\ndog 1 2 3\n")
    got = {r["word"]: r["vector"] for r in readers.read_word_vectors(spark, p).collect()}
    assert got == {"cat": [0.5, 1.0, -2.0], "dog": [1.0, 2.0, 3.0]}


def test_metric_files_union_by_name(spark, path):
    p = path()
    os.makedirs(p)
    for name, body in (("a.json", '{"accuracy": 0.5}'), ("b.json", '{\n "accuracy": 0.7,\n "f1": 0.6\n}')):
        with open(os.path.join(p, name), "w") as f:
            f.write(body)
    got = {(r["file_name"], r["accuracy"], r["f1"]) for r in readers.read_metrics(spark, p).collect()}
    assert got == {("a.json", 0.5, None), ("b.json", 0.7, 0.6)}


def test_split_path():
    config = {"dataset": {"train": "a", "test": "b"}}
    assert [readers.split_path(config, m) for m in ("train", "encode", "val")] == ["a", "b", "b"]
    with pytest.raises(ValueError):
        readers.split_path(config, "predict")


def test_sparse_vectors(spark, tiny, path):
    model = tfidf.fit_tfidf(tiny)
    encoded = model.encode(tiny, keep=["label"])
    p = path()
    vectors.write_vectors(encoded, model.size, p)
    stored = {r["doc_id"]: r["features"] for r in vectors.read_vectors(spark, p).collect()}
    lazy = {r["doc_id"]: r["features"] for r in vectors.as_vectors(encoded, model.size).collect()}
    assert stored == lazy
    assert stored[2].size == 3 and stored[2].toArray().tolist() == [1.0, 0.0, 0.0]


def test_saved_models(spark, tiny, path):
    p = path()
    model = catfreq.fit_category_model(tiny, tfidf.TermOptions(ngram_range=(1, 2)))
    model.save(p)
    loaded = catfreq.CategoryModel.load(spark, p)
    assert loaded.tfidf.options == model.tfidf.options and loaded.tfidf.size == model.tfidf.size
    key = ["doc_id", "term", "weight"]
    assert sorted(map(tuple, loaded.encode_with_labels(tiny).select(*key).collect())) == sorted(
        map(tuple, model.encode_with_labels(tiny).select(*key).collect())
    )


def test_increments_resume_and_do_not_repeat(spark, path):
    source, sink, state = path(), path(), path()
    df = spark.createDataFrame([(i, f"text {i}", 0) for i in range(30)], CORPUS)
    run = lambda: increments.process_increments(
        spark, source, df.schema, lambda b: b.withColumn("n", F.length("text")), sink, state
    )
    df.where("doc_id < 20").repartition(4).write.parquet(source)
    run()
    assert spark.read.parquet(sink).count() == 20
    run()
    assert spark.read.parquet(sink).count() == 20
    df.where("doc_id >= 20").write.mode("append").parquet(source)
    run()
    assert {r["doc_id"] for r in spark.read.parquet(sink).collect()} == set(range(30))


def test_batch_increments(spark, path):
    source, sink, state = path(), path(), path()
    df = spark.createDataFrame([(i, f"w{i % 3} x", i % 2) for i in range(12)], CORPUS)
    df.repartition(3).write.parquet(source)
    model = tfidf.fit_tfidf(df)
    increments.process_batches(spark, source, df.schema, lambda b: model.encode(b).select("doc_id", "terms"), sink, state)
    once = {r["doc_id"]: r["terms"] for r in model.encode(df).collect()}
    assert {r["doc_id"]: r["terms"] for r in spark.read.parquet(sink).collect()} == once


def test_observed_run(spark, tiny, path):
    encoded = tfidf.fit_tfidf(tiny, tfidf.TermOptions(min_df=2)).encode(tiny)
    p = path()
    row = observed_run(encoded, F.size("terms") == 0, lambda df: writers.write_parquet(df, p)).first()
    assert (row["total_samples"], row["successful_samples"], row["error_rate"]) == (3, 3, 0.0)
    assert spark.read.parquet(p).count() == 3
