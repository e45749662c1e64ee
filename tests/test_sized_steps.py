"""Steps whose parts, or whose stored columns, follow from what is asked and not from fixed settings."""

from pyspark.sql import functions as F

from sparktext import session
from sparktext.operators import joins, tfidf
from sparktext.plans.catalog import dense


def _documents(spark, path):
    rows = [(i, f"common w{i} x{i % 7} " * 3) for i in range(300)]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(str(path / "documents.parquet"))


def test_known_words_are_looked_up_without_their_vectors(spark, tmp_path, monkeypatch):
    _documents(spark, tmp_path)
    spark.createDataFrame([(i, [1.0] * dense.DIM, 0) for i in range(5)], "vec_id bigint, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    seen, real = [], joins.lookup
    monkeypatch.setattr(joins, "lookup", lambda facts, table, *a, **k: seen.append(table.columns) or real(facts, table, *a, **k))
    found = {r["doc_id"]: (r["known"], r["distinct_known"]) for r in dense.word_vector_lookup(spark, str(tmp_path)).collect()}
    assert seen == [["word"]]
    # The five words are common and x0 to x3.
    assert found == {i: (6, 2) if i % 7 < 4 else (3, 1) for i in range(300)}


def test_vocabulary_is_counted_in_more_parts_for_more_text(spark, tmp_path, monkeypatch):
    _documents(spark, tmp_path)
    df = spark.read.parquet(str(tmp_path / "documents.parquet"))
    seen, real = [], tfidf.materialize
    monkeypatch.setattr(tfidf, "materialize", lambda t: seen.append(session.parallelism(spark)) or real(t))
    before = session.parallelism(spark)
    usual = tfidf.fit_tfidf(df, tfidf.TermOptions(ngram_range=(1, 2), min_df=3))
    monkeypatch.setattr(session, "TASK_BYTES", -(-session.table_bytes(df) // 10))
    sized = tfidf.fit_tfidf(df, tfidf.TermOptions(ngram_range=(1, 2), min_df=3))
    assert seen == [before, 20] and session.parallelism(spark) == before
    assert sized.size == usual.size > 0
    assert sized.vocabulary.exceptAll(usual.vocabulary).isEmpty()
    assert sized.vocabulary.where(F.col("term") == "common").first()["df"] == 300
