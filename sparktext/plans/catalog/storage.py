"""Round trips through every source and sink. Whole tables are written to the shared folder and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparktext.operators import blocks, catfreq, evaluate, tfidf
from sparktext.plans.catalog.evaluation import _SCORES, SQL_PAIRS, pairs
from sparktext.plans.catalog.registry import SQL_CORPUS, corpus, documents, query
from sparktext.plans.catalog.vectorising import SQL_TFIDF, SQL_VOCABULARY, options
from sparktext.plans.catalog.weighting import SQL_CF, model
from sparktext.plans.statistics import observed_run
from sparktext.session import scratch_path
from sparktext.sources import readers, vectors, writers
from sparktext.streaming import increments

CORPUS = "doc_id bigint, text string, label_text string, label int"
_SAME_CORPUS = f"WITH {SQL_CORPUS} SELECT doc_id, md5(nullif(text, '')) AS digest, label, label_text FROM corpus"


def _digest(df):
    return df.select("doc_id", F.md5(F.nullif("text", F.lit(""))).alias("digest"), "label", "label_text")


@query("s1_s10_csv_round_trip", _SAME_CORPUS)
def csv_round_trip(spark, sf):
    path = scratch_path(spark, "csv")
    writers.write_csv(corpus(spark, sf), path)
    return _digest(readers.read_csv(spark, path, CORPUS))


@query("s2_chunked_scan", "SELECT (doc_id // 300) AS chunk, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS characters FROM documents GROUP BY 1")
def chunked_scan(spark, sf):
    chunk = F.floor(F.col("doc_id") / 300).cast("bigint").alias("chunk")
    return documents(spark, sf).groupBy(chunk).agg(F.count(F.lit(1)).alias("n"), F.sum(F.char_length("text").cast("bigint")).alias("characters"))


@query("s3_partitioned_parquet", "SELECT doc_id, md5(text) AS digest, lang FROM documents WHERE lang = 'fr'")
def partitioned_parquet(spark, sf):
    path = scratch_path(spark, "partitioned")
    writers.write_parquet(documents(spark, sf).withColumn("language", F.col("lang")), path, partition_by=["language"])
    return readers.read_parquet(spark, path, {"language": "fr"}).select("doc_id", F.md5("text").alias("digest"), "lang")


@query("s4_s11_parquet_round_trip", _SAME_CORPUS)
def parquet_round_trip(spark, sf):
    path = scratch_path(spark, "parquet")
    writers.write_parquet(corpus(spark, sf), path)
    return _digest(readers.read_parquet(spark, path))


@query("s5_json_lines", _SAME_CORPUS)
def json_lines(spark, sf):
    path = scratch_path(spark, "json")
    writers.write_json_lines(corpus(spark, sf), path)
    return _digest(readers.read_json_lines(spark, path, CORPUS))


@query("s5b_json_arrays", "SELECT conv_id, turn, role, md5(text) AS digest FROM conversations")
def json_arrays(spark, sf):
    path = scratch_path(spark, "arrays")
    writers.write_json_array(readers.read_table(spark, sf, "conversations", "conv_id"), path)
    back = readers.read_json_array(spark, path, "conv_id bigint, turn bigint, role string, text string")
    return back.select("conv_id", "turn", "role", F.md5("text").alias("digest"))


# A record mark inside the text is text; blanks at its ends go.
_LINE = r"trim(regexp_replace('### ' || text || ' ### end', '[\r\n]+', ' ', 'g'))"
_ROLE = "CASE role WHEN 'user' THEN 'RESULTS' WHEN 'assistant' THEN 'OBJECTIVE' ELSE role END"


def _marked(spark, sf):
    turns = readers.read_table(spark, sf, "conversations")
    target = F.when(F.col("role") == "user", "RESULTS").when(F.col("role") == "assistant", "OBJECTIVE").otherwise(F.col("role"))
    return turns.select("conv_id", "turn", target.alias("target"), F.concat(F.lit("### "), "text", F.lit(" ### end")).alias("text"))


@query(
    "s7_sectioned_text",
    f"SELECT CAST(conv_id AS VARCHAR) AS id, md5({_LINE}) AS digest, CASE role WHEN 'user' THEN 1 ELSE 4 END AS label, {_ROLE} AS label_text FROM conversations WHERE role IN ('user', 'assistant')",
)
def sectioned_text(spark, sf):
    path = scratch_path(spark, "sections")
    writers.write_sections(_marked(spark, sf), path, "conv_id", "turn", "target")
    rows = readers.read_sections(spark, path)
    return rows.select("id", F.md5("text").alias("digest"), "label", "label_text")


@query(
    "s8_positioned_lines",
    f"SELECT CAST(conv_id AS VARCHAR) AS group_id, {_ROLE} AS target, md5(lower({_LINE})) AS digest, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INTEGER) AS line_number, CAST(count(*) OVER (PARTITION BY conv_id) - 1 AS INTEGER) AS total_lines FROM conversations",
)
def positioned_lines(spark, sf):
    path = scratch_path(spark, "lines")
    writers.write_sections(_marked(spark, sf), path, "conv_id", "turn", "target")
    rows = readers.read_positioned_lines(spark, path)
    return rows.select("group_id", "target", F.md5("text").alias("digest"), "line_number", "total_lines")


@query("s9_word_vector_text", "SELECT 'w' || vec_id AS word, unnest(range(0, 64)) AS dim, unnest(list_transform(embedding::DOUBLE[], lambda x: round(x, 6))) AS value FROM embeddings")
def word_vector_text(spark, sf):
    path = scratch_path(spark, "wordvectors")
    named = readers.read_table(spark, sf, "embeddings").select(F.concat(F.lit("w"), "vec_id").alias("word"), F.col("embedding").alias("vector"))
    writers.write_word_vectors(named, path)
    long = readers.read_word_vectors(spark, path).select("word", F.posexplode("vector").alias("dim", "value"))
    return long.select("word", F.col("dim").cast("bigint").alias("dim"), F.round(F.col("value").cast("double"), 6).alias("value"))


@query("s12_sparse_vector_round_trip", f"WITH {SQL_TFIDF} SELECT doc_id, label, term_id, round(weight, 6) AS weight FROM tfidf")
def sparse_vector_round_trip(spark, sf):
    path = scratch_path(spark, "sparse")
    df = corpus(spark, sf)
    docs = blocks.counted(df, options(), keep=["label"])
    fit = tfidf.fitted_terms(docs.terms(), df, options())
    vectors.write_vectors(docs.encode(fit.vocabulary), fit.size, path)
    stored = vectors.read_vectors(spark, path).schema
    # The stored form of a sparse vector, so that no row becomes as long as the vocabulary.
    form = "struct<type: tinyint, size: int, indices: array<int>, values: array<double>>"
    raw = spark.read.schema(", ".join(f"{f.name} {form if f.name == 'features' else f.dataType.simpleString()}" for f in stored)).parquet(path)
    entries = raw.select("doc_id", "label", F.explode(F.arrays_zip(F.col("features.indices").alias("i"), F.col("features.values").alias("v"))).alias("e"))
    return entries.select("doc_id", "label", F.col("e.i").alias("term_id"), F.round("e.v", 6).alias("weight"))


@query("s13_vectors_as_json_text", "SELECT vec_id, unnest(range(0, 64)) AS dim, unnest(list_transform(embedding::DOUBLE[], lambda x: round(x, 6))) AS value FROM embeddings")
def vectors_as_json_text(spark, sf):
    text = readers.read_table(spark, sf, "embeddings").select("vec_id", vectors.to_json_text(F.col("embedding").cast("array<double>")).alias("t"))
    long = text.select("vec_id", F.posexplode(vectors.from_json_text("t")).alias("dim", "value"))
    return long.select("vec_id", F.col("dim").cast("bigint").alias("dim"), F.round("value", 6).alias("value"))


@query("s14_incremental_scan", "SELECT doc_id, md5(text) AS digest, lang, length(text) AS n FROM documents WHERE length(text) >= 2")
def incremental_scan(spark, sf):
    source, sink, state = (scratch_path(spark, n) for n in ("in", "out", "state"))
    df = documents(spark, sf).select("doc_id", "text", "lang")
    writers.write_parquet(df, source)

    def transform(batch):
        return batch.where(F.char_length("text") >= 2).withColumn("n", F.char_length("text").cast("bigint"))

    increments.process_increments(spark, source, df.schema, transform, sink, state, files_per_trigger=3)
    return spark.read.parquet(sink).select("doc_id", F.md5("text").alias("digest"), "lang", "n")


@query(
    "s15_s16_metric_files",
    f"""WITH {SQL_PAIRS}, {_SCORES}, acc AS (SELECT avg(CASE WHEN label = prediction THEN 1.0::DOUBLE ELSE 0 END) AS accuracy FROM pairs),
means AS (SELECT sum(precision * support) / sum(support) AS precision, sum(recall * support) / sum(support) AS recall, sum(f1 * support) / sum(support) AS f1 FROM scores)
SELECT 'part-00000' AS file, round(accuracy, 9) AS accuracy, round(precision, 9) AS precision, round(recall, 9) AS recall, round(f1, 9) AS f1, CAST(NULL AS VARCHAR) AS note FROM acc, means
UNION ALL SELECT 'part-00000', round(accuracy, 9), NULL, NULL, NULL, 'accuracy only' FROM acc""",
)
def metric_files(spark, sf):
    path = scratch_path(spark, "metrics")
    scored = pairs(spark, sf)
    writers.write_metrics(evaluate.weighted_scores(scored), path)
    writers.write_metrics(evaluate.accuracy(scored).withColumn("note", F.lit("accuracy only")), path, "append")
    file = F.regexp_extract("file_name", "^part-[0-9]+", 0).alias("file")
    return readers.read_metrics(spark, path).select(file, *[F.round(c, 9).alias(c) for c in ("accuracy", "precision", "recall", "f1")], "note")


@query(
    "s17_saved_category_model",
    f"WITH {SQL_VOCABULARY}, {SQL_CF} SELECT CAST(label AS INTEGER) AS label, term, term_id, round(idf, 9) AS idf, round(cf, 9) AS cf FROM cf JOIN vocabulary USING (term)",
)
def saved_category_model(spark, sf):
    path = scratch_path(spark, "model")
    model(spark, sf).save(path)
    loaded = catfreq.CategoryModel.load(spark, path)
    both = loaded.cf.join(loaded.tfidf.vocabulary, "term")
    return both.select("label", "term", "term_id", F.round("idf", 9).alias("idf"), F.round("cf", 9).alias("cf"))


@query("t26b_observed_encoding_run")
def observed_encoding_run(spark, sf):
    df = documents(spark, sf).select("doc_id", "text")
    encoded = tfidf.fit_tfidf(df, options()).encode(df)
    return observed_run(encoded, F.size("terms") == 0, lambda out: writers.write_parquet(out, scratch_path(spark, "encoded")))
