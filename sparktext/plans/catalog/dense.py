"""Dense vectors: pooling, quantisation, similarity, word and document vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparktext.functions import arrays, text
from sparktext.operators import components, embedding, tfidf, vectors, wordvec
from sparktext.operators.ranking import ranked_table
from sparktext.plans.catalog.registry import documents, query
from sparktext.session import materialize
from sparktext.sources.readers import read_table

DIM = 64
_E = "e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings)"
_NORM = "sqrt(list_sum(list_transform({v}, lambda x: x * x)))"
_UNIT = f"list_transform({{v}}, lambda x: x / {_NORM})"


def _embeddings(spark, sf) -> DataFrame:
    return read_table(spark, sf, "embeddings", "vec_id")


def entries(df: DataFrame, key: str, vector, digits: int = 6) -> DataFrame:
    """(key, dim, value) of a vector column, rounded."""
    long = df.select(key, F.posexplode(vector).alias("dim", "value"))
    return long.select(key, F.col("dim").cast("bigint").alias("dim"), F.round(F.col("value").cast("double"), digits).alias("value"))


def _joined(v) -> F.Column:
    return F.array_join(v.cast("array<string>"), ",")


@query("t6_unit_vectors", f"WITH {_E}, u AS (SELECT vec_id, v, {_NORM.format(v='v')} AS n FROM e) SELECT vec_id, unnest(range(0, {DIM})) AS dim, unnest(list_transform(v, lambda x: round(x / n, 6))) AS value FROM u")
def unit_vectors(spark, sf):
    return entries(_embeddings(spark, sf), "vec_id", arrays.l2_normalize("embedding"))


@query("t17_mean_pooling", f"WITH {_E}, x AS (SELECT label, unnest(range(0, {DIM})) AS dim, unnest(v) AS value FROM e) SELECT label, dim, round(avg(value), 6) AS value FROM x GROUP BY ALL")
def mean_pooling(spark, sf):
    return entries(vectors.mean_pool(_embeddings(spark, sf), "embedding", DIM, ["label"]), "label", F.col("embedding"))


@query("t18_truncated_vectors", f"WITH {_E} SELECT vec_id, unnest(range(0, 16)) AS dim, unnest(list_transform(v[1:16], lambda x: round(x, 6))) AS value FROM e")
def truncated_vectors(spark, sf):
    return entries(_embeddings(spark, sf), "vec_id", arrays.truncate("embedding", 16))


@query("t19_binary_quantisation", f"WITH {_E} SELECT vec_id, array_to_string(list_transform(v, lambda x: CASE WHEN x > 0 THEN 1 ELSE 0 END), ',') AS bits FROM e")
def binary_quantisation(spark, sf):
    return _embeddings(spark, sf).select("vec_id", _joined(arrays.binary_quantize("embedding")).alias("bits"))


_SCALE = "s AS (SELECT max(list_max(list_transform(v, lambda x: abs(x)))) / 127 AS scale FROM (SELECT v FROM e ORDER BY vec_id LIMIT 1000))"
_INT8 = "list_transform(v, lambda x: CAST(greatest(-127, least(127, trunc(x / scale))) AS INTEGER))"


@query("t20_int8_quantisation", f"WITH {_E}, {_SCALE} SELECT vec_id, array_to_string({_INT8}, ',') AS codes, round(scale, 9) AS scale FROM e, s")
def int8_quantisation(spark, sf):
    out = vectors.int8_vectors(_embeddings(spark, sf), "embedding", "vec_id")
    return out.select("vec_id", _joined(F.col("quantized")).alias("codes"), F.round("scale", 9).alias("scale"))


@query("t21_int8_dequantisation", f"WITH {_E}, {_SCALE} SELECT vec_id, unnest(range(0, {DIM})) AS dim, unnest(list_transform({_INT8}, lambda q: round(q * scale, 6))) AS value FROM e, s")
def int8_dequantisation(spark, sf):
    out = vectors.int8_vectors(_embeddings(spark, sf), "embedding", "vec_id")
    return entries(out, "vec_id", arrays.int8_dequantize("quantized", F.col("scale")))


def _pairs(spark, sf):
    ids = read_table(spark, sf, "embeddings").select(F.col("vec_id").alias("left_id"))
    return vectors.pair_similarity(
        ids.withColumn("right_id", F.col("left_id") + 1), read_table(spark, sf, "embeddings"), "embedding", "vec_id"
    )


@query(
    "t22_cosine_similarity",
    f"WITH {_E} SELECT a.vec_id AS left_id, b.vec_id AS right_id, round(list_cosine_similarity(a.v, b.v), 6) AS cosine FROM e a JOIN e b ON b.vec_id = a.vec_id + 1",
)
def cosine_similarity(spark, sf):
    return _pairs(spark, sf).select("left_id", "right_id", F.round("cosine", 6).alias("cosine"))


@query(
    "t23_binary_cosine_distance",
    f"""WITH {_E}, q AS (SELECT vec_id, list_transform(v, lambda x: CASE WHEN x > 0 THEN 1 ELSE 0 END) AS b, list_sum(list_transform(v, lambda x: CASE WHEN x > 0 THEN 1 ELSE 0 END)) AS n FROM e)
SELECT x.vec_id AS left_id, y.vec_id AS right_id, round(1 - list_dot_product(x.b::DOUBLE[], y.b::DOUBLE[]) / sqrt(CAST(x.n * y.n AS DOUBLE)), 6) AS binary_distance FROM q x JOIN q y ON y.vec_id = x.vec_id + 1""",
)
def binary_cosine_distance(spark, sf):
    return _pairs(spark, sf).select("left_id", "right_id", F.round("binary_distance", 6).alias("binary_distance"))


@query(
    "t24_quantisation_fan_out",
    f"""WITH {_E}, d AS (SELECT vec_id, dim, v[1:dim] AS c FROM e, (SELECT unnest([16, 32, 64]) AS dim)), u AS (SELECT vec_id, dim, c, sqrt(list_sum(list_transform(c, lambda x: x * x))) AS n FROM d),
v AS (SELECT vec_id, dim, list_transform(c, lambda x: x / n) AS v FROM u), f AS (SELECT *, row_number() OVER (PARTITION BY dim ORDER BY vec_id) AS rn FROM v),
s AS (SELECT dim, max(list_max(list_transform(v, lambda x: abs(x)))) / 127 AS scale FROM f WHERE rn <= 1000 GROUP BY dim)
SELECT vec_id, dim, 'float' AS quantization, round(list_sum(v), 6) AS total, NULL::DOUBLE AS scale FROM v
UNION ALL SELECT vec_id, dim, 'binary', CAST(list_sum(list_transform(v, lambda x: CASE WHEN x > 0 THEN 1 ELSE 0 END)) AS DOUBLE), NULL FROM v
UNION ALL SELECT vec_id, dim, 'int8', CAST(list_sum(list_transform(v, lambda x: greatest(-127, least(127, trunc(x / scale))))) AS DOUBLE), round(scale, 9) FROM v JOIN s USING (dim)""",
)
def quantisation_fan_out(spark, sf):
    out = vectors.quantization_fan_out(_embeddings(spark, sf), "embedding", "vec_id", (16, 32, 64))
    total = F.aggregate("values", F.lit(0.0), lambda acc, x: acc + x)
    return out.select("vec_id", "dim", "quantization", F.round(total, 6).alias("total"), F.round("scale", 9).alias("scale"))


@query("t25_principal_components")
def principal_components(spark, sf):
    return vectors.principal_components(_embeddings(spark, sf), "embedding", DIM, 3, "vec_id")


@query("t25b_sparse_components")
def sparse_components(spark, sf):
    """The first ten components of TF-IDF over the whole vocabulary."""
    df = documents(spark, sf)
    rows = materialize(tfidf.fit_tfidf(df, tfidf.TermOptions()).transform(df))
    return components.fit_components(df, rows, 10).transform(df, rows)


@query("t16_encoded_documents")
def encoded_documents(spark, sf):
    return vectors.encode_texts(documents(spark, sf), lambda: vectors.hashing_encoder(DIM), DIM)


# The most frequent words get the vectors of the embeddings table in order of rank.
_WV = f"""words AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '{text.WORDS}')) AS word FROM documents),
wv AS (SELECT word, embedding::DOUBLE[] AS v FROM (SELECT word, row_number() OVER (ORDER BY count(*) DESC, word) - 1 AS r FROM words GROUP BY word) JOIN embeddings ON vec_id = r)"""


def word_vectors(spark, sf) -> DataFrame:
    vecs = read_table(spark, sf, "embeddings").select(F.col("vec_id").alias("row_number"), F.col("embedding").cast("array<double>").alias("vector"))
    counts = documents(spark, sf).select(text.each(text.words(F.lower("text"))).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    best = counts.orderBy(F.desc("n"), "word").limit(vecs.count())
    ranks = ranked_table(best.withColumn("_o", F.struct((-F.col("n")).alias("n"), "word")), "_o")
    return ranks.select("word", (F.col("row_number") - 1).alias("row_number")).join(vecs, "row_number").select("word", "vector")


@query("j5_word_vector_lookup", f"WITH {_WV} SELECT doc_id, count(*) AS known, count(DISTINCT word) AS distinct_known FROM words JOIN wv USING (word) GROUP BY doc_id")
def word_vector_lookup(spark, sf):
    from sparktext.operators.joins import lookup

    counted = documents(spark, sf).select("doc_id", F.explode(text.term_counts(text.words(F.lower("text")))).alias("_t"))
    tokens = counted.select("doc_id", F.col("_t.term").alias("word"), F.col("_t.tf").alias("tf"))
    # Only known words count here: their vectors would be stored, measured and shuffled for nothing.
    known = lookup(tokens, word_vectors(spark, sf).select("word"), ["word"], spread_on="doc_id")
    return known.groupBy("doc_id").agg(F.sum("tf").alias("known"), F.count(F.lit(1)).alias("distinct_known"))


@query(
    "t12_document_vectors",
    f"""WITH {_WV}, u AS (SELECT word, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS n FROM wv), x AS (SELECT word, unnest(range(0, {DIM})) AS dim, unnest(list_transform(v, lambda y: y / n)) AS y FROM u),
c AS (SELECT doc_id, word, count(*) AS tf FROM words GROUP BY ALL), m AS (SELECT doc_id, dim, sum(tf * y) / sum(tf) AS value FROM c JOIN x USING (word) GROUP BY ALL),
g AS (SELECT doc_id, unnest(range(0, {DIM})) AS dim FROM documents) SELECT doc_id, dim, round(coalesce(value, 0), 6) AS value, m.doc_id IS NULL AS is_error FROM g LEFT JOIN m USING (doc_id, dim)""",
)
def document_vectors(spark, sf):
    df = documents(spark, sf).select("doc_id", F.lower("text").alias("text"))
    out = wordvec.document_vectors(df, word_vectors(spark, sf), DIM)
    long = out.select("doc_id", "is_error", F.posexplode("vector").alias("dim", "value"))
    return long.select("doc_id", F.col("dim").cast("bigint").alias("dim"), F.round("value", 6).alias("value"), "is_error")


_GRAMS = "SELECT DISTINCT word, {v}substring('<' || word || '>', i, n) AS gram FROM (SELECT *, unnest(range(1, length(word) + 3 - n + 1)) AS i FROM (SELECT *, unnest([3, 4, 5, 6]) AS n FROM {t}))"


@query(
    "t11_unknown_word_vectors",
    f"""WITH {_WV}, unknown AS (SELECT DISTINCT word FROM (SELECT unnest(regexp_extract_all(lower(text), '{text.WORDS}')) AS word FROM benchmark) WHERE word NOT IN (SELECT word FROM wv)),
kg AS ({_GRAMS.format(v='', t='wv')}), x AS (SELECT word, unnest(range(0, {DIM})) AS dim, unnest(v) AS y FROM wv), gv AS (SELECT gram, dim, avg(y) AS y FROM kg JOIN x USING (word) GROUP BY ALL),
ug AS ({_GRAMS.format(v='', t='unknown')}) SELECT word, dim, round(avg(y), 6) AS value FROM ug JOIN gv USING (gram) GROUP BY ALL""",
)
def unknown_word_vectors(spark, sf):
    known = materialize(word_vectors(spark, sf))
    words = read_table(spark, sf, "benchmark").select(text.each(text.words(F.lower("text"))).alias("word")).distinct()
    unknown = words.join(known, "word", "left_anti")
    out = wordvec.unknown_word_vectors(unknown, wordvec.gram_vectors(known, DIM), DIM)
    return entries(out, "word", F.col("vector"))


# Small blocks, so that small tables are trained by several tasks too, and half of the default epochs.
_TRAINED = embedding.TrainingOptions(epochs=10, block_words=50_000)


def _short_docs(spark, sf):
    return documents(spark, sf).select("doc_id", F.lower("text").alias("text"))


def _extra_texts(spark, sf):
    return read_table(spark, sf, "benchmark").select(F.col("item_id").alias("doc_id"), F.lower("text").alias("text"))


@query("t10_trained_word_vectors")
def trained_word_vectors(spark, sf):
    return embedding.train(_short_docs(spark, sf), _TRAINED).word_vectors()


@query("t10b_skip_gram_on_one_machine")
def skip_gram_on_one_machine(spark, sf):
    options = wordvec.WordVectorOptions(max_vocab_size=20_000)
    return wordvec.vector_table(wordvec.train_word_vectors(_short_docs(spark, sf), options))


@query("t11b_unknown_words_from_trained_grams")
def unknown_words_from_trained_grams(spark, sf):
    model = embedding.train(_short_docs(spark, sf), _TRAINED)
    words = _extra_texts(spark, sf).select(text.each(text.words("text")).alias("word")).distinct()
    return model.unknown_word_vectors(words.join(model.vocabulary, "word", "left_anti"))


@query("t13_t14_paragraph_vectors")
def paragraph_vectors(spark, sf):
    df = _short_docs(spark, sf)
    return embedding.train(df, _TRAINED, "dm").infer(df)


@query("t13b_t14b_bag_of_words_paragraphs")
def bag_of_words_paragraphs(spark, sf):
    df = _short_docs(spark, sf)
    return embedding.train(df, _TRAINED, "dbow").infer(_extra_texts(spark, sf))


@query("t15_continued_training")
def continued_training(spark, sf):
    base = embedding.train(_short_docs(spark, sf), _TRAINED)
    return embedding.train(_extra_texts(spark, sf), _TRAINED, base=base).word_vectors()
