"""Terms, vocabulary and TF-IDF."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparktext.functions import text
from sparktext.operators import blocks, catfreq, cleaning, tfidf
from sparktext.plans.catalog.registry import (
    SQL_COUNTS,
    SQL_TOKENS,
    STOPS,
    corpus,
    documents,
    query,
    sql_clean,
)
from sparktext.sources.readers import read_table

# All terms of all documents, with smoothed idf and ids in term order.
SQL_VOCABULARY = f"""{SQL_COUNTS}, nd AS (SELECT count(*) AS n FROM documents),
top AS (SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS corpus_count FROM counts GROUP BY term),
vocabulary AS (SELECT term, CAST(row_number() OVER (ORDER BY term) - 1 AS INTEGER) AS term_id, df, corpus_count, ln((1 + n) / (1 + df)) + 1 AS idf FROM top, nd)"""
SQL_TFIDF = f"""{SQL_VOCABULARY}, raw AS (SELECT doc_id, label, term, term_id, tf * idf AS w FROM counts JOIN vocabulary USING (term)),
tfidf AS (SELECT doc_id, label, term, term_id, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS weight FROM raw)"""


def options(**kw) -> tfidf.TermOptions:
    return tfidf.TermOptions(**kw)


def unit_rows(spark, sf, keep=()):
    """Long unit TF-IDF rows of all documents; shared by the weighting queries."""
    df = corpus(spark, sf)
    return tfidf.fit_tfidf(df, options()).transform(df, keep=keep)


def _ngram_sql(n: int) -> str:
    parts = " || ' ' || ".join(f"ts[i + {j}]" for j in range(n))
    return f"SELECT doc_id, unnest(list_transform(range(1, len(ts) - {n - 2}), lambda i: {parts})) AS term FROM t"


@query(
    "t1_ngram_counts",
    f"WITH t AS (SELECT doc_id, regexp_extract_all(lower(text), '{text.TERM}') AS ts FROM documents), g AS ({_ngram_sql(1)} UNION ALL {_ngram_sql(2)} UNION ALL {_ngram_sql(3)}) "
    "SELECT doc_id, count(*) AS grams, count(DISTINCT term) AS distinct_grams, max(term) AS last_gram FROM g GROUP BY doc_id",
)
def ngram_counts(spark, sf):
    def shape(counts):
        n = F.size(counts)
        grams = F.aggregate(counts, F.lit(0).cast("bigint"), lambda total, t: total + t["tf"])
        return F.struct(grams.alias("grams"), n.cast("bigint").alias("distinct_grams"), F.get(counts, n - 1)["term"].alias("last_gram"))

    # Counted terms are in order, so a text is done inside its row; only rows that share an id still meet.
    counts = text.term_counts(tfidf.term_column("text", tfidf.TermOptions(ngram_range=(1, 3))))
    found = text.keep_if(text.let(counts, shape), lambda s: s["distinct_grams"] > 0)
    rows = documents(spark, sf).select("doc_id", found.alias("_s")).select("doc_id", "_s.*")
    return rows.groupBy("doc_id").agg(F.sum("grams").alias("grams"), F.sum("distinct_grams").alias("distinct_grams"), F.max("last_gram").alias("last_gram"))


@query(
    "t2_vocabulary",
    f"""WITH {SQL_TOKENS}, nd AS (SELECT count(*) AS n FROM documents), c AS (SELECT doc_id, term, count(*) AS tf FROM tokens WHERE term NOT IN ({STOPS}) GROUP BY ALL),
v AS (SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS corpus_count FROM c, nd GROUP BY term, n HAVING count(*) >= 2 AND count(*) <= 0.5 * n ORDER BY corpus_count DESC, term LIMIT 2000)
SELECT term, CAST(row_number() OVER (ORDER BY term) - 1 AS INTEGER) AS term_id, df, corpus_count FROM v""",
)
def vocabulary(spark, sf):
    chosen = tfidf.TermOptions(min_df=2, max_df=0.5, max_features=2000, stop_words="english")
    return tfidf.fit_tfidf(documents(spark, sf), chosen).vocabulary.select("term", "term_id", "df", "corpus_count")


@query(
    "t2b_unbounded_bigram_vocabulary",
    f"""WITH t AS (SELECT doc_id, regexp_extract_all(lower(text), '{text.TERM}') AS ts FROM documents), g AS ({_ngram_sql(1)} UNION ALL {_ngram_sql(2)}),
v AS (SELECT term, count(DISTINCT doc_id) AS df FROM g GROUP BY term HAVING count(DISTINCT doc_id) >= 3) SELECT term, CAST(row_number() OVER (ORDER BY term) - 1 AS INTEGER) AS term_id, df FROM v""",
)
def unbounded_bigram_vocabulary(spark, sf):
    model = tfidf.fit_tfidf(documents(spark, sf), tfidf.TermOptions(ngram_range=(1, 2), min_df=3))
    return model.vocabulary.select("term", "term_id", "df")


@query("t3_smoothed_idf", f"WITH {SQL_VOCABULARY} SELECT term, round(idf, 9) AS idf FROM vocabulary")
def smoothed_idf(spark, sf):
    return tfidf.fit_tfidf(documents(spark, sf), options()).vocabulary.select("term", F.round("idf", 9).alias("idf"))


@query("t4_tfidf_rows", f"WITH {SQL_TFIDF} SELECT doc_id, term_id, round(weight, 6) AS weight FROM tfidf")
def tfidf_rows(spark, sf):
    return unit_rows(spark, sf).select("doc_id", "term_id", F.round("weight", 6).alias("weight"))


@query(
    "t4_top_terms_per_class",
    f"""WITH c AS (SELECT doc_id, lang, {sql_clean('text')} AS text FROM documents), kept AS (SELECT * FROM c WHERE trim(text) <> ''),
counts AS (SELECT doc_id, lang, term, count(*) AS tf FROM (SELECT doc_id, lang, unnest(regexp_extract_all(lower(text), '{text.TERM}')) AS term FROM kept) GROUP BY ALL),
nd AS (SELECT count(*) AS n FROM kept), v AS (SELECT term, ln((1 + max(n)) / (1 + count(*))) + 1 AS idf, sum(tf) AS cc FROM counts, nd GROUP BY term),
w AS (SELECT doc_id, lang, term, tf * idf AS w FROM counts JOIN v USING (term)), u AS (SELECT lang, term, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS u FROM w),
s AS (SELECT lang, count(*) AS docs FROM kept GROUP BY lang), m AS (SELECT lang, term, sum(u) / max(docs) AS mean_weight FROM u JOIN s USING (lang) GROUP BY lang, term)
SELECT lang, term, round(mean_weight, 6) AS mean_weight, row_number() OVER (PARTITION BY lang ORDER BY round(mean_weight, 6) DESC, term) AS rank FROM m QUALIFY rank <= 5""",
)
def top_terms_per_class(spark, sf):
    df = cleaning.clean_text(documents(spark, sf).select("doc_id", "lang", "text"), drop_blank=True)
    docs = blocks.counted(df, options(), keep=["lang"])
    rows = docs.summed(docs.weights(), "lang")
    sizes = docs.rows().groupBy("lang").agg(F.count(F.lit(1)).alias("_docs"))
    # Classes x vocabulary is bounded, so the ranking below sees few rows.
    sums = rows.groupBy("lang", "term").agg(F.sum("weight").alias("_sum")).join(sizes, "lang")
    means = sums.select("lang", "term", F.round(F.col("_sum") / F.col("_docs"), 6).alias("mean_weight"))
    best = catfreq.top_terms(means, 5, "lang", "mean_weight")
    return best.select("lang", "term", "mean_weight", F.col("rank").cast("bigint").alias("rank"))


@query(
    "t5_encode_new_documents",
    f"""WITH {SQL_VOCABULARY}, b AS (SELECT item_id, term, count(*) AS tf FROM (SELECT item_id, unnest(regexp_extract_all(lower(text), '{text.TERM}')) AS term FROM benchmark) GROUP BY ALL),
w AS (SELECT item_id, term_id, tf * idf AS w FROM b JOIN vocabulary USING (term)), u AS (SELECT item_id, term_id, w / sqrt(sum(w * w) OVER (PARTITION BY item_id)) AS u FROM w)
SELECT item_id, count(u) AS nonzeros, round(coalesce(sum(u), 0), 6) AS total FROM benchmark LEFT JOIN u USING (item_id) GROUP BY item_id""",
)
def encode_new_documents(spark, sf):
    model = tfidf.fit_tfidf(documents(spark, sf), options())
    encoded = model.encode(read_table(spark, sf, "benchmark", "item_id"), key="item_id")
    total = F.aggregate("terms", F.lit(0.0), lambda acc, t: acc + t["weight"])
    return encoded.select("item_id", F.size("terms").cast("bigint").alias("nonzeros"), F.round(total, 6).alias("total"))


@query("t4b_row_norms", f"WITH {SQL_TFIDF} SELECT doc_id, count(*) AS nonzeros, round(sqrt(sum(weight * weight)), 9) AS norm FROM tfidf GROUP BY doc_id")
def row_norms(spark, sf):
    norm = F.round(F.sqrt(F.sum(F.col("weight") * F.col("weight"))), 9)
    return unit_rows(spark, sf).groupBy("doc_id").agg(F.count(F.lit(1)).alias("nonzeros"), norm.alias("norm"))


@query(
    "t27_term_frequencies",
    f"""WITH {SQL_COUNTS}, v AS (SELECT term, CAST(sum(tf) AS BIGINT) AS corpus_count FROM counts GROUP BY term)
SELECT * FROM (SELECT 'most' AS side, term, corpus_count FROM v ORDER BY corpus_count DESC, term LIMIT 5) UNION ALL SELECT * FROM (SELECT 'least', term, corpus_count FROM v ORDER BY corpus_count, term LIMIT 5)
UNION ALL SELECT 'vocabulary size', 'all', count(*) FROM v""",
)
def term_frequencies(spark, sf):
    counts = tfidf.doc_terms(documents(spark, sf), tfidf.TermOptions()).groupBy("term").agg(F.sum("tf").alias("corpus_count"))
    most = counts.orderBy(F.desc("corpus_count"), "term").limit(5).select(F.lit("most").alias("side"), "*")
    least = counts.orderBy("corpus_count", "term").limit(5).select(F.lit("least").alias("side"), "*")
    size = counts.agg(F.count(F.lit(1)).alias("corpus_count")).select(F.lit("vocabulary size").alias("side"), F.lit("all").alias("term"), "corpus_count")
    return most.unionByName(least).unionByName(size)


@query(
    "t26_encoding_statistics",
    f"""WITH {SQL_COUNTS}, v AS (SELECT term FROM counts GROUP BY term HAVING count(*) >= 50), k AS (SELECT DISTINCT doc_id FROM counts JOIN v USING (term))
SELECT count(*) AS total_samples, count(k.doc_id) AS successful_samples, round(1 - count(k.doc_id) / CAST(count(*) AS DOUBLE), 9) AS error_rate FROM documents d LEFT JOIN k USING (doc_id)""",
)
def encoding_statistics(spark, sf):
    from sparktext.plans.statistics import encoding_counts

    df = documents(spark, sf)
    encoded = tfidf.fit_tfidf(df, tfidf.TermOptions(min_df=50)).encode(df)
    return encoding_counts(encoded, F.size("terms") == 0).withColumn("error_rate", F.round("error_rate", 9))


