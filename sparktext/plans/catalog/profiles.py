"""Counts, statistics and joins over the corpus."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparktext.functions import text
from sparktext.operators import joins, labels, profile, tfidf
from sparktext.operators.sampling import row_chunks, train_test_split
from sparktext.plans.catalog.registry import (
    SQL_CORPUS,
    SQL_COUNTS,
    SQL_SIZED,
    SQL_TOKENS,
    corpus,
    documents,
    query,
    sized,
)
from sparktext.sources.readers import read_table

_P = "SELECT {g}CAST({p} AS DOUBLE) AS p, round(quantile_cont(n_words, {p}), 6) AS value FROM sized {by}"


def _sql_percentiles(ps, group: str = "") -> str:
    g, by = (f"{group}, ", f"GROUP BY {group}") if group else ("", "")
    return " UNION ALL ".join(_P.format(g=g, p=p, by=by) for p in ps)


@query("a1_label_counts", f"WITH {SQL_CORPUS} SELECT label_text, count(*) AS n FROM corpus GROUP BY 1")
def label_counts(spark, sf):
    return profile.label_counts(corpus(spark, sf), "label_text")


@query("a1b_label_counts_by_label", f"WITH {SQL_CORPUS} SELECT label, count(*) AS n FROM corpus GROUP BY 1")
def label_counts_by_label(spark, sf):
    return profile.label_counts(corpus(spark, sf), "label", by_label=True)


@query(
    "a2_class_shares",
    "SELECT lang, count(*) AS n, round(count(*) / CAST(sum(count(*)) OVER () AS DOUBLE), 9) AS share FROM documents GROUP BY 1",
)
def class_shares(spark, sf):
    return profile.class_shares(read_table(spark, sf, "documents"), "lang").withColumn("share", F.round("share", 9))


@query(
    "a3_counts_by_set",
    "WITH d AS (SELECT [lang, source] AS s FROM documents) SELECT array_to_string(list_sort(s), ',') AS tags, count(*) AS n FROM d GROUP BY 1",
)
def counts_by_set(spark, sf):
    tagged = read_table(spark, sf, "documents").select(F.array("source", "lang").alias("tags"))
    return profile.set_counts(tagged, "tags").select(F.array_join("tags", ",").alias("tags"), "n")


@query(
    "a4_distinct_values",
    "SELECT count(DISTINCT lang) AS langs, count(DISTINCT source) AS sources, count(DISTINCT text) AS texts FROM documents",
)
def distinct_values(spark, sf):
    # Texts are compared by a 256-bit digest, so whole texts do not travel.
    df = read_table(spark, sf, "documents").select("lang", "source", F.sha2("text", 256).alias("digest"))
    counts = None
    for column, name in (("lang", "langs"), ("source", "sources"), ("digest", "texts")):
        one = df.where(F.col(column).isNotNull()).select(column).distinct().agg(F.count(F.lit(1)).alias(name))
        counts = one if counts is None else counts.crossJoin(F.broadcast(one))
    return counts


@query("a5_distinct_label_pairs", f"WITH {SQL_CORPUS} SELECT DISTINCT label, label_text FROM corpus")
def distinct_label_pairs(spark, sf):
    return corpus(spark, sf).select("label", "label_text").dropDuplicates()


@query(
    "a6_word_count_extremes",
    f"WITH {SQL_SIZED} SELECT round(avg(n_words), 6) AS mean, max(n_words) AS longest, min(n_words) AS shortest FROM sized",
)
def word_count_extremes(spark, sf):
    return sized(spark, sf).agg(F.round(F.avg("n_words"), 6).alias("mean"), F.max("n_words").alias("longest"), F.min("n_words").alias("shortest"))


_DESCRIBE = (
    "count(n_words) AS n, round(avg(n_words), 6) AS mean, round(stddev_samp(n_words), 6) AS std, CAST(min(n_words) AS DOUBLE) AS min, "
    "round(quantile_cont(n_words, 0.25), 6) AS q25, round(quantile_cont(n_words, 0.5), 6) AS q50, round(quantile_cont(n_words, 0.75), 6) AS q75, "
    "CAST(max(n_words) AS DOUBLE) AS max FROM sized"
)
_ROUNDED = ("mean", "std", "q25", "q50", "q75")


def _rounded(df, *names, digits=6):
    return df.withColumns({n: F.round(n, digits) for n in names})


@query("a7_describe", f"WITH {SQL_SIZED} SELECT {_DESCRIBE}")
def describe(spark, sf):
    return _rounded(profile.describe(sized(spark, sf), "n_words"), *_ROUNDED)


# One class is NULL: it is a group like any other.
SQL_NULLED = SQL_SIZED.replace("lang AS label_text", "nullif(lang, 'es') AS label_text")


def _nulled(spark, sf):
    return sized(spark, sf).withColumn("label_text", F.nullif("label_text", F.lit("es")))


@query("a8_describe_per_class", f"WITH {SQL_NULLED} SELECT label_text, {_DESCRIBE} GROUP BY label_text")
def describe_per_class(spark, sf):
    return _rounded(profile.describe(_nulled(spark, sf), "n_words", ["label_text"]), *_ROUNDED)


@query("a9_percentiles", f"WITH {SQL_SIZED} {_sql_percentiles((0.05, 0.95, 0.98))}")
def percentiles(spark, sf):
    return _rounded(profile.percentiles(sized(spark, sf), "n_words", (0.05, 0.95, 0.98)), "value")


@query(
    "a10_null_counts",
    "SELECT 'lang' AS column_name, count(*) FILTER (lang IS NULL) AS nulls FROM documents UNION ALL "
    "SELECT 'source', count(*) FILTER (nullif(source, 'src0') IS NULL) FROM documents UNION ALL "
    "SELECT 'text', count(*) FILTER (text IS NULL) FROM documents",
)
def null_counts(spark, sf):
    df = read_table(spark, sf, "documents").select("lang", F.nullif("source", F.lit("src0")).alias("source"), "text")
    return profile.null_counts(df)


def _sql_histogram(bins: int, group: str = "") -> str:
    g, by = (f"{group}, ", f"GROUP BY {group}") if group else ("", "")
    on = f"r.{group} IS NOT DISTINCT FROM s.{group}" if group else "true"
    same = f"b.{group} IS NOT DISTINCT FROM e.{group} AND " if group else ""
    return (
        f"WITH {SQL_NULLED if group else SQL_SIZED}, r AS (SELECT {g}CAST(min(n_words) AS DOUBLE) AS lo, CAST(max(n_words) AS DOUBLE) AS hi FROM sized {by}), "
        f"b AS (SELECT {'s.' + g if g else ''}CAST(least(floor((n_words - lo) / ((hi - lo) / {bins})), {bins - 1}) AS BIGINT) AS bin, count(*) AS n FROM sized s JOIN r ON {on} GROUP BY ALL), "
        f"e AS (SELECT {g}lo, hi, unnest(range(0, {bins})) AS bin FROM r) "
        f"SELECT {'e.' + g if g else ''}e.bin, round(lo + e.bin * (hi - lo) / {bins}, 6) AS left_edge, coalesce(n, 0) AS n FROM e LEFT JOIN b ON {same}b.bin = e.bin"
    )


@query("a11_histogram", _sql_histogram(50))
def histogram(spark, sf):
    return _rounded(profile.histogram(sized(spark, sf), "n_words", 50), "left_edge")


@query("a12_histogram_per_class", _sql_histogram(30, "label_text"))
def histogram_per_class(spark, sf):
    return _rounded(profile.histogram(_nulled(spark, sf), "n_words", 30, ["label_text"]), "left_edge")


@query(
    "a13_box_plot_per_class",
    f"""WITH {SQL_NULLED}, q AS (SELECT label_text, quantile_cont(n_words, 0.25) AS q25, quantile_cont(n_words, 0.5) AS q50, quantile_cont(n_words, 0.75) AS q75 FROM sized GROUP BY 1),
j AS (SELECT s.*, q25, q50, q75, n_words BETWEEN q25 - 1.5 * (q75 - q25) AND q75 + 1.5 * (q75 - q25) AS inside FROM sized s JOIN q ON s.label_text IS NOT DISTINCT FROM q.label_text)
SELECT label_text, round(q25, 6) AS q25, round(q50, 6) AS q50, round(q75, 6) AS q75, CAST(min(n_words) FILTER (inside) AS DOUBLE) AS whisker_low,
CAST(max(n_words) FILTER (inside) AS DOUBLE) AS whisker_high, count(*) FILTER (NOT inside) AS outliers FROM j GROUP BY label_text, q25, q50, q75""",
)
def box_plot_per_class(spark, sf):
    return _rounded(profile.box_plot(_nulled(spark, sf), "n_words", ["label_text"]), "q25", "q50", "q75")


@query(
    "a14_length_density",
    f"""WITH {SQL_SIZED}, s AS (SELECT count(*) AS n, stddev_samp(n_words) * pow(count(*), -0.2) AS w, min(n_words) AS lo, max(n_words) AS hi FROM sized),
g AS (SELECT unnest(range(0, 200)) AS point), x AS (SELECT point, lo + point * (hi - lo) / 199.0 AS x, n, w FROM g, s)
SELECT point, round(x, 6) AS x, round(sum(exp(-0.5 * pow((x - n_words) / w, 2))) / (n * w * sqrt(2 * pi())), 9) AS density FROM x, sized GROUP BY point, x, n, w""",
)
def length_density(spark, sf):
    out = profile.density(sized(spark, sf), "n_words", 200)
    return out.select("point", F.round("x", 6).alias("x"), F.round("density", 9).alias("density"))


@query(
    "a17_mean_of_chunk_accuracies",
    """WITH c AS (SELECT (row_number() OVER (ORDER BY event_id) - 1) // 700 AS chunk, CASE WHEN value > 10 AND event_type = 'purchase' OR value <= 10 AND event_type <> 'purchase' THEN 1.0 ELSE 0.0 END AS hit FROM events),
a AS (SELECT chunk, avg(hit) AS accuracy FROM c GROUP BY chunk) SELECT count(*) AS chunks, round(avg(accuracy), 9) AS mean_accuracy FROM a""",
)
def mean_of_chunk_accuracies(spark, sf):
    hit = ((F.col("value") > 10) == (F.col("event_type") == "purchase")).cast("double")
    chunks = row_chunks(read_table(spark, sf, "events").select("event_id", hit.alias("hit")), 700, "event_id")
    per_chunk = chunks.groupBy("chunk_id").agg(F.avg("hit").alias("accuracy"))
    return per_chunk.agg(F.count(F.lit(1)).alias("chunks"), F.round(F.avg("accuracy"), 9).alias("mean_accuracy"))


@query("a18_smallest_class", "SELECT min(n) AS smallest FROM (SELECT count(*) AS n FROM documents GROUP BY lang)")
def smallest_class(spark, sf):
    return profile.smallest_class(read_table(spark, sf, "documents"), "lang")


@query(
    "a19_matrix_shape",
    f"WITH {SQL_COUNTS} SELECT (SELECT count(DISTINCT doc_id) FROM documents) AS n_rows, count(DISTINCT term) AS n_columns, count(*) AS nonzeros, "
    "round(count(*) / (CAST((SELECT count(*) FROM documents) AS DOUBLE) * count(DISTINCT term)), 9) AS density FROM counts",
)
def matrix_shape(spark, sf):
    df = documents(spark, sf)
    counts = tfidf.doc_terms(df, tfidf.TermOptions())
    shape = profile.matrix_shape(counts, df, counts.select("term").distinct())
    return shape.withColumn("density", F.round("density", 9))


@query(
    "j1_common_column_join",
    "WITH a AS (SELECT lang, n_chars, md5(text) AS digest, count(*) AS left_rows FROM documents WHERE source < 'src5' GROUP BY ALL), "
    "b AS (SELECT lang, n_chars, md5(text) AS digest, count(*) AS right_rows FROM documents WHERE source >= 'src5' GROUP BY ALL) "
    "SELECT a.lang, a.n_chars, a.digest, left_rows, right_rows FROM a JOIN b ON a.lang IS NOT DISTINCT FROM b.lang AND a.n_chars IS NOT DISTINCT FROM b.n_chars AND a.digest IS NOT DISTINCT FROM b.digest",
)
def common_column_join(spark, sf):
    df = documents(spark, sf).select("source", "lang", "n_chars", F.md5("text").alias("digest"))
    return joins.common_rows(df.where("source < 'src5'").drop("source"), df.where("source >= 'src5'").drop("source"))


@query(
    "j2_vocabulary_lookup",
    f"WITH {SQL_COUNTS}, v AS (SELECT term FROM counts WHERE label = 1 GROUP BY term HAVING count(*) >= 20) "
    "SELECT doc_id, count(*) AS known_terms, CAST(sum(tf) AS BIGINT) AS known_tokens FROM counts JOIN v USING (term) GROUP BY doc_id",
)
def vocabulary_lookup(spark, sf):
    counts = tfidf.doc_terms(corpus(spark, sf), tfidf.TermOptions(), keep=["label"])
    vocabulary = counts.where("label = 1").groupBy("term").agg(F.count(F.lit(1)).alias("n")).where("n >= 20").select("term")
    known = joins.lookup(counts, vocabulary, ["term"], spread_on="doc_id")
    return known.groupBy("doc_id").agg(F.count(F.lit(1)).alias("known_terms"), F.sum("tf").alias("known_tokens"))


@query(
    "j2b_salted_vocabulary_join",
    f"WITH {SQL_COUNTS}, v AS (SELECT term, count(*) AS df FROM counts GROUP BY term) "
    "SELECT doc_id, CAST(sum(df) AS BIGINT) AS df_sum FROM counts JOIN v USING (term) GROUP BY doc_id",
)
def salted_vocabulary_join(spark, sf):
    counts = tfidf.doc_terms(documents(spark, sf), tfidf.TermOptions())
    vocabulary = counts.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    return joins.salted_join(counts, vocabulary, ["term"], spread_on="doc_id").groupBy("doc_id").agg(F.sum("df").alias("df_sum"))


@query(
    "j4_label_names",
    f"WITH {SQL_CORPUS}, names AS (SELECT DISTINCT label, label_text AS name FROM corpus WHERE label <> 2) SELECT doc_id, label, name FROM corpus LEFT JOIN names USING (label)",
)
def label_names(spark, sf):
    df = corpus(spark, sf)
    names = df.where("label <> 2").select("label", F.col("label_text").alias("name")).dropDuplicates()
    return labels.label_names(df.select("doc_id", "label"), names)


@query(
    "u1_row_concatenation",
    "SELECT 'documents' AS origin, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS characters FROM documents UNION ALL "
    "SELECT 'conversations', count(*), CAST(sum(length(text)) AS BIGINT) FROM conversations UNION ALL SELECT 'benchmark', count(*), CAST(sum(length(text)) AS BIGINT) FROM benchmark",
)
def row_concatenation(spark, sf):
    frames = [read_table(spark, sf, t).select(F.lit(t).alias("origin"), "text") for t in ("documents", "conversations", "benchmark")]
    stacked = frames[0].unionByName(frames[1]).unionByName(frames[2])
    return stacked.groupBy("origin").agg(F.count(F.lit(1)).alias("n"), F.sum(F.char_length("text").cast("bigint")).alias("characters"))


@query(
    "u2_matrix_stacking",
    f"""WITH {SQL_TOKENS}, b AS (SELECT item_id, unnest(regexp_extract_all(lower(text), '{text.TERM}')) AS term FROM benchmark)
SELECT 'documents' AS block, doc_id AS row_id, count(DISTINCT term) AS nonzeros FROM tokens GROUP BY doc_id UNION ALL SELECT 'benchmark', item_id, count(DISTINCT term) FROM b GROUP BY item_id""",
)
def matrix_stacking(spark, sf):
    top = tfidf.doc_terms(documents(spark, sf), tfidf.TermOptions()).select(F.lit("documents").alias("block"), F.col("doc_id").alias("row_id"), "term")
    low = tfidf.doc_terms(read_table(spark, sf, "benchmark", "item_id"), tfidf.TermOptions(), key="item_id").select(F.lit("benchmark").alias("block"), F.col("item_id").alias("row_id"), "term")
    return top.unionByName(low).groupBy("block", "row_id").agg(F.count(F.lit(1)).alias("nonzeros"))


@query("u3_distinct_label_union", "SELECT DISTINCT lang AS label FROM documents UNION SELECT DISTINCT role FROM conversations UNION SELECT DISTINCT event_type FROM events")
def distinct_label_union(spark, sf):
    parts = [read_table(spark, sf, t).select(F.col(c).alias("label")) for t, c in (("documents", "lang"), ("conversations", "role"), ("events", "event_type"))]
    # Each part is reduced first, so the union moves only distinct values.
    return parts[0].distinct().union(parts[1].distinct()).union(parts[2].distinct()).distinct()


@query(
    "x2_mean_length_per_split",
    f"""WITH {SQL_SIZED}, r AS (SELECT *, row_number() OVER (ORDER BY md5('42:' || doc_id), doc_id) AS rn, count(*) OVER () AS n FROM sized)
SELECT CASE WHEN rn <= ceil(n * 0.2) THEN 'test' ELSE 'train' END AS split, label_text, count(*) AS n, round(avg(n_words), 6) AS mean FROM r GROUP BY ALL""",
)
def mean_length_per_split(spark, sf):
    split = train_test_split(sized(spark, sf))
    return split.groupBy("split", "label_text").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("n_words"), 6).alias("mean"))
