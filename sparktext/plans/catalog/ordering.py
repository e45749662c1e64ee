"""Positions, top-k, samples and splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparktext.functions import text
from sparktext.operators import ranking, sampling, tfidf
from sparktext.plans.catalog.registry import SQL_CORPUS, SQL_COUNTS, SQL_SIZED, corpus, documents, query, sized
from sparktext.sources.readers import read_table

_HASHED = f"{SQL_CORPUS}, h AS (SELECT doc_id, label, label_text, md5('42:' || doc_id) AS k FROM corpus)"


def _labelled(spark, sf):
    return corpus(spark, sf).select("doc_id", "label", "label_text")


@query(
    "w1_positions_in_group",
    "SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS line_number, count(*) OVER (PARTITION BY conv_id) - 1 AS total_lines FROM (SELECT nullif(conv_id, 3) AS conv_id, turn FROM conversations)",
)
def positions_in_group(spark, sf):
    df = read_table(spark, sf, "conversations").select(F.nullif("conv_id", F.lit(3)).alias("conv_id"), "turn")
    return sampling.with_positions(df, "conv_id", "turn")


@query(
    "w2_carry_header_forward",
    "SELECT event_id, last_value(CASE WHEN event_type = 'purchase' THEN event_id END IGNORE NULLS) OVER (ORDER BY event_id) AS header_id FROM events",
)
def carry_header_forward(spark, sf):
    df = read_table(spark, sf, "events").select("event_id", F.when(F.col("event_type") == "purchase", F.col("event_id")).alias("header"))
    return ranking.carry_forward(df, "event_id", "header", "header_id").select("event_id", "header_id")


@query(
    "w3_first_n_per_class",
    f"WITH {SQL_CORPUS} SELECT doc_id, label FROM corpus QUALIFY row_number() OVER (PARTITION BY label ORDER BY doc_id) <= 50",
)
def first_n_per_class(spark, sf):
    return sampling.first_n_per_class(_labelled(spark, sf), 50).select("doc_id", "label")


@query("w4_row_chunks", "SELECT doc_id, (row_number() OVER (ORDER BY doc_id) - 1) // 128 AS chunk_id FROM documents")
def row_chunks(spark, sf):
    return sampling.row_chunks(read_table(spark, sf, "documents").select("doc_id"), 128)


@query(
    "w5_ratio_to_class_and_total",
    "SELECT lang, source, count(*) AS n, round(count(*) / CAST(sum(count(*)) OVER (PARTITION BY lang) AS DOUBLE), 9) AS of_class, round(count(*) / CAST(sum(count(*)) OVER () AS DOUBLE), 9) AS of_all FROM documents GROUP BY lang, source",
)
def ratio_to_class_and_total(spark, sf):
    counts = read_table(spark, sf, "documents").groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n"))
    classes = counts.groupBy("lang").agg(F.sum("n").alias("_class"))
    total = counts.agg(F.sum("n").alias("_all"))
    both = counts.join(classes, "lang").crossJoin(F.broadcast(total))
    return both.select("lang", "source", "n", F.round(F.col("n") / F.col("_class"), 9).alias("of_class"), F.round(F.col("n") / F.col("_all"), 9).alias("of_all"))


@query("o1_sorted_by_label", f"WITH {SQL_CORPUS} SELECT doc_id, label, label_text FROM corpus ORDER BY label, doc_id")
def sorted_by_label(spark, sf):
    return _labelled(spark, sf).orderBy("label", "doc_id")


@query("o2_top_k_by_count", "SELECT source, lang, count(*) AS n FROM documents GROUP BY 1, 2 ORDER BY n DESC, source, lang LIMIT 20")
def top_k_by_count(spark, sf):
    counts = read_table(spark, sf, "documents").groupBy("source", "lang").agg(F.count(F.lit(1)).alias("n"))
    return counts.orderBy(F.desc("n"), "source", "lang").limit(20)


@query(
    "o5_most_frequent_terms",
    f"WITH {SQL_COUNTS} SELECT term, CAST(sum(tf) AS BIGINT) AS corpus_count FROM counts GROUP BY term ORDER BY corpus_count DESC, term LIMIT 500",
)
def most_frequent_terms(spark, sf):
    model = tfidf.fit_tfidf(documents(spark, sf), tfidf.TermOptions(max_features=500))
    return model.vocabulary.select("term", "corpus_count")


@query("o7_first_and_next_rows", "SELECT doc_id, lang FROM documents ORDER BY doc_id LIMIT 100 OFFSET 50")
def first_and_next_rows(spark, sf):
    return sampling.head_and_next(read_table(spark, sf, "documents").select("doc_id", "lang"), 100, 50)


@query("o8_seeded_shuffle", "SELECT doc_id, row_number() OVER (ORDER BY md5('42:' || doc_id), doc_id) AS place FROM documents")
def seeded_shuffle(spark, sf):
    df = read_table(spark, sf, "documents").select("doc_id", ranking.hash_key("doc_id").alias("k"))
    return ranking.ranked(df, "k", number="place").select("doc_id", "place").orderBy("place")


@query("v1_sample_n", "SELECT doc_id FROM documents ORDER BY md5('42:' || doc_id), doc_id LIMIT 100")
def sample_n(spark, sf):
    return sampling.sample_n(read_table(spark, sf, "documents").select("doc_id"), 100)


@query("v2_sample_fraction", "SELECT doc_id FROM documents WHERE CAST('0x' || substring(md5('42:' || doc_id), 1, 8) AS BIGINT) / 4294967296.0 < 0.1")
def sample_fraction(spark, sf):
    return sampling.sample_fraction(read_table(spark, sf, "documents").select("doc_id"), 0.1)


@query(
    "v3_train_test_split",
    "SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY md5('412:' || doc_id), doc_id) <= ceil(0.2 * count(*) OVER ()) THEN 'test' ELSE 'train' END AS split FROM documents",
)
def train_test_split(spark, sf):
    return sampling.train_test_split(read_table(spark, sf, "documents").select("doc_id"), 0.2, seed=412)


@query(
    "v4_balanced_sample",
    f"WITH {_HASHED} SELECT doc_id, label FROM h QUALIFY row_number() OVER (PARTITION BY label ORDER BY k, doc_id) <= 120",
)
def balanced_sample(spark, sf):
    return sampling.balanced_sample(_labelled(spark, sf), 120).select("doc_id", "label")


@query(
    "v5_balance_to_smallest",
    f"WITH {_HASHED}, m AS (SELECT least(min(n), 2000) AS take FROM (SELECT count(*) AS n FROM h GROUP BY label)), r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY k, doc_id) AS rn FROM h) "
    "SELECT doc_id, label FROM r, m WHERE rn <= take",
)
def balance_to_smallest(spark, sf):
    return sampling.balance_to_smallest(_labelled(spark, sf), 2000).select("doc_id", "label")


@query(
    "v6_training_sample",
    f"WITH {_HASHED}, m AS (SELECT least(count(DISTINCT label) * 100, count(*)) AS take FROM h), r AS (SELECT *, row_number() OVER (ORDER BY k, doc_id) AS rn FROM h) SELECT doc_id, label FROM r, m WHERE rn <= take",
)
def training_sample(spark, sf):
    return sampling.training_sample(_labelled(spark, sf), 100).select("doc_id", "label")


@query(
    "v7_mini_corpus",
    f"WITH {_HASHED}, r AS (SELECT doc_id, row_number() OVER (ORDER BY k, doc_id) AS rn, count(*) OVER () AS n FROM h) SELECT doc_id, unnest(range(rn, 2 * n + 3, n)) AS slot FROM r",
)
def mini_corpus(spark, sf):
    df = _labelled(spark, sf).select("doc_id")
    return sampling.mini_corpus(df, 2 * df.count() + 2)


@query(
    "v8_stratified_folds",
    f"WITH {SQL_CORPUS} SELECT doc_id, nullif(label, 2) AS label, CAST((row_number() OVER (PARTITION BY nullif(label, 2) ORDER BY doc_id) - 1) % 5 AS INTEGER) AS fold FROM corpus",
)
def stratified_folds(spark, sf):
    rows = _labelled(spark, sf).select("doc_id", F.nullif("label", F.lit(2)).alias("label"))  # rows without a label have folds too
    return sampling.stratified_folds(rows, 5)


def _sql_sequences(tokens: str, length: int, cap: int) -> str:
    return f"""WITH t AS (SELECT doc_id, {tokens} AS ts FROM documents), w AS (SELECT doc_id, unnest(range(0, len(ts))) AS pos, unnest(ts) AS token FROM t),
v AS (SELECT token, row_number() OVER (ORDER BY count(*) DESC, token) + 1 AS id FROM w GROUP BY token ORDER BY id LIMIT {cap - 2}),
s AS (SELECT doc_id, list(coalesce(id, 1) ORDER BY pos) AS ids FROM w LEFT JOIN v USING (token) WHERE pos < {length} GROUP BY doc_id)
SELECT doc_id, array_to_string(list_resize(coalesce(ids, []), {length}, 0), ' ') AS sequence FROM documents LEFT JOIN s USING (doc_id)"""


_PLAIN = f"regexp_replace(lower(text), '{text.PUNCTUATION}', '', 'g')"


@query("f11_padded_sequences", _sql_sequences(f"regexp_extract_all({_PLAIN}, '{text.WORDS}')", 55, 68000))
def padded_sequences(spark, sf):
    out = tfidf.padded_sequences(documents(spark, sf), 55, 68_000)
    return out.select("doc_id", F.array_join(F.col("sequence").cast("array<string>"), " ").alias("sequence"))


@query(
    "f11b_padded_character_sequences",
    _sql_sequences(f"list_filter(string_split(regexp_replace({_PLAIN}, '{text.SPACES}', '', 'g'), ''), lambda c: c <> '')", 290, 70),
)
def padded_character_sequences(spark, sf):
    out = tfidf.padded_sequences(documents(spark, sf), 290, 70, characters=True)
    return out.select("doc_id", F.array_join(F.col("sequence").cast("array<string>"), " ").alias("sequence"))


@query(
    "f12_arg_max_class",
    f"WITH {SQL_SIZED}, s AS (SELECT doc_id, [n_words % 7, n_words % 5, n_words % 3, doc_id % 4] AS p FROM sized) SELECT doc_id, CAST(list_position(p, list_max(p)) - 1 AS BIGINT) AS prediction, list_max(p) AS top FROM s",
)
def arg_max_class(spark, sf):
    from sparktext.functions import arrays

    p = F.array(F.col("n_words") % 7, F.col("n_words") % 5, F.col("n_words") % 3, F.col("doc_id") % 4)
    scored = sized(spark, sf).select("doc_id", p.alias("p"))
    return scored.select("doc_id", arrays.arg_max("p").cast("bigint").alias("prediction"), F.array_max("p").alias("top"))
