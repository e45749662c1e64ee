"""One query per operator over its whole table, with production parameters, and SQL where it can say the same."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparktext.llm import (
    blas_search,
    bpe,
    exact_dedup,
    filter_audit,
    jaccard_join,
    lattice_lm,
    length_buckets,
    line_dedup,
    mil_quality,
    positional_index,
    suffix_dedup,
    token_counts,
    winnowing,
)
from sparktext.llm.common import identified, table

QUERIES = {}
ORACLES = {}
BLANK_CHARS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
SQL_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


@query(
    "op1_line_dedup",
    f"""WITH split AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents),
    lines AS (SELECT doc_id, unnest(parts) AS line, generate_subscripts(parts, 1) AS pos FROM split),
    keyed AS (SELECT *, {SQL_LOWER.format(f"trim(line, {BLANK_CHARS})")} AS key FROM lines),
    bad AS (SELECT key FROM keyed WHERE key <> '' GROUP BY key HAVING count(DISTINCT doc_id) >= 10),
    marked AS (SELECT keyed.*, bad.key IS NOT NULL AS dropped FROM keyed LEFT JOIN bad ON keyed.key = bad.key)
    SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE dropped) AS n_dropped,
      sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), '')) AS kept_sha256
    FROM marked GROUP BY doc_id""",
)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    kept = line_dedup.keep_lines(docs, line_dedup.line_bitmaps(docs, min_docs=10, min_chars=1))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


@query("op2_winnowing")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnowing.compare_edited(table(spark, sf_dir, "documents"), gram=3, window=4)


@query("op3_token_counts")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return token_counts.context_limits(token_counts.length_histogram(docs, str(path), public_tokenizers.PATTERN))


@query("op4_lattice_lm")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice_lm.score_documents(table(spark, sf_dir, "documents"), str(public_tokenizers.path("piece_bpe_32k.model")))


# Below this score a document is predicted to be of low quality.
QUALITY_AT_LEAST = 0.3


@query("op5_mil_quality")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = mil_quality.score(docs, mil_quality.train(docs, table(spark, sf_dir, "labels")))
    predicted = (F.col("score") >= QUALITY_AT_LEAST).cast("int").alias("predicted")
    return scored.select("doc_id", mil_quality.held_out("doc_id").alias("held_out"), "score", predicted, "most_weighted", "most_weight")


@query("op6_bpe")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_digests(table(spark, sf_dir, "documents"), str(public_tokenizers.path("word_bpe_49k.json")))


@query("op7_length_buckets")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("word_bpe_49k.json")
    lengths = length_buckets.token_lengths(identified(table(spark, sf_dir, "documents")), str(path))
    packed = length_buckets.pack(lengths, buckets=16, token_budget=65_536)
    return packed.drop("text_hash")


@query(
    "op8_exact_dedup",
    """SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
      doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
    FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))""",
)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"), keep="largest").drop("text_hash")


@query("op9_jaccard_join")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.linked_components(table(spark, sf_dir, "documents"), percent=80, words=5).drop("text_hash")


@query("op10_suffix_dedup")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = suffix_dedup.remove_repeated(table(spark, sf_dir, "documents"), length=400)
    spans = F.size("spans").cast("bigint").alias("n_spans")
    return cut.select("doc_id", "n_bytes", "n_removed", spans, F.sha2("kept", 256).alias("kept_sha256"))


_TERMS = SQL_LOWER.format("coalesce(text, '')")
_WINDOW = 10


@query(
    "op11_positional_index",
    rf"""WITH d AS (SELECT doc_id, regexp_extract_all({_TERMS}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
    b AS (SELECT item_id, regexp_extract_all({_TERMS}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
    sized AS (SELECT item_id, w, least(len(w), {_WINDOW}) AS size FROM b WHERE len(w) > 0),
    item_windows AS (SELECT DISTINCT item_id, size, array_to_string(w[i:i + size - 1], ' ') AS words FROM (SELECT *, unnest(range(1, len(w) - size + 2)) AS i FROM sized)),
    sizes AS (SELECT DISTINCT size FROM sized),
    doc_windows AS (SELECT doc_id, size, i, array_to_string(w[i:i + size - 1], ' ') AS words FROM (SELECT d.*, size, unnest(range(1, len(w) - size + 2)) AS i FROM d, sizes)),
    found AS (SELECT doc_id, item_id, size, i FROM doc_windows JOIN item_windows USING (size, words)),
    hit AS (SELECT doc_id, count(DISTINCT word) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS word FROM found) GROUP BY doc_id),
    listed AS (SELECT doc_id, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM found) GROUP BY doc_id)
    SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
    FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN listed USING (doc_id)""",
)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = positional_index.index_documents(table(spark, sf_dir, "documents"))
    found = positional_index.match_items(index, table(spark, sf_dir, "benchmark"), window=_WINDOW)
    ids = positional_index.item_ids(F.col("hits"))
    return found.select(
        "doc_id",
        "n_words",
        positional_index.covered_words(F.col("hits")).alias("n_hit"),
        F.size(ids).cast("bigint").alias("n_items"),
        F.sha2(F.array_join(ids, ",").cast("binary"), 256).alias("items_sha256"),
        (F.size("hits") > 0).alias("contaminated"),
    )


@query(
    "op12_filter_audit",
    rf"""WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
    l AS (SELECT doc_id, coalesce(max(CAST(quality = 1 AS INTEGER)), 0) AS good, coalesce(max(CAST(toxic = 1 AS INTEGER)), 0) AS toxic FROM labels GROUP BY doc_id),
    m AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic, CAST(len(w) < 50 AS INTEGER) + 2 * CAST(100 * len(list_distinct(w)) < 65 * len(w) AS INTEGER)
      + 4 * CAST(100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t) AS INTEGER) + 8 * CAST(regexp_matches(t, '[#$%&*|]') AS INTEGER)
      + 16 * CAST(coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false) AS INTEGER) AS mask FROM d LEFT JOIN l USING (doc_id)),
    cells AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM m GROUP BY ALL),
    letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x, unnest([1, 2, 4, 8, 16]) AS bit),
    orders AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits FROM letters a, letters b, letters c, letters d, letters e
      WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31 AND len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
    steps AS (SELECT filter_order, step, bits[step] AS bit, CAST(coalesce(list_sum(bits[1:step - 1]), 0) AS INTEGER) AS before FROM (SELECT *, unnest([1, 2, 3, 4, 5]) AS step FROM orders)),
    r AS (SELECT part, filter_order, step, bit, coalesce(sum(n) FILTER (WHERE mask & (before | bit) = 0), 0) AS kept,
      coalesce(sum(n) FILTER (WHERE mask & before = 0 AND mask & bit > 0), 0) AS removed, coalesce(sum(n) FILTER (WHERE mask & before > 0 AND mask & bit > 0), 0) AS redundant,
      coalesce(sum(n) FILTER (WHERE mask = bit), 0) AS unique_fails, coalesce(sum(good) FILTER (WHERE mask & before = 0 AND mask & bit > 0), 0) AS good_lost,
      coalesce(sum(toxic) FILTER (WHERE mask & before = 0 AND mask & bit > 0), 0) AS toxic_lost FROM cells, steps GROUP BY ALL)
    SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
      CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley FROM r""",
)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = filter_audit.document_cells(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return filter_audit.audit_orders(cells, "ABCDE")


@query(
    "op13_blas_search",
    rf"""WITH t AS (SELECT doc_id, unnest(regexp_extract_all({_TERMS}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
    c AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY ALL),
    n AS (SELECT doc_id, count(*) AS n FROM t GROUP BY doc_id),
    s AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS words FROM n),
    w AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * any_value(docs) + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w FROM c, s GROUP BY term),
    q AS (SELECT item_id, unnest(regexp_extract_all({_TERMS}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
    scored AS (SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // words)))) AS BIGINT) AS score
      FROM q JOIN w USING (term) JOIN c USING (term) JOIN n USING (doc_id), s GROUP BY ALL)
    SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
    FROM scored WHERE score > 0 QUALIFY rank <= 10""",
)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blas_search.top_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=10)
