"""Scalar text functions, cleaning and row filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparktext.functions import arrays, html, text
from sparktext.operators import cleaning, labels
from sparktext.plans.catalog.registry import (
    LANGS,
    SQL_CORPUS,
    SQL_SIZED,
    SQL_WORDS,
    corpus,
    documents,
    query,
    quoted,
    sized,
    sql_clean,
    sql_clean_chars,
    sql_replace,
)
from sparktext.sources.readers import read_table

_SIMPLE = {
    "p1_lower_case": (lambda: text.lower("text"), "lower(text)"),
    "p2_remove_punctuation": (lambda: text.remove_punctuation("text"), sql_replace("text", text.PUNCTUATION)),
    "p3_remove_numbers": (lambda: text.remove_numbers("text"), sql_replace("text", text.DIGITS)),
    "p4_letters_only": (lambda: text.remove_special_characters("text"), sql_replace("text", text.NOT_LETTERS)),
    "p4b_letters_and_digits": (
        lambda: text.remove_special_characters("text", keep_digits=True),
        sql_replace("text", text.NOT_LETTERS_DIGITS),
    ),
    "p5_collapse_whitespace": (
        lambda: text.collapse_whitespace("text"),
        f"trim({sql_replace('text', text.SPACES, ' ')})",
    ),
    "p7_word_tokens": (
        lambda: F.array_join(text.word_tokens("text"), " "),
        f"array_to_string(regexp_extract_all(text, '{text.WORD_OR_SIGN}'), ' ')",
    ),
    "p7b_whitespace_tokens": (lambda: F.array_join(text.words("text"), " "), f"array_to_string({SQL_WORDS}, ' ')"),
    "p8_stop_words_removed": (
        lambda: F.array_join(text.drop_stop_words(text.words(text.lower("text"))), " "),
        f"array_to_string(list_filter(regexp_extract_all(lower(text), '{text.WORDS}'), "
        f"lambda w: w NOT IN ({quoted(text.ENGLISH_STOP_WORDS)})), ' ')",
    ),
    "p11_cast_to_string": (lambda: F.col("n_chars").cast("string"), "CAST(n_chars AS VARCHAR)"),
    "p12_clean_text": (lambda: cleaning.clean_expression("text"), sql_clean("text")),
    "p21_fill_null_text": (lambda: F.coalesce(F.nullif("text", F.lit("")), F.lit("")), "coalesce(nullif(text, ''), '')"),
    "f8_spaced_characters": (
        lambda: text.spaced_characters("text"),
        "array_to_string(list_filter(string_split(text, ''), lambda c: c <> ''), ' ')",
    ),
}


def _register_simple() -> None:
    for name, (build, sql) in _SIMPLE.items():
        query(name, f"SELECT doc_id, {sql} AS value FROM documents")(
            lambda spark, sf, build=build: documents(spark, sf).select("doc_id", build().alias("value"))
        )


_register_simple()


@query("p6_strip_tags", f"SELECT page_id, {sql_replace('html', text.TAG)} AS value FROM pages")
def strip_tags(spark, sf):
    return read_table(spark, sf, "pages", "page_id").select("page_id", text.strip_tags("html").alias("value"))


@query("p9_stemmed_text")
def stemmed_text(spark, sf):
    options = cleaning.CleanOptions(stem=True)
    return cleaning.clean_text(documents(spark, sf).select("doc_id", "text"), "text", options)


_LEMMA = """CASE WHEN length(w) > 4 AND w LIKE '%ies' THEN regexp_replace(w, 'ies$', 'y')
 WHEN length(w) > 4 AND regexp_matches(w, '(s|x|z|ch|sh)es$') THEN regexp_replace(w, 'es$', '')
 WHEN length(w) > 3 AND w LIKE '%men' THEN regexp_replace(w, 'men$', 'man')
 WHEN length(w) > 3 AND regexp_matches(w, '[^siu]s$') THEN regexp_replace(w, 's$', '') ELSE w END"""


@query(
    "p10_lemmatised_text",
    f"SELECT doc_id, array_to_string(list_transform(regexp_extract_all({sql_clean('text')}, '{text.WORDS}'), lambda w: {_LEMMA}), ' ') AS text FROM documents",
)
def lemmatised_text(spark, sf):
    options = cleaning.CleanOptions(lemma=True)
    return cleaning.clean_text(documents(spark, sf).select("doc_id", "text"), "text", options)


@query(
    "p13_drop_empty",
    f"SELECT doc_id, value FROM (SELECT doc_id, {sql_clean('text')} AS value FROM documents) WHERE trim(value) <> ''",
)
def drop_empty(spark, sf):
    df = documents(spark, sf).select("doc_id", F.col("text").alias("value"))
    return cleaning.clean_text(df, "value", drop_blank=True)


@query("p14_drop_null_columns", "SELECT doc_id, source, n_chars FROM documents")
def drop_null_columns(spark, sf):
    wide = documents(spark, sf).select("doc_id", "source", "n_chars", F.nullif("lang", "lang").alias("always_null"))
    return cleaning.drop_null_columns(wide)


@query("p15_select_rename_drop", "SELECT doc_id AS id, lang AS label_text, lang AS label_copy, n_chars FROM documents")
def select_rename_drop(spark, sf):
    df = documents(spark, sf).drop("text", "source").withColumnsRenamed({"doc_id": "id", "lang": "label_text"})
    return df.withColumn("label_copy", F.col("label_text"))


@query("p16_class_membership", "SELECT doc_id, lang FROM documents WHERE lang IN ('de', 'fr')")
def class_membership(spark, sf):
    return read_table(spark, sf, "documents").where(F.col("lang").isin("de", "fr")).select("doc_id", "lang")


@query(
    "p17_split_by_partition",
    "SELECT doc_id, CASE WHEN source = 'src0' THEN 'test' ELSE 'train' END AS split FROM documents",
)
def split_by_partition(spark, sf):
    df = read_table(spark, sf, "documents").select("doc_id", "source")
    test = df.where("source = 'src0'").select("doc_id", F.lit("test").alias("split"))
    return test.unionByName(df.where("source <> 'src0'").select("doc_id", F.lit("train").alias("split")))


@query(
    "p18_length_predicates",
    f"SELECT doc_id, CAST(len({SQL_WORDS}) AS BIGINT) AS n_words FROM documents WHERE length(text) >= 2 AND len({SQL_WORDS}) < 4000",
)
def length_predicates(spark, sf):
    kept = cleaning.shorter_than(documents(spark, sf).where(F.char_length("text") >= 2), 4000)
    return kept.select("doc_id", text.word_count("text").alias("n_words"))


@query(
    "p19_percentile_trim",
    f"WITH {SQL_SIZED}, b AS (SELECT quantile_cont(n_words, 0.05) AS lo, quantile_cont(n_words, 0.95) AS hi FROM sized) "
    "SELECT doc_id, label_text, n_words FROM sized, b WHERE n_words > lo AND n_words < hi",
)
def percentile_trim(spark, sf):
    return cleaning.trim_by_percentile(sized(spark, sf), "n_words")


@query(
    "p19b_percentile_cap",
    f"WITH {SQL_SIZED}, b AS (SELECT quantile_cont(n_words, 0.95) AS hi FROM sized) "
    "SELECT doc_id, label_text, n_words FROM sized, b WHERE n_words <= hi",
)
def percentile_cap(spark, sf):
    return cleaning.trim_by_percentile(sized(spark, sf), "n_words", low=None)


@query("p20_concat_fields", "SELECT doc_id, source || chr(10) || ' ' || nullif(text, '') AS value FROM documents")
def concat_fields(spark, sf):
    whole = text.concat_fields("source", F.nullif("text", F.lit("")), sep="\n ")
    return documents(spark, sf).select("doc_id", whole.alias("value"))


def _sql_visible(expr: str) -> str:
    out = expr
    for pattern in (html.COMMENT, html.HIDDEN, html.ANY_TAG):
        out = sql_replace(out, pattern)
    for name, char in html.ENTITIES:
        out = f"replace({out}, '{name}', {quoted([char])})"
    return f"replace({out}, '&amp;', '&')"


_TITLE = r"regexp_extract(html, '(?is)<title\b[^>]*>(.*?)</title\s*>', 1)"


@query("p22_visible_text", f"SELECT page_id, {_sql_visible('html')} AS value FROM pages")
def visible_text(spark, sf):
    return read_table(spark, sf, "pages", "page_id").select("page_id", html.visible_text("html").alias("value"))


@query(
    "p23_clean_web_pages",
    "SELECT page_id, url, text FROM (SELECT page_id, url, trim("
    f"{sql_clean(_sql_visible(_TITLE))} || ' ' || {sql_clean(_sql_visible('html'))}) AS text FROM pages) WHERE length(text) >= 2",
)
def clean_web_pages(spark, sf):
    title = F.regexp_extract("html", r"(?is)<title\b[^>]*>(.*?)</title\s*>", 1)
    pages = read_table(spark, sf, "pages", "page_id").withColumns({"title": title, "main_content": F.col("html")})
    return cleaning.clean_pages(pages.drop("html"))


@query(
    "p24_options_all_off",
    f"SELECT doc_id, array_to_string(regexp_extract_all({sql_replace('lower(text)', text.TAG)}, '{text.WORD_OR_SIGN}'), ' ') AS text FROM documents",
)
def options_all_off(spark, sf):
    options = cleaning.CleanOptions(True, False, False, False, False, False)
    return cleaning.clean_text(documents(spark, sf).select("doc_id", "text"), "text", options)


@query(
    "x1_clean_without_stop_words",
    f"SELECT doc_id, array_to_string(regexp_extract_all({sql_clean_chars('text')}, '{text.WORDS}'), ' ') AS text FROM documents",
)
def clean_without_stop_words(spark, sf):
    options = cleaning.CleanOptions(remove_stopwords=False)
    return cleaning.clean_text(documents(spark, sf).select("doc_id", "text"), "text", options)


@query("f1_word_count", f"SELECT doc_id, CAST(len({SQL_WORDS}) AS BIGINT) AS n_words FROM documents")
def word_count(spark, sf):
    return documents(spark, sf).select("doc_id", text.word_count("text").alias("n_words"))


@query("f2_char_count", "SELECT doc_id, length(text) AS n_characters FROM documents")
def char_count(spark, sf):
    return documents(spark, sf).select("doc_id", F.char_length("text").cast("bigint").alias("n_characters"))


_ARTICLES = "text || ' Art. ' || doc_id || '-1; article 8 and ARTICLE ' || n_chars || '.'"


@query(
    "f3_article_numbers",
    f"SELECT doc_id, array_to_string(list_sort(list_distinct(regexp_extract_all({_ARTICLES}, '{text.ARTICLE}', 2))), ',') AS articles FROM documents",
)
def article_numbers(spark, sf):
    cited = F.concat("text", F.lit(" Art. "), "doc_id", F.lit("-1; article 8 and ARTICLE "), "n_chars", F.lit("."))
    return documents(spark, sf).select("doc_id", F.array_join(text.article_numbers(cited), ",").alias("articles"))


@query(
    "f4_recode_labels",
    "SELECT doc_id, CAST(CASE lang WHEN 'en' THEN 0 WHEN 'fr' THEN 1 WHEN 'de' THEN 2 END AS INTEGER) AS code FROM documents",
)
def recode_labels(spark, sf):
    return read_table(spark, sf, "documents").select("doc_id", labels.recode("lang", {"en": 0, "fr": 1, "de": 2}).alias("code"))


@query(
    "f5_encode_labels",
    "SELECT doc_id, source, CAST(coalesce(CASE WHEN source IS NOT NULL THEN dense_rank() OVER (ORDER BY source) - 1 END, -1) AS INTEGER) AS label FROM documents",
)
def encode_labels(spark, sf):
    return labels.encode_labels(read_table(spark, sf, "documents").select("doc_id", "source"), "source")


@query(
    "f5b_apply_saved_codes",
    "WITH codes AS (SELECT lang, row_number() OVER (ORDER BY lang) - 1 AS label FROM (SELECT DISTINCT lang FROM documents WHERE source = 'src0' AND lang <> 'es')) "
    "SELECT d.doc_id, d.lang, CAST(coalesce(c.label, -1) AS INTEGER) AS label FROM documents d LEFT JOIN codes c USING (lang)",
)
def apply_saved_codes(spark, sf):
    df = read_table(spark, sf, "documents").select("doc_id", "lang", "source")
    saved = labels.label_codes(df.where("source = 'src0' AND lang <> 'es'"), "lang")
    return labels.encode_labels(df.select("doc_id", "lang"), "lang", codes=saved)


@query(
    "f6_one_hot_labels",
    f"WITH {SQL_CORPUS} SELECT doc_id, array_to_string(list_transform(range(0, 4), lambda i: CASE WHEN i = label THEN 1 ELSE 0 END), ',') AS hot FROM corpus",
)
def one_hot_labels(spark, sf):
    return corpus(spark, sf).select("doc_id", F.array_join(arrays.one_hot("label", len(LANGS)).cast("array<string>"), ",").alias("hot"))


@query(
    "f7_one_hot_depth",
    "SELECT conv_id, turn, array_to_string(list_transform(range(0, 15), lambda i: CASE WHEN i = turn THEN 1 ELSE 0 END), ',') AS hot FROM conversations",
)
def one_hot_depth(spark, sf):
    hot = F.array_join(arrays.one_hot("turn", 15).cast("array<string>"), ",")
    return read_table(spark, sf, "conversations").select("conv_id", "turn", hot.alias("hot"))


@query(
    "f9_sentences",
    f"""WITH parts AS (SELECT doc_id, list_filter(string_split(regexp_replace(trim(text), '([.!?])[{text.SPACE}]+', '\\1' || chr(1), 'g'), chr(1)), lambda s: s <> '') AS s FROM documents)
SELECT doc_id, unnest(range(0, len(s))) AS pos, unnest(s) AS sentence FROM parts""",
)
def sentences(spark, sf):
    return documents(spark, sf).select("doc_id", F.posexplode(text.sentences("text")).alias("pos", "sentence")).withColumn("pos", F.col("pos").cast("bigint"))


@query(
    "f10_long_text_pieces",
    f"""WITH w AS (SELECT doc_id, {SQL_WORDS} AS ws FROM documents),
s AS (SELECT doc_id, ws, unnest(CASE WHEN len(ws) > 512 THEN range(1, len(ws) + 1, 500) ELSE [1] END) AS first FROM w)
SELECT doc_id, (first - 1) // 500 AS pos, array_to_string(CASE WHEN len(ws) > 512 THEN list_slice(ws, first, first + 499) ELSE ws END, ' ') AS piece FROM s""",
)
def long_text_pieces(spark, sf):
    return documents(spark, sf).select("doc_id", F.posexplode(text.pieces("text")).alias("pos", "piece")).withColumn("pos", F.col("pos").cast("bigint"))


@query(
    "f14_tagged_documents",
    f"SELECT CAST(doc_id AS VARCHAR) AS tag, CAST(len({SQL_WORDS}) AS BIGINT) AS n_words, {SQL_WORDS}[1] AS first_word FROM documents",
)
def tagged_documents(spark, sf):
    tagged = documents(spark, sf).select(F.struct(text.words("text").alias("words"), F.col("doc_id").cast("string").alias("tag")).alias("doc"))
    return tagged.select("doc.tag", F.size("doc.words").cast("bigint").alias("n_words"), F.get("doc.words", F.lit(0)).alias("first_word"))


_PROPS = "replace(props, '}', ', \"list\": [1, 2], \"obj\": {\"a\": 1}, \"type\": \"' || event_type || '\"}')"


@query(
    "s6_json_scalar_members",
    f"WITH e AS (SELECT event_id, {_PROPS} AS p FROM events) "
    "SELECT event_id, 'k' AS name, p ->> '$.k' AS value FROM e UNION ALL SELECT event_id, 'type', p ->> '$.type' FROM e",
)
def json_scalar_members(spark, sf):
    tail = F.concat(F.lit(', "list": [1, 2], "obj": {"a": 1}, "type": "'), F.col("event_type"), F.lit('"}'))
    wide = read_table(spark, sf, "events").select("event_id", F.replace("props", F.lit("}"), tail).alias("props"))
    return wide.select("event_id", F.explode(text.scalar_members("props")).alias("name", "value"))


@query("f13_json_member_names", "SELECT event_id, 'k' AS names FROM events")
def json_member_names(spark, sf):
    members = F.array_join(F.array_sort(F.map_keys(text.scalar_members("props"))), ",")
    return read_table(spark, sf, "events").select("event_id", members.alias("names"))
