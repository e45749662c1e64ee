"""Terms, vocabularies and TF-IDF.

Term counts are made inside the document row, so counting needs no shuffle. Fitting shuffles
one partial count per (task, term). Encoding joins the vocabulary (broadcast when bounded) and
shuffles the weights once, by document.
"""

from __future__ import annotations

import json
import os
from collections.abc import Sequence
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparktext.functions import text
from sparktext.operators.joins import lookup, measure, require_columns
from sparktext.operators.ranking import ONE_TASK_ROWS, ranked, ranked_table
from sparktext.session import materialize, sized_shuffles


@dataclass(frozen=True)
class TermOptions:
    """What counts as a term and which terms enter the vocabulary.

    An int ``min_df``/``max_df`` is a number of documents, a float a share of them.
    ``stop_words`` is a word list, "english" for the built-in list, or None.
    """

    ngram_range: tuple[int, int] = (1, 1)
    min_df: int | float = 1
    max_df: int | float = 1.0
    max_features: int | None = None
    stop_words: Sequence[str] | str | None = None

    @classmethod
    def from_config(cls, params: dict | None) -> TermOptions:
        given = {k: v for k, v in (params or {}).items() if k in cls.__dataclass_fields__}
        span = given.get("ngram_range", (1, 1))
        if isinstance(span, str):
            span = tuple(int(x) for x in span.split(","))
        given["ngram_range"] = tuple(span)
        return cls(**given)

    def stop_list(self) -> Sequence[str] | None:
        if self.stop_words == "english":
            return text.ENGLISH_STOP_WORDS
        return self.stop_words


def term_column(column: Column | str, options: TermOptions) -> Column:
    """Array of all terms of a text: tokens, stop words out, then n-grams."""
    tokens = text.terms(column)
    if options.stop_list():
        tokens = text.drop_stop_words(tokens, options.stop_list())
    return text.ngrams(tokens, *options.ngram_range)


def doc_terms(df: DataFrame, options: TermOptions, column: str = "text", key: str = "doc_id", keep: Sequence[str] = ()) -> DataFrame:
    """Long table (key, keep..., term, tf)."""
    require_columns(df, column, key, *keep)
    counted = df.select(key, *keep, F.explode(text.term_counts(term_column(column, options))).alias("_t"))
    return counted.select(key, *keep, "_t.term", "_t.tf")


def _bound(limit: int | float, n: Column) -> Column:
    return F.lit(limit).cast("double") if isinstance(limit, int) else n * F.lit(limit)


def build_vocabulary(counts: DataFrame, n_docs: DataFrame, options: TermOptions) -> DataFrame:
    """(term, term_id, df, corpus_count, idf) with ids in term order.

    ``n_docs`` is a one-row table (n_docs). Ties at the ``max_features`` cut go to the term that
    sorts first.
    """
    terms = counts.groupBy("term").agg(
        F.count(F.lit(1)).alias("df"), F.sum("tf").alias("corpus_count")
    )
    return chosen_terms(terms, n_docs, options)


def weighted_terms(terms: DataFrame, n_docs: DataFrame, options: TermOptions) -> DataFrame:
    """The counted terms (term, df, corpus_count) that ``options`` keep, with ``idf`` and without ids."""
    sized = terms.crossJoin(F.broadcast(n_docs))
    n = F.col("n_docs")
    kept = sized.where((F.col("df") >= _bound(options.min_df, n)) & (F.col("df") <= _bound(options.max_df, n)))
    kept = kept.withColumn("idf", F.log((1 + n) / (1 + F.col("df"))) + 1)
    if options.max_features:
        kept = kept.orderBy(F.desc("corpus_count"), "term").limit(options.max_features)
    return kept


def chosen_terms(terms: DataFrame, n_docs: DataFrame, options: TermOptions) -> DataFrame:
    """``build_vocabulary`` from counted terms (term, df, corpus_count)."""
    kept = weighted_terms(terms, n_docs, options)
    if options.max_features and options.max_features <= ONE_TASK_ROWS:
        numbered = ranked(kept, "term", one_task=True)
    else:
        numbered = ranked_table(kept, "term")
    return numbered.select("term", (F.col("row_number") - 1).cast("int").alias("term_id"), "df", "corpus_count", "idf")


@dataclass
class TfidfModel:
    """A fitted, stored vocabulary with its number of rows and bytes; the bytes decide on broadcasting."""

    vocabulary: DataFrame
    options: TermOptions
    size: int
    table_bytes: int

    def weights(self, df: DataFrame, column: str = "text", key: str = "doc_id", keep: Sequence[str] = ()) -> DataFrame:
        """Unnormalised weights (key, keep..., term, term_id, weight); unknown terms dropped."""
        counts = doc_terms(df, self.options, column, key, keep)
        terms = self.vocabulary.select("term", "term_id", "idf", "df")
        found = lookup(counts, terms, ["term"], spread_on=key, table_bytes=self.table_bytes, frequency="df")
        return found.select(key, *keep, "term", "term_id", (F.col("tf") * F.col("idf")).alias("weight"))

    def transform(self, df: DataFrame, column: str = "text", key: str = "doc_id", keep: Sequence[str] = ()) -> DataFrame:
        """Unit rows in long form (key, keep..., term, term_id, weight)."""
        return normalize_rows(self.weights(df, column, key, keep), key, keep)

    def encode(self, df: DataFrame, column: str = "text", key: str = "doc_id", keep: Sequence[str] = ()) -> DataFrame:
        """(key, keep..., terms): the unit row of every document as array of (term_id, weight).

        Documents without a known term keep an empty array. Every document sends one marker row
        without a term through the lookup, so it need not be joined back, and the weights move once.
        """
        require_columns(df, column, key, *keep)
        kind = "array<struct<term:string,tf:bigint>>"
        counts = F.coalesce(text.term_counts(term_column(column, self.options)), F.array().cast(kind))
        marker = F.array(F.struct(F.lit(None).cast("string").alias("term"), F.lit(0).cast("bigint").alias("tf")))
        counted = df.select(key, *keep, F.explode(F.concat(counts, marker)).alias("_t"))
        terms = self.vocabulary.select("term", "term_id", "idf", "df")
        found = lookup(
            counted.select(key, *keep, "_t.term", "_t.tf"), terms, ["term"], "left", spread_on=key, table_bytes=self.table_bytes, frequency="df"
        )
        kept = found.where(F.col("term_id").isNotNull() | F.col("term").isNull())
        return unit_rows(kept.select(key, *keep, "term_id", (F.col("tf") * F.col("idf")).alias("weight")), key, keep)

    def save(self, path: str) -> None:
        self.vocabulary.write.mode("overwrite").parquet(os.path.join(path, "vocabulary"))
        spark = self.vocabulary.sparkSession
        params = json.dumps(asdict(self.options))
        spark.createDataFrame([(params,)], "value string").coalesce(1).write.mode("overwrite").text(
            os.path.join(path, "options")
        )

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> TfidfModel:
        params = json.loads(spark.read.text(os.path.join(path, "options")).first()["value"])
        table = spark.read.parquet(os.path.join(path, "vocabulary"))
        return cls(table, TermOptions.from_config(params), *measure(table))


def unit_rows(weights: DataFrame, key: str = "doc_id", keep: Sequence[str] = ()) -> DataFrame:
    """One row per document with ``terms``: sorted array of (term_id, unit weight). One shuffle.

    A NULL term id only keeps its document in the result.
    """
    known = F.when(F.col("term_id").isNotNull(), F.struct("term_id", "weight"))
    gathered = weights.groupBy(key, *keep).agg(F.sort_array(F.collect_list(known)).alias("terms"))
    size = F.sqrt(F.aggregate("terms", F.lit(0.0), lambda acc, t: acc + t["weight"] * t["weight"]))
    sized = gathered.withColumn("_norm", size)
    scaled = F.transform(
        "terms",
        lambda t: F.struct(
            t["term_id"].alias("term_id"),
            F.when(F.col("_norm") > 0, t["weight"] / F.col("_norm")).otherwise(0.0).alias("weight"),
        ),
    )
    return sized.withColumn("terms", scaled).drop("_norm")


def normalize_rows(weights: DataFrame, key: str = "doc_id", keep: Sequence[str] = (), value: str = "weight") -> DataFrame:
    """Divide by the row's L2 norm in long form; zero rows stay zero."""
    gathered = weights.groupBy(key, *keep).agg(F.collect_list(F.struct("term", "term_id", value)).alias("_r"))
    size = F.sqrt(F.aggregate("_r", F.lit(0.0), lambda acc, t: acc + t[value] * t[value]))
    rows = gathered.withColumn("_norm", size).select(key, *keep, "_norm", F.explode("_r").alias("_t"))
    unit = F.when(F.col("_norm") > 0, F.col(f"_t.{value}") / F.col("_norm")).otherwise(F.lit(0.0))
    return rows.select(key, *keep, "_t.term", "_t.term_id", unit.alias(value))


def fit_tfidf(df: DataFrame, options: TermOptions = TermOptions(), column: str = "text", key: str = "doc_id") -> TfidfModel:
    """Fit and store the vocabulary: one pass over the texts."""
    return fitted(doc_terms(df, options, column, key), df, options)


def fitted(counts: DataFrame, df: DataFrame, options: TermOptions) -> TfidfModel:
    return fitted_terms(counts.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("corpus_count")), df, options)


def fitted_terms(terms: DataFrame, df: DataFrame, options: TermOptions) -> TfidfModel:
    """Model of counted terms (term, df, corpus_count) of the documents ``df``."""
    low, high = options.ngram_range
    with sized_shuffles(df, high - low + 1):
        table = materialize(chosen_terms(terms, df.agg(F.count(F.lit(1)).alias("n_docs")), options))
    return TfidfModel(table, options, *measure(table))


def vector_struct(size: int, column: str = "terms") -> Column:
    """(term_id, weight) array -> the storage form of an MLlib sparse vector, built in the JVM.

    ``sources.vectors.as_vectors`` turns it into a vector column.
    """
    entries = F.filter(F.sort_array(F.col(column)), lambda t: t["weight"] != 0)
    return F.struct(
        F.lit(0).cast("tinyint").alias("type"),
        F.lit(size).cast("int").alias("size"),
        F.transform(entries, lambda t: t["term_id"]).alias("indices"),
        F.transform(entries, lambda t: t["weight"]).alias("values"),
    )


def term_frequencies(model: TfidfModel, n: int, least: bool = False) -> DataFrame:
    """The n most (or least) common terms of a vocabulary."""
    order = F.asc("corpus_count") if least else F.desc("corpus_count")
    return model.vocabulary.select("term", "corpus_count").orderBy(order, "term").limit(n)


def vocabulary_size(model: TfidfModel) -> DataFrame:
    return model.vocabulary.agg(F.count(F.lit(1)).alias("vocabulary_size"), F.sum("corpus_count").alias("tokens"))


def padded_sequences(
    df: DataFrame,
    length: int = 55,
    max_tokens: int = 68_000,
    column: str = "text",
    key: str = "doc_id",
    characters: bool = False,
) -> DataFrame:
    """Token ids by frequency rank: 0 pads, 1 unknown, known words from 2; cut or padded to ``length``.

    Only the first ``length`` tokens of a row can appear, so only those meet the vocabulary;
    the vocabulary itself is counted over whole texts.
    """
    plain = text.remove_punctuation(F.lower(column))
    tokens = text.words(plain)
    if characters:
        tokens = F.filter(F.split(F.regexp_replace(plain, text.SPACES, ""), ""), lambda x: x != "")
    vocabulary = (
        df.select(text.each(tokens).alias("token"))
        .groupBy("token")
        .agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.desc("n"), "token")
        .limit(max_tokens - 2)
    )
    minus = F.struct((-F.col("n")).alias("n"), "token")
    ids = ranked_table(vocabulary.withColumn("_order", minus), "_order").select(
        "token", (F.col("row_number") + 1).cast("int").alias("token_id")
    )
    # A row without a token keeps its document, so it need not be joined back.
    placed = F.transform(F.slice(tokens, 1, length), lambda t, i: F.struct(i.alias("pos"), t.alias("token")))
    marker = F.array(F.struct(F.lit(-1).alias("pos"), F.lit(None).cast("string").alias("token")))
    empty = F.array().cast("array<struct<pos:int,token:string>>")
    places = df.select(key, F.explode(F.concat(F.coalesce(placed, empty), marker)).alias("_p")).select(key, "_p.pos", "_p.token")
    known = lookup(places, ids, ["token"], "left", spread_on=key)
    entry = F.when(F.col("pos") >= 0, F.struct("pos", F.coalesce("token_id", F.lit(1)).alias("id")))
    seq = known.groupBy(key).agg(F.array_sort(F.collect_list(entry)).alias("_s"))
    filled = F.concat(F.transform("_s", lambda e: e["id"]), F.array_repeat(F.lit(0), length))
    return seq.select(key, F.slice(filled, 1, length).alias("sequence"))
