"""Cleaning of text columns and row filters around it."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, fields

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparktext.functions import html, text
from sparktext.functions.words import ENGLISH_STOP_WORDS, cached_stem
from sparktext.operators.joins import lookup, require_columns
from sparktext.operators.ranking import exact_percentiles


@dataclass(frozen=True)
class CleanOptions:
    """Which cleaning steps run. The order is fixed; lemmatising wins over stemming."""

    lower: bool = True
    remove_punctuation: bool = True
    remove_stopwords: bool = True
    remove_numbers: bool = True
    remove_special_characters: bool = True
    remove_extra_whitespace: bool = True
    lemma: bool = False
    stem: bool = False

    @classmethod
    def from_config(cls, config: dict | None) -> CleanOptions:
        """Build from a config mapping; ``lemmatize`` is accepted for ``lemma``, unknown keys raise."""
        given = dict(config or {})
        if "lemmatize" in given:
            given["lemma"] = given.pop("lemmatize")
        unknown = set(given) - {f.name for f in fields(cls)}
        if unknown:
            raise ValueError(f"unknown cleaning options: {', '.join(sorted(unknown))}")
        return cls(**given)


def clean_expression(
    c: Column | str, options: CleanOptions = CleanOptions(), stop_words: Sequence[str] = ENGLISH_STOP_WORDS
) -> Column:
    """The cleaning steps up to stop words as one expression.

    Tags are stripped after punctuation, so they survive as glued words when punctuation goes.
    NULL stays NULL.
    """
    out = text._col(c).cast("string")
    if options.lower:
        out = text.lower(out)
    if options.remove_punctuation:
        out = text.remove_punctuation(out)
    if options.remove_numbers:
        out = text.remove_numbers(out)
    if options.remove_special_characters:
        out = text.remove_special_characters(out)
    if options.remove_extra_whitespace:
        out = text.collapse_whitespace(out)
    out = text.strip_tags(out)
    # Once only letters and spaces are left, a whitespace split gives the same tokens.
    plain = options.remove_punctuation and options.remove_special_characters
    tokens = text.words(out) if plain else text.word_tokens(out)
    if options.remove_stopwords:
        tokens = text.drop_stop_words(tokens, stop_words)
    return F.array_join(tokens, " ")


def clean_text(
    df: DataFrame,
    column: str = "text",
    options: CleanOptions = CleanOptions(),
    key: str = "doc_id",
    lemmas: DataFrame | None = None,
    drop_blank: bool = False,
) -> DataFrame:
    """Clean one column; ``drop_blank`` also drops NULL and blank results.

    A user's lemma table is applied once per distinct word and joined back; everything else
    works within the row.
    """
    require_columns(df, column)
    cleaned = clean_expression(column, options)
    if drop_blank:
        cleaned = text.keep_if(cleaned, lambda t: F.trim(t) != "")
    out = df.select(*[cleaned.alias(c) if c == column else F.col(c) for c in df.columns])
    if options.lemma and lemmas is not None:
        return map_words(out, column, key, lambda ws: lemmatize(ws, lemmas))
    if options.lemma:
        return out.withColumn(column, F.array_join(F.transform(text.words(column), suffix_lemma), " "))
    if options.stem:
        return out.withColumn(column, stem_words(column))
    return out


def stem_words(column: Column | str) -> Column:
    """Porter stems of all words of a text, in Arrow batches.

    Each worker remembers the stems it made, so the algorithm runs about once per distinct word
    and task, and no word has to be shuffled.
    """

    @F.pandas_udf("string")
    def stemmed(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else " ".join(map(cached_stem, t.split())))

    return stemmed(text._col(column))


def suffix_lemma(word: Column | str) -> Column:
    """Regular English noun plurals -> singular."""
    w = text._col(word)
    return (
        F.when((F.length(w) > 4) & w.rlike("ies$"), F.regexp_replace(w, "ies$", "y"))
        .when((F.length(w) > 4) & w.rlike("(s|x|z|ch|sh)es$"), F.regexp_replace(w, "es$", ""))
        .when((F.length(w) > 3) & w.rlike("men$"), F.regexp_replace(w, "men$", "man"))
        .when((F.length(w) > 3) & w.rlike("[^siu]s$"), F.regexp_replace(w, "s$", ""))
        .otherwise(w)
    )


def lemmatize(words: DataFrame, lemmas: DataFrame | None = None, word: str = "word") -> DataFrame:
    """Add ``mapped``: the lemma from a user table (form, lemma), else by suffix rules."""
    if lemmas is None:
        return words.select(word, suffix_lemma(word).alias("mapped"))
    table = lemmas.select(F.col("form").alias(word), "lemma").dropDuplicates([word])
    found = lookup(words.select(word), table, [word], "left")
    return found.select(word, F.coalesce("lemma", suffix_lemma(word)).alias("mapped"))


def map_words(df: DataFrame, column: str, key: str, mapper) -> DataFrame:
    """Replace every whitespace token of a column by ``mapper`` of it, keeping the order.

    ``mapper`` sees each distinct word once. Words are joined back by value and put together
    per row; repeated words of one row travel as a single record with their positions.
    """
    places = df.select(key, text.each(text.words(column), position=True).alias("pos", "word"))
    per_doc = places.groupBy(key, "word").agg(F.collect_list("pos").alias("at"))
    mapped = mapper(per_doc.select("word").distinct())
    joined = lookup(per_doc, mapped, ["word"], "left", spread_on=key)
    entries = F.flatten(F.collect_list(F.transform("at", lambda p: F.struct(p.alias("pos"), F.col("mapped").alias("w")))))
    back = joined.groupBy(key).agg(F.array_join(F.transform(F.array_sort(entries), lambda e: e["w"]), " ").alias("_new"))
    kept = [F.coalesce("_new", F.when(F.col(column).isNotNull(), "")).alias(c) if c == column else F.col(c) for c in df.columns]
    return df.join(back, key, "left").select(*kept)


def drop_empty(df: DataFrame, column: str = "text") -> DataFrame:
    """Drop rows whose text is NULL or blank."""
    return df.where(F.nullif(text.collapse_whitespace(column), F.lit("")).isNotNull())


def drop_null_columns(df: DataFrame) -> DataFrame:
    """Drop columns that hold no value at all (one aggregate over the input)."""
    counts = df.agg(*[F.count(c).alias(c) for c in df.columns]).first()
    return df.select(*[c for c in df.columns if counts[c] > 0])


def shorter_than(df: DataFrame, words: int = 4000, column: str = "text") -> DataFrame:
    return df.where(text.word_count(column) < words)


def trim_by_percentile(
    df: DataFrame, value: str, low: float | None = 0.05, high: float = 0.95, strict: bool = True
) -> DataFrame:
    """Keep rows between two exact percentiles of ``value``, or up to ``high`` if ``low`` is None."""
    wanted = [high] if low is None else [low, high]
    bounds = exact_percentiles(df, value, wanted).agg(F.min("value").alias("_low"), F.max("value").alias("_high"))
    v = F.col(value)
    above = F.lit(True) if low is None else (v > F.col("_low") if strict else v >= F.col("_low"))
    below = v < F.col("_high") if strict and low is not None else v <= F.col("_high")
    return df.crossJoin(F.broadcast(bounds)).where(above & below).drop("_low", "_high")


def clean_pages(df: DataFrame, title: str = "title", body: str = "main_content", options: CleanOptions = CleanOptions()) -> DataFrame:
    """Web pages -> cleaned ``text``: visible text of both fields, cleaned, joined; blanks dropped."""
    require_columns(df, title, body)
    plain = df.withColumn(body, html.visible_text(body)).withColumn(title, html.visible_text(title))
    both = plain.where(F.col(body).isNotNull() & F.col(title).isNotNull())
    joined = text.concat_fields(clean_expression(title, options), clean_expression(body, options))
    rest = [c for c in df.columns if c not in (title, body)]
    return both.select(*rest, text.keep_if(F.trim(joined), lambda t: F.char_length(t) >= 2).alias("text"))
