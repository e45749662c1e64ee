"""Category frequencies and the TF-IDF variants weighted by them.

CF(class, term) is the share of the class's documents that hold the term. ``encode_with_labels``
uses the true label of the rows it encodes; on test rows that leaks the answer into the vector.
For unlabelled or held-out text use the hard, probabilistic or maximum weighting instead.
"""

from __future__ import annotations

import os
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparktext.operators.blocks import UnitRows
from sparktext.operators.joins import lookup
from sparktext.operators.tfidf import TermOptions, TfidfModel, doc_terms, fitted_terms, normalize_rows
from sparktext.session import materialize

# Fixed value: weight of a (class, term) pair never seen together.
UNSEEN_CF = 1e-6


def category_frequency(counts: DataFrame, class_sizes: DataFrame, label: str = "label") -> DataFrame:
    """(label, term, cf) from a long table (doc, label, term, tf) with one row per doc and term."""
    return shares(counts.groupBy(label, "term").agg(F.count(F.lit(1)).alias("docs")), class_sizes, label)


def shares(pairs: DataFrame, class_sizes: DataFrame, label: str = "label") -> DataFrame:
    """``category_frequency`` from counted pairs (label, term, docs)."""
    sized = lookup(pairs, class_sizes, [label], spread_on="term")
    return sized.select(label, "term", (F.col("docs") / F.col("class_docs")).alias("cf"))


def class_sizes(df: DataFrame, label: str = "label") -> DataFrame:
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("class_docs"))


def inverse_category_frequency(counts: DataFrame, label: str = "label") -> DataFrame:
    """(term, icf) with icf = ln((1 + classes) / (1 + classes holding the term))."""
    pairs = materialize(counts.select(label, "term").distinct())
    classes = pairs.select(label).distinct().agg(F.count(F.lit(1)).alias("_c"))
    held = pairs.groupBy("term").agg(F.count(F.lit(1)).alias("_t"))
    return held.crossJoin(F.broadcast(classes)).select("term", F.log((1 + F.col("_c")) / (1 + F.col("_t"))).alias("icf"))


def max_cf(cf: DataFrame) -> DataFrame:
    return cf.groupBy("term").agg(F.max("cf").alias("cf"))


def _weighed(cf: DataFrame) -> DataFrame:
    """``cf`` with ``_often``, by which ``lookup`` finds hot keys: a pair's share of documents tells how
    often it is met, so the rows looked up need not be made once more to count them."""
    return cf.withColumn("_often", F.col("cf"))


def _classes_by_term(cf: DataFrame, label: str, name: str) -> DataFrame:
    """(term, ``name`` map<label, cf>, ``_often``)."""
    return cf.groupBy("term").agg(F.map_from_entries(F.collect_list(F.struct(label, "cf"))).alias(name), F.sum("cf").alias("_often"))


@dataclass
class CategoryModel:
    """Vocabulary plus category frequencies."""

    tfidf: TfidfModel
    cf: DataFrame
    label: str = "label"

    def encode_with_labels(self, df: DataFrame, column: str = "text", key: str = "doc_id") -> DataFrame:
        """Unit rows of tf-idf x cf(own label, term); unseen pairs weigh 1e-6."""
        rows = self.tfidf.weights(df, column, key, [self.label])
        found = lookup(rows, _weighed(self.cf), [self.label, "term"], "left", spread_on=key, frequency="_often")
        weight = F.col("weight") * F.coalesce("cf", F.lit(UNSEEN_CF))
        return normalize_rows(found.select(key, self.label, "term", "term_id", weight.alias("weight")), key, [self.label])

    def save(self, path: str) -> None:
        self.tfidf.save(path)
        self.cf.write.mode("overwrite").parquet(os.path.join(path, "category_frequency"))

    @classmethod
    def load(cls, spark: SparkSession, path: str, label: str = "label") -> CategoryModel:
        cf = spark.read.parquet(os.path.join(path, "category_frequency"))
        return cls(TfidfModel.load(spark, path), cf, label)


def fit_category_model(
    df: DataFrame,
    options: TermOptions = TermOptions(stop_words="english"),
    column: str = "text",
    label: str = "label",
    key: str = "doc_id",
) -> CategoryModel:
    """One pass over the texts: documents and occurrences are counted per (class, term) and stored; the
    vocabulary and the category frequencies both come from these counts."""
    counts = doc_terms(df, options, column, key, [label])
    pairs = materialize(counts.groupBy(label, "term").agg(F.count(F.lit(1)).alias("docs"), F.sum("tf").alias("tf")))
    tfidf = fitted_terms(pairs.groupBy("term").agg(F.sum("docs").alias("df"), F.sum("tf").alias("corpus_count")), df, options)
    known = lookup(pairs, tfidf.vocabulary.select("term"), ["term"], spread_on=label, table_bytes=tfidf.table_bytes)
    return CategoryModel(tfidf, materialize(shares(known, class_sizes(df, label), label)), label)


def _in_blocks(rows: DataFrame | UnitRows, cf: DataFrame, label: str, kind: str) -> bool:
    """Blocks compare classes as they are; those of another type than ``cf`` has are left to a join."""
    return isinstance(rows, UnitRows) and kind == dict(cf.dtypes)[label]


def _long(rows: DataFrame | UnitRows) -> DataFrame:
    return rows.frame() if isinstance(rows, UnitRows) else rows


def weight_by_inverse_cf(rows: DataFrame | UnitRows, icf: DataFrame, key: str = "doc_id", frequency: str | None = None) -> DataFrame:
    """Unit tf-idf rows x icf (1 for terms without one); not normalised again. ``frequency``: as in ``lookup``."""
    if isinstance(rows, UnitRows):
        return rows.scaled(icf.select("term", F.col("icf").alias("factor")))
    found = lookup(rows, icf, ["term"], "left", spread_on=key, frequency=frequency)
    return found.withColumn("weight", F.col("weight") * F.coalesce("icf", F.lit(1.0))).drop("icf")


def weight_hard(rows: DataFrame | UnitRows, predicted: DataFrame, cf: DataFrame, key: str = "doc_id", label: str = "label") -> DataFrame:
    """Weight by the CF of the predicted class; a missing CF leaves the weight unchanged.

    ``predicted`` has (key, prediction) with predictions in the label domain of ``cf``.
    """
    if _in_blocks(rows, cf, label, dict(predicted.dtypes)["prediction"]):
        found = rows.of_class(predicted, cf, label)
        return found.select(key, "term", "term_id", (F.col("weight") * F.coalesce("cf", F.lit(1.0))).alias("weight"))
    rows = _long(rows)
    classed = rows.join(predicted.select(key, F.col("prediction").alias(label)), key)
    found = lookup(classed, _weighed(cf), [label, "term"], "left", spread_on=key, frequency="_often")
    return found.select(
        *rows.columns[:-1], (F.col("weight") * F.coalesce("cf", F.lit(1.0))).alias("weight")
    )


def weight_probabilistic(
    rows: DataFrame | UnitRows, probabilities: DataFrame, cf: DataFrame, key: str = "doc_id", label: str = "label"
) -> DataFrame:
    """Weight by sum(p * cf) / sum(p) over the classes that hold the term; 1 if none does.

    ``probabilities`` has (key, probabilities map<label, double>). The classes of a term travel
    as one small map, so rows are not multiplied by the number of classes.
    """
    if _in_blocks(rows, cf, label, dict(probabilities.dtypes)["probabilities"].removeprefix("map<").partition(",")[0]):
        return rows.of_chances(probabilities, cf, label)
    rows = _long(rows)
    by_term = _classes_by_term(cf, label, "_cf")
    found = lookup(rows.join(probabilities, key), by_term, ["term"], "left", spread_on=key, frequency="_often")
    held = F.map_entries(F.coalesce("_cf", F.map_from_entries(F.array().cast(f"array<struct<k:{dict(cf.dtypes)[label]},v:double>>"))))
    p = lambda e: F.coalesce(F.try_element_at(F.col("probabilities"), e["key"]), F.lit(0.0))
    top = F.aggregate(held, F.lit(0.0), lambda acc, e: acc + p(e) * e["value"])
    bottom = F.aggregate(held, F.lit(0.0), lambda acc, e: acc + p(e))
    factor = F.when(bottom > 0, top / bottom).otherwise(F.lit(1.0))
    return found.select(*rows.columns[:-1], (F.col("weight") * factor).alias("weight"))


def weight_max(rows: DataFrame | UnitRows, cf: DataFrame, key: str = "doc_id") -> DataFrame:
    """Weight by the largest CF of the term over all classes; unchanged if it has none."""
    if isinstance(rows, UnitRows):
        return rows.scaled(max_cf(cf).select("term", F.col("cf").alias("factor")))
    most = cf.groupBy("term").agg(F.max("cf").alias("cf"), F.sum("cf").alias("_often"))
    found = lookup(rows, most, ["term"], "left", spread_on=key, frequency="_often")
    return found.select(*rows.columns[:-1], (F.col("weight") * F.coalesce("cf", F.lit(1.0))).alias("weight"))


def consensus(predictions: DataFrame, threshold: float = 0.8) -> DataFrame:
    """Add agreement and confidence of the three annotations.

    Expects ``predicted_class_{hard,prob,maxcf}`` and ``confidence_{hard,prob,maxcf}``.
    """
    classes = [F.col(f"predicted_class_{m}") for m in ("hard", "prob", "maxcf")]
    sure = [F.col(f"confidence_{m}") for m in ("hard", "prob", "maxcf")]
    same = (classes[0] == classes[1]) & (classes[1] == classes[2])
    return (
        predictions.withColumn("consensus", F.when(same, classes[0]))
        .withColumn("high_confidence", F.greatest(*sure) >= threshold)
        .withColumn("avg_confidence", (sure[0] + sure[1] + sure[2]) / 3)
    )


def explain_terms(
    rows: DataFrame | UnitRows, predicted: DataFrame, cf: DataFrame, key: str = "doc_id", label: str = "label"
) -> DataFrame:
    """Per document and term: tf-idf, CF by class, CF of the predicted class and final score."""
    if _in_blocks(rows, cf, label, dict(predicted.dtypes)["prediction"]):
        score = (F.col("weight") * F.coalesce("cf", F.lit(1.0))).alias("final_score")
        found = rows.of_class(predicted, cf, label)
        return found.select(key, "prediction", "term", F.col("weight").alias("tfidf_score"), "cf_scores", F.col("cf").alias("predicted_class_cf"), score)
    rows = _long(rows)
    by_term = _classes_by_term(cf, label, "cf_scores")
    found = lookup(rows.join(predicted.select(key, "prediction"), key), by_term, ["term"], "left", spread_on=key, frequency="_often")
    own = F.try_element_at("cf_scores", F.col("prediction"))
    return found.select(
        key,
        "prediction",
        "term",
        F.col("weight").alias("tfidf_score"),
        "cf_scores",
        own.alias("predicted_class_cf"),
        (F.col("weight") * F.coalesce(own, F.lit(1.0))).alias("final_score"),
    )


def top_terms(scored: DataFrame, k: int, key: str = "doc_id", score: str = "final_score") -> DataFrame:
    """The k best terms of each document; ties go to the term that sorts first.

    For k up to 1000 Spark limits every group on the map side, so a large group is never
    gathered whole.
    """
    order = W.partitionBy(key).orderBy(F.desc(score), "term")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(key, "rank", "term", score)
