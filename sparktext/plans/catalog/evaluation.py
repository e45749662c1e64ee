"""Evaluation of a rule that guesses the language of a document from marker words."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparktext.functions import arrays, text
from sparktext.operators import evaluate, joins
from sparktext.operators.sampling import train_test_split
from sparktext.plans.catalog.registry import SQL_LABEL, documents, query, quoted

# Marker words of each class, in class order (de, en, es, fr).
MARKERS = (("der", "die", "und", "das"), ("the", "of", "and", "to"), ("el", "los", "que", "con"), ("le", "la", "de", "que"))
LABELS = [0, 1, 2, 3]

_HITS = ", ".join(f"len(list_filter(ws, lambda t: t IN ({quoted(m)})))" for m in MARKERS)
SQL_PAIRS = f"""w AS (SELECT doc_id, source, CAST({SQL_LABEL} AS INTEGER) AS label, regexp_extract_all(lower(text), '{text.WORDS}') AS ws FROM documents),
h AS (SELECT doc_id, source, label, [{_HITS}] AS hits FROM w), s AS (SELECT doc_id, source, label, list_transform(hits, lambda x: (1.0 + x) / (4.0 + list_sum(hits))) AS scores FROM h),
pairs AS (SELECT doc_id, source, label, list_transform(scores, lambda x: CAST(x AS DOUBLE)) AS scores, CAST(list_position(scores, list_max(scores)) - 1 AS INTEGER) AS prediction, CAST(list_max(scores) AS DOUBLE) AS confidence FROM s)"""
SQL_PAIRS = SQL_PAIRS.replace("(1.0 + x) / (4.0 + list_sum(hits))", "CAST(1 + x AS DOUBLE) / CAST(4 + list_sum(hits) AS DOUBLE)")
_CELLS = "cells AS (SELECT label, prediction, count(*) AS n FROM pairs GROUP BY ALL)"
_SCORES = f"""{_CELLS}, sides AS (SELECT label AS class, n AS support, 0 AS predicted, CASE WHEN label = prediction THEN n ELSE 0 END AS hits FROM cells UNION ALL SELECT prediction, 0, n, 0 FROM cells),
sums AS (SELECT class, sum(support) AS support, sum(predicted) AS predicted, sum(hits) AS hits FROM sides GROUP BY class),
pr AS (SELECT class, CASE WHEN predicted > 0 THEN hits / CAST(predicted AS DOUBLE) ELSE 0 END AS precision, CASE WHEN support > 0 THEN hits / CAST(support AS DOUBLE) ELSE 0 END AS recall, CAST(support AS BIGINT) AS support FROM sums),
scores AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS f1 FROM pr)"""
_REPORT = """SELECT CAST(class AS VARCHAR) AS class, precision, recall, f1, support FROM scores UNION ALL SELECT 'macro avg', avg(precision), avg(recall), avg(f1), CAST(sum(support) AS BIGINT) FROM scores
UNION ALL SELECT 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support), sum(f1 * support) / sum(support), CAST(sum(support) AS BIGINT) FROM scores
UNION ALL SELECT 'accuracy', avg(CASE WHEN label = prediction THEN 1.0::DOUBLE ELSE 0 END), avg(CASE WHEN label = prediction THEN 1.0::DOUBLE ELSE 0 END), avg(CASE WHEN label = prediction THEN 1.0::DOUBLE ELSE 0 END), count(*) FROM pairs"""


def guessed(spark, sf):
    """(doc_id, source, label, scores, prediction, confidence)."""
    langs = F.array(*[F.lit(x) for x in ("de", "en", "es", "fr")])

    def count(ws, markers):
        return F.size(F.filter(ws, lambda t: t.isin(*markers)))

    def hits(ws):
        return F.array(*[count(ws, m) for m in MARKERS])

    def normed(h):
        whole = F.aggregate(h, F.lit(4), lambda acc, x: acc + x).cast("double")
        return F.transform(h, lambda x: (x + 1).cast("double") / whole)

    scores = text.let(text.let(text.words(F.lower("text")), hits), normed)
    label = (F.array_position(langs, F.col("lang")) - 1).cast("int")
    out = documents(spark, sf).select("doc_id", "source", label.alias("label"), scores.alias("scores"))
    return out.withColumn("prediction", arrays.arg_max("scores").cast("int")).withColumn("confidence", F.array_max("scores"))


def pairs(spark, sf):
    return guessed(spark, sf).select("doc_id", "source", "label", "prediction", "confidence")


def _round(df, *names):
    return df.withColumns({n: F.round(n, 9) for n in names})


@query("j6_paired_predictions", f"WITH {SQL_PAIRS} SELECT doc_id, label, prediction FROM pairs")
def paired_predictions(spark, sf):
    both = pairs(spark, sf)
    return joins.pair_predictions(both.select("doc_id", "label"), both.select("doc_id", "prediction"))


@query("e1_accuracy", f"WITH {SQL_PAIRS} SELECT round(avg(CASE WHEN label = prediction THEN 1.0::DOUBLE ELSE 0 END), 9) AS accuracy FROM pairs")
def accuracy(spark, sf):
    return _round(evaluate.accuracy(pairs(spark, sf)), "accuracy")


@query(
    "e2_weighted_scores",
    f"WITH {SQL_PAIRS}, {_SCORES} SELECT (SELECT round(avg(CASE WHEN label = prediction THEN 1.0::DOUBLE ELSE 0 END), 9) FROM pairs) AS accuracy, round(sum(precision * support) / sum(support), 9) AS precision, round(sum(recall * support) / sum(support), 9) AS recall, round(sum(f1 * support) / sum(support), 9) AS f1 FROM scores",
)
def weighted_scores(spark, sf):
    return _round(evaluate.weighted_scores(pairs(spark, sf)), "accuracy", "precision", "recall", "f1")


@query("e3_classification_report", f"WITH {SQL_PAIRS}, {_SCORES}, r AS ({_REPORT}) SELECT class, round(precision, 9) AS precision, round(recall, 9) AS recall, round(f1, 9) AS f1, support FROM r")
def classification_report(spark, sf):
    return _round(evaluate.classification_report(pairs(spark, sf)), "precision", "recall", "f1")


@query(
    "e4_confusion_matrix",
    f"WITH {SQL_PAIRS}, {_CELLS}, l AS (SELECT CAST(unnest(range(0, 5)) AS INTEGER) AS c) SELECT a.c AS label, b.c AS prediction, coalesce(n, 0) AS n FROM l a CROSS JOIN l b LEFT JOIN cells ON label = a.c AND prediction = b.c",
)
def confusion_matrix(spark, sf):
    return evaluate.confusion_matrix(pairs(spark, sf), [*LABELS, 4])


_ROC = f"""WITH {SQL_PAIRS}, long AS (SELECT unnest(range(0, 4)) AS class, unnest(scores) AS threshold, label FROM pairs),
c AS (SELECT class, threshold, count(*) FILTER (label = class) AS p, count(*) FILTER (label <> class) AS q FROM long GROUP BY ALL),
r AS (SELECT class, threshold, p, q, sum(p) OVER w AS tp, sum(q) OVER w AS fp, sum(p) OVER (PARTITION BY class) AS ap, sum(q) OVER (PARTITION BY class) AS aq FROM c WINDOW w AS (PARTITION BY class ORDER BY threshold DESC))"""


@query("e5_roc_points", f"{_ROC} SELECT CAST(class AS INTEGER) AS class, round(threshold, 9) AS threshold, round(fp / CAST(aq AS DOUBLE), 9) AS fpr, round(tp / CAST(ap AS DOUBLE), 9) AS tpr FROM r")
def roc_points(spark, sf):
    return _round(evaluate.roc_points(guessed(spark, sf), 4), "threshold", "fpr", "tpr")


@query("e6_auc", f"{_ROC} SELECT CAST(class AS INTEGER) AS class, round(sum(CAST(q AS DOUBLE) * (tp - p / 2.0::DOUBLE)) / (CAST(max(ap) AS DOUBLE) * max(aq)), 9) AS auc FROM r GROUP BY class")
def auc(spark, sf):
    return _round(evaluate.auc(guessed(spark, sf), 4), "auc")


_SPLIT = "split AS (SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY md5('42:' || doc_id), doc_id) <= ceil(0.2 * count(*) OVER ()) THEN 'test' ELSE 'train' END AS split FROM documents)"


@query(
    "e8_split_reports",
    f"""WITH {SQL_PAIRS.replace('pairs AS', 'every AS')}, {_SPLIT}, a AS (SELECT e.*, split FROM every e JOIN split USING (doc_id)), t AS (SELECT split, label, prediction, count(*) AS n FROM a GROUP BY ALL),
sides AS (SELECT split, label AS class, n AS support, 0 AS predicted, CASE WHEN label = prediction THEN n ELSE 0 END AS hits FROM t UNION ALL SELECT split, prediction, 0, n, 0 FROM t),
sums AS (SELECT split, class, sum(support) AS support, sum(predicted) AS predicted, sum(hits) AS hits FROM sides GROUP BY ALL),
pr AS (SELECT split, class, hits, CASE WHEN predicted > 0 THEN hits / CAST(predicted AS DOUBLE) ELSE 0 END AS precision, CASE WHEN support > 0 THEN hits / CAST(support AS DOUBLE) ELSE 0 END AS recall, CAST(support AS BIGINT) AS support FROM sums),
sc AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS f1 FROM pr),
r AS (SELECT split, CAST(class AS VARCHAR) AS class, precision, recall, f1, support FROM sc
UNION ALL SELECT split, 'macro avg', avg(precision), avg(recall), avg(f1), CAST(sum(support) AS BIGINT) FROM sc GROUP BY split
UNION ALL SELECT split, 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support), sum(f1 * support) / sum(support), CAST(sum(support) AS BIGINT) FROM sc GROUP BY split
UNION ALL SELECT split, 'accuracy', sum(hits) / CAST(sum(support) AS DOUBLE), sum(hits) / CAST(sum(support) AS DOUBLE), sum(hits) / CAST(sum(support) AS DOUBLE), CAST(sum(support) AS BIGINT) FROM sc GROUP BY split)
SELECT split, class, round(precision, 9) AS precision, round(recall, 9) AS recall, round(f1, 9) AS f1, support FROM r""",
)
def split_reports(spark, sf):
    split = train_test_split(pairs(spark, sf))
    out = evaluate.compare_splits(train=split.where("split = 'train'"), test=split.where("split = 'test'"))
    return _round(out, "precision", "recall", "f1")


_EXPERIMENTS = f"WITH {SQL_PAIRS}, m AS (SELECT source AS experiment, round(avg(CASE WHEN label = prediction THEN 1.0::DOUBLE ELSE 0 END), 9) AS accuracy, round(avg(confidence), 9) AS confidence FROM pairs GROUP BY source)"


def _experiments(spark, sf):
    hit = (F.col("label") == F.col("prediction")).cast("double")
    return pairs(spark, sf).groupBy(F.col("source").alias("experiment")).agg(F.round(F.avg(hit), 9).alias("accuracy"), F.round(F.avg("confidence"), 9).alias("confidence"))


@query("e9_ranked_experiments", f"{_EXPERIMENTS} SELECT *, CAST(row_number() OVER (ORDER BY accuracy DESC, experiment) AS INTEGER) AS rank FROM m")
def ranked_experiments(spark, sf):
    return evaluate.rank_experiments(_experiments(spark, sf), "accuracy")


@query(
    "o6_transposed_metrics",
    f"{_EXPERIMENTS} SELECT 'accuracy' AS metric, max(accuracy) FILTER (experiment = 'src0') AS src0, max(accuracy) FILTER (experiment = 'src1') AS src1, max(accuracy) FILTER (experiment = 'src2') AS src2 FROM m UNION ALL "
    "SELECT 'confidence', max(confidence) FILTER (experiment = 'src0'), max(confidence) FILTER (experiment = 'src1'), max(confidence) FILTER (experiment = 'src2') FROM m",
)
def transposed_metrics(spark, sf):
    return evaluate.transposed(_experiments(spark, sf), values=("accuracy", "confidence"), experiments=["src0", "src1", "src2"])


@query("e10_class_metric_rows", f"WITH {SQL_PAIRS}, {_SCORES} SELECT class, 'precision' AS metric, round(precision, 9) AS value FROM scores UNION ALL SELECT class, 'recall', round(recall, 9) FROM scores UNION ALL SELECT class, 'f1', round(f1, 9) FROM scores")
def class_metric_rows(spark, sf):
    return _round(evaluate.class_metric_rows(pairs(spark, sf)), "value")


@query("e11_error_listing", f"WITH {SQL_PAIRS} SELECT doc_id, label, prediction, round(confidence, 9) AS confidence, label = prediction AS is_correct FROM pairs")
def error_listing(spark, sf):
    return _round(evaluate.errors(pairs(spark, sf).drop("source")), "confidence")


@query("o3_most_confident_errors", f"WITH {SQL_PAIRS} SELECT doc_id, label, prediction, round(confidence, 9) AS confidence FROM pairs WHERE label <> prediction ORDER BY pairs.confidence DESC, doc_id LIMIT 100")
def most_confident_errors(spark, sf):
    return _round(evaluate.most_confident_errors(pairs(spark, sf)).select("doc_id", "label", "prediction", "confidence"), "confidence")
