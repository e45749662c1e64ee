"""Multinomial naive Bayes over long weight tables, in closed form.

Fitting is one aggregate, prediction one lookup by term; neither needs vectors.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparktext.operators.blocks import TermBlocks
from sparktext.operators.joins import lookup
from sparktext.session import materialize


@dataclass
class BayesModel:
    """``likelihoods``: (term, scores array over classes); ``priors``: one row (prior array)."""

    likelihoods: DataFrame
    priors: DataFrame
    labels: Sequence[int]

    def predict(self, docs: DataFrame, rows: DataFrame, key: str = "doc_id") -> DataFrame:
        """(key, prediction) for every document; one without known terms gets the largest prior."""
        found = lookup(rows, self.likelihoods, ["term"], spread_on=key)
        sums = [F.sum(F.col("weight") * F.get("scores", F.lit(i))).alias(f"_s{i}") for i in range(len(self.labels))]
        scored = found.groupBy(key).agg(*sums)
        return self._best(docs.select(key).join(scored, key, "left"), key, [f"_s{i}" for i in range(len(self.labels))])

    def predict_blocks(self, docs: TermBlocks, weights: DataFrame) -> DataFrame:
        """``predict`` for documents in blocks with the weights (term, idf) of their terms."""
        n = len(self.labels)
        return self._best(docs.scored(weights, self.likelihoods, n), docs.key, [F.get("scores", F.lit(i)) for i in range(n)])

    def _best(self, scored: DataFrame, key: str, scores: Sequence[Column | str]) -> DataFrame:
        joint = F.array(*[F.coalesce(x, F.lit(0.0)) + F.get("prior", F.lit(i)) for i, x in enumerate(scores)])
        classes = F.array(*[F.lit(x) for x in self.labels])
        out = scored.crossJoin(F.broadcast(self.priors)).withColumn("_j", joint)
        best = F.array_position("_j", F.array_max("_j")).cast("int")
        return out.select(key, F.get(classes, best - 1).alias("prediction"))


def fit_bayes(docs: DataFrame, rows: DataFrame, labels: Sequence[int], alpha: float = 1.0, label: str = "label") -> BayesModel:
    """``rows`` is a long table (key, label, term, weight); ``docs`` gives the class priors."""
    sums = rows.groupBy("term").agg(
        *[F.sum(F.when(F.col(label) == c, F.col("weight")).otherwise(0.0)).alias(f"_w{i}") for i, c in enumerate(labels)]
    )
    sums = materialize(sums)
    totals = sums.agg(F.count(F.lit(1)).alias("_v"), *[F.sum(f"_w{i}").alias(f"_t{i}") for i in range(len(labels))])
    score = F.array(
        *[F.log(F.col(f"_w{i}") + alpha) - F.log(F.col(f"_t{i}") + alpha * F.col("_v")) for i in range(len(labels))]
    )
    likelihoods = sums.crossJoin(F.broadcast(totals)).select("term", score.alias("scores"))
    n = F.count(F.lit(1))
    priors = docs.agg(F.array(*[F.log(F.sum((F.col(label) == c).cast("double")) / n) for c in labels]).alias("prior"))
    return BayesModel(likelihoods, priors, list(labels))
