"""Training rows of the catalog's classifiers lie in one part for each core at most."""

import pytest

from sparktext.plans import classify
from sparktext.plans.catalog import models


class Stop(Exception):
    pass


@pytest.mark.parametrize("run", [models.random_forest, models.kernel_svm_with_probabilities, models.logistic_regression])
def test_training_rows_are_dealt_to_the_cores(spark, tmp_path, monkeypatch, run):
    rows = [(i, [float(i % 7 + j) for j in range(models.DIM)], i % 10) for i in range(200)]
    spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    parts = []

    class Fitted:
        def fit(self, df):
            parts.append((df.count(), df.rdd.getNumPartitions()))
            raise Stop

    monkeypatch.setattr(classify, "make_classifier", lambda *a, **k: Fitted())
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        with pytest.raises(Stop):
            run(spark, str(tmp_path))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert parts[0][0] == 160 and parts[0][1] <= spark.sparkContext.defaultParallelism
