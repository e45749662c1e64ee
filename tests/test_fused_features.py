"""What a training pass over fused features carries."""

from pyspark.ml.linalg import Vectors

from sparktext.plans import classify


def test_fused_features_carry_no_attribute_for_each_feature(spark):
    df = spark.createDataFrame([(1, 0, Vectors.sparse(500, {3: 1.0})), (2, 1, Vectors.dense([0.0] * 500))], ["doc_id", "place", "words"])
    fused = classify.fuse_features(df, ["words"], {"place": 4})
    assert len(fused.schema["features"].metadata.get("ml_attr", {}).get("attrs", {})) == 0
    assert [r["features"].size for r in fused.orderBy("doc_id").collect()] == [504, 504]
