"""Dense embeddings: pooling, quantisation, similarity, encoders."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparktext.functions import arrays, text
from sparktext.operators.joins import lookup, measure


def mean_pool(df: DataFrame, vector: str, dim: int, groups: Sequence[str], weight: str | None = None) -> DataFrame:
    """(Weighted) mean vector per group: one sum per dimension, combined map-side."""
    w = F.col(weight) if weight else F.lit(1)
    sums = [F.sum(F.get(F.col(vector), F.lit(i)).cast("double") * w).alias(f"_s{i}") for i in range(dim)]
    summed = df.groupBy(*groups).agg(*sums, F.sum(w).alias("_w"))
    return summed.select(*groups, F.array(*[F.col(f"_s{i}") / F.col("_w") for i in range(dim)]).alias(vector))


def calibration_scale(df: DataFrame, vector: str, key: str, samples: int = 1000) -> DataFrame:
    """One row (scale): the largest absolute value of the first ``samples`` rows over 127."""
    first = df.select(key, vector).orderBy(key).limit(samples)
    biggest = F.array_max(F.transform(vector, lambda x: F.abs(x.cast("double"))))
    return first.agg((F.max(biggest) / 127).alias("scale"))


def int8_vectors(df: DataFrame, vector: str, key: str, samples: int = 1000) -> DataFrame:
    """Add ``quantized`` (int8) and ``scale``."""
    scaled = df.crossJoin(F.broadcast(calibration_scale(df, vector, key, samples)))
    return scaled.withColumn("quantized", arrays.int8_quantize(vector, F.col("scale")))


def quantization_fan_out(df: DataFrame, vector: str, key: str, dims: Sequence[int], samples: int = 1000) -> DataFrame:
    """For every dimension the unit vector as float, binary and int8 rows (key, dim, quantization, values, scale)."""
    cut = F.explode(
        F.array(*[F.struct(F.lit(d).alias("dim"), arrays.l2_normalize(arrays.truncate(vector, d)).alias("v")) for d in dims])
    )
    wide = df.select(key, cut.alias("_c")).select(key, "_c.dim", "_c.v")
    scales = None
    for d in dims:
        one = calibration_scale(
            df.select(key, arrays.l2_normalize(arrays.truncate(vector, d)).alias("v")), "v", key, samples
        ).select(F.lit(d).alias("dim"), "scale")
        scales = one if scales is None else scales.unionByName(one)
    sized = wide.join(F.broadcast(scales), "dim")
    kinds = F.array(
        F.struct(F.lit("float").alias("quantization"), F.col("v").alias("values")),
        F.struct(F.lit("binary").alias("quantization"), F.transform(arrays.binary_quantize("v"), lambda x: x.cast("double")).alias("values")),
        F.struct(F.lit("int8").alias("quantization"), F.transform(arrays.int8_quantize("v", F.col("scale")), lambda x: x.cast("double")).alias("values")),
    )
    out = sized.select(key, "dim", "scale", F.explode(kinds).alias("_k"))
    return out.select(key, "dim", "_k.quantization", "_k.values", F.when(F.col("_k.quantization") == "int8", F.col("scale")).alias("scale"))


def pair_similarity(pairs: DataFrame, vectors: DataFrame, vector: str, key: str) -> DataFrame:
    """Cosine similarity and binary cosine distance of explicit pairs (left_id, right_id).

    An id may be in any share of the pairs: the vectors are broadcast if they are small, else ids of many pairs
    are spread over several tasks.
    """
    a = vectors.select(F.col(key).alias("left_id"), F.col(vector).alias("_a"))
    b = vectors.select(F.col(key).alias("right_id"), F.col(vector).alias("_b"))
    size = measure(a)[1]
    half = lookup(pairs, a, ["left_id"], spread_on="right_id", table_bytes=size)
    joined = lookup(half, b, ["right_id"], spread_on="left_id", table_bytes=size)
    return joined.select(
        "left_id",
        "right_id",
        arrays.cosine_similarity("_a", "_b").alias("cosine"),
        arrays.binary_cosine_distance(arrays.binary_quantize("_a"), arrays.binary_quantize("_b")).alias("binary_distance"),
    )


Encoder = Callable[[Sequence[str]], np.ndarray]


def hashing_encoder(dim: int = 64) -> Encoder:
    """A deterministic stand-in encoder: signed counts of hashed words."""
    import xxhash

    def encode(texts: Sequence[str]) -> np.ndarray:
        out = np.zeros((len(texts), dim))
        for row, t in enumerate(texts):
            for word in t.split():
                h = xxhash.xxh64_intdigest(word)
                out[row, h % dim] += 1.0 if (h >> 32) & 1 else -1.0
        return out

    return encode


def encode_texts(
    df: DataFrame,
    make_encoder: Callable[[], Encoder],
    dim: int,
    column: str = "text",
    key: str = "doc_id",
    batch_size: int = 64,
) -> DataFrame:
    """Apply a batch text encoder: long texts in pieces, piece vectors averaged, empty text -> zeros.

    ``make_encoder`` runs once per task, so a model is loaded there and not shipped with the plan.
    """
    pieces = df.select(key, F.explode(text.pieces(F.coalesce(F.col(column), F.lit("")))).alias("_piece"))
    kind = dict(df.dtypes)[key]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = make_encoder()
        for pdf in batches:
            for start in range(0, len(pdf), batch_size):
                part = pdf.iloc[start : start + batch_size]
                vectors = np.asarray(encoder(list(part["_piece"])), dtype=float)
                vectors[[not p for p in part["_piece"]]] = 0.0
                yield pd.DataFrame({key: part[key], "embedding": list(vectors)})

    encoded = pieces.mapInPandas(run, f"{key} {kind}, embedding array<double>")
    return mean_pool(encoded, "embedding", dim, [key])


def encode_batches(
    df: DataFrame,
    make_encoder: Callable[[], Encoder],
    dim: int,
    column: str = "text",
    key: str = "doc_id",
    batch_size: int = 64,
) -> DataFrame:
    """``encode_texts`` as a batch inference column: the encoder stays in its worker from one task to the next.

    Pieces of a partition are sorted by length, so the texts of a batch have about the same length and a
    padding encoder pads little.
    """
    from pyspark.ml.functions import predict_batch_udf
    from pyspark.sql.types import ArrayType, DoubleType

    def make():
        encoder = make_encoder()
        return lambda texts: np.asarray(encoder(list(texts)), dtype=float)

    run = predict_batch_udf(make, return_type=ArrayType(DoubleType()), batch_size=batch_size)
    pieces = df.select(key, F.explode(text.pieces(F.coalesce(F.col(column), F.lit("")))).alias("_piece"))
    by_length = pieces.withColumn("_length", F.char_length("_piece")).sortWithinPartitions("_length")
    encoded = by_length.withColumn("embedding", run("_piece"))
    zero = F.array_repeat(F.lit(0.0), dim)
    filled = encoded.select(key, F.when(F.col("_length") == 0, zero).otherwise(F.col("embedding")).alias("embedding"))
    return mean_pool(filled, "embedding", dim, [key])


def principal_components(df: DataFrame, vector: str, dim: int, k: int = 3, key: str = "doc_id") -> DataFrame:
    """Project centred vectors on the first ``k`` principal components."""
    from pyspark.ml.feature import PCA, StandardScaler
    from pyspark.ml.functions import array_to_vector, vector_to_array

    vecs = df.select(key, array_to_vector(F.col(vector).cast("array<double>")).alias("_v"))
    centred = StandardScaler(inputCol="_v", outputCol="_c", withMean=True, withStd=False).fit(vecs).transform(vecs)
    model = PCA(k=k, inputCol="_c", outputCol="_p").fit(centred)
    return model.transform(centred).select(key, vector_to_array("_p").alias("components"))
