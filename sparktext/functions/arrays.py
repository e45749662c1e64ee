"""Dense-vector and label-vector functions over array columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sparktext.functions.text import _col, let


def norm(v: Column | str) -> Column:
    return F.sqrt(F.aggregate(_col(v), F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))


def l2_normalize(v: Column | str) -> Column:
    """Unit-length copy; a zero vector stays zero."""
    vec = _col(v)

    def scaled(n: Column) -> Column:
        return F.transform(vec, lambda x: F.when(n > 0, x.cast("double") / n).otherwise(F.lit(0.0)))

    return let(norm(vec), scaled)


def truncate(v: Column | str, dim: int) -> Column:
    return F.slice(_col(v), 1, dim)


def binary_quantize(v: Column | str) -> Column:
    return F.transform(_col(v), lambda x: (x > 0).cast("tinyint"))


def int8_quantize(v: Column | str, scale: Column) -> Column:
    """Divide by the scale, cut toward zero, clamp to +-127."""

    def cut(x: Column) -> Column:
        q = x.cast("double") / scale
        whole = F.when(q < 0, F.ceil(q)).otherwise(F.floor(q))
        return F.greatest(F.lit(-127), F.least(F.lit(127), whole)).cast("tinyint")

    return F.transform(_col(v), cut)


def int8_dequantize(q: Column | str, scale: Column) -> Column:
    return F.transform(_col(q), lambda x: x.cast("double") * scale)


def dot(a: Column | str, b: Column | str) -> Column:
    pairs = F.zip_with(_col(a), _col(b), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(pairs, F.lit(0.0), lambda acc, x: acc + x)


def cosine_similarity(a: Column | str, b: Column | str) -> Column:
    return dot(a, b) / (norm(a) * norm(b))


def binary_cosine_distance(a: Column | str, b: Column | str) -> Column:
    """1 - n(a and b) / sqrt(n(a) * n(b)) on 0/1 vectors, counted in 64 bits."""

    def ones(v: Column) -> Column:
        return F.aggregate(v, F.lit(0).cast("bigint"), lambda acc, x: acc + (x != 0).cast("bigint"))

    both = ones(F.zip_with(_col(a), _col(b), lambda x, y: x * y))
    return 1 - both / F.sqrt((ones(_col(a)) * ones(_col(b))).cast("double"))


def one_hot(code: Column | str, depth: int) -> Column:
    """0/1 vector of length ``depth``; a code outside 0..depth-1 gives zeros only."""
    c = _col(code)
    return F.transform(
        F.sequence(F.lit(0), F.lit(depth - 1)), lambda i: F.coalesce((i == c).cast("int"), F.lit(0))
    )


def arg_max(v: Column | str) -> Column:
    """0-based position of the first maximum."""
    vec = _col(v)
    return F.array_position(vec, F.array_max(vec)) - 1
