"""Vector expressions: sums are taken as doubles, in order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def total(a) -> Column:
    return F.aggregate(_c(a), F.lit(0.0), lambda s, v: s + v.cast("double"))


def norm(a) -> Column:
    return F.sqrt(dot(a, a))


def normalise(a, eps: float = 1e-12) -> Column:
    """The vector over its length; a vector under eps is left as it is."""
    n = norm(a)
    return F.transform(_c(a), lambda x: F.when(n > eps, x.cast("double") / n).otherwise(x.cast("double")))


def cosine(a, b, lo: float = 0.0, hi: float = 1.0, eps: float = 1e-12) -> Column:
    """Cosine clipped to [lo, hi]; 0 where a vector is null or under eps."""
    n = norm(a) * norm(b)
    return F.coalesce(F.when(n > eps, F.least(F.greatest(dot(a, b) / n, F.lit(lo)), F.lit(hi))), F.lit(0.0))


def bhattacharyya(a, b) -> Column:
    """Distance of two histograms."""
    both = F.aggregate(F.zip_with(_c(a), _c(b), lambda x, y: F.sqrt(x * y)), F.lit(0.0), lambda s, v: s + v)
    scale = F.sqrt(total(a) * total(b))
    return F.sqrt(F.greatest(F.lit(0.0), 1.0 - F.when(scale > 0, both / scale).otherwise(0.0)))


def mean_vector(vectors, size: int) -> Column:
    """Element-wise mean of an array of vectors of one size."""
    zero = F.array_repeat(F.lit(0.0), size)
    add = F.aggregate(_c(vectors), zero, lambda s, v: F.zip_with(s, v, lambda x, y: x + y.cast("double")))
    return F.transform(add, lambda x: x / F.size(_c(vectors)))
