"""Vector arithmetic on ``ARRAY<FLOAT|DOUBLE>`` columns, narrow and JVM-side."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_double(vec: Column) -> Column:
    return vec.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")),
        F.lit(0.0),
        lambda acc, x: acc + x,
    )


def norm(vec: Column) -> Column:
    return F.sqrt(dot(vec, vec))


def normalize(vec: Column) -> Column:
    """Scale to unit length; the zero vector stays as it is."""
    # Repeating the length evaluates it once per vector rather than once per component.
    lengths = F.array_repeat(norm(vec), F.size(vec))
    return F.zip_with(as_double(vec), lengths, lambda x, n: F.when(n == 0, x).otherwise(x / n))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity, 0 when either side has no length."""
    lengths = norm(a) * norm(b)
    return F.when(lengths == 0, F.lit(0.0)).otherwise(dot(a, b) / lengths)


def truncate_dim(vec: Column, dim: int = 32, renormalize: bool = True) -> Column:
    """Keep the leading ``dim`` components."""
    head = as_double(F.slice(vec, 1, dim))
    return normalize(head) if renormalize else head


def clip(vec: Column, low: float, high: float) -> Column:
    return F.transform(
        as_double(vec), lambda x: F.least(F.greatest(x, F.lit(float(low))), F.lit(float(high)))
    )


def mean_vector(vec: Column, dim: int) -> Column:
    """Aggregate: the component-wise mean, as ``dim`` codegen'd averages."""
    return F.array(*[F.avg(vec[i].cast("double")) for i in range(dim)])
