"""Vector expressions that stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def dot(left: Column, right: Column) -> Column:
    """Dot product in double precision, clipped to [-1, 1]."""
    products = F.zip_with(left, right, lambda a, b: a.cast("double") * b.cast("double"))
    total = F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)
    return F.least(F.lit(1.0), F.greatest(F.lit(-1.0), total))


def norm(vector: Column) -> Column:
    squares = F.transform(vector, lambda x: x.cast("double") * x.cast("double"))
    return F.sqrt(F.aggregate(squares, F.lit(0.0), lambda acc, x: acc + x))


def l2_normalize(vector: Column, epsilon: float = 1e-12) -> Column:
    """Unit vector as floats; null for a non-finite or near-zero norm."""
    size = norm(vector)
    usable = ~F.isnan(size) & (size != F.lit(float("inf"))) & (size > epsilon)
    return F.when(usable, F.transform(vector, lambda x: (x.cast("double") / size).cast("float")))
