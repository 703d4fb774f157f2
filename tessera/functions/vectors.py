"""Vector expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """In double precision, as single precision differs between engines."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def mean_vector(vector: str, dim: int) -> list[Column]:
    return [F.avg(F.col(vector)[i].cast("double")).alias(f"m{i}") for i in range(dim)]
