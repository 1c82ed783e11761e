"""Vector expressions over arrays, computed in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda total, x: total + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Column) -> Column:
    """``a`` divided by its length; a vector of zeros stays as it is."""
    length = norm(a)
    return F.transform(a, lambda x: x.cast("double") / F.when(length == 0, F.lit(1.0)).otherwise(length))
