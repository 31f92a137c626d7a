"""Vector expressions over array columns."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Raw cosine in double precision; null for a zero vector."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def mean_vector(v: Column) -> Column:
    """Aggregate: mean of equally long arrays, combined before the shuffle."""
    return vector_to_array(Summarizer.mean(array_to_vector(v.cast("array<double>"))))
