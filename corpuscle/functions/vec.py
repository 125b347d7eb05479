"""Vector expressions over ``array<float>`` columns, summed left to right in double."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _fold(a: Column, b: Column, term) -> Column:
    products = F.zip_with(a, b, lambda x, y: term(x.cast("double"), y.cast("double")))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def l2sq(a: Column, b: Column) -> Column:
    """Squared Euclidean distance, the default metric."""
    return _fold(a, b, lambda x, y: (x - y) * (x - y))


def inner_product(a: Column, b: Column) -> Column:
    return _fold(a, b, lambda x, y: x * y)


def cosine(a: Column, b: Column) -> Column:
    """Cosine distance."""
    norm = F.sqrt(inner_product(a, a)) * F.sqrt(inner_product(b, b))
    return 1 - inner_product(a, b) / norm


def similarity(distance: Column) -> Column:
    return 1 - distance


def require_distance(distance: Column) -> Column:
    """A hit without a distance is an error, never a null score."""
    return F.when(distance.isNull(), F.raise_error(F.lit("hit without a distance")).cast("double")).otherwise(distance)
