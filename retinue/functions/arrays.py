"""Column expressions on descriptor and histogram arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def reshape_rows(flat: Column, dim: int = 128) -> Column:
    """Flat array of n*dim values -> n rows of ``dim``; a remainder is dropped."""
    n = F.floor(F.size(flat) / F.lit(dim)).cast("int")
    rows = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.slice(flat, i * dim + 1, F.lit(dim)))
    return F.when(flat.isNotNull(), F.when(n > 0, rows).otherwise(F.array()))


def concat_features(first: Column, second: Column) -> Column:
    """Both descriptor sets of an image, ``first`` in front; null only if both are."""
    joined = F.concat(F.coalesce(first, F.array()), F.coalesce(second, F.array()))
    return F.when(first.isNotNull() | second.isNotNull(), joined)


def squared_distance(a: Column, b: Column) -> Column:
    """64-bit sum of squared differences of two integer arrays."""
    terms = F.zip_with(a, b, lambda x, y: (x - y).cast("long") * (x - y).cast("long"))
    return F.aggregate(terms, F.lit(0).cast("long"), lambda total, t: total + t)
