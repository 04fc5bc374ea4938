"""Scalar numeric functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(a: Column, b: Column) -> Column:
    """a / b as double, 0 where b is 0."""
    return F.when(b == 0, F.lit(0.0)).otherwise(a.cast("double") / F.when(b == 0, F.lit(None)).otherwise(b))


def f1_of(p: Column, r: Column) -> Column:
    return F.when(p + r == 0, F.lit(0.0)).otherwise(2 * p * r / F.when(p + r == 0, F.lit(None)).otherwise(p + r))


def f1_ceiling(recall: Column) -> Column:
    """The best F1 that a retriever of this recall allows."""
    return F.when(recall > 0, 2 * recall / (1 + recall)).otherwise(0.0)


def finite_number(v: Column, low: float | None = None, high: float | None = None) -> Column:
    """Whether a variant is a finite number in the bounds; booleans and texts are none."""
    kind = F.schema_of_variant(v)
    x = F.try_variant_get(v, "$", "double")
    ok = (kind.isin("BIGINT", "DOUBLE", "FLOAT", "INT", "SMALLINT", "TINYINT") | kind.startswith("DECIMAL")) & x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    if low is not None:
        ok = ok & (x >= low)
    if high is not None:
        ok = ok & (x <= high)
    return F.coalesce(ok, F.lit(False))


def dot(a: Column, b: Column) -> Column:
    """Scalar product of two arrays, in double."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def normalised(a: Column) -> Column:
    """The array at unit length; zeros stay zeros."""
    size = F.sqrt(dot(a, a))
    return F.transform(a, lambda x: F.when(size > 0, x.cast("double") / size).otherwise(0.0))
