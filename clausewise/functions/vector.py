"""Column expressions on vectors held as arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_double(v: Column) -> Column:
    return F.transform(v, lambda x: x.cast("double"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def cosine(a: Column, b: Column) -> Column:
    """Null for null and zero vectors."""
    size = norm(a) * norm(b)
    return F.when(size > 0, dot(a, b) / F.nullif(size, F.lit(0.0)))


def resize(v: Column, width: Column | int) -> Column:
    """Cut to width, or filled with zeros."""
    return F.slice(F.concat(v, F.array_repeat(F.lit(0.0), width)), F.lit(1), F.lit(width))


def normalise(v: Column, guard: float = 1e-12) -> Column:
    size = norm(v) + guard
    return F.transform(v, lambda x: x.cast("double") / size)


def quantise(v: Column, places: int = 6) -> Column:
    """To a number of decimals, as vectors are kept in text."""
    return F.transform(v, lambda x: F.round(x.cast("double"), places).cast("float"))
