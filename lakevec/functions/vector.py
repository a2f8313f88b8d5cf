"""Vector functions on array columns, evaluated in the JVM in double precision."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from lakevec import types

Vector = Column | str | Sequence[float]


def as_vector(v: Vector) -> Column:
    """A column of doubles from a column, a column name or numbers."""
    if isinstance(v, Column):
        c = v
    elif isinstance(v, str):
        c = F.col(v)
    else:
        c = F.array(*(F.lit(float(x)) for x in v))
    return c.cast("array<double>")


def inner_product(a: Vector, b: Vector) -> Column:
    """The dot product; null if a vector or element is null or the lengths differ."""
    products = F.zip_with(as_vector(a), as_vector(b), lambda x, y: x * y)
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def squared_distance(a: Vector, b: Vector) -> Column:
    squares = F.zip_with(as_vector(a), as_vector(b), lambda x, y: (x - y) * (x - y))
    return F.aggregate(squares, F.lit(0.0), lambda s, x: s + x)


def euclidean(a: Vector, b: Vector) -> Column:
    return F.sqrt(squared_distance(a, b))


def norm(a: Vector) -> Column:
    return F.sqrt(F.aggregate(as_vector(a), F.lit(0.0), lambda s, x: s + x * x))


def _cosine(a: Vector, b: Vector, at_zero: Column) -> Column:
    length = norm(a) * norm(b)
    return F.when(length == 0.0, at_zero).otherwise(inner_product(a, b) / F.when(length == 0.0, F.lit(1.0)).otherwise(length))


def vector_similarity(a: Vector, b: Vector, metric: str) -> Column:
    """The SQL function: cosine (a zero vector is an error), l2 (the distance, not negated) or inner; null vectors are an error."""
    m = types.metric(metric)
    if m == "l2":
        value = euclidean(a, b)
    elif m == "inner":
        value = inner_product(a, b)
    else:
        value = _cosine(a, b, F.raise_error(F.lit("cosine of a zero vector")).cast("double"))
    missing = as_vector(a).isNull() | as_vector(b).isNull()
    differ = F.size(as_vector(a)) != F.size(as_vector(b))
    return (
        F.when(missing, F.raise_error(F.lit("vector function of NULL")).cast("double"))
        .when(differ, F.raise_error(F.lit("vectors of different dimension")).cast("double"))
        .otherwise(value)
    )


#: An alias of the same function, also for cosine.
vector_distance = vector_similarity


def score(a: Vector, b: Vector, metric: str) -> Column:
    """The search score, higher is better: cosine (0 at a zero vector), minus the Euclidean distance, or the dot product."""
    m = types.metric(metric)
    if m == "l2":
        return F.lit(0.0) - euclidean(a, b)
    if m == "inner":
        return inner_product(a, b)
    return _cosine(a, b, F.lit(0.0))


def finite(a: Vector) -> Column:
    """Whether every element is a finite number."""
    return F.forall(as_vector(a), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
