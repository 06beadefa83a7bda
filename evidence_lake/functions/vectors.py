"""Column expressions on vectors held as arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """Inner product in doubles."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def dot_unrolled(a: Column, b: Column, dims: int) -> Column:
    """Inner product of vectors of known length as one expression, without lambdas."""
    out = F.lit(0.0)
    for i in range(dims):
        out = out + a[i].cast("double") * b[i].cast("double")
    return out


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def let(value: Column, body) -> Column:
    """body(value), with value computed once and not once a use."""
    return F.transform(F.array(value), body)[0]


def unit(a: Column, add: float = 0.0) -> Column:
    """a over its norm (plus `add`); a zero vector stays."""

    def scaled(v: Column) -> Column:
        return let(norm(v), lambda n: F.transform(v, lambda x: F.when(n > 0, x / (n + add)).otherwise(x.cast("double"))))

    return let(a, scaled)


def max_sim(query: Column, doc: Column) -> Column:
    """Late interaction: over query tokens the sum of the best inner product with a document token."""
    return F.aggregate(query, F.lit(0.0), lambda s, q: s + F.array_max(F.transform(doc, lambda d: dot(q, d))))


def mean(vectors: Column, dims: int) -> Column:
    zero = F.array_repeat(F.lit(0.0), dims)
    total = F.aggregate(vectors, zero, lambda s, v: F.zip_with(s, v, lambda x, y: x + y))
    return F.transform(total, lambda x: x / F.size(vectors))
