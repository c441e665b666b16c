"""Vector expressions over ARRAY<FLOAT or DOUBLE> columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """The body over a value that is computed once for each row, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def dot(a: Column, b: Column) -> Column:
    """Inner product, summed in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; null if either vector is null or has no length."""
    length = norm(a) * norm(b)
    return F.when(length > 0, dot(a, b) / length)


def unit(a: Column) -> Column:
    """The vector at length 1; one without length stays as it is."""
    return let(a, lambda v: let(norm(v), lambda n: F.when(n > 0, F.transform(v, lambda x: x.cast("double") / n)).otherwise(v.cast("array<double>"))))


def fit_dimension(a: Column, dim: int) -> Column:
    """The vector cut, or filled with zeros, to dim values."""
    return F.slice(F.concat(a.cast("array<float>"), F.array_repeat(F.lit(0.0).cast("float"), dim)), 1, dim)


def feature_hash_vector(text: Column) -> Column:
    """Ten features of a text: its length, its share of distinct tokens, its first characters and seven bytes of its hash, before scaling."""
    toks = F.filter(F.split(text, r"[ \t\n\r\f]+"), lambda x: x != "")
    first = F.aggregate(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(F.lit(10), F.length(text)))), lambda i: F.ascii(F.substring(text, i, F.lit(1)))), F.lit(0), lambda s, x: s + x)
    low = [F.conv(F.substring(F.md5(text), 31 - 2 * k, 2), 16, 10).cast("double") / 255.0 for k in range(7)]
    return F.array(F.length(text) / 1000.0, F.size(F.array_distinct(toks)) / (F.size(toks) + 1e-6), first / 1280.0, *low)


def feature_hash_embedding(text: Column) -> Column:
    """The feature vector at length 1; null for null and empty texts."""
    return F.when(F.length(text) > 0, unit(feature_hash_vector(text)))
