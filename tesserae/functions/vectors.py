"""Vector expressions over array columns; sums in double."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import held


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda total, x: total + x)


def as_double(vector: Column) -> Column:
    return vector.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def norm(vector: Column) -> Column:
    return F.sqrt(_sum(F.transform(vector, lambda x: x.cast("double") * x.cast("double"))))


def l2_normalized(vector: Column) -> Column:
    """The vector by its length; a zero vector stays."""
    by = lambda v: held(norm(v), lambda n: held(F.when(n == 0, 1.0).otherwise(n), lambda n: F.transform(v, lambda x: x / n)))
    return held(as_double(vector), by)


def query_normalized(vector: Column) -> Column:
    """The vector by its length and a little more, as queries are normalised."""
    return held(as_double(vector), lambda v: held(norm(v) + 1e-8, lambda n: F.transform(v, lambda x: x / n)))


def fitted(vector: Column, dimension: int) -> Column:
    """Cut, or filled up with zeros, to a dimension."""
    return F.slice(F.concat(as_double(vector), F.array_repeat(F.lit(0.0), dimension)), 1, dimension)


def resolution(vector: Column, dimension: int) -> Column:
    """The first numbers of a multi-resolution vector, normalised again."""
    return l2_normalized(fitted(vector, dimension))


def cosine(a: Column, b: Column) -> Column:
    """0 if either is a zero vector."""
    lengths = norm(a) * norm(b)
    return F.when(lengths == 0, 0.0).otherwise(dot(a, b) / F.when(lengths == 0, 1.0).otherwise(lengths))


def unit_interval(similarity: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), (similarity + 1.0) / 2.0))


def squared_distance(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))))


def inverse_distance(a: Column, b: Column) -> Column:
    """1 / (1 + squared distance): the order of the dot product for unit vectors."""
    return 1.0 / (1.0 + squared_distance(a, b))


def hash_vector(text: Column, dimension: int) -> Column:
    """The bytes of SHA-256, repeated to a dimension, by 255: a deterministic stand-in for a model."""
    digest = F.sha2(F.coalesce(text, F.lit("")), 256)
    return held(digest, lambda d: _bytes(d, dimension))


def _bytes(digest: Column, dimension: int) -> Column:
    byte = lambda i: F.conv(F.substring(digest, F.pmod(i, F.lit(32)) * 2 + 1, F.lit(2)), 16, 10).cast("double")
    once = F.transform(F.sequence(F.lit(0), F.lit(31)), lambda i: byte(i) / 255.0)
    every = lambda v: F.transform(F.sequence(F.lit(0), F.lit(dimension - 1)), lambda i: F.element_at(v, F.pmod(i, F.lit(32)) + 1))
    return held(once, every)


def seeded_vector(text: Column, dimension: int = 384) -> Column:
    """((hash + place) mod 2**31) / 2**31, from a hash that is the same in every process."""
    seed = F.xxhash64(F.coalesce(text, F.lit("")))
    return F.transform(F.sequence(F.lit(0), F.lit(dimension - 1)), lambda i: F.pmod(seed + i, F.lit(1 << 31)) / float(1 << 31))
