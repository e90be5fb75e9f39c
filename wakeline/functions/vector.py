"""Vectors as arrays of floats; sums run in double."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DIM = 64


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine; null where a vector has no length."""
    return 1 - F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def grid_bucket(lon: Column, lat: Column, dim: int = DIM) -> Column:
    """Bucket of the one-degree cell of a point; points beyond the map go to its edge."""
    col = F.floor(F.least(F.greatest(lon, F.lit(-180.0)), F.lit(179.999)) + 180)
    row = F.floor(F.least(F.greatest(lat, F.lit(-90.0)), F.lit(89.999)) + 90)
    return F.pmod((row * 360 + col) * F.lit(2654435761), F.lit(dim)).cast("int")


def unit(counts: Column) -> Column:
    """A count vector scaled to length one in single precision; a zero vector stays zero."""
    length = F.sqrt(F.aggregate(counts, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    scale = F.when(length > 0, (1 / length).cast("float")).otherwise(F.lit(0.0).cast("float"))
    return F.transform(counts, lambda x: (x.cast("float") * scale).cast("float"))
