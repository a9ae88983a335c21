"""Dense vectors as array<float>, summed in double."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Dimensions that an embedding provider may be asked for. Fixed values.
SUPPORTED = (256, 512, 1024, 1536)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine_similarity(a: Column, b: Column) -> Column:
    """Null for a null or zero vector and for vectors of unequal lengths."""
    size = norm(a) * norm(b)
    return F.when((F.size(a) == F.size(b)) & (size > 0), dot(a, b) / size)


def cosine_distance(a: Column, b: Column) -> Column:
    return 1 - cosine_similarity(a, b)


def fit(a: Column, dim: int) -> Column:
    """The leading `dim` components, renormalised if any were cut off; a shorter vector is an error."""
    head = F.slice(a, 1, dim)
    size = norm(head)
    cut = F.when(size > 0, F.transform(head, lambda x: (x / size).cast("float"))).otherwise(head)
    return F.when(F.size(a) < dim, F.raise_error(F.lit(f"vector has fewer than {dim} components")).cast("array<float>")).when(F.size(a) == dim, a).otherwise(cut)


def supported_dimension(target: Column) -> Column:
    """The smallest supported dimension that is at least the target, else the largest."""
    all_ = F.array(*map(F.lit, SUPPORTED))
    return F.coalesce(F.array_min(F.filter(all_, lambda d: d >= target)), F.lit(max(SUPPORTED)))


def literal(a: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(F.transform(a, lambda x: x.cast("string")), ","), F.lit("]"))


def parse(text: Column) -> Column:
    return F.from_json(text, "array<float>")
