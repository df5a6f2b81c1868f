"""Vector arithmetic on array<float> columns: sums in double, in order of the elements.

Two vectors must be of one size; others raise an error. A null vector gives null.
"""

from pyspark.sql import Column
from pyspark.sql import functions as F


def _alike(a: Column, b: Column, value: Column) -> Column:
    said = F.concat(F.lit("vectors of "), F.size(a).cast("string"), F.lit(" and "), F.size(b).cast("string"), F.lit(" elements"))
    return F.when(a.isNull() | b.isNull(), F.lit(None)).when(F.size(a) == F.size(b), value).otherwise(F.raise_error(said).cast("double"))


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return _alike(a, b, _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))))


def norm(a: Column) -> Column:
    return F.sqrt(_sum(F.transform(a, lambda x: x.cast("double") * x.cast("double"))))


def l2_squared(a: Column, b: Column) -> Column:
    return _alike(a, b, _sum(F.zip_with(a, b, lambda x, y: F.pow(x.cast("double") - y.cast("double"), F.lit(2.0)))))


def cosine_distance(a: Column, b: Column) -> Column:
    """1 where either vector is zero."""
    size = norm(a) * norm(b)
    return F.when(size == 0, F.lit(1.0)).otherwise(1 - dot(a, b) / size)


def normalized(a: Column) -> Column:
    """Unit length, rounded to float; a zero vector stays as it is."""
    size = norm(a)
    return F.when(size == 0, a).otherwise(F.transform(a, lambda x: (x.cast("double") / size).cast("float")))


def registered(a: Column) -> Column:
    """(embedding, norm): a vector at length 1, and the length that it came with."""
    return F.struct(normalized(a).alias("embedding"), norm(a).alias("norm"))


def distance(metric: str, a: Column, b: Column) -> Column:
    if metric == "cosine":
        return cosine_distance(a, b)
    if metric == "l2":
        return l2_squared(a, b)
    if metric == "ip":
        return -dot(a, b)
    raise ValueError(f"unknown metric {metric}")


def similarity(metric: str, distance_: Column) -> Column:
    """What is largest for the nearest: one minus a cosine distance, minus any other."""
    return 1 - distance_ if metric == "cosine" else -distance_


def search_mode(rows: Column) -> Column:
    """Which search an amount of vectors calls for."""
    return F.when(rows < 10_000, "exact").when(rows < 250_000, "exact_or_ann").otherwise("local_ann")
