"""Vector columns over ``array<float>`` or ``array<double>``; sums run in double."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Distances are compared at this many decimals, so that ties are broken the same way everywhere.
DISTANCE_DECIMALS = 9


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def l2_norm(v: Column) -> Column:
    return F.sqrt(_sum(F.transform(v, lambda x: x.cast("double") * x.cast("double"))))


def l2_distance(a: Column, b: Column) -> Column:
    def squared(x: Column, y: Column) -> Column:
        gap = x.cast("double") - y.cast("double")
        return gap * gap

    return F.sqrt(_sum(F.zip_with(a, b, squared)))


def l2_normalize(v: Column) -> Column:
    """Unit-length copy of ``v``; a zero vector stays as it is."""
    length = l2_norm(v)
    return F.when(length == 0.0, F.transform(v, lambda x: x.cast("double"))).otherwise(
        F.transform(v, lambda x: x.cast("double") / length)
    )


def cosine_from_l2(distance: Column) -> Column:
    """Cosine similarity of two unit vectors at L2 distance ``distance``."""
    return 1 - distance * distance / 2
