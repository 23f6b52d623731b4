"""Similarities of sparse codes from their overlap and sizes, and the soft threshold on them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def cosine(both: Column, a: Column, b: Column) -> Column:
    """Overlap over the geometric mean of the sizes; 0 if either code is empty."""
    return F.when((a > 0) & (b > 0), both / F.sqrt((a * b).cast("double"))).otherwise(0.0)


def jaccard(both: Column, a: Column, b: Column) -> Column:
    """Overlap over union; 0 if both codes are empty."""
    return F.when((a + b - both) > 0, both / (a + b - both)).otherwise(0.0)


def _squared(base: Callable[..., Column]) -> Callable[..., Column]:
    return lambda both, a, b: base(both, a, b) * base(both, a, b)


#: Names by which a similarity can be asked for.
BY_NAME = {
    "cosine": cosine, "jaccard": jaccard,
    "jaccard2": _squared(jaccard), "j2": _squared(jaccard), "jac2": _squared(jaccard),
    "cosine2": _squared(cosine), "cos2": _squared(cosine),
}


def similarity(name: str, both: Column, a: Column, b: Column) -> Column:
    """A similarity by name; unknown names mean Jaccard."""
    return BY_NAME.get(name.strip().lower(), jaccard)(both, a, b)


def thresholded(s: Column, level: float, eta: float | None) -> Column:
    """0 up to 0; without eta a hard threshold at the level, with it the similarity times a sigmoid about the level."""
    if eta is None:
        kept = F.when(s >= level, s).otherwise(0.0)
    else:
        kept = s * (1.0 / (1.0 + F.exp(-eta * (s - level))))
    return F.when(s > 0, kept).otherwise(0.0)


def angle_similarity(a: Column, b: Column) -> Column:
    """(cos of the circular difference + 1) / 2, of angles in degrees."""
    apart = F.pmod(F.abs(a - b), F.lit(360.0))
    return (F.cos(F.radians(F.least(apart, 360.0 - apart))) + 1.0) / 2.0
