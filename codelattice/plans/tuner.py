"""Parameters of a layout run from the number of points."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Name -> (factor, least, most) of the parameters that scale with the number of points.
LONG_PAIRS = (0.35, 4_000, 20_000)
LONG_STEPS = (1 / 25, 300, 1_500)
LONG_SUBSET = (8.0, 512, 2_048)
LONG_REFRESH = (18, 20, 80)
SHORT_PAIRS = (0.2, 1_800, 12_000)
SHORT_STEPS = (1.6, 160, 900)
LOCAL_RADIUS, ENERGY_RADIUS, RADIUS_MIN = 0.05, 0.04, 1
RECALC = (6, 30)
EMPTY_RATIO, START_FACTOR = 0.5, 0.5


def _within(value: Column, least: int, most: int) -> Column:
    return F.greatest(F.lit(least), F.least(F.lit(most), value.cast("long"))).cast("int")


def tuned(points: Column) -> dict[str, Column]:
    """Every parameter as a column of the number of points (positive, else an error)."""
    n = F.when(points > 0, points).otherwise(F.raise_error(F.lit("the number of points must be positive")).cast("long"))
    grid = F.ceil(F.sqrt(n * (1.0 + EMPTY_RATIO))).cast("int")
    long_steps = _within(n / 25, *LONG_STEPS[1:])
    short_steps = _within(grid * SHORT_STEPS[0], *SHORT_STEPS[1:])
    local = F.greatest(F.lit(RADIUS_MIN), (grid * LOCAL_RADIUS).cast("int"))
    return {
        "grid": grid,
        "long_pairs": _within(n * LONG_PAIRS[0], *LONG_PAIRS[1:]),
        "long_steps": long_steps,
        "long_subset": _within(F.sqrt(n.cast("double")) * LONG_SUBSET[0], *LONG_SUBSET[1:]),
        "long_refresh": _within(F.floor(long_steps / LONG_REFRESH[0]), *LONG_REFRESH[1:]),
        "short_pairs": _within(n * SHORT_PAIRS[0], *SHORT_PAIRS[1:]),
        "short_steps": short_steps,
        "local_radius": local,
        "energy_radius": F.greatest(F.lit(RADIUS_MIN), (grid * ENERGY_RADIUS).cast("int")),
        "recalc_every": F.greatest(F.lit(RECALC[1]), F.floor(short_steps / RECALC[0]).cast("int")),
        "pair_radius": F.greatest(F.lit(RADIUS_MIN), F.least(F.greatest(F.lit(1), local), (grid * START_FACTOR).cast("int"))),
    }
