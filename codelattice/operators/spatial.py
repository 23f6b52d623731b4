"""Range joins on a grid, by cells of the radius instead of nested loops.

A grid position holds at most one point, so a cell of the radius holds a bounded number of points
however many there are in all.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def disc_join(centers: DataFrame, points: DataFrame, radius: float, cy: str = "cy", cx: str = "cx", strict: bool = False) -> DataFrame:
    """Every center with the points (y, x) within the radius, and d2, their squared distance.

    The centers' columns and the points' must not share names.  Each center looks into the cells
    around its own; the exact test follows.
    """
    side = float(max(radius, 1.0))
    around = F.explode(F.sequence(F.lit(-1), F.lit(1)))
    looking = (
        centers.withColumn("__dy", around).withColumn("__dx", around)
        .withColumn("__cell_y", F.floor(F.col(cy) / side) + F.col("__dy"))
        .withColumn("__cell_x", F.floor(F.col(cx) / side) + F.col("__dx"))
        .drop("__dy", "__dx")
    )
    placed = points.withColumn("__cell_y", F.floor(F.col("y") / side)).withColumn("__cell_x", F.floor(F.col("x") / side))
    dy, dx = F.col(cy) - F.col("y"), F.col(cx) - F.col("x")
    pairs = looking.join(placed, ["__cell_y", "__cell_x"]).drop("__cell_y", "__cell_x").withColumn("d2", (dy * dy + dx * dx).cast("double"))
    limit = float(radius) * float(radius)
    return pairs.where(F.col("d2") < limit if strict else F.col("d2") <= limit)


def coverage(detectors: DataFrame, points: DataFrame, max_radius: float) -> DataFrame:
    """(detector_id, point_id, d2): the points inside each detector's own radius, at most max_radius."""
    found = disc_join(detectors.select("detector_id", "cy", "cx", "radius"), points.select("point_id", "y", "x"), max_radius)
    return found.where("d2 <= radius * radius").select("detector_id", "point_id", "d2")


def fill_radius(centers: DataFrame, points: DataFrame, least: int, most: int, wanted: int) -> DataFrame:
    """(center_id, radius, covered): the smallest whole radius from least to most that covers the wanted number of points.

    Where none does, the smallest of those that cover the most.  centers: (center_id, cy, cx).
    """
    found = disc_join(centers.select("center_id", "cy", "cx"), points.select("y", "x"), most)
    rings = found.select("center_id", F.greatest(F.lit(least), F.ceil(F.sqrt("d2"))).cast("int").alias("ring"))
    per_ring = rings.groupBy("center_id", "ring").agg(F.count("*").alias("n"))
    # at most `most` rings per center: their sizes are summed inside one small array
    held = per_ring.groupBy("center_id").agg(F.sort_array(F.collect_list(F.struct("ring", "n"))).alias("rings"))
    upto = lambda r: F.aggregate("rings", F.lit(0).cast("long"), lambda t, s: t + F.when(s["ring"] <= r, s["n"]).otherwise(0))
    steps = F.transform(F.sequence(F.lit(least), F.lit(most)), lambda r: F.struct(r.alias("radius"), upto(r).alias("covered")))
    counted = held.select("center_id", steps.alias("steps"))
    enough = F.filter("steps", lambda s: s["covered"] >= wanted)
    fullest = F.array_min(F.transform("steps", lambda s: F.struct((-s["covered"]).alias("c"), s["radius"].alias("r"))))
    chosen = F.when(F.size(enough) > 0, F.get(enough, F.lit(0))).otherwise(F.struct(fullest["r"].alias("radius"), (-fullest["c"]).alias("covered")))
    return counted.select("center_id", chosen.alias("s")).select("center_id", "s.radius", "s.covered")
