"""Ordered greedy selections as rounds of local minima.

An item whose place in the order comes before those of all remaining items it conflicts with is
accepted by the sequential rule as well; accepting all such items and removing what they exclude,
until nothing is left, therefore gives the sequential result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codelattice.operators.spatial import disc_join
from codelattice.tables import drop_stored, stored


def accept_swaps(wanted: DataFrame) -> DataFrame:
    """The swaps (seq, y1, x1, y2, x2) that are taken when each in order of seq is, unless a cell of it was used."""
    rest = stored(wanted, "wanted")
    taken = None
    while rest.limit(1).count():
        cells = rest.select("seq", F.explode(F.array(F.struct(F.col("y1").alias("y"), F.col("x1").alias("x")), F.struct(F.col("y2").alias("y"), F.col("x2").alias("x")))).alias("cell"))
        cells = cells.distinct()
        first = cells.groupBy("cell").agg(F.min("seq").alias("first"))
        judged = cells.join(first, "cell").groupBy("seq").agg(F.bool_and(F.col("seq") == F.col("first")).alias("wins"))
        winners = stored(rest.join(judged.where("wins"), "seq", "left_semi"), "winners")
        used = winners.select(F.explode(F.array(F.struct(F.col("y1").alias("y"), F.col("x1").alias("x")), F.struct(F.col("y2").alias("y"), F.col("x2").alias("x")))).alias("cell")).distinct()
        blocked = cells.join(used, "cell", "left_semi").select("seq").distinct()
        following = stored(rest.join(blocked, "seq", "left_anti"), "wanted")
        drop_stored(rest)
        rest = following
        taken = winners if taken is None else taken.unionByName(winners)
    return rest if taken is None else taken


def spread_out(candidates: DataFrame, min_distance: float) -> DataFrame:
    """The candidates (rank, y, x, ...) that are taken when each in order of rank is, unless one taken before is nearer than min_distance."""
    rest = stored(candidates, "candidates")
    near = disc_join(rest.select(F.col("rank").alias("r"), F.col("y").alias("cy"), F.col("x").alias("cx")), rest.select("rank", "y", "x"), min_distance, strict=True)
    edges = stored(near.where("rank < r").select(F.col("r").alias("later"), F.col("rank").alias("earlier")), "conflicts")
    taken = None
    while rest.limit(1).count():
        open_ = edges.join(rest.select(F.col("rank").alias("later")), "later", "left_semi").join(rest.select(F.col("rank").alias("earlier")), "earlier", "left_semi")
        open_ = stored(open_, "conflicts")
        winners = stored(rest.join(open_.select(F.col("later").alias("rank")).distinct(), "rank", "left_anti"), "accepted")
        out = open_.join(winners.select(F.col("rank").alias("earlier")), "earlier", "left_semi").select(F.col("later").alias("rank"))
        gone = winners.select("rank").unionByName(out).distinct()
        following = stored(rest.join(gone, "rank", "left_anti"), "candidates")
        drop_stored(rest)
        drop_stored(edges)
        rest, edges = following, open_
        taken = winners if taken is None else taken.unionByName(winners)
    return rest if taken is None else taken
