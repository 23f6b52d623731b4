"""Which cells a layout step tries to swap: seeded draws as columns, tiles, weights and a similarity cutoff."""

from __future__ import annotations

import math
import random

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codelattice.functions import bits as B
from codelattice.functions.similarity import similarity

ATTEMPTS, DRAWS = 5, 50


def uniform(*parts) -> Column:
    """A number in [0, 1) that depends on the parts alone."""
    return F.xxhash64(*[p if isinstance(p, Column) else F.lit(p) for p in parts]).bitwiseAND((1 << 52) - 1) / float(1 << 52)


def other_cell(y: Column, x: Column, low_y: Column, high_y: Column, low_x: Column, high_x: Column, *parts) -> Column:
    """struct(y, x): a cell of the bounds (inclusive) drawn evenly, never (y, x) itself; null where there is no other."""
    wide = high_x - low_x + 1
    others = (high_y - low_y + 1) * wide - 1
    own = (y - low_y) * wide + (x - low_x)
    drawn = F.floor(uniform(*parts) * others)
    place = F.when(drawn >= own, drawn + 1).otherwise(drawn)
    cell = F.struct((low_y + F.floor(place / wide)).cast("int").alias("y"), (low_x + place % wide).cast("int").alias("x"))
    return F.when(others > 0, cell)


def near_cell(y: Column, x: Column, radius: float, low_y, high_y, low_x, high_x, *parts) -> Column:
    """struct(y, x): a cell drawn evenly from those of the disc about (y, x) and the bounds, never (y, x) itself.

    Fifty draws from the square about the cell are made and the first that fits is taken; where none
    does, a cell of the bounds is drawn evenly.
    """
    bounds = [v if isinstance(v, Column) else F.lit(v) for v in (low_y, high_y, low_x, high_x)]
    reach = int(radius)
    aside = lambda n, axis: (F.floor(uniform(*parts, n, axis) * (2 * reach + 1)) - reach).cast("int")
    moves = F.transform(F.sequence(F.lit(1), F.lit(DRAWS)), lambda n: F.struct(aside(n, 1).alias("dy"), aside(n, 2).alias("dx")))

    def fits(m):
        there = (m["dy"] * m["dy"] + m["dx"] * m["dx"]).between(1, reach * reach)
        return there & (y + m["dy"]).between(bounds[0], bounds[1]) & (x + m["dx"]).between(bounds[2], bounds[3])

    first = F.get(F.filter(moves, fits), F.lit(0))
    near = F.struct((y + first["dy"]).cast("int").alias("y"), (x + first["dx"]).cast("int").alias("x"))
    return F.when(first.isNotNull(), near).otherwise(other_cell(y, x, *bounds, *parts, 0))


def random_pairs(state: DataFrame, count: int, side: int, radius: float | None, *parts) -> DataFrame:
    """(seq, y1, x1, y2, x2): points drawn evenly, and other cells, within the radius where one is given.

    state: (number, y, x, ...) with the points numbered from 0.
    """
    n = state.count()
    rows = state.sparkSession.range(count).select(F.col("id").alias("seq"), F.floor(uniform(*parts, F.col("id"), 3) * n).alias("drawn"))
    rows = rows.join(state.select("number", F.col("y").alias("y1"), F.col("x").alias("x1")), F.col("drawn") == F.col("number"))
    ends = [F.lit(v) for v in (0, side - 1, 0, side - 1)]
    own = (F.col("y1"), F.col("x1"))
    other = other_cell(*own, *ends, *parts, F.col("seq"), 5) if radius is None else near_cell(*own, radius, *ends, *parts, F.col("seq"))
    # a 1 x 1 grid has no other cell
    return rows.select("seq", "y1", "x1", other.alias("o")).where("o is not null").select("seq", "y1", "x1", F.col("o.y").alias("y2"), F.col("o.x").alias("x2"))


def tile_cuts(side: int, tiles: int, *parts) -> tuple[list[int], list[int]]:
    """Random cuts of rows and columns into about so many tiles: round(sqrt) rows, and columns to match."""
    draw = random.Random("-".join(map(str, parts)))
    rows = max(1, round(math.sqrt(tiles)))
    columns = math.ceil(tiles / rows)
    cut = lambda n: sorted(draw.sample(range(1, side), min(n - 1, side - 1))) if side > 1 else []
    return cut(rows), cut(columns)


def segment(value: Column, cuts: list[int], side: int) -> tuple[Column, Column, Column]:
    """(number, first, last) of the segment between cuts that holds a value."""
    ends = [0, *cuts, side]
    number = F.lit(0)
    for cut in cuts:
        number = number + F.when(value >= cut, 1).otherwise(0)
    pick = lambda values: F.get(F.array(*[F.lit(v) for v in values]), number)
    return number, pick(ends[:-1]), pick([e - 1 for e in ends[1:]])


def short_pairs(
    state: DataFrame, length: int, name: str, side: int, count: int, radius: float, seed: int, step: int,
    cutoff: float | None = None, weights: DataFrame | None = None, tiles: int = 1,
) -> DataFrame:
    """(seq, y1, x1, y2, x2): about count pairs of near cells whose first cell holds a point.

    Every tile gets an even share of the pairs, and in it the points get theirs by weight
    (point_id, weight), evenly where the tile's weights are all 0; a point's share is rounded by a
    draw.  Second cells stay in the tile.  A pair of points less similar than the cutoff is drawn
    again up to five times; what is still missing then is drawn from the whole grid.
    """
    spark = state.sparkSession
    rows_cut, columns_cut = tile_cuts(side, max(1, tiles), seed, step)
    ty, y_low, y_high = segment(F.col("y"), rows_cut, side)
    tx, x_low, x_high = segment(F.col("x"), columns_cut, side)
    number = len(columns_cut) + 1
    rows = state.select("point_id", "y", "x", B.pack(F.col("bits"), length).alias("words"), F.size("bits").alias("ones"))
    rows = rows.withColumn("weight", F.lit(0.0)) if weights is None else rows.join(weights.select("point_id", "weight"), "point_id")
    rows = rows.select("*", (ty * number + tx).alias("tile"), y_low.alias("y_low"), y_high.alias("y_high"), x_low.alias("x_low"), x_high.alias("x_high"))
    sums = rows.groupBy("tile").agg(F.sum("weight").alias("total"), F.count("*").alias("n"))
    total = (len(rows_cut) + 1) * number
    share, rest = divmod(count, total)
    # a random tile is the first to get one of the pairs that are left over
    turn = random.Random(f"{seed}-{step}-tiles").randrange(total)
    sums = sums.withColumn("quota", F.lit(share) + F.when((F.col("tile") + turn) % total < rest, 1).otherwise(0))
    chance = F.when(F.col("total") > 0, F.col("weight") / F.col("total")).otherwise(1.0 / F.col("n"))
    copies = F.floor(F.col("quota") * chance + uniform(seed, step, "copies", F.col("point_id"))).cast("int")
    drawn = rows.join(F.broadcast(sums), "tile").withColumn("copies", copies).where("copies > 0")
    slots = drawn.select("*", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("slot"))
    tries = slots.select("*", F.explode(F.sequence(F.lit(1), F.lit(ATTEMPTS))).alias("attempt"))
    other = near_cell(F.col("y"), F.col("x"), radius, F.col("y_low"), F.col("y_high"), F.col("x_low"), F.col("x_high"), seed, step, F.col("point_id"), F.col("slot"), F.col("attempt"))
    tries = tries.select("*", other.alias("o")).where("o is not null").select("*", F.col("o.y").alias("y2"), F.col("o.x").alias("x2")).drop("o")
    other = rows.select(F.col("y").alias("oy"), F.col("x").alias("ox"), F.col("words").alias("o_words"), F.col("ones").alias("o_ones"))
    met = tries.join(other, (F.col("y2") == F.col("oy")) & (F.col("x2") == F.col("ox")), "left")
    if cutoff is not None:
        s = similarity(name, B.common(F.col("words"), F.col("o_words")), F.col("ones"), F.col("o_ones"))
        met = met.where(F.col("o_words").isNull() | (s >= cutoff))
    first = met.groupBy("point_id", "slot").agg(F.min(F.struct("attempt", F.col("y").alias("y1"), F.col("x").alias("x1"), "y2", "x2")).alias("p"))
    # the order of a step's pairs is a draw too: it decides between pairs that share a cell
    order = F.xxhash64(F.lit(seed), F.lit(step), "point_id", "slot")
    return first.select(order.alias("seq"), "p.y1", "p.x1", "p.y2", "p.x2")


def filled_up(pairs: DataFrame, state: DataFrame, count: int, side: int, radius: float | None, seed: int, step: int) -> DataFrame:
    """The pairs, and random ones from the whole grid for those missing from count."""
    missing = count - pairs.count()
    return pairs if missing <= 0 else pairs.unionByName(random_pairs(state, missing, side, radius, seed, step, "fill"))
