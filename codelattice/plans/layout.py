"""Arranging codes on a grid by iterated swaps: a driver loop with a few jobs per step.

The state is a table (point_id, y, x, bits) in the shared folder.  A step samples pairs of cells,
computes the energies of all of them at once, accepts a conflict-free set in order, and writes the
new state; random choices are hashes of (seed, step, number), so a run can be repeated.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codelattice.functions.display import hue_rgb, rescaled_hue
from codelattice.operators import energy
from codelattice.operators.greedy import accept_swaps
from codelattice.operators.monitors import decayed, followed
from codelattice.plans.sampling import filled_up, random_pairs, short_pairs, uniform
from codelattice.tables import drop_stored, ordered_index, stored, sweep, written

#: A row of the log of steps.
STEP_LOG = "run string, step long, swaps long, pairs long, energy double, mode string, radius double, lambda double"


@dataclass(frozen=True)
class Options:
    """Similarity and thresholds of a layout, and the sizes of its phases."""

    length: int
    similarity: str = "cosine"
    level: float = 0.65
    eta: float | None = 10.0
    empty_ratio: float = 0.15
    seed: int = 0
    subset: int = 512
    energy_radius: int | None = None
    stop_window: int = 20
    stop_delta: float = 5e-4
    stop_ratio: float = 0.003
    stall_window: int = 1


@dataclass
class Progress:
    """What a phase did: swaps and average energy by step."""

    swaps: list[int] = field(default_factory=list)
    energies: list[float] = field(default_factory=list)


def grid_side(points: int, empty_ratio: float) -> int:
    return max(1, math.ceil(math.sqrt(points * (1.0 + empty_ratio))))


def place(points: DataFrame, side: int, seed: int | str) -> DataFrame:
    """Points on the cells of a square grid in the order of the cells' hashes; every point gets its own cell."""
    spark = points.sparkSession
    cells = spark.range(side * side).select(F.col("id").alias("cell"), F.md5(F.concat(F.lit(str(seed)), F.col("id").cast("string"))).alias("h"))
    dealt = ordered_index(cells, [F.col("h").asc(), F.col("cell").asc()], "n")
    numbered = ordered_index(points, [F.col("point_id").asc()], "n")
    y, x = F.floor(F.col("cell") / side).cast("int"), (F.col("cell") % side).cast("int")
    return numbered.join(dealt, "n").select(*points.columns, y.alias("y"), x.alias("x"))


def with_members(ends: DataFrame, state: DataFrame) -> DataFrame:
    """Pairs with the points on their cells, the first cell occupied; pairs of two empty cells are left out."""
    at = lambda n: state.select(F.col("point_id").alias(f"idx_{n}"), F.col("y").alias(f"py_{n}"), F.col("x").alias(f"px_{n}"))
    rows = ends.join(at("a"), (F.col("y1") == F.col("py_a")) & (F.col("x1") == F.col("px_a")), "left")
    rows = rows.join(at("b"), (F.col("y2") == F.col("py_b")) & (F.col("x2") == F.col("px_b")), "left")
    rows = rows.where("idx_a is not null or idx_b is not null")
    turned = F.col("idx_a").isNull()
    pick = lambda one, other: F.when(turned, F.col(other)).otherwise(F.col(one))
    return rows.select(
        "seq", pick("y1", "y2").alias("y1"), pick("x1", "x2").alias("x1"), pick("y2", "y1").alias("y2"), pick("x2", "x1").alias("x2"),
        pick("idx_a", "idx_b").alias("idx_a"), pick("idx_b", "idx_a").alias("idx_b"),
    )


def evaluated_subset(state: DataFrame, size: int, seed: int, epoch: int) -> DataFrame:
    """So many of the points, drawn by a hash; all where there are no more."""
    n = state.count()
    return state if n <= size else state.orderBy(uniform(seed, "subset", epoch, F.col("point_id")), "point_id").limit(size)


@dataclass(frozen=True)
class Adaptive:
    """A radius that decays over a phase, is cut when swaps dry up, and a threshold that then rises."""

    start: int
    end: int = 1
    trigger: float = 0.01
    lambda_step: float | None = 0.05


@dataclass(frozen=True)
class Phase:
    """Steps of one mode, long or short, and how they draw their pairs.

    Without a radius long pairs are drawn from the whole grid and short ones from the mean distance
    of the long swaps.  Energies are measured every so many steps.
    """

    mode: str
    steps: int
    pairs: int
    radius: float | None = None
    adaptive: Adaptive | None = None
    cutoff: float | None = None
    weighted: bool = False
    tiles: int = 1
    refresh: int = 50
    energy_every: int = 1


def step(state: DataFrame, options: Options, side: int, phase: Phase, radius: float | None, number: int, level: float) -> tuple[DataFrame, DataFrame]:
    """One step over a state with numbered points: the new state and the swaps made; all else that it stores is deleted."""
    mark = written()
    reach = max(1.0, float(radius or options.energy_radius or 7))
    if phase.mode == "long":
        ends = random_pairs(state, phase.pairs, side, radius, options.seed, number)
    else:
        raw = energy.local_energy(state, options.length, reach, options.similarity, level, options.eta) if phase.weighted else None
        weights = None if raw is None else energy.short_weights(raw)
        ends = stored(short_pairs(state, options.length, options.similarity, side, phase.pairs, reach, options.seed, number, phase.cutoff, weights, phase.tiles), "ends")
        ends = filled_up(ends, state, phase.pairs, side, reach, options.seed, number)
    sampled = stored(with_members(ends, state), "pairs")
    if phase.mode == "long":
        known = evaluated_subset(state, options.subset, options.seed, number // max(1, phase.refresh))
        energies = energy.comparable_energy_long(sampled, state, known, options.similarity, level, options.eta)
    else:
        energies = energy.pair_energy_short(sampled, state, options.length, reach, options.similarity, level, options.eta)
    wanted = energy.swaps_wanted(energies, phase.mode).where("swap").select("seq")
    taken = stored(accept_swaps(sampled.join(wanted, "seq", "left_semi")), "swaps")
    moves = taken.where("idx_a is not null").select(F.col("idx_a").alias("m_id"), F.col("y2").alias("ny"), F.col("x2").alias("nx")).unionByName(
        taken.where("idx_b is not null").select(F.col("idx_b").alias("m_id"), F.col("y1").alias("ny"), F.col("x1").alias("nx"))
    )
    moved = state.join(moves, F.col("point_id") == F.col("m_id"), "left")
    others = [c for c in state.columns if c not in ("y", "x")]
    following = stored(moved.select(*others, F.coalesce("ny", "y").alias("y"), F.coalesce("nx", "x").alias("x")), "layout")
    sweep(state.sparkSession, mark, keep=(following, taken))
    return following, taken


def write_step(spark: SparkSession, folder: str, run_name: str, number: int, phase: Phase, swaps: int, value: float | None, radius: float | None, level: float) -> None:
    """Append a step to the log that streaming.telemetry watches; energy is null where it was not measured."""
    row = (run_name, number, swaps, phase.pairs, value, phase.mode, None if radius is None else float(radius), level)
    spark.createDataFrame([row], STEP_LOG).coalesce(1).write.mode("append").parquet(folder)


def numbered(points: DataFrame) -> DataFrame:
    """Adds number, the place of every point in the order of ids, from which points are drawn evenly."""
    return ordered_index(points, [F.col("point_id").asc()], "number")


def run(
    points: DataFrame, options: Options, phases: list[Phase], side: int | None = None, resume: bool = False,
    log: str | None = None, save: str | None = None, run_name: str = "layout",
) -> tuple[DataFrame, Progress]:
    """Place points (point_id, bits, ...) and run the phases; with resume the points keep the y and x they have.

    A phase ends early when its last stall_window steps' swaps are on average at most stop_ratio of
    their pairs, or when the average energy has changed by less than stop_delta over stop_window
    measurements.  log: a folder to which every step is appended.  save: a folder that gets the
    layout (without its working column) whenever a phase ends, early or not, so a run can be resumed.
    """
    spark = points.sparkSession
    side = side or grid_side(points.count(), options.empty_ratio)
    mark = written()
    points = numbered(points.drop("number"))
    state = stored(points if resume else place(points, side, options.seed), "layout")
    sweep(spark, mark, keep=(state,))
    progress = Progress()
    reach = options.energy_radius or max(1, min(side // 2, 15))
    number, level = 0, options.level
    distance, distances = 0.0, 0
    for phase in phases:
        made: list[tuple[int, int]] = []
        recent: list[float] = []
        plan, entry_level, widest = phase.adaptive, level, None
        for k in range(phase.steps):
            radius = phase.radius
            if plan:
                now = decayed(k, plan.start, plan.end, phase.steps)
                radius = now if widest is None else min(now, widest)
            if radius is None and phase.mode == "short" and distances:
                radius = max(1, round(distance / distances))
            mark = written()
            following, taken = step(state, options, side, phase, radius, number, level)
            far = F.sqrt(((F.col("y1") - F.col("y2")) * (F.col("y1") - F.col("y2")) + (F.col("x1") - F.col("x2")) * (F.col("x1") - F.col("x2"))).cast("double"))
            swaps, total = taken.agg(F.count("*"), F.coalesce(F.sum(far), F.lit(0.0))).first()
            before, state = state, following
            if phase.mode == "long":
                distance, distances = distance + total, distances + swaps
            progress.swaps.append(swaps)
            made.append((k, swaps))
            value = None
            if k % phase.energy_every == 0:
                raw = energy.local_energy(state, options.length, reach, options.similarity, level, options.eta)
                value = energy.average_energy(raw).first()[0]
                progress.energies.append(value)
                recent = [*recent, value][-options.stop_window - 1 :]
            sweep(spark, mark, keep=(state,))
            drop_stored(before)
            if log:
                write_step(spark, log, run_name, number, phase, swaps, value, radius, level)
            number += 1
            last = made[-options.stall_window :]
            if len(last) == options.stall_window and sum(n for _, n in last) <= options.stop_ratio * phase.pairs * len(last):
                break
            if plan:
                *_, (_, _, level, widest) = followed(made, plan.start, plan.end, phase.steps, plan.trigger, entry_level, plan.lambda_step)
            if len(recent) > options.stop_window and max(abs(a - b) for a, b in zip(recent, recent[1:])) < options.stop_delta:
                break
        if save:
            state.drop("number").write.mode("overwrite").parquet(save)
    return state.drop("number"), progress


def render(points: DataFrame, placement: DataFrame, height: int, width: int) -> DataFrame:
    """(y, x, r, g, b) of every cell: the rescaled hue of its point (point_id, hue), black where there is none."""
    low, high = points.agg(F.min("hue"), F.max("hue")).first()
    spark = points.sparkSession
    red, green, blue = hue_rgb(rescaled_hue(F.col("hue"), F.lit(low), F.lit(high)))
    shown = placement.select("point_id", "y", "x").join(points.select("point_id", "hue"), "point_id").select("y", "x", red.alias("r"), green.alias("g"), blue.alias("b"))
    cells = spark.range(height * width).select(F.floor(F.col("id") / width).cast("int").alias("y"), (F.col("id") % width).cast("int").alias("x"))
    black = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return cells.join(shown, ["y", "x"], "left").select("y", "x", black("r"), black("g"), black("b"))


def tile_of(value: Column, cuts: list[float]) -> Column:
    """The number of cuts at or below a value: its segment."""
    place_of = F.lit(0)
    for cut in cuts:
        place_of = place_of + F.when(value >= cut, 1).otherwise(0)
    return place_of


def tile_quotas(points_per_tile: DataFrame, total: int, tiles: int) -> DataFrame:
    """Adds quota: the total dealt evenly over the tiles, the remainder one each to the first ones."""
    share, rest = divmod(total, tiles)
    return points_per_tile.withColumn("quota", F.lit(share) + F.when(F.col("tile") < rest, 1).otherwise(0))
