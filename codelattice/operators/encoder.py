"""Overlapping detector windows over closed and open dimensions, and the codes that values get from them.

A value's active windows are found by arithmetic: the few window numbers near the value are
listed per layer and the exact inclusive test is applied to these, so encoding is a projection.
"""

from __future__ import annotations

import random
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codelattice.functions.display import hue_rgb


@dataclass(frozen=True)
class Layer:
    """So many windows that overlap by a share of their width."""

    count: int
    overlap: float

    def __post_init__(self):
        if self.count <= 0 or not 0 <= self.overlap <= 1:
            raise ValueError("a layer has a positive count and an overlap from 0 to 1")


@dataclass(frozen=True)
class Dimension:
    """A value range, closed (a circle) or open (an interval), and its layers."""

    title: str
    low: float
    high: float
    layers: tuple[Layer, ...]
    closed: bool = False

    def __post_init__(self):
        if self.high <= self.low or not self.layers:
            raise ValueError("a dimension has a range and at least one layer")

    @property
    def period(self) -> float:
        return self.high - self.low


def placing(dim: Dimension, layer: Layer) -> tuple[float, float]:
    """(step, width) of a layer's windows."""
    if dim.closed:
        step = dim.period / layer.count
        return step, dim.period if layer.overlap >= 1 else min(dim.period, step / (1 - layer.overlap))
    if layer.count == 1:
        return 0.0, dim.period
    width = dim.period / (1 + (layer.count - 1) * (1 - layer.overlap))
    return width * (1 - layer.overlap), width


def center_of(dim: Dimension, layer: Layer, number):
    """The center of a window, of a number or a column of numbers."""
    step, width = placing(dim, layer)
    return dim.low + (number + 0.5) * step if dim.closed else dim.low + width / 2 + number * step


@dataclass(frozen=True)
class Encoder:
    """Dimensions whose windows are numbered by dimension, layer and place; a window's bit is its number unless mapped."""

    dimensions: tuple[Dimension, ...]
    bit_map: tuple[int, ...] | None = None
    length: int | None = None

    @property
    def windows(self) -> int:
        return sum(layer.count for dim in self.dimensions for layer in dim.layers)

    @property
    def code_length(self) -> int:
        return self.length or self.windows

    def with_random_bits(self, length: int, seed: int) -> Encoder:
        """Each window gets one of length bits at random, with repeats: windows that share a bit are or-ed."""
        draw = random.Random(seed)
        return Encoder(self.dimensions, tuple(draw.randrange(length) for _ in range(self.windows)), length)

    def detector_table(self, spark: SparkSession) -> DataFrame:
        """One row per window: bit, dim, layer, place, center, half_width, closed, lo, hi, period."""
        rows, number = [], 0
        for d, dim in enumerate(self.dimensions):
            for k, layer in enumerate(dim.layers):
                half = placing(dim, layer)[1] / 2
                for i in range(layer.count):
                    rows.append((number, d, k, i, center_of(dim, layer, i), half, dim.closed, dim.low, dim.high, dim.period))
                    number += 1
        return spark.createDataFrame(
            rows, "bit int, dim int, layer int, place int, center double, half_width double, closed boolean, lo double, hi double, period double"
        )

    def encode(self, *values: Column) -> Column:
        """Sorted active bits of one value per dimension; too few or too many values are an error."""
        if len(values) != len(self.dimensions):
            raise ValueError("one value per dimension")
        parts, number = [], 0
        for dim, value in zip(self.dimensions, values):
            held = wrapped(value, dim)
            for layer in dim.layers:
                parts.append(_shifted(active_windows(held, dim, layer), number))
                number += layer.count
        bits = F.concat(*parts)
        if self.bit_map is not None:
            table = F.array(*[F.lit(b) for b in self.bit_map])
            bits = F.array_distinct(F.transform(bits, lambda b: F.get(table, b)))
        return F.array_sort(bits)


def _shifted(numbers: Column, by: int) -> Column:
    return F.transform(numbers, lambda i: (i + by).cast("int"))


def wrapped(value: Column, dim: Dimension) -> Column:
    """A closed dimension's value brought into its period; an open one's outside its range is an error."""
    value = value.cast("double")
    if dim.closed:
        return F.pmod(value - dim.low, F.lit(dim.period)) + dim.low
    message = F.concat(F.lit(f"{dim.title} is outside its range: "), value.cast("string"))
    return F.when(value.between(dim.low, dim.high), value).when(value.isNull(), value).otherwise(F.raise_error(message).cast("double"))


def active_windows(value: Column, dim: Dimension, layer: Layer) -> Column:
    """Numbers of the layer's windows that hold the value, both ends included."""
    step, width = placing(dim, layer)
    half, first = width / 2, center_of(dim, layer, 0)
    every = F.sequence(F.lit(0), F.lit(layer.count - 1))
    if dim.closed and half >= dim.period / 2:
        return F.when(value.isNotNull(), every)
    if step == 0:
        near = every
    else:
        low = F.ceil((value - half - first) / step) - 1
        high = F.floor((value + half - first) / step) + 1
        near = F.sequence(low, high)
        if dim.closed:
            near = F.transform(near, lambda i: F.pmod(i, F.lit(layer.count)))
            if width / step + 4 > layer.count:  # as many numbers as windows: some may repeat
                near = F.array_distinct(near)
        else:
            near = F.sequence(F.greatest(F.lit(0).cast("bigint"), low), F.least(F.lit(layer.count - 1).cast("bigint"), high))

    def holds(i):
        center = center_of(dim, layer, i)
        if not dim.closed:
            return (value >= center - half) & (value <= center + half)
        apart = F.pmod(F.abs(value - center), F.lit(dim.period))
        return F.least(apart, dim.period - apart) <= half

    return F.filter(near, holds)


#: The default encoder, 229 windows.
DEFAULT = Encoder(
    (
        Dimension("Angle", 0.0, 360.0, tuple(Layer(n, 0.7) for n in (90, 45, 30, 10)), closed=True),
        Dimension("X", 0.0, 6.0, tuple(Layer(n, 0.7) for n in (7, 6, 5, 4, 3, 2))),
        Dimension("Y", 0.0, 6.0, tuple(Layer(n, 0.7) for n in (7, 6, 5, 4, 3, 2))),
    )
)


def encode_measurements(rows: DataFrame, encoder: Encoder = DEFAULT) -> DataFrame:
    """Adds bits and ones to rows of (angle, x, y)."""
    return rows.withColumn("bits", encoder.encode(F.col("angle"), F.col("x"), F.col("y"))).withColumn("ones", F.size("bits"))


def hue_groups(codes: DataFrame, order: str = "seq", hue: str = "hue") -> DataFrame:
    """(hue, first_seq, n): the groups of equal hue with the place of their first code, which orders the groups."""
    return codes.groupBy(hue).agg(F.min(order).alias("first_seq"), F.count("*").alias("n"))


@dataclass(frozen=True)
class PatchGrid:
    """Square patches of a grid that is centered in its image."""

    across: int
    down: int
    edge: float
    left: float = 0.0
    top: float = 0.0


def inferred_grid(encoder: Encoder) -> tuple[int, int] | None:
    """(across, down) from the ranges of the dimensions named x and y in any case; None without both or with an empty range."""
    sizes = {d.title.lower(): round(d.high) - round(d.low) + 1 for d in encoder.dimensions}
    across, down = sizes.get("x", 0), sizes.get("y", 0)
    return (across, down) if across > 0 and down > 0 else None


def patch_grid(rows: DataFrame, grid: tuple[int, int] | None = None, image: tuple[int, int] | None = None) -> PatchGrid:
    """The grid of patches at (x, y): of the given size, or up to the largest x and y of the rows.

    image: (height, width); the patches fill its shorter side.  Without an image a patch is one unit wide.
    """
    if grid is None:
        most = rows.agg(F.max(F.col("x").cast("int")), F.max(F.col("y").cast("int"))).first()
        grid = tuple(0 if m is None else m + 1 for m in most)
    across, down = grid
    if image is None or min(*image, across, down) <= 0:
        return PatchGrid(across, down, 1.0)
    edge = min(image[1] / across, image[0] / down)
    return PatchGrid(across, down, edge, (image[1] - across * edge) / 2, (image[0] - down * edge) / 2)


def debug_geometry(rows: DataFrame, grid: PatchGrid) -> DataFrame:
    """Where a measurement's patch lies, for display: its corner, its center, its hue in [0, 360) and the hue's colour."""
    left, top = F.col("x") * grid.edge + grid.left, F.col("y") * grid.edge + grid.top
    hue = F.pmod(F.col("angle"), F.lit(360.0))
    r, g, b = hue_rgb(hue)
    return rows.select(
        "*", left.alias("left"), top.alias("top"), (left + grid.edge / 2).alias("center_x"), (top + grid.edge / 2).alias("center_y"),
        hue.alias("hue"), r.alias("r"), g.alias("g"), b.alias("b"),
    )


def grid_boxes(spark: SparkSession, grid: PatchGrid) -> DataFrame:
    """(y, x, left, top, edge) of every patch of a grid, for the overlay's boxes."""
    number = F.col("id")
    rows = spark.range(grid.across * grid.down).select(F.floor(number / grid.across).cast("int").alias("y"), (number % grid.across).cast("int").alias("x"))
    return rows.select("y", "x", (F.col("x") * grid.edge + grid.left).alias("left"), (F.col("y") * grid.edge + grid.top).alias("top"), F.lit(grid.edge).alias("edge"))
