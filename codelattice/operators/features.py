"""Gradient angles of 28 x 28 images, without a shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SIDE, PATCH = 28, 4
PATCHES = SIDE // PATCH
#: The Sobel kernels.
KX = ((-1, 0, 1), (-2, 0, 2), (-1, 0, 1))
KY = ((1, 2, 1), (0, 0, 0), (-1, -2, -1))


def mean_kernel(kernel) -> list[list[float]]:
    """The mean of a 3 x 3 kernel over the four places it fits in a 4 x 4 patch, as one 4 x 4 kernel."""
    steps = range(PATCH - len(kernel) + 1)
    out = [[0.0] * PATCH for _ in range(PATCH)]
    for top in steps:
        for left in steps:
            for y, row in enumerate(kernel):
                for x, weight in enumerate(row):
                    out[top + y][left + x] += weight / len(steps) ** 2
    return out


def normalised(pixels: Column) -> Column:
    """Pixels on a scale of 0 to 1: divided by 255 where the brightest is above 1.5.  Other sizes are an error."""
    sized = F.when(F.size(pixels) == SIDE * SIDE, pixels).otherwise(
        F.raise_error(F.lit(f"an image has {SIDE} x {SIDE} pixels")).cast("array<double>")
    )
    # the test stands outside the lambda, so it is made once an image
    return F.when(F.array_max(sized) > 1.5, F.transform(sized, lambda v: v / 255.0)).otherwise(sized)


def patch_rows(images: DataFrame, pixels: str = "pixels") -> DataFrame:
    """A row per image and patch with seq, y, x, gx and gy in place of the pixels: the patches in rows.

    The pixels are read in generated code from the one array of the image; nothing is shuffled.
    """
    others = [c for c in images.columns if c != pixels]
    rows = images.select(*others, pixels, F.explode(F.sequence(F.lit(0), F.lit(PATCHES**2 - 1))).alias("seq"))
    y, x = F.floor(F.col("seq") / PATCHES).cast("int"), F.col("seq") % PATCHES

    def total(kernel):
        out = None
        for dy, row in enumerate(kernel):
            for dx, weight in enumerate(row):
                if weight:
                    term = F.get(F.col(pixels), (y * PATCH + dy) * SIDE + (x * PATCH + dx)) * weight
                    out = term if out is None else out + term
        return out

    return rows.select(*others, "seq", y.alias("y"), x.alias("x"), total(mean_kernel(KX)).alias("gx"), total(mean_kernel(KY)).alias("gy"))


def measurements(images: DataFrame, threshold: float = 1e-3, degrees: bool = True, prepared: bool = False) -> DataFrame:
    """(image_id, label, seq, angle, x, y) of the patches whose mean gradient is stronger than the threshold."""
    ready = images if prepared else images.withColumn("pixels", normalised(F.col("pixels")))
    rows = patch_rows(ready.select("image_id", "label", "pixels"))
    gx, gy = F.col("gx"), F.col("gy") + F.lit(0.0)
    angle = F.atan2(gy, gx)
    strong = rows.where(F.sqrt(gx * gx + gy * gy) > threshold)
    return strong.select("image_id", "label", "seq", (F.degrees(angle) if degrees else angle).alias("angle"), "x", "y")
