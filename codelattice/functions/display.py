"""How labels, hues and activation values are shown."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CIRCLE = 360.0


def label_text(value: Column) -> Column:
    """Numbers within 1e-6 of a whole one as that, others with three decimals."""
    whole = F.bround(value, 0)
    return F.when(F.abs(value - whole) < 1e-6, whole.cast("long").cast("string")).otherwise(F.format_string("%.3f", value))


def short_number(value: Column, digits: int = 6) -> Column:
    """A number to so many significant digits, as the step log shows it; 0 and null as they are."""
    places = digits - 1 - F.floor(F.log10(F.abs(F.nullif(value, F.lit(0.0)))))
    scale = F.pow(F.lit(10.0), places)
    return F.coalesce(F.round(value * scale) / scale, value)


def label_from_name(name: Column) -> Column:
    """The first run of digits in a file name's stem, 0 if there is none or it is no int."""
    stem = F.regexp_replace(F.regexp_extract(name, r"[^/]*$", 0), r"(?<=.)\.[^.]*$", "")
    return F.coalesce(F.nullif(F.regexp_extract(stem, r"(\d+)", 1), F.lit("")).try_cast("int"), F.lit(0))


def rescaled_hue(hue: Column, low: Column, high: Column) -> Column:
    """Hues stretched over the circle between the table's least and greatest; 0 if these are equal."""
    scaled = (hue - low) * (CIRCLE / F.nullif(high - low, F.lit(0.0)))
    return F.when(high == low, 0.0).otherwise(F.when(scaled >= CIRCLE, CIRCLE - 1e-9).otherwise(scaled))


def hue_rgb(hue: Column) -> list[Column]:
    """Red, green and blue, 0 to 255 and truncated, of a fully saturated hue in degrees."""
    h = F.pmod(hue, F.lit(CIRCLE)) / CIRCLE * 6.0
    sector = F.floor(h)
    rising, falling = h - sector, 1.0 - (h - sector)
    #: by sector: red, green, blue
    table = [
        (F.lit(1.0), rising, F.lit(0.0)), (falling, F.lit(1.0), F.lit(0.0)), (F.lit(0.0), F.lit(1.0), rising),
        (F.lit(0.0), falling, F.lit(1.0)), (rising, F.lit(0.0), F.lit(1.0)), (F.lit(1.0), F.lit(0.0), falling),
    ]
    out = []
    for channel in range(3):
        value = F.lit(0.0)
        for number, row in enumerate(table):
            value = F.when(sector == number, row[channel]).otherwise(value)
        out.append(F.floor(value * 255).cast("int"))
    return out


def value_alpha(value: Column) -> Column:
    """Opacity 0 to 255, truncated, of a value held between 0 and 1; the colour is red."""
    return F.floor(F.greatest(F.lit(0.0), F.least(F.lit(1.0), value)) * 255).cast("int")
