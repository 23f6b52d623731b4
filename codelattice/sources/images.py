"""Images as rows (image_id, label, pixels): from PNG files, ZIP archives of them, tables, and generated angles."""

from __future__ import annotations

import io
import zipfile

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codelattice.functions.display import label_from_name
from codelattice.operators.features import SIDE
from codelattice.sources.png import decode_grey, resized
from codelattice.tables import ordered_index

FIELDS = "name string, pixels array<double>"


def _decoded(name: str, data: bytes, resize: bool) -> tuple[str, list[float]]:
    grey = decode_grey(data)
    if not resize and grey.shape != (SIDE, SIDE):
        raise ValueError(f"{name} is not {SIDE} x {SIDE}")
    values = resized(grey, SIDE)
    return name, ((values / 255.0) if values.max() > 1.5 else values).ravel().tolist()


def _numbered(rows: DataFrame) -> DataFrame:
    indexed = ordered_index(rows.withColumn("label", label_from_name(F.col("name"))), [F.col("name").asc()], "image_id")
    return indexed.select("image_id", "name", "label", "pixels")


def read_pngs(spark: SparkSession, path: str, resize: bool = True) -> DataFrame:
    """(image_id, name, label, pixels 0 to 1) of PNG files, in order of their names; labels come from the names."""

    def decode(batches):
        for pdf in batches:
            yield pd.DataFrame([_decoded(n, d, resize) for n, d in zip(pdf["path"], pdf["content"])], columns=["name", "pixels"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.png").load(path)
    return _numbered(files.select("path", "content").mapInPandas(decode, FIELDS))


def read_pngs_as_they_are(spark: SparkSession, path: str) -> DataFrame:
    """(name, height, width, pixels 0 to 1) of PNG files of any size, neither resized nor checked."""

    def decode(batches):
        for pdf in batches:
            greys = [decode_grey(data) for data in pdf["content"]]
            yield pd.DataFrame(
                {
                    "name": pdf["path"], "height": [g.shape[0] for g in greys], "width": [g.shape[1] for g in greys],
                    "pixels": [(g / 255.0 if g.max() > 1.5 else g.astype(float)).ravel().tolist() for g in greys],
                }
            )

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.png").load(path)
    return files.select("path", "content").mapInPandas(decode, "name string, height int, width int, pixels array<double>")


def read_zip(spark: SparkSession, path: str) -> DataFrame:
    """The same for the .png members of ZIP archives, which must be 28 x 28; other members are left out."""

    def decode(batches):
        for pdf in batches:
            for data in pdf["content"]:
                with zipfile.ZipFile(io.BytesIO(data)) as archive:
                    members = [n for n in archive.namelist() if n.lower().endswith(".png")]
                    yield pd.DataFrame([_decoded(n, archive.read(n), False) for n in members], columns=["name", "pixels"])

    files = spark.read.format("binaryFile").load(path)
    return _numbered(files.select("content").mapInPandas(decode, FIELDS))


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """(image_id, label, pixels) of a Parquet table of labelled images."""
    return spark.read.parquet(path).select(F.col("image_id").cast("long"), F.col("label").cast("int"), F.col("pixels").cast("array<double>"))


def angle_range(spark: SparkSession, count: int = 360) -> DataFrame:
    """(seq, angle): the whole angles from 0, an input without images."""
    return spark.range(count).select(F.col("id").alias("seq"), F.col("id").cast("double").alias("angle"))


def first_images(rows: DataFrame, label: int | None, count: int, need_codes: bool = False, codes: DataFrame | None = None) -> DataFrame:
    """The rows of the first count images by image_id, of a label if one is given.

    With need_codes only images that have a row in codes are counted.
    """
    images = rows if label is None else rows.where(F.col("label") == label)
    images = images.select("image_id").distinct()
    if need_codes:
        images = images.join(codes.select("image_id").distinct(), "image_id", "left_semi")
    chosen = images.orderBy("image_id").limit(count)
    return rows.join(F.broadcast(chosen) if count <= 50_000 else chosen, "image_id", "left_semi")
