"""Layout documents: JSON in the exchange format, Parquet in between."""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codelattice.functions import bits as B
from codelattice.sources.png import encode_rgb

ENTRY = "struct<index:bigint,y:int,x:int,label:string,value:string,hue:double,ones:int>"
#: The exchange format; unknown keys are carried along by write_json.
DOCUMENT = (
    "width int, height int, points bigint, similarity string, lambda_threshold double, eta double, pair_radius int, "
    f"layout array<{ENTRY}>, embeddings array<struct<class:string,label:string,embedding:string>>"
)


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """One row per document with its path; documents that cannot be read have nulls."""
    return spark.read.schema(DOCUMENT).option("multiLine", True).json(path).withColumn("path", F.input_file_name())


def readiness(documents: DataFrame) -> DataFrame:
    """(path, points, pair_radius, ready): ready if sized and every entry has a position."""
    placed = F.forall("layout", lambda e: e["y"].isNotNull() & e["x"].isNotNull())
    ready = (F.col("width") > 0) & (F.col("height") > 0) & (F.size("layout") > 0) & placed
    return documents.select("path", F.coalesce("points", F.size("layout").cast("long")).alias("points"), "pair_radius", F.coalesce(ready, F.lit(False)).alias("ready"))


def newest(spark: SparkSession, folder: str, points: int) -> DataFrame:
    """(path, modificationTime) of a point count's layout files, the newest first."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", f"layout-{points}-*.json").load(folder)
    return files.select("path", "modificationTime").orderBy(F.desc("modificationTime"), "path")


def in_first_place(rows: DataFrame, key: str = "path", place: str = "place") -> DataFrame:
    """(key, place): every value once, at the first of its places; null and empty values are left out."""
    return rows.where(F.col(key) != "").groupBy(key).agg(F.min(place).alias(place))


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is a file or folder of that name."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def usable(spark: SparkSession, folder: str, points: int, path: str | None = None) -> str | None:
    """The first document that is ready: the one asked for, then those of the folder with that many points, the newest first."""
    found = [row["path"] for row in newest(spark, folder, points).collect()]  # file names of one folder
    ranked = spark.createDataFrame([(p, n) for n, p in enumerate([path if path and exists(spark, path) else None, *found])], "path string, place int")
    for row in in_first_place(ranked).orderBy("place").collect():
        if readiness(read_json(spark, row["path"])).where("ready").limit(1).count():
            return row["path"]
    return None


def points_of(documents: DataFrame, pair_radius: int | None = None) -> DataFrame:
    """(path, point_id, y, x, label, hue, ones, bits); incomplete documents and other radii are errors."""
    rows = documents.select("path", "pair_radius", "width", "height", F.explode("layout").alias("e"))
    bad = F.col("e.y").isNull() | F.col("e.x").isNull() | F.coalesce(F.col("width") <= 0, F.lit(True)) | F.coalesce(F.col("height") <= 0, F.lit(True))
    if pair_radius is not None:
        bad = bad | ~F.col("pair_radius").eqNullSafe(F.lit(pair_radius))
    value = F.when(bad, F.raise_error(F.lit("the layout is incomplete or of another radius")).cast("string")).otherwise(F.col("e.value"))
    return rows.select(
        "path", F.col("e.index").alias("point_id"), F.col("e.y").alias("y"), F.col("e.x").alias("x"), F.col("e.label").alias("label"),
        F.col("e.hue").alias("hue"), F.col("e.ones").alias("ones"), B.parse01(value).alias("bits"),
    )


def labelled_embeddings(records: DataFrame) -> DataFrame:
    """(label, bits, ones) of rows (class, label, embedding): the class or else the label; rows without either or without a code are left out."""
    rows = records.select(F.coalesce("class", "label").try_cast("int").alias("label"), "embedding").dropna()
    bits = B.parse01(F.col("embedding"))
    return rows.select("label", bits.alias("bits"), F.size(bits).alias("ones"))


def merged_payload(points: DataFrame, base: DataFrame) -> DataFrame:
    """Entries of the layout with what the base has for their index: the base's label, value, hue and ones win where present.

    points: (index, y, x, label, value, hue, ones), base: the same without y and x.
    """
    fields = ("label", "value", "hue", "ones")
    held = base.select(F.col("index").alias("b_index"), *[F.col(c).alias(f"b_{c}") for c in fields])
    rows = points.join(held, F.col("index") == F.col("b_index"), "left")
    return rows.select("index", "y", "x", *[F.coalesce(f"b_{c}", c).alias(c) for c in fields])


def write_table(entries: DataFrame, path: str) -> None:
    """Entries as a Parquet table."""
    entries.write.mode("overwrite").parquet(path)


def write_png(rendered: DataFrame, path: str, height: int, width: int) -> None:
    """A rendered grid (y, x, r, g, b) as a PNG file, written by the driver: one pixel per cell of one layout."""
    pixels = np.zeros((height, width, 3), np.uint8)
    for row in rendered.toLocalIterator():
        pixels[row["y"], row["x"]] = row["r"], row["g"], row["b"]
    with open(path, "wb") as file:
        file.write(encode_rgb(pixels))


def write_json(entries: DataFrame, path: str, head: dict, embeddings: DataFrame | None = None, existing: dict | None = None) -> None:
    """A layout document for exchange, written by the driver: a document is one layout of a few thousand points.

    existing: a document whose other top-level keys are kept.
    """
    rows = [r.asDict() for r in entries.orderBy("index").toLocalIterator()]
    document = dict(existing or {}) | head | {"points": len(rows), "layout": rows}
    if embeddings is not None:
        document["embeddings"] = [{"class": str(r["label"]), "embedding": r["embedding"]} for r in embeddings.toLocalIterator()]
    with open(path, "w", encoding="utf-8") as file:
        json.dump(document, file, ensure_ascii=False)
