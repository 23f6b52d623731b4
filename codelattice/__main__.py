"""Commands: layout builds a layout and its embeddings, predict classifies images, evaluate measures accuracy,
export writes a layout and its embeddings as a JSON document, import reads the points of such a document.

Images are a Parquet table (image_id, label, pixels), a folder of PNG files, or a ZIP of them.
"""

from __future__ import annotations

import argparse
import json
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codelattice.functions import bits as B
from codelattice.plans import layout as L
from codelattice.plans import recognition as R
from codelattice.sources import images as I
from codelattice.sources import layouts as S
from codelattice.tables import stored


def _images(spark: SparkSession, path: str) -> DataFrame:
    if path.endswith(".zip"):
        return I.read_zip(spark, path)
    return I.read_table(spark, path) if path.endswith(".parquet") else I.read_pngs(spark, path)


def build(spark: SparkSession, source: str, folder: str, count: int, samples: int, label: int | None = None, phases: list[L.Phase] | None = None, resume: bool = False) -> None:
    """Lay out the codes of the first count images and store points, sample embeddings and the log of steps in the folder.

    With resume the layout goes on from the points that the folder holds.
    """
    images = _images(spark, source)
    if resume:
        points = stored(spark.read.parquet(f"{folder}/points"), "points")
        side = max(points.agg(F.greatest(F.max("y"), F.max("x"))).first()[0] + 1, L.grid_side(points.count(), 0.5))
    else:
        points, side = R.layout_points(R.encode_images(I.first_images(images, label, count))), None
    options = L.Options(R.DEFAULT.code_length, eta=0.0, empty_ratio=0.5)
    L.run(points, options, phases or R.tuned_phases(points), side, resume, log=f"{folder}/steps", save=f"{folder}/points")
    recogniser = R.Recogniser.over(spark.read.parquet(f"{folder}/points"))
    every = R.encode_images(images)
    chosen = I.first_images(images, None, samples, need_codes=True, codes=every)
    embedded = recogniser.embed(every.join(chosen.select("image_id"), "image_id", "left_semi"), chosen)
    embedded.write.mode("overwrite").parquet(f"{folder}/embeddings")


def predict(spark: SparkSession, source: str, folder: str, temperature: float) -> tuple[DataFrame, DataFrame]:
    """Predictions for all images of the source, and their embeddings with labels."""
    images = _images(spark, source)
    recogniser = R.Recogniser.over(spark.read.parquet(f"{folder}/points"))
    queries = recogniser.embed(R.encode_images(images), images).withColumnRenamed("image_id", "query_id")
    memory = spark.read.parquet(f"{folder}/embeddings").withColumnRenamed("image_id", "memory_id")
    return R.classify(queries, memory, temperature), queries


def export(spark: SparkSession, folder: str, document: str, length: int = R.DEFAULT.code_length) -> None:
    """Write the folder's layout and embeddings to a JSON document.

    Of a document that is there already the other top-level keys stay, and its entries' label, value, hue and ones win.
    """
    existing = {}
    if os.path.exists(document):
        with open(document, encoding="utf-8") as file:
            existing = json.load(file)
    rows = spark.read.parquet(f"{folder}/points")
    height, width = rows.agg(F.max("y") + 1, F.max("x") + 1).first()
    entries = rows.select(F.col("point_id").alias("index"), "y", "x", "label", B.to01(F.col("bits"), length).alias("value"), "hue", "ones")
    if existing.get("layout"):
        held = S.read_json(spark, document).select(F.explode("layout").alias("e")).select("e.*")
        entries = S.merged_payload(entries, held)
    embedded = spark.read.parquet(f"{folder}/embeddings").select("label", B.to01(F.col("bits"), length).alias("embedding"))
    side = max(height, width)
    S.write_json(entries, document, {"width": max(side, existing.get("width") or 0), "height": max(side, existing.get("height") or 0)}, embedded, existing)


def import_points(spark: SparkSession, document: str, folder: str, pair_radius: int | None = None) -> None:
    """Store the points of a JSON document in the folder, from which layout --resume goes on."""
    points = S.points_of(S.read_json(spark, document), pair_radius)
    S.write_table(points.drop("path"), f"{folder}/points")


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="codelattice", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    for name in ("layout", "predict", "evaluate"):
        command = commands.add_parser(name)
        command.add_argument("images")
        command.add_argument("folder", help="where the layout and its embeddings are stored")
        if name == "layout":
            command.add_argument("--count", type=int, default=64)
            command.add_argument("--samples", type=int, default=64)
            command.add_argument("--label", type=int)
            command.add_argument("--resume", action="store_true", help="go on from the layout in the folder")
        else:
            command.add_argument("--temperature", type=float, default=0.35)
    for name in ("export", "import"):
        command = commands.add_parser(name)
        command.add_argument("folder")
        command.add_argument("document", help="a JSON file")
    asked = parser.parse_args(argv)
    spark = SparkSession.builder.appName("codelattice").getOrCreate()
    if asked.command in ("export", "import"):
        export(spark, asked.folder, asked.document) if asked.command == "export" else import_points(spark, asked.document, asked.folder)
        return
    if asked.command == "layout":
        build(spark, asked.images, asked.folder, asked.count, asked.samples, asked.label, resume=asked.resume)
        return
    found, queries = predict(spark, asked.images, asked.folder, asked.temperature)
    if asked.command == "predict":
        found.select("query_id", "predicted_class", F.round("confidence", 4).alias("confidence")).orderBy("query_id").show(1000, False)
    else:
        print(f"accuracy={R.evaluate(found, queries):.4f}")


if __name__ == "__main__":
    main()
