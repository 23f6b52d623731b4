"""Inputs of the registered queries, made from the given tables, as DataFrames and as SQL."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codelattice.functions import bits as B
from codelattice.plans.layout import place
from codelattice.tables import stored

LENGTH = 64
SPARSE, DENSE = 0.15, 0.0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def codes(spark: SparkSession, sf_dir: str, above: float = SPARSE) -> DataFrame:
    """(point_id, label, bits): a position is active where the embedding is above a level."""
    rows = table(spark, sf_dir, "embeddings")
    bits = B.active(F.col("embedding"), lambda v: v.cast("double") > above)
    return rows.select(F.col("vec_id").alias("point_id"), "label", bits.alias("bits"))


def side_of(spark: SparkSession, sf_dir: str) -> int:
    return math.ceil(math.sqrt(table(spark, sf_dir, "embeddings").count() * 1.5))


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sparse codes on a grid: (point_id, label, bits, y, x)."""
    return stored(place(codes(spark, sf_dir), side_of(spark, sf_dir), ""), "points")


def pairs(spark: SparkSession, sf_dir: str, placed: DataFrame) -> DataFrame:
    """A pair for every point: its own cell and cell 7 * id + 13, which may be empty."""
    side = side_of(spark, sf_dir)
    cell = (F.col("point_id") * 7 + 13) % (side * side)
    a = placed.select(
        F.col("point_id").alias("seq"), F.col("y").alias("y1"), F.col("x").alias("x1"),
        F.floor(cell / side).cast("int").alias("y2"), (cell % side).cast("int").alias("x2"), F.col("point_id").alias("idx_a"),
    )
    b = placed.select(F.col("point_id").alias("idx_b"), F.col("y").alias("by"), F.col("x").alias("bx"))
    return a.where("y1 != y2 or x1 != x2").join(b, (F.col("y2") == F.col("by")) & (F.col("x2") == F.col("bx")), "left").drop("by", "bx")


def detectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A detector for every supplier: (detector_id, cy, cx, radius, lambda, bit)."""
    side = side_of(spark, sf_dir)
    key = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(
        key.alias("detector_id"), (key * 7 % side).cast("int").alias("cy"), (key * 13 % side).cast("int").alias("cx"),
        (1 + key % 6).cast("double").alias("radius"), (0.45 + 0.1 * (key % 5)).alias("lambda"), key.cast("int").alias("bit"),
    )


def measured_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(seq, image_id, label, angle, x, y): the time of day as an angle; an image is a user, its label the id's last digit."""
    seconds = F.hour("ts") * 3600 + F.minute("ts") * 60 + F.second("ts")
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("seq"), F.col("user_id").alias("image_id"), (F.col("user_id") % 10).cast("int").alias("label"),
        (seconds / 86400.0 * 360.0).alias("angle"), (F.col("event_id") % 7).cast("int").alias("x"), (F.col("user_id") % 7).cast("int").alias("y"),
    )


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(image_id, label, pixels): a pattern per vector, on a scale of 255 where the id is odd and of 1 where it is even."""
    i = F.col("vec_id")
    value = lambda p: (i * 31 + F.floor(p / 28) * F.floor(p / 28) * 7 + (p % 28) * 13 + (F.floor(p / 28) * (p % 28)) % 17 * 11) % 256
    scaled = lambda p: F.when(i % 2 == 1, value(p).cast("double")).otherwise(value(p) / 255.0)
    return table(spark, sf_dir, "embeddings").select(i.alias("image_id"), "label", F.transform(F.sequence(F.lit(0), F.lit(783)), scaled).alias("pixels"))


def step_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(run, step, energy, swaps, pairs): a user's events in order."""
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("run"), F.col("event_id").alias("step"), F.col("value").alias("energy"), F.floor("value").cast("int").alias("swaps"), F.lit(300).alias("pairs")
    )


BITS_SQL = """bits AS (
    SELECT vec_id AS point_id, label, bit::INT AS bit
    FROM embeddings, (SELECT unnest(range(64)) AS bit) WHERE embedding[bit + 1]::DOUBLE > {above}::DOUBLE
), codes AS (
    SELECT vec_id AS point_id, embeddings.label, count(bit)::INT AS ones, string_agg(bit::VARCHAR, ',' ORDER BY bit) AS bit_list
    FROM embeddings LEFT JOIN bits ON vec_id = point_id GROUP BY ALL
)"""
CODES_SQL = BITS_SQL.format(above=SPARSE)
DENSE_SQL = BITS_SQL.format(above=DENSE)

OVERLAP_SQL = """overlap AS (
    SELECT a.point_id AS i, b.point_id AS k, count(*) AS common
    FROM bits a JOIN bits b ON a.bit = b.bit GROUP BY ALL
), cosines AS (
    SELECT i, k, common / sqrt((a.ones * b.ones)::DOUBLE) AS s
    FROM overlap JOIN codes a ON i = a.point_id JOIN codes b ON k = b.point_id
)"""

POINTS_SQL = f"""{CODES_SQL}, side AS (
    SELECT ceil(sqrt(count(*) * 1.5))::INT AS side FROM embeddings
), cells AS (
    SELECT cell, row_number() OVER (ORDER BY md5(cell::VARCHAR), cell) - 1 AS n
    FROM (SELECT unnest(range(side * side)) AS cell FROM side)
), points AS (
    SELECT point_id, label, (cell // side)::INT AS y, (cell % side)::INT AS x
    FROM (SELECT vec_id AS point_id, label, row_number() OVER (ORDER BY vec_id) - 1 AS n FROM embeddings) JOIN cells USING (n), side
)"""

PAIRS_SQL = """ends AS (
    SELECT point_id AS seq, y AS y1, x AS x1, ((point_id * 7 + 13) % (side * side)) // side AS y2,
           ((point_id * 7 + 13) % (side * side)) % side AS x2, point_id AS idx_a
    FROM points, side
), pairs AS (
    SELECT ends.*, b.point_id AS idx_b FROM ends LEFT JOIN points b ON b.y = y2 AND b.x = x2 WHERE y1 <> y2 OR x1 <> x2
)"""

DETECTORS_SQL = """detectors AS (
    SELECT s_suppkey AS detector_id, s_suppkey * 7 % side AS cy, s_suppkey * 13 % side AS cx,
           (1 + s_suppkey % 6)::DOUBLE AS radius, 0.45::DOUBLE + 0.1::DOUBLE * (s_suppkey % 5) AS lambda, s_suppkey AS bit
    FROM supplier, side
)"""

EVENTS_SQL = """measured AS (
    SELECT event_id AS seq, user_id AS image_id, (user_id % 10)::INT AS label,
           (hour(ts) * 3600 + minute(ts) * 60 + second(ts)) / 86400::DOUBLE * 360::DOUBLE AS angle,
           (event_id % 7)::INT AS x, (user_id % 7)::INT AS y
    FROM events
)"""
