"""Queries over images, measurements and the encoder."""

from __future__ import annotations

from pyspark.sql import functions as F

from codelattice.operators import encoder as E
from codelattice.operators import features
from codelattice.queries.fixtures import EVENTS_SQL, images, measured_events
from codelattice.sources.images import angle_range, first_images

ANGLE = E.DEFAULT.dimensions[0]
PINWHEEL = E.Encoder((E.Dimension("Angle", 0.0, 360.0, tuple(E.Layer(n, 0.4) for n in (64, 32, 16, 8)), closed=True),))


def _text(bits):
    return F.array_join(bits, ",")


def q_normalize(spark, sf_dir):
    rows = images(spark, sf_dir).select("image_id", features.normalised(F.col("pixels")).alias("v"))
    total = F.aggregate("v", F.lit(0.0), lambda t, v: t + v)
    return rows.select("image_id", F.round(F.array_max("v"), 9).alias("peak"), F.round(total, 6).alias("total"))


def q_sobel(spark, sf_dir):
    rows = images(spark, sf_dir).select("image_id", features.normalised(F.col("pixels")).alias("pixels"))
    rows = features.patch_rows(rows)
    return rows.select("image_id", "y", "x", (F.round("gx", 6) + 0.0).alias("gx"), (F.round("gy", 6) + 0.0).alias("gy"))


def q_angle(spark, sf_dir):
    rows = features.measurements(images(spark, sf_dir), threshold=0.05)
    return rows.select("image_id", "label", "seq", "x", "y", F.round("angle", 6).alias("angle"))


def _windows(spark, number):
    rows = E.DEFAULT.detector_table(spark)
    rows = rows.where("closed" if number == 0 else "not closed")
    return rows.select("bit", "dim", "layer", F.round("center", 9).alias("center"), F.round("half_width", 9).alias("half_width"))


def q_detectors_closed(spark, sf_dir):
    return _windows(spark, 0)


def q_detectors_open(spark, sf_dir):
    return _windows(spark, 1)


def q_wrap(spark, sf_dir):
    dim = E.Dimension("d", 10.0, 100.0, (E.Layer(1, 0.0),), closed=True)
    rows = measured_events(spark, sf_dir)
    return rows.select("seq", F.round(E.wrapped(F.col("angle") - 180.0, dim), 9).alias("wrapped"))


def q_encode_closed(spark, sf_dir):
    rows = measured_events(spark, sf_dir)
    return rows.select("seq", _text(E.Encoder((ANGLE,)).encode(F.col("angle"))).alias("bits"))


def q_encode_open(spark, sf_dir):
    rows = measured_events(spark, sf_dir)
    return rows.select("seq", _text(E.Encoder(E.DEFAULT.dimensions[1:]).encode(F.col("x"), F.col("y"))).alias("bits"))


def q_encode(spark, sf_dir):
    rows = E.encode_measurements(measured_events(spark, sf_dir))
    return rows.select("seq", _text(F.col("bits")).alias("bits"), "ones")


def q_encode_random_bits(spark, sf_dir):
    """Random bit maps depend on Python's generator, so there is no SQL for them."""
    encoder = E.DEFAULT.with_random_bits(4096, seed=1)
    rows = measured_events(spark, sf_dir)
    return rows.select("seq", _text(encoder.encode(F.col("angle"), F.col("x"), F.col("y"))).alias("bits"))


def q_pinwheel(spark, sf_dir):
    return angle_range(spark).select("seq", _text(PINWHEEL.encode(F.col("angle"))).alias("bits"))


def q_codes_by_hue(spark, sf_dir):
    rows = measured_events(spark, sf_dir).withColumn("hue", F.floor(F.col("angle") * 10) / 10)
    return E.hue_groups(rows)


def q_collect_codes(spark, sf_dir):
    rows = first_images(measured_events(spark, sf_dir), label=3, count=20)
    return E.encode_measurements(rows).select("image_id", "seq", "ones")


def q_collect_samples(spark, sf_dir):
    rows = measured_events(spark, sf_dir)
    return first_images(rows, label=None, count=50, need_codes=True, codes=rows.where("x = 3")).groupBy("image_id").agg(F.count("*").alias("n"))


def q_debug_geometry(spark, sf_dir):
    """In an image of 30 x 28 whose grid is inferred from the encoder."""
    rows = measured_events(spark, sf_dir)
    rows = E.debug_geometry(rows, E.patch_grid(rows, E.inferred_grid(E.DEFAULT), (30, 28)))
    return rows.select("seq", "left", "top", "center_x", "center_y", F.round("hue", 9).alias("hue"), "r", "g", "b")


def q_debug_boxes(spark, sf_dir):
    """The boxes of the grid that the measurements span, in an image of 35 x 42."""
    return E.grid_boxes(spark, E.patch_grid(measured_events(spark, sf_dir), image=(35, 42)))


WINDOWS_SQL = """layers AS (
    SELECT dim, layer, n, 0.7::DOUBLE AS ov, CASE dim WHEN 0 THEN 360::DOUBLE ELSE 6::DOUBLE END AS period,
           sum(n) OVER (ORDER BY dim, layer) - n AS base
    FROM (VALUES (0, 0, 90), (0, 1, 45), (0, 2, 30), (0, 3, 10), (1, 0, 7), (1, 1, 6), (1, 2, 5), (1, 3, 4), (1, 4, 3), (1, 5, 2),
                 (2, 0, 7), (2, 1, 6), (2, 2, 5), (2, 3, 4), (2, 4, 3), (2, 5, 2)) t(dim, layer, n)
), sized AS (
    SELECT *, CASE dim WHEN 0 THEN least(period, period / n / (1 - ov)) ELSE period / (1 + (n - 1) * (1 - ov)) END AS width FROM layers
), windows AS (
    SELECT (base + i)::INT AS bit, dim, layer, period, width / 2 AS half_width,
           CASE dim WHEN 0 THEN (i + 0.5::DOUBLE) * (period / n) ELSE width / 2 + i * (width * (1 - ov)) END AS center
    FROM (SELECT *, unnest(range(n)) AS i FROM sized)
)"""

_HIT = "(least(abs(angle - center) % 360, 360 - abs(angle - center) % 360) <= half_width)"
_OPEN = "({v} >= center - half_width AND {v} <= center + half_width)"

PIXELS_SQL = """raw AS (
    SELECT vec_id AS image_id, label, p // 28 AS py, p % 28 AS px,
           (vec_id * 31 + (p // 28) * (p // 28) * 7 + (p % 28) * 13 + (p // 28) * (p % 28) % 17 * 11) % 256 AS v
    FROM embeddings, (SELECT unnest(range(784)) AS p)
), scaled AS (
    SELECT *, CASE WHEN image_id % 2 = 1 THEN v::DOUBLE ELSE v / 255::DOUBLE END AS s FROM raw
), pixels AS (
    SELECT image_id, label, py, px, CASE WHEN max(s) OVER (PARTITION BY image_id) > 1.5 THEN s / 255 ELSE s END AS v FROM scaled
)"""

SOBEL_SQL = f"""{PIXELS_SQL}, kernel AS (
    SELECT oy + wy AS ky, ox + wx AS kx, sum(gx) / 4 AS wgx, sum(gy) / 4 AS wgy
    FROM (VALUES (0, 0, -1, 1), (0, 1, 0, 2), (0, 2, 1, 1), (1, 0, -2, 0), (1, 1, 0, 0), (1, 2, 2, 0), (2, 0, -1, -1), (2, 1, 0, -2), (2, 2, 1, -1)) k(wy, wx, gx, gy),
         (VALUES (0), (1)) a(oy), (VALUES (0), (1)) b(ox) GROUP BY ALL
), patches AS (
    SELECT image_id, label, (py // 4)::INT AS y, (px // 4)::INT AS x, sum(v * wgx) AS gx, sum(v * wgy) AS gy
    FROM pixels JOIN kernel ON py % 4 = ky AND px % 4 = kx GROUP BY ALL
)"""

ORACLE = {
    "q_normalize": f"WITH {PIXELS_SQL} SELECT image_id, round(max(v), 9) AS peak, round(sum(v), 6) AS total FROM pixels GROUP BY image_id",
    "q_sobel": f"WITH {SOBEL_SQL} SELECT image_id, y, x, round(gx, 6) + 0.0 AS gx, round(gy, 6) + 0.0 AS gy FROM patches",
    "q_angle": f"""WITH {SOBEL_SQL} SELECT image_id, label, (y * 7 + x)::INT AS seq, x, y, round(degrees(atan2(gy + 0.0, gx)), 6) AS angle
        FROM patches WHERE sqrt(gx * gx + gy * gy) > 0.05""",
    "q_detectors_closed": f"WITH {WINDOWS_SQL} SELECT bit, dim, layer, round(center, 9) AS center, round(half_width, 9) AS half_width FROM windows WHERE dim = 0",
    "q_detectors_open": f"WITH {WINDOWS_SQL} SELECT bit, dim, layer, round(center, 9) AS center, round(half_width, 9) AS half_width FROM windows WHERE dim > 0",
    "q_wrap": f"WITH {EVENTS_SQL} SELECT seq, round(((angle - 180 - 10) % 90 + 90) % 90 + 10, 9) AS wrapped FROM measured",
    "q_encode_closed": f"""WITH {EVENTS_SQL}, {WINDOWS_SQL} SELECT seq, string_agg(bit::VARCHAR, ',' ORDER BY bit) AS bits
        FROM measured JOIN windows ON dim = 0 AND {_HIT} GROUP BY seq""",
    "q_encode_open": f"""WITH {EVENTS_SQL}, {WINDOWS_SQL} SELECT seq, string_agg((bit - 175)::VARCHAR, ',' ORDER BY bit) AS bits
        FROM measured JOIN windows ON (dim = 1 AND {_OPEN.format(v="x")}) OR (dim = 2 AND {_OPEN.format(v="y")}) GROUP BY seq""",
    "q_encode": f"""WITH {EVENTS_SQL}, {WINDOWS_SQL} SELECT seq, string_agg(bit::VARCHAR, ',' ORDER BY bit) AS bits, count(*)::INT AS ones
        FROM measured JOIN windows ON (dim = 0 AND {_HIT}) OR (dim = 1 AND {_OPEN.format(v="x")}) OR (dim = 2 AND {_OPEN.format(v="y")}) GROUP BY seq""",
    "q_pinwheel": """WITH layers AS (SELECT layer, n, sum(n) OVER (ORDER BY layer) - n AS base FROM (VALUES (0, 64), (1, 32), (2, 16), (3, 8)) t(layer, n)),
        windows AS (SELECT (base + i)::INT AS bit, (i + 0.5::DOUBLE) * (360::DOUBLE / n) AS center, least(360::DOUBLE, 360::DOUBLE / n / (1 - 0.4::DOUBLE)) / 2 AS half_width
            FROM (SELECT *, unnest(range(n)) AS i FROM layers)), angles AS (SELECT unnest(range(360)) AS angle)
        SELECT angle AS seq, string_agg(bit::VARCHAR, ',' ORDER BY bit) AS bits FROM angles JOIN windows
          ON least(abs(angle - center) % 360, 360 - abs(angle - center) % 360) <= half_width GROUP BY angle""",
    "q_codes_by_hue": f"WITH {EVENTS_SQL} SELECT floor(angle * 10) / 10 AS hue, min(seq) AS first_seq, count(*) AS n FROM measured GROUP BY 1",
    "q_collect_codes": f"""WITH {EVENTS_SQL}, {WINDOWS_SQL}, chosen AS (SELECT DISTINCT image_id FROM measured WHERE label = 3 ORDER BY image_id LIMIT 20)
        SELECT image_id, seq, count(*)::INT AS ones FROM (SELECT * FROM measured SEMI JOIN chosen USING (image_id)) JOIN windows
          ON (dim = 0 AND {_HIT}) OR (dim = 1 AND {_OPEN.format(v="x")}) OR (dim = 2 AND {_OPEN.format(v="y")}) GROUP BY ALL""",
    "q_collect_samples": f"""WITH {EVENTS_SQL}, chosen AS (SELECT DISTINCT image_id FROM measured WHERE x = 3 ORDER BY image_id LIMIT 50)
        SELECT image_id, count(*) AS n FROM measured SEMI JOIN chosen USING (image_id) GROUP BY image_id""",
    "q_debug_geometry": f"""WITH {EVENTS_SQL}, h AS (SELECT *, angle % 360 AS h, floor(angle % 360 / 360 * 6)::INT AS k, angle % 360 / 360 * 6 - floor(angle % 360 / 360 * 6) AS f FROM measured)
        SELECT seq, x * 4::DOUBLE AS left, y * 4::DOUBLE + 1 AS top, (x + 0.5::DOUBLE) * 4 AS center_x, (y + 0.5::DOUBLE) * 4 + 1 AS center_y, round(h, 9) AS hue,
            floor(255 * CASE k WHEN 0 THEN 1 WHEN 1 THEN 1 - f WHEN 2 THEN 0 WHEN 3 THEN 0 WHEN 4 THEN f ELSE 1 END)::INT AS r,
            floor(255 * CASE k WHEN 0 THEN f WHEN 1 THEN 1 WHEN 2 THEN 1 WHEN 3 THEN 1 - f ELSE 0 END)::INT AS g,
            floor(255 * CASE k WHEN 0 THEN 0 WHEN 1 THEN 0 WHEN 2 THEN f WHEN 3 THEN 1 WHEN 4 THEN 1 ELSE 1 - f END)::INT AS b FROM h""",
    "q_debug_boxes": f"""WITH {EVENTS_SQL}, size AS (SELECT max(x) + 1 AS across, max(y) + 1 AS down, least(42 / (max(x) + 1)::DOUBLE, 35 / (max(y) + 1)::DOUBLE) AS edge FROM measured)
        SELECT y::INT AS y, x::INT AS x, x * edge + (42 - across * edge) / 2 AS left, y * edge + (35 - down * edge) / 2 AS top, edge
        FROM size, (SELECT unnest(range(100)) AS x), (SELECT unnest(range(100)) AS y) WHERE x < across AND y < down""",
}

QUERIES = {name: f for name, f in globals().items() if name.startswith("q_")}
