"""Readers and writers of images and layout documents, and the watched step log."""

import json
import struct
import zipfile
import zlib

import numpy as np

from codelattice.functions import bits as B
from codelattice.sources import images, layouts
from codelattice.sources.png import PASSES, SIGNATURE, decode_grey, encode_rgb, resized
from codelattice.streaming import telemetry
from pyspark.sql import functions as F


def grey_png(values):
    return encode_rgb(np.repeat(np.asarray(values)[:, :, None], 3, axis=2))


def test_png_round_trip():
    values = np.arange(784).reshape(28, 28) % 256
    assert (decode_grey(grey_png(values)) == values).all()
    assert resized(values, 14).shape == (14, 14)


def test_png_folder_and_zip(spark, tmp_path):
    small, large = np.full((28, 28), 255), np.zeros((56, 56))
    (tmp_path / "p").mkdir()
    (tmp_path / "p" / "b_7.png").write_bytes(grey_png(small))
    (tmp_path / "p" / "a_12.png").write_bytes(grey_png(large))
    rows = images.read_pngs(spark, str(tmp_path / "p")).orderBy("image_id").collect()
    assert [(r.image_id, r.label) for r in rows] == [(0, 12), (1, 7)]
    assert rows[1].pixels == [1.0] * 784 and rows[0].pixels == [0.0] * 784
    with zipfile.ZipFile(tmp_path / "s.zip", "w") as archive:
        archive.writestr("x_3.png", grey_png(small))
        archive.writestr("readme.txt", "no image")
    assert [(r.name, r.label) for r in images.read_zip(spark, str(tmp_path / "s.zip")).collect()] == [("x_3.png", 3)]


def test_rendered_grid_as_png(spark, tmp_path):
    cells = spark.createDataFrame([(0, 0, 255, 255, 255), (1, 1, 0, 0, 0)], "y int, x int, r int, g int, b int")
    layouts.write_png(cells, str(tmp_path / "g.png"), 2, 2)
    assert decode_grey((tmp_path / "g.png").read_bytes()).tolist() == [[255, 0], [0, 0]]


def test_layout_document_round_trip(spark, tmp_path):
    entries = spark.createDataFrame([(0, 1, 2, "a", "0110", 5.0, 2), (1, 0, 0, "b", "1000", 6.0, 1)], "index long, y int, x int, label string, value string, hue double, ones int")
    path = str(tmp_path / "layout-2-6.json")
    layouts.write_json(entries, path, {"width": 3, "height": 3, "pair_radius": 6}, existing={"note": "kept"})
    assert json.load(open(path))["note"] == "kept"
    document = layouts.read_json(spark, path)
    assert layouts.readiness(document).first()[1:] == (2, 6, True)
    points = layouts.points_of(document, 6).orderBy("point_id").collect()
    assert [(p.point_id, p.y, p.x, p.bits) for p in points] == [(0, 1, 2, [1, 2]), (1, 0, 0, [0])]
    assert layouts.newest(spark, str(tmp_path), 2).count() == 1


def test_labelled_embeddings_leave_out_what_is_incomplete(spark):
    rows = spark.createDataFrame([("3", None, "01"), (None, "4", "11"), (None, None, "11"), ("5", None, None)], "class string, label string, embedding string")
    assert sorted((r.label, r.bits) for r in layouts.labelled_embeddings(rows).collect()) == [(3, [1]), (4, [0, 1])]


def test_bits_of_any_values(spark):
    row = spark.range(1).select(B.active(F.array(F.lit(1), F.lit(0), F.lit(None), F.lit(3)))).first()
    assert row[0] == [0, 3]


def test_watched_log_asks_for_a_stop_once(spark, tmp_path):
    folder, seen = str(tmp_path / "log"), []
    rows = lambda run, steps, swaps, energy: [(run, s, swaps(s), 100, energy(s), "long", 3.0, 0.5) for s in steps]
    calm = rows("calm", range(8), lambda s: 50, lambda s: 1.0 if s >= 2 else 2.0 + s)
    idle = rows("idle", range(8), lambda s: 0 if s == 6 else 40, lambda s: None if s % 2 else float(s))
    write = lambda r: spark.createDataFrame(r, telemetry.STEP_LOG).coalesce(1).write.mode("append").parquet(folder)
    write(calm[:4] + idle[:4])
    query = telemetry.watch(telemetry.read_step_log(spark, folder), str(tmp_path / "c"), lambda df: seen.extend(df.collect()), window=3)
    query.processAllAvailable()
    write(calm[4:] + idle[4:])
    query.processAllAvailable()
    query.stop()
    found = sorted((r.run, r.step, r.why) for r in seen)
    assert found == [("calm", 5, "energy"), ("calm", 6, "energy"), ("calm", 7, "energy"), ("idle", 6, "swaps")]
    whole = telemetry.stops_of(spark.read.parquet(folder), window=3).collect()
    assert sorted((r.run, r.step, r.why) for r in whole) == found


def _png(width, height, depth, colour, interlaced, raw, palette=b""):
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    head = struct.pack(">IIBBBBB", width, height, depth, colour, 0, 0, interlaced)
    return SIGNATURE + chunk(b"IHDR", head) + (chunk(b"PLTE", palette) if palette else b"") + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def test_png_of_other_depths():
    assert decode_grey(_png(3, 2, 1, 0, 0, bytes([0, 0b10100000, 0, 0b01000000]))).tolist() == [[255, 0, 255], [0, 255, 0]]
    assert decode_grey(_png(3, 1, 4, 0, 0, bytes([0, 0x0F, 0x30]))).tolist() == [[0, 255, 51]]
    assert decode_grey(_png(2, 1, 16, 0, 0, bytes([1, 0x12, 0x34, 0x10, 0x00]))).tolist() == [[0x12, 0x22]]
    assert decode_grey(_png(2, 1, 2, 3, 0, bytes([0, 0b01100000]), bytes([0, 0, 0, 9, 9, 9, 200, 200, 200]))).tolist() == [[9, 200]]


def test_interlaced_png():
    values = np.arange(77).reshape(11, 7) * 3
    raw = b"".join(bytes([0, *row]) for y, x, dy, dx in PASSES for row in values[y::dy, x::dx].tolist() if row)
    assert (decode_grey(_png(7, 11, 8, 0, 1, raw)) == values).all()


def test_png_as_it_is(spark, tmp_path):
    (tmp_path / "a.png").write_bytes(grey_png(np.array([[0, 255, 51]])))
    row = images.read_pngs_as_they_are(spark, str(tmp_path)).first()
    assert (row.height, row.width, row.pixels) == (1, 3, [0.0, 1.0, 0.2])


def test_first_usable_document(spark, tmp_path):
    entries = spark.createDataFrame([(0, 1, 2, "a", "01", 5.0, 1)], "index long, y int, x int, label string, value string, hue double, ones int")
    bad, good = str(tmp_path / "layout-1-a.json"), str(tmp_path / "layout-1-b.json")
    layouts.write_json(entries, bad, {"width": 0, "height": 3})
    layouts.write_json(entries, good, {"width": 3, "height": 3})
    assert layouts.usable(spark, str(tmp_path), 1, bad).endswith("layout-1-b.json")
    assert layouts.usable(spark, str(tmp_path), 1, str(tmp_path / "none.json")).endswith("layout-1-b.json")
    assert layouts.usable(spark, str(tmp_path), 2, bad) is None and layouts.usable(spark, str(tmp_path), 2, good) == good
