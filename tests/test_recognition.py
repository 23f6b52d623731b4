"""Bars in two directions, from pixels to predictions."""

import json

from codelattice import __main__ as commands
from codelattice.plans import layout as L
from codelattice.plans import recognition as R


def bars(label, shift):
    across = [[1.0 if (x if label else y) % 14 in (shift, shift + 1, shift + 2) else 0.0 for x in range(28)] for y in range(28)]
    return [v for row in across for v in row]


def test_images_to_predictions(spark, tmp_path):
    rows = [(i, i % 2, bars(i % 2, i // 2)) for i in range(10)] + [(10, 1, [0.0] * 784)]
    path = str(tmp_path / "images.parquet")
    spark.createDataFrame(rows, "image_id long, label int, pixels array<double>").write.parquet(path)
    folder = str(tmp_path / "layout")
    commands.build(spark, path, folder, count=8, samples=8, phases=[L.Phase("long", 1, 300)])
    embedded = spark.read.parquet(f"{folder}/embeddings").collect()
    assert len(embedded) == 8 and all(0 < r.ones <= R.SATURATION for r in embedded)
    document = tmp_path / "out.json"
    document.write_text(json.dumps({"note": "kept"}))
    commands.export(spark, folder, str(document))
    commands.import_points(spark, str(document), str(tmp_path / "again"))
    content = json.loads(document.read_text())
    assert content["note"] == "kept" and len(content["embeddings"]) == 8
    fields = ("point_id", "y", "x", "label", "ones", "bits")
    same = [spark.read.parquet(f"{f}/points").select(*fields).orderBy("point_id").collect() for f in (folder, str(tmp_path / "again"))]
    assert same[0] == same[1]
    commands.export(spark, folder, str(document))
    assert json.loads(document.read_text())["layout"] == content["layout"]
    found, queries = commands.predict(spark, path, folder, 0.35)
    by = {r.query_id: r for r in found.collect()}
    assert len(by) == 11 and by[10].confidence == 0.1 and by[10].predicted_class == 0
    # so small a layout has too few detectors to tell the bars apart: only the form of the answer is checked
    assert all(abs(sum(r.probabilities) - 1) < 1e-6 and r.confidence == max(r.probabilities) for r in by.values())
    assert 0 <= R.evaluate(found, queries) <= 1


def test_embeddings_are_told_apart(spark):
    memory = spark.createDataFrame([(i, i % 3, [i % 3 * 10 + k for k in range(6)] + [100 + i]) for i in range(12)], "memory_id long, label int, bits array<int>")
    queries = spark.createDataFrame([(0, 0, [0, 1, 2]), (1, 1, [10, 11]), (2, 2, [20, 25, 103]), (3, 0, [])], "query_id long, label int, bits array<int>")
    found = {r.query_id: r for r in R.classify(queries, memory).collect()}
    assert [found[i].predicted_class for i in range(3)] == [0, 1, 2] and found[0].confidence == 1.0
    assert found[3].predicted_class == 0 and found[3].confidence == 0.1
    assert R.evaluate(R.classify(queries, memory), queries) == 1.0
