"""Comparisons of all pairs of codes must not shuffle a row per pair: disk would grow with the square of the codes."""

import pytest
from pyspark.sql import functions as F

from codelattice.operators import activation as A
from codelattice.operators.activation import detector_levels, matrix
from codelattice.operators.pairs import overlaps, similarity_pairs
from codelattice.queries import codes as C
from codelattice.queries import layouts as Q
from codelattice.queries.fixtures import DENSE, codes


def shuffled_rows(spark, run):
    """Rows that all stages of a run wrote to shuffles."""
    jvm, gateway = spark._jvm, spark.sparkContext._gateway

    def stages():
        spark._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        found = spark._jsc.sc().statusStore().stageList(None, False, False, gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
        return {(found.apply(i).stageId(), found.apply(i).attemptId()): found.apply(i).shuffleWriteRecords() for i in range(found.size())}

    before, setting = stages(), "spark.sql.autoBroadcastJoinThreshold"
    spark.conf.set(setting, "-1")  # tables of any size: none is small enough to be sent to every task
    try:
        run().write.format("noop").mode("overwrite").save()
    finally:
        spark.conf.unset(setting)
    return sum(n for key, n in stages().items() if key not in before)


def assert_no_row_per_pair(spark, query, sf_dir="/root/testdata/sf0.01"):
    n = codes(spark, sf_dir).count()
    assert 0 < shuffled_rows(spark, lambda: query(spark, sf_dir)) < n * n / 4


def test_embedding_codes(spark):
    assert_no_row_per_pair(spark, Q.q_embedding_codes)


def test_sim_all_pairs(spark):
    assert_no_row_per_pair(spark, C.q_sim_all_pairs)


def test_looked_up_similarities_are_those_of_the_formula(spark):
    """Also beyond the sizes of which a table is made, and for codes without any bit."""
    many = spark.createDataFrame([(i, list(range(i % 2, 700 + i))) for i in range(12)] + [(12, [])], "point_id long, bits array<int>")
    few = spark.createDataFrame([(i, list(range(i % 3, 2 + i))) for i in range(12)] + [(12, [])], "point_id long, bits array<int>")
    for frame in (many, few):
        held = {r.point_id: set(r.bits) for r in frame.collect()}
        expected = {(i, j): round(len(a & b) / (len(a) * len(b)) ** 0.5, 9) for i, a in held.items() for j, b in held.items() if i < j and a & b}
        assert {(r.i, r.j): r.sim for r in similarity_pairs(frame, "cosine", 9).collect()} == expected


def test_activation(spark):
    assert_no_row_per_pair(spark, Q.q_activation)


def test_pair_energy_long_dense(spark):
    assert_no_row_per_pair(spark, Q.q_pair_energy_long_dense)


def test_packed_codes_do_not_pass_the_driver(spark):
    rows = codes(spark, "/root/testdata/sf0.01", DENSE)
    plan = overlaps(rows, rows)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "Broadcast" not in plan


def test_detector_level(spark):
    assert_no_row_per_pair(spark, Q.q_detector_level)


def test_matrix(spark):
    assert_no_row_per_pair(spark, Q.q_matrix)


def test_pair_stats(spark):
    assert_no_row_per_pair(spark, Q.q_pair_stats)


def test_swap_decision(spark):
    assert_no_row_per_pair(spark, Q.q_swap_decision)


def test_pair_energy_long(spark):
    assert_no_row_per_pair(spark, Q.q_pair_energy_long)


def test_embedding(spark):
    assert_no_row_per_pair(spark, Q.q_embedding)


def test_detectors_of_the_same_points_share_their_sums(spark):
    """A row per image, point and detector would grow with the detectors that share a circle."""
    points, images, copies = range(40), range(30), 50
    energy = {p: (p + 1) / 40 for p in points}
    activation = spark.createDataFrame([(i, p, 0.5 + (i + p) % 5 / 10) for i in images for p in points if (i + p) % 3], "image_id long, point_id long, value double")
    circle = {d: [p for p in points if p % 4 == d % 4] for d in range(4 * copies)}
    own = {d: sum(energy[p] for p in circle[d]) * (1 + d % 3) if d % 11 else 0.0 for d in circle}
    frames = (
        spark.createDataFrame(list(energy.items()), "point_id long, energy double"),
        spark.createDataFrame(list(own.items()), "detector_id long, energy double"),
        spark.createDataFrame([(d, p) for d, held in circle.items() for p in held], "detector_id long, point_id long"),
    )
    expected, values = {}, {(r.image_id, r.point_id): r.value for r in activation.collect()}
    for i in images:
        for d, held in circle.items():
            used = [p for p in held if energy[p] >= 0.3 and (i, p) in values]
            level = sum(values[i, p] * energy[p] for p in used) / own[d] if own[d] > 0 else 0.0
            if level >= 0.25:
                expected[i, d] = (round(level, 9), len(used))
    run = lambda: detector_levels(activation, *frames, 0.3, 0.25)
    found = run().collect()
    assert len(found) == len(expected) and {(r.image_id, r.detector_id): (round(r.level, 9), r.points_used) for r in found} == expected
    products = sum((i, p) in values for i in images for d in circle for p in circle[d] if energy[p] >= 0.3)
    assert shuffled_rows(spark, run) < products / 4


def test_embedding_with_many_suppliers(spark, tmp_path):
    """Suppliers repeat circles: what is shuffled grows with the suppliers, not with their points in all images."""
    source = "/root/testdata/sf0.01"
    spark.read.parquet(f"{source}/embeddings.parquet").write.parquet(f"{tmp_path}/embeddings.parquet")
    suppliers = spark.read.parquet(f"{source}/supplier.parquet")
    many = suppliers.crossJoin(spark.range(60)).withColumn("s_suppkey", suppliers.s_suppkey + F.col("id") * suppliers.count()).drop("id")
    many.write.parquet(f"{tmp_path}/supplier.parquet")
    # a supplier's cells and points are some 80 rows; its points in each image are not among them
    assert 0 < shuffled_rows(spark, lambda: Q.q_embedding(spark, str(tmp_path))) < 90 * many.count()


def test_empty_matrix_rows_are_not_shuffled(spark):
    """Each image has as many rows as the grid, most of them without a point."""
    images, height, width = 40, 50, 6
    values = {(i, p): 0.1 * (p + 1) for i in range(images) for p in range(8) if (i + p) % 3 == 0} | {(images, 8): 0.5}
    places = {p: (p * 7 % height, p % width) for p in range(8)} | {8: (height, 0)}
    activation = spark.createDataFrame([(i, p, v) for (i, p), v in values.items()], "image_id long, point_id long, value double")
    placement = spark.createDataFrame([(p, y, x) for p, (y, x) in places.items()], "point_id long, y int, x int")
    expected = {(i, y): [0.0] * width for i in range(images + 1) for y in range(height)}
    for (i, p), v in values.items():
        if places[p][0] < height:
            expected[i, places[p][0]][places[p][1]] = v
    run = lambda: matrix(activation, placement, height, width)
    found = run().collect()
    assert len(found) == len(expected) and {(r.image_id, r.y): r["values"] for r in found} == expected
    assert shuffled_rows(spark, run) < images * height / 2


def copies(spark, folder, vectors, suppliers, source="/root/testdata/sf0.01"):
    """Tables in a folder, each repeated so many times with shifted keys; returns their rows."""
    counts = []
    for name, key, times in (("embeddings", "vec_id", vectors), ("supplier", "s_suppkey", suppliers)):
        rows = spark.read.parquet(f"{source}/{name}.parquet")
        many = rows.crossJoin(spark.range(times)).withColumn(key, rows[key] + F.col("id") * rows.count()).drop("id")
        many.write.parquet(f"{folder}/{name}.parquet")
        counts.append(many.count())
    return counts


def test_embedding_shuffles_an_activation_once(spark, tmp_path):
    """Disk would grow with the activations of all points, with their sums and with the detectors that these reach."""
    vectors, _ = copies(spark, tmp_path, 10, 1)
    activated = Q.q_activation(spark, str(tmp_path)).count()
    # besides: some rows per vector and cell of the grid
    assert 0 < shuffled_rows(spark, lambda: Q.q_embedding(spark, str(tmp_path))) < activated + 15 * vectors


def test_embedding_shuffles_no_row_per_supplier_and_point(spark, tmp_path):
    _, suppliers = copies(spark, tmp_path, 1, 60)
    assert 0 < shuffled_rows(spark, lambda: Q.q_embedding(spark, str(tmp_path))) < 10 * suppliers


def test_embedding_compares_equal_codes_as_one(spark, tmp_path):
    """Copies of a point would each be shuffled with every image that activates them."""
    vectors, _ = copies(spark, tmp_path, 30, 1)
    assert 0 < shuffled_rows(spark, lambda: Q.q_embedding(spark, str(tmp_path))) < 15 * vectors


@pytest.mark.parametrize("looked_up_in", ["broadcast", "shuffle"])
def test_activated_levels_are_those_of_the_activation(spark, monkeypatch, looked_up_in):
    """Over an inverted index and over blocks, with codes that an image or several points have twice and empty ones."""
    if looked_up_in == "shuffle":
        monkeypatch.setattr(A, "small", lambda df: df)
    energy = {p: (p * 7 % 20 + 1) / 20 for p in range(60)}
    covered = spark.createDataFrame([(d, p) for d in range(25) for p in energy if (p * p + d) % 9 < 2 and p < 55], "detector_id long, point_id long")
    own = spark.createDataFrame([(d, 0.0 if d == 3 else 1.0 + d % 4) for d in range(25)], "detector_id long, energy double")
    wide = lambda i: sorted({i % 7, i * 3 % 11, i * 5 % 13, 20 + i % 3})
    narrow = lambda i: [100 + i % 47, 200 + i % 59]
    for code in (wide, narrow):
        points = spark.createDataFrame([(p, energy[p], code(p) if p % 10 else []) for p in energy], "point_id long, energy double, bits array<int>")
        stimuli = spark.createDataFrame([(s // 5, s, code(s * s // 5) if s % 12 else []) for s in range(90)], "image_id long, stim long, bits array<int>")
        rows = lambda df: sorted((r.image_id, r.detector_id, round(r.level, 9), r.points_used) for r in df.collect())
        for eta in (None, 10.0):
            activation = A.activate(stimuli, points, "cosine", 0.45, eta)
            expected = rows(detector_levels(activation, points, own, covered, 0.3, 0.21))
            assert expected and rows(A.activated_levels(stimuli, points, own, covered, "cosine", 0.45, eta, 0.3, 0.21)) == expected


def test_shared_circles_merge_as_single_detectors(spark):
    """Few and many detectors a circle; lambdas that are equal, nearly equal and not above 0."""
    lambdas = (0.45, 0.55, 0.65, 0.65 * (1 + 2**-52), 0.65 * (1 - 2**-52), 0.85, 0.0, -0.5)
    held = [(d, d % 13, d % 4, float(1 + d % 2), lambdas[d * d % 31 % 8], d) for d in range(400)] + [(400, 99, 0, 1.0, 0.55, 400)]
    detectors = spark.createDataFrame(held, "detector_id long, cy int, cx int, radius double, lambda double, bit int")
    own = {}
    for d, *circle, _, _ in held:
        own.setdefault(tuple(circle), []).append(d)
    level = lambda i, ids: round(0.1 + (i * 17 + ids[0] * 29) % 23 / 37, 6)
    reached = [(i, ids) for i in range(40) for ids in own.values() if (i + ids[0]) % 3]
    each = spark.createDataFrame([(i, d, level(i, ids)) for i, ids in reached for d in ids], "image_id long, detector_id long, level double")
    shared = spark.createDataFrame([(i, ids[0], level(i, ids)) for i, ids in reached], "image_id long, detector_id long, level double")
    for saturation in (1, 3, 8, 200, 1000):
        expected = {r.image_id: r.bits for r in A.embed_single_bits(each, detectors, saturation).collect()}
        found = A.embed_shared_bits(shared, A.shared_circles(detectors, saturation), saturation).collect()
        assert len(found) == len(expected) == 40 and {r.image_id: r.bits for r in found} == expected
