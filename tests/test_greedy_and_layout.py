"""Greedy rounds against sequential loops, and what must hold after a layout run."""

import random

from pyspark.sql import functions as F

from codelattice import tables
from codelattice.operators import activation as A
from codelattice.operators import monitors as M
from codelattice.operators import pairs as joins
from codelattice.operators.greedy import accept_swaps, spread_out
from codelattice.plans import layout as L
from codelattice.plans import sampling
from codelattice.queries.layouts import _levels, q_apply_swaps, q_embedding_codes
from codelattice.queries.fixtures import pairs, points


def test_swaps_as_in_sequence(spark, sf_dir):
    placed = points(spark, sf_dir)
    wanted = sorted(pairs(spark, sf_dir, placed).select("seq", "y1", "x1", "y2", "x2").collect())
    used, expected = set(), []
    for seq, y1, x1, y2, x2 in wanted:
        if (y1, x1) not in used and (y2, x2) not in used:
            used |= {(y1, x1), (y2, x2)}
            expected.append(seq)
    assert sorted(r.seq for r in q_apply_swaps(spark, sf_dir).collect()) == expected


def test_spacing_as_in_sequence(spark):
    draw = random.Random(2)
    rows = [(i, draw.randrange(20), draw.randrange(20)) for i in range(80)]
    taken = []
    for _, y, x in rows:
        if all((y - b) ** 2 + (x - a) ** 2 >= 9 for b, a in taken):
            taken.append((y, x))
    found = spread_out(spark.createDataFrame(rows, "rank long, y int, x int"), 3.0).collect()
    assert [(r.y, r.x) for r in sorted(found)] == taken
    assert spread_out(spark.createDataFrame([], "rank long, y int, x int"), 3.0).count() == 0
    assert accept_swaps(spark.createDataFrame([], "seq long, y1 int, x1 int, y2 int, x2 int")).count() == 0


def test_detectors_as_in_sequence(spark):
    draw = random.Random(5)
    cells = draw.sample(range(400), 250)
    rows = [(i, c // 20, c % 20, draw.choice((0.0, 0.2, 0.5, draw.random()))) for i, c in enumerate(cells)]
    placed = spark.createDataFrame([r[:3] for r in rows], "point_id long, y int, x int")
    energies = spark.createDataFrame([(r[0], r[3]) for r in rows], "point_id long, energy double")
    found = sorted(A.build_detectors(placed, energies, (0.5, 0.7), max_detectors=12, density=3).collect())
    order, taken = sorted(rows, key=lambda r: (-r[3], r[0])), []
    step = max(1, len(rows) // (6 * 3))
    for _, y, x, _ in order[::step]:
        if any((y - d[0]) ** 2 + (x - d[1]) ** 2 < 4.8**2 for d in taken):
            continue
        best = (6, [])
        for r in range(1, 7):
            near = [e for _, b, a, e in rows if (y - b) ** 2 + (x - a) ** 2 <= r * r]
            if len(near) > len(best[1]):
                best = (r, near)
            if len(near) >= 28:
                break
        if sum(best[1]) > 0:
            taken.append((y, x, float(best[0]), len(best[1])))
    assert [(d.cy, d.cx, d.radius, d.points_count) for d in found] == taken[:12]
    assert [d.bit for d in found] == list(range(len(found))) and {d["lambda"] for d in found[:6]} == {0.5}


def test_whole_codes_merge_as_in_sequence(spark, sf_dir):
    levels, circles = _levels(spark, sf_dir)
    detectors = {r.detector_id: r for r in circles.collect()}
    by_image = {}
    for r in levels.collect():
        by_image.setdefault(r.image_id, []).append((-round(r.level, 6) * detectors[r.detector_id]["lambda"], r.detector_id))
    expected = {}
    for image, ranked in by_image.items():
        have = set()
        for _, d in sorted(ranked):
            both = have | {detectors[d].bit * k % 97 for k in (1, 3, 7)}
            have = both if len(both) <= 20 else have
        expected[image] = ",".join(map(str, sorted(have)))
    assert {r.image_id: r.bits for r in q_embedding_codes(spark, sf_dir).collect()} == expected


def test_layout_run_keeps_every_point_on_its_own_cell(spark):
    draw = random.Random(1)
    codes = spark.createDataFrame([(i, sorted(draw.sample(range(32), 6))) for i in range(60)], "point_id long, bits array<int>")
    options = L.Options(32, level=0.3, empty_ratio=0.5, stop_ratio=-1.0)
    short = L.Phase("short", 1, 60, adaptive=L.Adaptive(3), cutoff=0.1, weighted=True, tiles=4)
    state, progress = L.run(codes, options, [L.Phase("long", 2, 60), short])
    rows = state.collect()
    side = L.grid_side(60, 0.5)
    assert sorted(r.point_id for r in rows) == list(range(60))
    assert len({(r.y, r.x) for r in rows}) == 60 and all(0 <= r.y < side and 0 <= r.x < side for r in rows)
    assert len(progress.swaps) == len(progress.energies) == 3 and sum(progress.swaps) > 0


def test_radius_follows_the_swaps():
    def after(*swaps):
        return [(r, level, most) for r, _, level, most in M.followed(enumerate(swaps), 9, 1, 5, 0.1, 0.5, 0.05)]

    assert [r for r, _, _ in after(100, 100, 100, 100, 100)] == [9, 7, 5, 3, 1]
    assert after(100, 10, 10) == [(9, 0.5, 9), (7, 0.55, 3), (3, 0.55, 3)]
    assert [r for r, *_ in M.followed([(0, 5)], 9, 2, 1, 0.1, 0.5, None)] == [2]


def test_a_run_stores_its_state_only_and_logs_every_step(spark, tmp_path):
    draw = random.Random(1)
    codes = spark.createDataFrame([(i, sorted(draw.sample(range(32), 6))) for i in range(60)], "point_id long, bits array<int>")
    options = L.Options(32, level=0.3, empty_ratio=0.5, stop_ratio=-1.0, subset=20)
    log, save = str(tmp_path / "steps"), str(tmp_path / "points")
    before = tables.written()
    state, progress = L.run(codes, options, [L.Phase("long", 2, 40), L.Phase("short", 1, 40, adaptive=L.Adaptive(3))], log=log, save=save)
    assert tables.written() == before + 1
    steps = spark.read.parquet(log).orderBy("step").collect()
    assert [(r.step, r.swaps, r.mode) for r in steps] == list(zip(range(3), progress.swaps, ["long", "long", "short"]))
    assert [r.energy for r in steps] == progress.energies
    saved = spark.read.parquet(save)
    rows = lambda df: sorted((r.point_id, r.y, r.x) for r in df.collect())
    assert rows(saved) == rows(state) and "number" not in saved.columns
    idle = L.Options(32, level=0.3, empty_ratio=0.5, stop_ratio=1.0, stall_window=2)
    again, progress = L.run(saved, idle, [L.Phase("long", 5, 1)], L.grid_side(60, 0.5), resume=True)
    assert len(progress.swaps) == 2 and sum(a != b for a, b in zip(rows(again), rows(saved))) <= 4


def test_draws_are_even_and_stay_within_disc_and_bounds(spark):
    places = spark.range(20_000).select("id", F.lit(1).alias("y"), F.lit(8).alias("x"))
    found = places.select(sampling.near_cell(F.col("y"), F.col("x"), 2, 0, 8, 0, 8, 7, F.col("id")).alias("c")).groupBy("c").count().collect()
    cells = {(y, x) for y in range(9) for x in range(9) if 0 < (y - 1) ** 2 + (x - 8) ** 2 <= 4}
    assert {(r.c.y, r.c.x) for r in found} == cells and max(r["count"] for r in found) < 1.2 * min(r["count"] for r in found)
    alone = places.limit(50).select(sampling.near_cell(F.col("y"), F.col("x"), 0.5, 1, 2, 8, 9, 7, F.col("id")).alias("c")).collect()
    assert {(r.c.y, r.c.x) for r in alone} == {(1, 9), (2, 8), (2, 9)}
    assert places.limit(1).select(sampling.near_cell(F.col("y"), F.col("x"), 3, 1, 1, 8, 8, 7, F.col("id")).alias("c")).first().c is None
    state = spark.createDataFrame([(0, 2, 2), (1, 3, 3)], "number long, y int, x int")
    ends = sampling.random_pairs(state, 500, 5, None, 3).collect()
    assert len(ends) == 500 and {(r.y1, r.x1) for r in ends} == {(2, 2), (3, 3)} and all((r.y1, r.x1) != (r.y2, r.x2) for r in ends)
    assert len({(r.y2, r.x2) for r in ends}) == 25


def test_dense_codes_meet_in_blocks_as_over_the_index(spark):
    draw = random.Random(2)
    frame = spark.createDataFrame([(i, sorted(draw.sample(range(130), draw.choice([0, 40, 70])))) for i in range(90)], "point_id long, bits array<int>")
    many, length = joins.meetings(frame, frame)
    assert many > joins.MEETINGS_PER_COMPARISON * 90 * 90 and 128 < length <= 130
    bits = {r.point_id: set(r.bits) for r in frame.collect()}
    expected = {(i, k, len(bits[i] & bits[k])) for i in bits for k in bits if i != k and bits[i] & bits[k]}
    assert {(r.i, r.k, r.common) for r in joins.overlaps(frame, frame, rows_per_block=16).collect()} == expected
    assert {(r.i, r.k) for r in joins.overlaps(frame, frame, ordered=True).collect()} == {(i, k) for i, k, _ in expected if i < k}
