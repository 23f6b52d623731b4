"""Values worked out by hand from the definitions."""

import math

import pytest
from pyspark.sql import functions as F

from codelattice.functions import bits as B
from codelattice.functions import display
from codelattice.functions.similarity import similarity, thresholded
from codelattice.operators import encoder as E
from codelattice.operators import energy as N
from codelattice.operators import features
from codelattice.operators import monitors as M
from codelattice.operators.decode import predictions, soft_vote
from codelattice.plans.tuner import tuned


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def ints(*values):
    return F.array(*[F.lit(v) for v in values]).cast("array<int>")


@pytest.mark.parametrize("rows, expected", [(False, (4.0, 0.0)), (True, (0.0, -4.0))])
def test_sobel_of_half_bright_patch(spark, rows, expected):
    pixels = [0.0] * 784
    for y in range(4):
        for x in range(4):
            pixels[y * 28 + x] = 1.0 if (y if rows else x) >= 2 else 0.0
    found = features.patch_rows(spark.createDataFrame([(pixels,)], "pixels array<double>")).where("seq = 0").first()
    assert (found["gx"], found["gy"]) == expected


def test_image_of_another_size_is_an_error(spark):
    with pytest.raises(Exception, match="pixels"):
        one(spark, features.normalised(F.array(F.lit(1.0))))


def test_wrap_and_windows(spark):
    circle = E.Dimension("a", 0.0, 360.0, (E.Layer(4, 0.0),), closed=True)
    line2, line3 = (E.Dimension("b", 0.0, 6.0, (E.Layer(n, o),)) for n, o in ((2, 0.0), (3, 0.5)))
    assert one(spark, E.wrapped(F.lit(-10.0), circle))[0] == 350
    assert one(spark, E.Encoder((circle,)).encode(F.lit(90.0)))[0] == [0, 1]
    assert one(spark, E.Encoder((circle,)).encode(F.lit(0.0)))[0] == [0, 3]
    assert one(spark, E.Encoder((line2,)).encode(F.lit(3.0)))[0] == [0, 1]
    assert one(spark, E.Encoder((line3,)).encode(F.lit(6.0)))[0] == [2]
    zero = one(spark, E.DEFAULT.encode(F.lit(0.0), F.lit(0), F.lit(0)))[0]
    assert E.DEFAULT.code_length == 229 and len(zero) == 28
    with pytest.raises(Exception, match="outside"):
        one(spark, E.Encoder((line2,)).encode(F.lit(7.0)))
    with pytest.raises(ValueError):
        E.DEFAULT.encode(F.lit(1.0))


def test_random_bits_stay_in_range(spark):
    found = one(spark, E.DEFAULT.with_random_bits(64, 3).encode(F.lit(10.0), F.lit(1), F.lit(2)))[0]
    assert found == sorted(set(found)) and all(0 <= b < 64 for b in found)


def test_similarity(spark):
    a, b = B.pack(ints(0, 1, 2), 70), B.pack(ints(1, 2, 3), 70)
    both = B.common(a, b)
    got = one(spark, both, *[similarity(n, both, F.lit(3), F.lit(3)) for n in ("cosine", "jaccard", "jaccard2", "cosine2")])
    assert list(got) == pytest.approx([2, 2 / 3, 0.5, 0.25, 4 / 9])
    assert one(spark, B.popcount(B.pack(ints(0, 63, 64), 70)))[0] == 3
    with pytest.raises(Exception, match="length"):
        one(spark, B.common(a, B.pack(ints(1), 64)))


def test_threshold(spark):
    s = F.lit(2 / 3)
    got = one(spark, thresholded(s, 0.65, None), thresholded(s, 0.7, None), thresholded(s, 0.65, 0.0), thresholded(F.lit(0.0), 0.1, 10.0))
    assert list(got) == pytest.approx([2 / 3, 0, 1 / 3, 0])


def test_pair_energies(spark):
    # a(0,0), b(0,2), k(1,0); a shares half of its bits with k, b a quarter
    points = spark.createDataFrame([(1, 0, 0, [0, 1, 2, 3]), (2, 0, 2, [2, 4, 5, 6]), (3, 1, 0, [0, 1, 4, 7])], "point_id long, y int, x int, bits array<int>")
    pairs = spark.createDataFrame([(0, 0, 0, 0, 2, 1, 2)], "seq long, y1 int, x1 int, y2 int, x2 int, idx_a long, idx_b long")
    long = N.pair_energy_long(pairs, points, points, "cosine", 0.0, None).first()
    assert (long.energy_c, long.energy_s) == pytest.approx((1.75, 2.75))
    short = N.pair_energy_short(pairs, points, 8, 2, "cosine", 0.0, None).first()
    assert (short.energy_c, short.energy_s) == pytest.approx((0.55, 0.35), abs=1e-4)


def test_soft_vote(spark):
    rows = spark.createDataFrame([(1, 3, 0.5), (1, 3, 0.5), (1, 7, 0.3)], "query_id long, label int, sim double")
    queries = spark.createDataFrame([(1,), (2,)], "query_id long")
    found = {r.query_id: r for r in predictions(queries, soft_vote(rows), list(range(10))).collect()}
    assert found[1].predicted_class == 3
    assert found[1].probabilities[3] == pytest.approx(0.77981, abs=1e-5) and found[1].probabilities[7] == pytest.approx(0.22019, abs=1e-5)
    assert found[2].predicted_class == 0 and found[2].probabilities == [0.1] * 10


def test_swap_stall(spark):
    log = spark.createDataFrame([(1, i, s, 10) for i, s in enumerate((5, 3, 1))], "run int, step int, swaps int, pairs int")
    assert [r.stop for r in M.swap_stall(log, 2, 0.25).orderBy("step").collect()] == [False, False, True]


def test_tuner(spark):
    got = one(spark, *[c.alias(n) for n, c in tuned(F.lit(10_000)).items()]).asDict()
    assert [got[k] for k in ("long_pairs", "long_steps", "long_subset", "long_refresh", "short_pairs", "short_steps", "local_radius", "energy_radius", "recalc_every", "pair_radius")] == [4000, 400, 800, 22, 2000, 196, 6, 4, 32, 6]


def test_display(spark):
    assert one(spark, display.label_text(F.lit(3.0)), display.label_text(F.lit(0.25)))[:] == ("3", "0.250")
    assert list(one(spark, *[display.short_number(F.lit(v)) for v in (123456.789, 0.000123456789, 0.0)])) == [123457.0, 0.000123457, 0.0]
    names = ("a/img_012x7.png", "none.png", "99999999999.png")
    assert list(one(spark, *[display.label_from_name(F.lit(n)) for n in names])) == [12, 0, 0]
    assert list(one(spark, *display.hue_rgb(F.lit(120.0)))) == [0, 255, 0]


def test_long_energy_equals_the_direct_sum(spark):
    import random

    draw = random.Random(4)
    cells = draw.sample(range(144), 40)
    rows = [(i, c // 12, c % 12, sorted(draw.sample(range(16), draw.randrange(0, 7)))) for i, c in enumerate(cells)]
    points = spark.createDataFrame(rows, "point_id long, y int, x int, bits array<int>")
    pairs = [(s, *draw.sample(rows, 2)) for s in range(20)]
    frame = spark.createDataFrame([(s, a[1], a[2], b[1], b[2], a[0], b[0] if s % 4 else None) for s, a, b in pairs], "seq long, y1 int, x1 int, y2 int, x2 int, idx_a long, idx_b long")
    found = {r.seq: (r.energy_c, r.energy_s) for r in N.pair_energy_long(frame, points, points, "cosine", 0.3, 10.0).collect()}

    def t(a, b):
        n = len(set(a[3]) & set(b[3]))
        s = n / math.sqrt(len(a[3]) * len(b[3])) if n else 0.0
        return s / (1 + math.exp(-10 * (s - 0.3))) if s > 0 else 0.0

    for s, a, b in pairs:
        b_in = bool(s % 4)
        c = e = 0.0
        for k in rows:
            if k[0] == a[0] or (b_in and k[0] == b[0]):
                continue
            s1, s2 = t(a, k), t(b, k) if b_in else 0.0
            d1, d2 = ((p[1] - k[1]) ** 2 + (p[2] - k[2]) ** 2 for p in (a, b))
            c, e = c + s1 * d1 + s2 * d2, e + s2 * d1 + s1 * d2
        assert found[s] == pytest.approx((c, e), abs=1e-6)


def test_long_swaps_of_equal_energies_are_not_wanted(spark):
    """As the moments are rounded, members of equal codes, members without others and others at equal distances got swaps that lower nothing."""
    import random

    draw = random.Random(5)
    kinds = [[0, 1, 2, 3, 4, 5, 6], [0, 1, 2, 3, 4, 5, 7], [0, 1, 2, 3, 4, 5], [1, 2, 3], [20, 21, 22], [20, 21, 23]]
    cells = draw.sample(range(400), 150)
    # codes of 30 to 149 come in twos, which have a weight with each other only
    rows = [(i, c // 20, c % 20, kinds[i % 6] if i < 30 else [i // 2 * 3 + b for b in range(2 + i % 2)]) for i, c in enumerate(cells)]
    points = spark.createDataFrame(rows, "point_id long, y int, x int, bits array<int>")
    pairs = [(a, b) for a in rows[:30] for b in rows[:30] if a[0] < b[0]] + list(zip(rows[30::2], rows[31::2]))
    frame = spark.createDataFrame([(s, *a[1:3], *b[1:3], a[0], b[0]) for s, (a, b) in enumerate(pairs)], "seq long, y1 int, x1 int, y2 int, x2 int, idx_a long, idx_b long")
    t = lambda a, b: (lambda n: n / math.sqrt(len(a[3]) * len(b[3])) if n else 0.0)(len(set(a[3]) & set(b[3])))
    d = lambda a, b: (a[1] - b[1]) ** 2 + (a[2] - b[2]) ** 2
    expected, equal = {}, 0
    for s, (a, b) in enumerate(pairs):
        terms = [(w * (d(a, k) - d(b, k))) for k in rows if k[0] not in (a[0], b[0]) for w in [t(b, k) - t(a, k)]]
        equal += abs(sum(terms)) < 1e-9
        expected[s] = sum(terms) < -1e-9
    found = N.swaps_wanted(N.comparable_energy_long(frame, points, points, "cosine", 0.1, None), "long")
    assert equal > 100 and any(expected.values()) and {r.seq: r.swap for r in found.collect()} == expected


def test_patch_grids():
    from codelattice.operators import encoder as E

    assert E.inferred_grid(E.DEFAULT) == (7, 7) and E.inferred_grid(E.Encoder(E.DEFAULT.dimensions[:1])) is None
    assert E.patch_grid(None, (7, 7)) == E.PatchGrid(7, 7, 1.0)
    assert E.patch_grid(None, (7, 7), (28, 42)) == E.PatchGrid(7, 7, 4.0, 7.0, 0.0)
