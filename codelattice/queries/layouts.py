"""Queries over placed codes: energies, swaps, detectors, activation, embeddings, and a layout run."""

from __future__ import annotations

from pyspark.sql import functions as F

from codelattice.operators import activation as A
from codelattice.operators import energy as N
from codelattice.operators.greedy import accept_swaps, spread_out
from codelattice.operators.spatial import coverage, fill_radius
from codelattice.plans import layout as L
from codelattice.queries.fixtures import CODES_SQL, DENSE, DENSE_SQL, DETECTORS_SQL, LENGTH, OVERLAP_SQL, PAIRS_SQL, POINTS_SQL, codes, detectors, pairs, points, side_of, table
from codelattice.tables import stored

SIM = ("cosine", 0.65, 10.0)
HARD = ("cosine", 0.6, None)
RADIUS = 3


def _raw(placed, radius=RADIUS):
    return N.local_energy(placed, LENGTH, radius, *SIM)


def q_place(spark, sf_dir):
    return points(spark, sf_dir).select("point_id", "y", "x")


def q_local_energy(spark, sf_dir):
    return N.normalised_energy(_raw(points(spark, sf_dir))).select("point_id", F.round("energy", 6).alias("energy"))


def q_local_energy_centers(spark, sf_dir):
    """Raw energies of the points of one label among all points; the others have 0."""
    placed = points(spark, sf_dir)
    raw = N.local_energy(placed, LENGTH, RADIUS, *SIM, centers=placed.where("label = 3"))
    return raw.select("point_id", F.round("raw", 6).alias("raw"))


def q_avg_energy(spark, sf_dir):
    return N.average_energy(_raw(points(spark, sf_dir))).select(F.round("avg_energy", 6).alias("avg_energy"))


def q_short_weights(spark, sf_dir):
    return N.short_weights(_raw(points(spark, sf_dir))).select("point_id", F.round("weight", 6).alias("weight"))


def q_coverage(spark, sf_dir):
    return coverage(detectors(spark, sf_dir), points(spark, sf_dir), 6).select("detector_id", "point_id")


def q_choose_radius(spark, sf_dir):
    placed = points(spark, sf_dir)
    centers = placed.select(F.col("point_id").alias("center_id"), F.col("y").alias("cy"), F.col("x").alias("cx"))
    return fill_radius(centers, placed.select("point_id", "y", "x"), 1, 6, 28)


def _rounded(rows):
    return rows.select("seq", F.round("energy_c", 4).alias("energy_c"), F.round("energy_s", 4).alias("energy_s"))


def _long(spark, sf_dir, sim=SIM, energies=N.pair_energy_long):
    placed = points(spark, sf_dir)
    return energies(pairs(spark, sf_dir, placed), placed, placed, *sim)


def _short(spark, sf_dir):
    placed = points(spark, sf_dir)
    return N.pair_energy_short(pairs(spark, sf_dir, placed), placed, LENGTH, 7, *SIM)


def q_pair_energy_long(spark, sf_dir):
    return _rounded(_long(spark, sf_dir))


def q_pair_energy_long_dense(spark, sf_dir):
    """The same over codes with half of their bits active."""
    placed = points(spark, sf_dir)
    dense = placed.drop("bits").join(codes(spark, sf_dir, DENSE).select("point_id", "bits"), "point_id")
    return _rounded(N.pair_energy_long(pairs(spark, sf_dir, placed), dense, dense, *SIM))


def q_pair_energy_short(spark, sf_dir):
    return _rounded(_short(spark, sf_dir))


def q_pair_stats(spark, sf_dir):
    placed = points(spark, sf_dir)
    rows = N.pair_stats(pairs(spark, sf_dir, placed), placed, placed, *HARD)
    return rows.select(*[F.round(c, 6).alias(c) if "_s" in c else F.col(c).cast("bigint").alias(c) for c in rows.columns])


def q_short_subset(spark, sf_dir):
    placed = points(spark, sf_dir)
    return N.short_subset(pairs(spark, sf_dir, placed), placed, 2)


def q_short_pair_radius(spark, sf_dir):
    return N.short_pair_radius(pairs(spark, sf_dir, points(spark, sf_dir)), 6)


def q_swap_decision(spark, sf_dir):
    long = N.swaps_wanted(_long(spark, sf_dir, HARD, N.comparable_energy_long), "long").select("seq", F.col("swap").alias("long"))
    short = N.swaps_wanted(_short(spark, sf_dir), "short").select("seq", F.col("swap").alias("short"))
    return long.join(short, "seq")


def q_apply_swaps(spark, sf_dir):
    """Ordered greedy acceptance of all pairs; tested against a sequential loop."""
    placed = points(spark, sf_dir)
    return accept_swaps(pairs(spark, sf_dir, placed).select("seq", "y1", "x1", "y2", "x2"))


def q_spread_out(spark, sf_dir):
    """Ordered greedy spacing of all points; tested against a sequential loop."""
    placed = points(spark, sf_dir).select(F.col("point_id").alias("rank"), "y", "x")
    return spread_out(placed, 4.8)


def q_detector_candidates(spark, sf_dir):
    energies = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("point_id"), F.col("p_retailprice").alias("energy"))
    return A.detector_candidates(energies, per_layer=20).select("point_id", "rank")


def q_detectors(spark, sf_dir):
    """Detectors of the layout of all codes; tested against a sequential construction."""
    placed = points(spark, sf_dir)
    energies = N.normalised_energy(_raw(placed))
    return A.build_detectors(placed, energies, (0.45, 0.55, 0.65, 0.75, 0.85))


def _stimuli(rows):
    """Five codes make an image."""
    return rows.select(F.floor(F.col("point_id") / 5).alias("image_id"), F.col("point_id").alias("stim"), "bits")


def _activation(spark, sf_dir):
    rows = codes(spark, sf_dir)
    return A.activate(_stimuli(rows), rows, *HARD)


def q_activation(spark, sf_dir):
    return _activation(spark, sf_dir).select("image_id", "point_id", F.round("value", 6).alias("value"))


def q_matrix(spark, sf_dir):
    side = side_of(spark, sf_dir)
    rows = A.matrix(_activation(spark, sf_dir), points(spark, sf_dir).select("point_id", "y", "x"), side, side)
    return rows.select("image_id", "y", F.array_join(F.transform("values", lambda v: F.when(v == 0, 0).otherwise(F.round(v * 1000).cast("int"))), ",").alias("row"))


def _energy():
    """A price-like energy from the table keeps every detector's own energy above 0."""
    return ((F.col("point_id") * 37 % 100 + 1) / 100.0).alias("energy")


def _levels(spark, sf_dir):
    placed = points(spark, sf_dir)
    circles = detectors(spark, sf_dir)
    covered = coverage(circles, placed, 6)
    energies = placed.select("point_id", _energy())
    own = covered.join(energies, "point_id").groupBy("detector_id").agg(F.sum("energy").alias("energy"))
    circles = circles.join(own, "detector_id")
    return A.detector_levels(_activation(spark, sf_dir), energies, circles, covered, 0.12, 0.1), circles


def q_detector_level(spark, sf_dir):
    return _levels(spark, sf_dir)[0].select("image_id", "detector_id", F.round("level", 6).alias("level"), "points_used")


def q_embedding(spark, sf_dir):
    """Suppliers of the same circle share its level, and only points inside a circle are compared."""
    placed = points(spark, sf_dir).select("point_id", _energy(), "bits", "y", "x")
    circles = stored(A.shared_circles(detectors(spark, sf_dir), 8), "circles")
    covered = stored(coverage(circles, placed, 6), "covered")
    own = stored(covered.join(placed, "point_id").groupBy("detector_id").agg(F.sum("energy").alias("energy")), "own")
    levels = A.activated_levels(_stimuli(codes(spark, sf_dir)), placed, own, covered, *HARD, 0.12, 0.1)
    found = A.embed_shared_bits(levels.withColumn("level", F.round("level", 6)), circles, 8)
    return found.select("image_id", F.array_join("bits", ",").alias("bits"))


def q_embedding_codes(spark, sf_dir):
    """Codes of several bits merged whole or not at all; tested against a sequential loop."""
    levels, circles = _levels(spark, sf_dir)
    wide = circles.withColumn("bits", F.array(*[(F.col("bit") * k % 97).cast("int") for k in (1, 3, 7)])).withColumn("bits", F.array_distinct("bits"))
    return A.embed(levels.withColumn("level", F.round("level", 6)), wide, 20).select("image_id", F.array_join("bits", ",").alias("bits"))


def q_tiles(spark, sf_dir):
    placed = points(spark, sf_dir)
    ys, xs = (3.0, 9.0, 17.0), (5.0, 11.0)
    tile = L.tile_of(F.col("y"), list(ys)) * (len(xs) + 1) + L.tile_of(F.col("x"), list(xs))
    counts = placed.groupBy(tile.alias("tile")).agg(F.count("*").alias("n"))
    return L.tile_quotas(counts, 101, 12)


def q_render(spark, sf_dir):
    side = side_of(spark, sf_dir)
    placed = points(spark, sf_dir)
    return L.render(placed.select("point_id", (F.col("label") * 36.5).alias("hue")), placed, side, side)


def q_layout_run(spark, sf_dir):
    """A short run over all codes; its random choices have no SQL, and tests check its invariants."""
    options = L.Options(LENGTH, level=0.5, subset=100_000, empty_ratio=0.5)
    state, _ = L.run(codes(spark, sf_dir), options, [L.Phase("long", 2, 200), L.Phase("short", 2, 200, 4, cutoff=0.2, weighted=True, tiles=4)], side_of(spark, sf_dir))
    return state.select("point_id", "y", "x")


_SOFT = "(s * (1 / (1 + exp(-10::DOUBLE * (s - 0.65::DOUBLE)))))"
ENERGY_SQL = f"""{POINTS_SQL}, {OVERLAP_SQL}, raw AS (
    SELECT points.point_id, coalesce(e, 0) AS raw FROM points LEFT JOIN (
        SELECT i, sum({_SOFT} / (((p.y - q.y) * (p.y - q.y) + (p.x - q.x) * (p.x - q.x))::DOUBLE + 1e-6::DOUBLE)) AS e
        FROM cosines JOIN points p ON p.point_id = i JOIN points q ON q.point_id = k
        WHERE i <> k AND (p.y - q.y) * (p.y - q.y) + (p.x - q.x) * (p.x - q.x) <= {RADIUS * RADIUS} GROUP BY i
    ) ON i = points.point_id
)"""

_D = lambda n: f"((y{n} - y) * (y{n} - y) + (x{n} - x) * (x{n} - x))"


def _long_sql(weight: str) -> str:
    return f"""{POINTS_SQL}, {OVERLAP_SQL}, {PAIRS_SQL}, w AS (SELECT i, k, {weight} AS s FROM cosines), long AS (
    SELECT seq, sum(coalesce(a.s, 0) * {_D(1)} + coalesce(b.s, 0) * {_D(2)}) AS energy_c, sum(coalesce(b.s, 0) * {_D(1)} + coalesce(a.s, 0) * {_D(2)}) AS energy_s
    FROM pairs JOIN points ON point_id <> idx_a AND point_id IS DISTINCT FROM idx_b
    LEFT JOIN w a ON a.i = idx_a AND a.k = point_id LEFT JOIN w b ON b.i = idx_b AND b.k = point_id GROUP BY seq
)"""


_HARD = "CASE WHEN s >= 0.6 THEN s ELSE 0 END"
_NEAR = "point_id <> idx_a AND point_id IS DISTINCT FROM idx_b AND ((y1 + y2) / 2::DOUBLE - y) ** 2 + ((x1 + x2) / 2::DOUBLE - x) ** 2 <= {r}"
_SHORT = f"""short AS (
    SELECT p.seq, coalesce(energy_c, 0) AS energy_c, coalesce(energy_s, 0) AS energy_s FROM pairs p LEFT JOIN (
        SELECT seq, sum(coalesce(a.s, 0) / ({_D(1)} + 1e-6::DOUBLE) + coalesce(b.s, 0) / ({_D(2)} + 1e-6::DOUBLE)) AS energy_c,
               sum(coalesce(b.s, 0) / ({_D(1)} + 1e-6::DOUBLE) + coalesce(a.s, 0) / ({_D(2)} + 1e-6::DOUBLE)) AS energy_s
        FROM pairs JOIN points ON {_NEAR.format(r=49)} LEFT JOIN ws a ON a.i = idx_a AND a.k = point_id LEFT JOIN ws b ON b.i = idx_b AND b.k = point_id GROUP BY seq
    ) e USING (seq)
)"""

LEVELS_SQL = f"""{POINTS_SQL}, {OVERLAP_SQL}, {DETECTORS_SQL}, activation AS (
    SELECT i // 5 AS image_id, k AS point_id, max(s) AS value FROM cosines WHERE s >= 0.6 GROUP BY ALL
), covered AS (
    SELECT detector_id, point_id, (point_id * 37 % 100 + 1) / 100::DOUBLE AS energy
    FROM detectors JOIN points ON (cy - y) * (cy - y) + (cx - x) * (cx - x) <= radius * radius
), own AS (SELECT detector_id, sum(energy) AS own FROM covered GROUP BY detector_id
), levels AS (
    SELECT image_id, detector_id, round(sum(value * energy) / own, 6) AS level, count(*) AS points_used, sum(value * energy) / own AS exact
    FROM covered JOIN activation USING (point_id) JOIN own USING (detector_id) WHERE energy >= 0.12 GROUP BY image_id, detector_id, own
    HAVING sum(value * energy) / own >= 0.1
)"""

#: Ordered greedy selections: one row per round, with what has been used so far as a list.
SWAPS_SQL = f"""WITH RECURSIVE {POINTS_SQL}, {PAIRS_SQL}, ordered AS (
    SELECT *, y1 * side + x1 AS a, y2 * side + x2 AS b, row_number() OVER (ORDER BY seq) AS n FROM pairs, side
), walk AS (
    SELECT 0::BIGINT AS n, []::BIGINT[] AS used, NULL::BIGINT AS seq, false AS took
    UNION ALL
    SELECT o.n, CASE WHEN list_contains(used, o.a) OR list_contains(used, o.b) THEN used ELSE list_concat(used, [o.a::BIGINT, o.b::BIGINT]) END, o.seq,
           NOT (list_contains(used, o.a) OR list_contains(used, o.b))
    FROM walk w JOIN ordered o ON o.n = w.n + 1
) SELECT seq, y1, x1, y2::INT AS y2, x2::INT AS x2 FROM walk JOIN pairs USING (seq) WHERE took"""
SPACED_SQL = f"""WITH RECURSIVE {POINTS_SQL}, ordered AS (SELECT point_id, y, x, row_number() OVER (ORDER BY point_id) AS n FROM points
), walk AS (
    SELECT 0::BIGINT AS n, []::STRUCT(y INT, x INT)[] AS held, NULL::BIGINT AS point_id, false AS took
    UNION ALL
    SELECT o.n, CASE WHEN len(list_filter(held, lambda h: (h.y - o.y) * (h.y - o.y) + (h.x - o.x) * (h.x - o.x) < 23.04)) > 0 THEN held ELSE list_append(held, {{'y': o.y, 'x': o.x}}) END,
           o.point_id, len(list_filter(held, lambda h: (h.y - o.y) * (h.y - o.y) + (h.x - o.x) * (h.x - o.x) < 23.04)) = 0
    FROM walk w JOIN ordered o ON o.n = w.n + 1
) SELECT p.point_id AS rank, y, x FROM walk JOIN points p USING (point_id) WHERE took"""
MERGED_SQL = f"""WITH RECURSIVE {LEVELS_SQL}, ranked AS (
    SELECT image_id, list_distinct([bit % 97, bit * 3 % 97, bit * 7 % 97]) AS bits, row_number() OVER (PARTITION BY image_id ORDER BY level * "lambda" DESC, detector_id) AS n
    FROM levels JOIN detectors USING (detector_id)
), walk AS (
    SELECT DISTINCT image_id, 0::BIGINT AS n, []::BIGINT[] AS have FROM ranked
    UNION ALL
    SELECT w.image_id, r.n, CASE WHEN len(list_distinct(list_concat(have, r.bits))) <= 20 THEN list_distinct(list_concat(have, r.bits)) ELSE have END
    FROM walk w JOIN ranked r ON r.image_id = w.image_id AND r.n = w.n + 1
) SELECT image_id, array_to_string(list_sort(arg_max(have, n)), ',') AS bits FROM walk GROUP BY image_id"""

ORACLE = {
    "q_apply_swaps": SWAPS_SQL,
    "q_spread_out": SPACED_SQL,
    "q_embedding_codes": MERGED_SQL,
    "q_place": f"WITH {POINTS_SQL} SELECT point_id, y, x FROM points",
    "q_local_energy": f"WITH {ENERGY_SQL} SELECT point_id, round(CASE WHEN max(raw) OVER () > 0 THEN raw / max(raw) OVER () ELSE 0 END, 6) AS energy FROM raw",
    "q_local_energy_centers": f"WITH {ENERGY_SQL} SELECT point_id, round(CASE WHEN label = 3 THEN raw ELSE 0 END, 6) AS raw FROM raw JOIN points USING (point_id)",
    "q_avg_energy": f"WITH {ENERGY_SQL} SELECT round(avg(raw) / max(raw), 6) AS avg_energy FROM raw",
    "q_short_weights": f"WITH {ENERGY_SQL} SELECT point_id, round(greatest(0::DOUBLE, -ln(greatest(1e-6::DOUBLE, raw / max(raw) OVER ()))), 6) AS weight FROM raw",
    "q_coverage": f"WITH {POINTS_SQL}, {DETECTORS_SQL} SELECT detector_id, point_id FROM detectors JOIN points ON (cy - y) * (cy - y) + (cx - x) * (cx - x) <= radius * radius",
    "q_choose_radius": f"""WITH {POINTS_SQL}, counted AS (
            SELECT a.point_id AS center_id, r::INT AS radius, count(*) AS covered FROM points a, (SELECT unnest(range(1, 7)) AS r), points b
            WHERE (a.y - b.y) * (a.y - b.y) + (a.x - b.x) * (a.x - b.x) <= r * r GROUP BY ALL
        ) SELECT center_id, coalesce(min(radius) FILTER (covered >= 28), arg_min(radius, struct_pack(c := -covered, r := radius))) AS radius,
            CASE WHEN bool_or(covered >= 28) THEN arg_min(covered, radius) FILTER (covered >= 28) ELSE max(covered) END AS covered FROM counted GROUP BY center_id""",
    "q_pair_energy_long": f"WITH {_long_sql(_SOFT)} SELECT seq, round(energy_c, 4) AS energy_c, round(energy_s, 4) AS energy_s FROM long",
    "q_pair_energy_long_dense": f"WITH {_long_sql(_SOFT).replace(CODES_SQL, DENSE_SQL)} SELECT seq, round(energy_c, 4) AS energy_c, round(energy_s, 4) AS energy_s FROM long",
    "q_pair_energy_short": f"""WITH {POINTS_SQL}, {OVERLAP_SQL}, {PAIRS_SQL}, ws AS (SELECT i, k, {_SOFT} AS s FROM cosines), {_SHORT}
        SELECT seq, round(energy_c, 4) AS energy_c, round(energy_s, 4) AS energy_s FROM short""",
    "q_pair_stats": f"""WITH {POINTS_SQL}, {OVERLAP_SQL}, {PAIRS_SQL}, w AS (SELECT i, k, s FROM cosines WHERE s >= 0.6), rows AS (
            SELECT seq, coalesce(a.s, 0) AS s1, coalesce(b.s, 0) AS s2, {_D(1)} AS d1, {_D(2)} AS d2
            FROM pairs JOIN points ON point_id <> idx_a AND point_id IS DISTINCT FROM idx_b
            LEFT JOIN w a ON a.i = idx_a AND a.k = point_id LEFT JOIN w b ON b.i = idx_b AND b.k = point_id WHERE a.s > 0 OR b.s > 0
        ) SELECT seq, count(*) AS n, {", ".join(f"round({f}({c}), 6) AS {f}_{c}" for c in ("s1", "s2") for f in ("min", "max", "sum"))},
            {", ".join(f"{f}({c})::BIGINT AS {f}_{c}" for c in ("d1", "d2") for f in ("min", "max", "sum"))} FROM rows GROUP BY seq""",
    "q_short_subset": f"WITH {POINTS_SQL}, {PAIRS_SQL} SELECT DISTINCT point_id FROM pairs JOIN points ON {_NEAR.format(r=4)}",
    "q_short_pair_radius": f"""WITH {POINTS_SQL}, {PAIRS_SQL} SELECT seq, greatest(1, 6, ceil(sqrt(((y1 - y2) * (y1 - y2) + (x1 - x2) * (x1 - x2))::DOUBLE))::INT) AS radius FROM pairs""",
    "q_swap_decision": f"""WITH {_long_sql(_HARD)}, ws AS (SELECT i, k, {_SOFT} AS s FROM cosines), {_SHORT}
        SELECT seq, long.energy_s < long.energy_c AS long, short.energy_s > short.energy_c AS short FROM long JOIN short USING (seq)""",
    "q_detector_candidates": """SELECT p_partkey AS point_id, rank FROM (SELECT p_partkey, row_number() OVER (ORDER BY p_retailprice DESC, p_partkey) - 1 AS rank, count(*) OVER () AS n FROM part)
        WHERE rank % greatest(1, n // 120) = 0""",
    "q_activation": f"WITH {POINTS_SQL}, {OVERLAP_SQL} SELECT i // 5 AS image_id, k AS point_id, round(max(s), 6) AS value FROM cosines WHERE s >= 0.6 GROUP BY ALL",
    "q_matrix": f"""WITH {POINTS_SQL}, {OVERLAP_SQL}, act AS (SELECT i // 5 AS image_id, k AS point_id, max(s) AS value FROM cosines WHERE s >= 0.6 GROUP BY ALL),
        grid AS (SELECT image_id, (cell // side)::INT AS y, (cell % side)::INT AS x FROM (SELECT DISTINCT image_id FROM act), cells, side)
        SELECT image_id, y, string_agg(round(coalesce(value, 0) * 1000)::INT::VARCHAR, ',' ORDER BY x) AS row
        FROM grid LEFT JOIN (SELECT image_id, y, x, value FROM act JOIN points USING (point_id)) USING (image_id, y, x) GROUP BY image_id, y""",
    "q_detector_level": f"WITH {LEVELS_SQL} SELECT image_id, detector_id, level, points_used FROM levels",
    "q_embedding": f"""WITH {LEVELS_SQL}, ranked AS (SELECT image_id, bit, row_number() OVER (PARTITION BY image_id ORDER BY level * "lambda" DESC, detector_id) AS rn FROM levels JOIN detectors USING (detector_id))
        SELECT image_id, string_agg(bit::VARCHAR, ',' ORDER BY bit) AS bits FROM ranked WHERE rn <= 8 GROUP BY image_id""",
    "q_tiles": f"""WITH {POINTS_SQL} SELECT ((y >= 3)::INT + (y >= 9)::INT + (y >= 17)::INT) * 3 + (x >= 5)::INT + (x >= 11)::INT AS tile, count(*) AS n,
        8 + CASE WHEN ((y >= 3)::INT + (y >= 9)::INT + (y >= 17)::INT) * 3 + (x >= 5)::INT + (x >= 11)::INT < 5 THEN 1 ELSE 0 END AS quota FROM points GROUP BY 1""",
    "q_render": f"""WITH {POINTS_SQL}, s AS (SELECT y, x, least((label * 36.5::DOUBLE - min(label * 36.5::DOUBLE) OVER ()) * (360 / (max(label * 36.5::DOUBLE) OVER () - min(label * 36.5::DOUBLE) OVER ())), 360 - 1e-9::DOUBLE) / 360 * 6 AS v FROM points),
        t AS (SELECT y, x, floor(v)::INT AS k, v - floor(v) AS f FROM s), c AS (SELECT y, x,
            floor(255 * CASE k WHEN 0 THEN 1 WHEN 1 THEN 1 - f WHEN 2 THEN 0 WHEN 3 THEN 0 WHEN 4 THEN f ELSE 1 END)::INT AS r,
            floor(255 * CASE k WHEN 0 THEN f WHEN 1 THEN 1 WHEN 2 THEN 1 WHEN 3 THEN 1 - f ELSE 0 END)::INT AS g,
            floor(255 * CASE k WHEN 0 THEN 0 WHEN 1 THEN 0 WHEN 2 THEN f WHEN 3 THEN 1 WHEN 4 THEN 1 ELSE 1 - f END)::INT AS b FROM t)
        SELECT g2.y, g2.x, coalesce(r, 0) AS r, coalesce(g, 0) AS g, coalesce(b, 0) AS b FROM (SELECT (cell // side)::INT AS y, (cell % side)::INT AS x FROM cells, side) g2 LEFT JOIN c ON c.y = g2.y AND c.x = g2.x""",
}

QUERIES = {name: f for name, f in globals().items() if name.startswith("q_")}
