"""Queries over codes, their similarities, and small scalar functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codelattice.functions import bits as B
from codelattice.functions import display
from codelattice.functions.similarity import angle_similarity, cosine, jaccard, similarity, thresholded
from codelattice.operators.pairs import pair_similarity, similarity_block, similarity_pairs
from codelattice.plans.tuner import tuned
from codelattice.queries.fixtures import CODES_SQL, DENSE, DENSE_SQL, EVENTS_SQL, LENGTH, OVERLAP_SQL, codes, measured_events, table
from codelattice.sources.layouts import in_first_place, labelled_embeddings, merged_payload, readiness


def _neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every dense code beside that of the next id: (point_id, common, ones_a, ones_b, bits, next_bits)."""
    rows = codes(spark, sf_dir, DENSE).select("point_id", "bits", B.pack(F.col("bits"), LENGTH).alias("words"))
    after = rows.select((F.col("point_id") - 1).alias("point_id"), F.col("bits").alias("next_bits"), F.col("words").alias("next_words"))
    met = rows.join(after, "point_id")
    return met.select(
        "point_id", "bits", "next_bits", B.common(F.col("words"), F.col("next_words")).alias("common"),
        B.popcount(F.col("words")).alias("ones_a"), B.popcount(F.col("next_words")).alias("ones_b"),
    )


NEIGHBOURS_SQL = f"""{DENSE_SQL}, near AS (
    SELECT a.point_id, count(*) FILTER (b.bit IS NOT NULL) AS common FROM bits a LEFT JOIN bits b
      ON b.point_id = a.point_id + 1 AND b.bit = a.bit GROUP BY a.point_id
), met AS (
    SELECT a.point_id, coalesce(common, 0)::INT AS common, a.ones AS ones_a, b.ones AS ones_b
    FROM codes a JOIN codes b ON b.point_id = a.point_id + 1 LEFT JOIN near ON near.point_id = a.point_id
)"""


def q_bits_parse(spark, sf_dir):
    rows = codes(spark, sf_dir, DENSE).select("point_id", B.to01(F.col("bits"), LENGTH).alias("text"))
    return rows.select("point_id", F.array_join(B.parse01(F.col("text")), ",").alias("bit_list"))


def q_popcount(spark, sf_dir):
    return codes(spark, sf_dir, DENSE).select("point_id", B.popcount(B.pack(F.col("bits"), LENGTH)).alias("ones"))


def q_to01(spark, sf_dir):
    return codes(spark, sf_dir, DENSE).select("point_id", B.to01(F.col("bits"), LENGTH).alias("text"))


def q_common(spark, sf_dir):
    return _neighbours(spark, sf_dir).select("point_id", "common")


def q_bit_ops(spark, sf_dir):
    rows = _neighbours(spark, sf_dir)
    text = lambda c: F.array_join(c, ",")
    return rows.select(
        "point_id",
        text(B.union(F.col("bits"), F.col("next_bits"))).alias("either"),
        text(B.intersection(F.col("bits"), F.col("next_bits"))).alias("both"),
        text(B.with_bit(F.col("bits"), F.lit(5))).alias("with_5"),
        text(B.with_bit(F.col("bits"), F.lit(5), False)).alias("without_5"),
    )


def q_sim_cosine(spark, sf_dir):
    return _neighbours(spark, sf_dir).select("point_id", F.round(cosine(F.col("common"), F.col("ones_a"), F.col("ones_b")), 9).alias("sim"))


def q_sim_jaccard(spark, sf_dir):
    return _neighbours(spark, sf_dir).select("point_id", F.round(jaccard(F.col("common"), F.col("ones_a"), F.col("ones_b")), 9).alias("sim"))


def q_sim_variants(spark, sf_dir):
    names = ("jaccard2", "j2", "cosine2", "cos2", "unknown")
    return _neighbours(spark, sf_dir).select(
        "point_id", *[F.round(similarity(n, F.col("common"), F.col("ones_a"), F.col("ones_b")), 9).alias(n) for n in names]
    )


def q_sim_lambda(spark, sf_dir):
    s = cosine(F.col("common"), F.col("ones_a"), F.col("ones_b"))
    return _neighbours(spark, sf_dir).select(
        "point_id", *[F.round(thresholded(s, 0.5, eta), 9).alias(name) for name, eta in (("hard", None), ("flat", 0.0), ("soft", 10.0))]
    )


def q_sim_all_pairs(spark, sf_dir):
    return similarity_pairs(codes(spark, sf_dir), "cosine", 9)


def q_sim_all_pairs_dense(spark, sf_dir):
    """The same over codes with half of their bits active."""
    return similarity_pairs(codes(spark, sf_dir, DENSE), "cosine", 9)


def q_sim_block(spark, sf_dir):
    rows = codes(spark, sf_dir)
    return similarity_block(rows.where("label = 3"), rows, "jaccard").select("i", "k", F.round("sim", 9).alias("sim"))


def q_sim_lookup(spark, sf_dir):
    """The similarity of every code to the code of three times its id, null where there is none."""
    rows = codes(spark, sf_dir, DENSE)
    asked = rows.select(F.col("point_id").alias("i"), (F.col("point_id") * 3).alias("k"))
    return pair_similarity(asked, rows, LENGTH, "jaccard").select("i", "k", F.round("sim", 9).alias("sim"))


def q_unique_paths(spark, sf_dir):
    """Users as paths in the order of their events, each at its first place."""
    rows = table(spark, sf_dir, "events").select(F.concat(F.lit("layouts/"), F.nullif(F.col("user_id"), F.lit(0)).cast("string")).alias("path"), F.col("event_id").alias("place"))
    return in_first_place(rows, "path", "place")


def q_angle_similarity(spark, sf_dir):
    rows = measured_events(spark, sf_dir)
    return rows.select("seq", F.round(angle_similarity(F.col("angle"), (F.col("image_id") * 37 % 360).cast("double")), 9).alias("sim"))


def q_label_format(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", display.label_text(F.col("l_quantity")).alias("whole"), display.label_text(F.col("l_discount")).alias("part")
    )


def q_label_from_name(spark, sf_dir):
    names = table(spark, sf_dir, "customer").select("c_custkey", F.concat(F.lit("data/"), F.regexp_replace("c_name", "#0*", "_"), F.lit(".png")).alias("name"))
    return names.select("c_custkey", display.label_from_name(F.col("name")).alias("label"))


def q_hue_rgb(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select("p_partkey", F.col("p_retailprice").alias("hue"))
    low, high = rows.agg(F.min("hue"), F.max("hue")).first()
    hue = display.rescaled_hue(F.col("hue"), F.lit(low), F.lit(high))
    rows = rows.select("p_partkey", hue.alias("scaled"))
    r, g, b = display.hue_rgb(F.col("scaled"))
    return rows.select("p_partkey", F.round("scaled", 6).alias("scaled"), r.alias("r"), g.alias("g"), b.alias("b"))


def q_value_alpha(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", display.value_alpha(F.col("value") / 100.0 - 0.1).alias("alpha"))


def q_code_stats(spark, sf_dir):
    rows = codes(spark, sf_dir)
    return rows.agg(
        F.count("*").alias("n"), F.min(F.size("bits")).alias("least"), F.max(F.size("bits")).alias("most"),
        F.round(F.avg(F.size("bits")), 9).alias("mean"), F.count_distinct("label").alias("labels"),
    )


def q_embedding_load(spark, sf_dir):
    rows = codes(spark, sf_dir)
    odd = F.col("point_id") % 3
    records = rows.select(
        F.when(odd == 0, F.col("label").cast("string")).alias("class"), F.when(odd == 1, F.col("label").cast("string")).alias("label"), B.to01(F.col("bits"), LENGTH).alias("embedding")
    )
    return labelled_embeddings(records).groupBy("label").agg(F.count("*").alias("n"), F.sum("ones").alias("ones"))


def _layout_documents(spark, sf_dir) -> DataFrame:
    """A document per nation: its suppliers as entries, without a place where the balance is negative."""
    s = table(spark, sf_dir, "supplier")
    place = lambda c: F.when(F.col("s_acctbal") >= 0, c)
    entry = F.struct(
        F.col("s_suppkey").alias("index"), place((F.col("s_suppkey") % 17).cast("int")).alias("y"), place((F.col("s_suppkey") % 23).cast("int")).alias("x"),
        F.lit("a").alias("label"), F.lit("01").alias("value"), F.lit(0.0).alias("hue"), F.lit(1).alias("ones"),
    )
    rows = s.groupBy("s_nationkey").agg(F.collect_list(entry).alias("layout"))
    return rows.select(
        F.col("s_nationkey").cast("string").alias("path"), F.lit(17).alias("height"), (F.col("s_nationkey") % 5 * 5).cast("int").alias("width"),
        F.lit(None).cast("bigint").alias("points"), F.lit(6).alias("pair_radius"), "layout",
    )


def q_layout_ready(spark, sf_dir):
    return readiness(_layout_documents(spark, sf_dir))


def q_merge_payload(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("index"), (F.col("c_custkey") % 31).cast("int").alias("y"), (F.col("c_custkey") % 37).cast("int").alias("x"),
        F.col("c_mktsegment").alias("label"), F.lit("0").alias("value"), F.col("c_acctbal").alias("hue"), F.lit(0).alias("ones"),
    )
    b = table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("index"), F.col("s_name").alias("label"), F.lit("1").alias("value"),
        F.when(F.col("s_acctbal") >= 0, F.col("s_acctbal")).alias("hue"), F.lit(1).alias("ones"),
    )
    return merged_payload(c, b)


def q_missing_ids(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem")
    named = line.select(F.col("l_partkey").alias("id")).union(line.select(F.col("l_suppkey").alias("id"))).distinct()
    return named.join(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id")), "id", "left_anti")


def q_tune(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", *[c.alias(n) for n, c in tuned((F.col("o_orderkey") + 1) * 7).items()])


_PAIR_SIM = {
    "cosine": "common / sqrt((ones_a * ones_b)::DOUBLE)",
    "jaccard": "common / (ones_a + ones_b - common)::DOUBLE",
}
_C, _J = _PAIR_SIM["cosine"], _PAIR_SIM["jaccard"]

ORACLE = {
    "q_bits_parse": f"WITH {DENSE_SQL} SELECT point_id, coalesce(bit_list, '') AS bit_list FROM codes",
    "q_popcount": f"WITH {DENSE_SQL} SELECT point_id, ones FROM codes",
    "q_to01": """SELECT vec_id AS point_id, string_agg(CASE WHEN embedding[bit + 1] > 0 THEN '1' ELSE '0' END, '' ORDER BY bit) AS text
        FROM embeddings, (SELECT unnest(range(64)) AS bit) GROUP BY vec_id""",
    "q_common": f"WITH {NEIGHBOURS_SQL} SELECT point_id, common FROM met",
    "q_bit_ops": f"""WITH {DENSE_SQL}, seen AS (
            SELECT a.point_id, t.bit::INT AS bit, bool_or(t.bit = own.bit AND own.point_id = a.point_id) AS here, bool_or(t.bit = own.bit AND own.point_id = a.point_id + 1) AS there
            FROM codes a JOIN codes b ON b.point_id = a.point_id + 1, (SELECT unnest(range(64)) AS bit) t
            LEFT JOIN bits own ON own.bit = t.bit AND own.point_id IN (a.point_id, a.point_id + 1) GROUP BY ALL
        ) SELECT point_id,
            coalesce(string_agg(bit::VARCHAR, ',' ORDER BY bit) FILTER (coalesce(here, false) OR coalesce(there, false)), '') AS either,
            coalesce(string_agg(bit::VARCHAR, ',' ORDER BY bit) FILTER (coalesce(here, false) AND coalesce(there, false)), '') AS both,
            coalesce(string_agg(bit::VARCHAR, ',' ORDER BY bit) FILTER (coalesce(here, false) OR bit = 5), '') AS with_5,
            coalesce(string_agg(bit::VARCHAR, ',' ORDER BY bit) FILTER (coalesce(here, false) AND bit <> 5), '') AS without_5
        FROM seen GROUP BY point_id""",
    "q_sim_cosine": f"WITH {NEIGHBOURS_SQL} SELECT point_id, round({_C}, 9) AS sim FROM met",
    "q_sim_jaccard": f"WITH {NEIGHBOURS_SQL} SELECT point_id, round({_J}, 9) AS sim FROM met",
    "q_sim_variants": f"""WITH {NEIGHBOURS_SQL}, s AS (SELECT point_id, {_C} AS c, {_J} AS j FROM met)
        SELECT point_id, round(j * j, 9) AS jaccard2, round(j * j, 9) AS j2, round(c * c, 9) AS cosine2, round(c * c, 9) AS cos2, round(j, 9) AS unknown FROM s""",
    "q_sim_lambda": f"""WITH {NEIGHBOURS_SQL}, s AS (SELECT point_id, {_C} AS s FROM met)
        SELECT point_id, round(CASE WHEN s >= 0.5 THEN s ELSE 0 END, 9) AS hard, round(s * 0.5::DOUBLE, 9) AS flat,
               round(s * (1 / (1 + exp(-10::DOUBLE * (s - 0.5::DOUBLE)))), 9) AS soft FROM s""",
    "q_sim_all_pairs": f"WITH {CODES_SQL}, {OVERLAP_SQL} SELECT i, k AS j, round(s, 9) AS sim FROM cosines WHERE i < k",
    "q_sim_all_pairs_dense": f"WITH {DENSE_SQL}, {OVERLAP_SQL} SELECT i, k AS j, round(s, 9) AS sim FROM cosines WHERE i < k",
    "q_sim_block": f"""WITH {CODES_SQL}, {OVERLAP_SQL} SELECT i, k, round(common / (a.ones + b.ones - common)::DOUBLE, 9) AS sim
        FROM overlap JOIN codes a ON i = a.point_id JOIN codes b ON k = b.point_id WHERE a.label = 3""",
    "q_sim_lookup": f"""WITH {DENSE_SQL}, asked AS (SELECT point_id AS i, point_id * 3 AS k FROM codes),
        met AS (SELECT i, k, count(a.bit) AS common FROM asked LEFT JOIN bits a ON a.point_id = i AND EXISTS (SELECT 1 FROM bits b WHERE b.point_id = k AND b.bit = a.bit) GROUP BY i, k)
        SELECT i, k, CASE WHEN b.point_id IS NOT NULL THEN round(common / (a.ones + b.ones - common)::DOUBLE, 9) END AS sim
        FROM met JOIN codes a ON a.point_id = i LEFT JOIN codes b ON b.point_id = k""",
    "q_unique_paths": "SELECT 'layouts/' || user_id AS path, min(event_id) AS place FROM events WHERE user_id <> 0 GROUP BY user_id",
    "q_angle_similarity": f"""WITH {EVENTS_SQL}, d AS (SELECT seq, abs(angle - (image_id * 37 % 360)::DOUBLE) % 360 AS d FROM measured)
        SELECT seq, round((cos(radians(least(d, 360 - d))) + 1) / 2, 9) AS sim FROM d""",
    "q_label_format": """SELECT l_orderkey, l_linenumber,
        CASE WHEN abs(l_quantity - round_even(l_quantity, 0)) < 1e-6 THEN round_even(l_quantity, 0)::BIGINT::VARCHAR ELSE printf('%.3f', l_quantity) END AS whole,
        CASE WHEN abs(l_discount - round_even(l_discount, 0)) < 1e-6 THEN round_even(l_discount, 0)::BIGINT::VARCHAR ELSE printf('%.3f', l_discount) END AS part
        FROM lineitem""",
    "q_label_from_name": "SELECT c_custkey, coalesce(try_cast(nullif(regexp_extract(c_name, '[1-9][0-9]*'), '') AS INT), 0) AS label FROM customer",
    "q_hue_rgb": """WITH s AS (SELECT p_partkey, least((p_retailprice - min(p_retailprice) OVER ()) * (360 / (max(p_retailprice) OVER () - min(p_retailprice) OVER ())), 360 - 1e-9::DOUBLE) AS h FROM part),
        t AS (SELECT p_partkey, h, h / 360 * 6 AS v, floor(h / 360 * 6)::INT AS k, h / 360 * 6 - floor(h / 360 * 6) AS f FROM s)
        SELECT p_partkey, round(h, 6) AS scaled,
            floor(255 * CASE k WHEN 0 THEN 1 WHEN 1 THEN 1 - f WHEN 2 THEN 0 WHEN 3 THEN 0 WHEN 4 THEN f ELSE 1 END)::INT AS r,
            floor(255 * CASE k WHEN 0 THEN f WHEN 1 THEN 1 WHEN 2 THEN 1 WHEN 3 THEN 1 - f ELSE 0 END)::INT AS g,
            floor(255 * CASE k WHEN 0 THEN 0 WHEN 1 THEN 0 WHEN 2 THEN f WHEN 3 THEN 1 WHEN 4 THEN 1 ELSE 1 - f END)::INT AS b FROM t""",
    "q_value_alpha": "SELECT event_id, floor(greatest(0::DOUBLE, least(1::DOUBLE, value / 100::DOUBLE - 0.1::DOUBLE)) * 255)::INT AS alpha FROM events",
    "q_code_stats": f"WITH {CODES_SQL} SELECT count(*) AS n, min(ones) AS least, max(ones) AS most, round(avg(ones), 9) AS mean, count(DISTINCT label) AS labels FROM codes",
    "q_embedding_load": f"WITH {CODES_SQL} SELECT label, count(*) AS n, sum(ones)::BIGINT AS ones FROM codes WHERE point_id % 3 <> 2 GROUP BY label",
    "q_layout_ready": """SELECT s_nationkey::VARCHAR AS path, count(*) AS points, 6 AS pair_radius,
        s_nationkey % 5 <> 0 AND bool_and(s_acctbal >= 0) AS ready FROM supplier GROUP BY s_nationkey""",
    "q_merge_payload": """SELECT c_custkey AS index, (c_custkey % 31)::INT AS y, (c_custkey % 37)::INT AS x, coalesce(s_name, c_mktsegment) AS label,
        CASE WHEN s_suppkey IS NULL THEN '0' ELSE '1' END AS value, CASE WHEN s_acctbal >= 0 THEN s_acctbal ELSE c_acctbal END AS hue,
        CASE WHEN s_suppkey IS NULL THEN 0 ELSE 1 END AS ones FROM customer LEFT JOIN supplier ON c_custkey = s_suppkey""",
    "q_missing_ids": "SELECT id FROM (SELECT l_partkey AS id FROM lineitem UNION SELECT l_suppkey FROM lineitem) WHERE id NOT IN (SELECT s_suppkey FROM supplier)",
    "q_tune": """WITH n AS (SELECT o_orderkey, (o_orderkey + 1) * 7 AS n, ceil(sqrt((o_orderkey + 1) * 7 * 1.5::DOUBLE))::INT AS grid FROM orders),
        t AS (SELECT *, greatest(300, least(1500, trunc(n / 25)::INT)) AS long_steps, greatest(160, least(900, trunc(grid * 1.6::DOUBLE)::INT)) AS short_steps,
              greatest(1, trunc(grid * 0.05::DOUBLE)::INT) AS local_radius FROM n)
        SELECT o_orderkey, grid, greatest(4000, least(20000, trunc(n * 0.35::DOUBLE)::INT)) AS long_pairs, long_steps,
            greatest(512, least(2048, trunc(sqrt(n::DOUBLE) * 8)::INT)) AS long_subset, greatest(20, least(80, long_steps // 18)) AS long_refresh,
            greatest(1800, least(12000, trunc(n * 0.2::DOUBLE)::INT)) AS short_pairs, short_steps, local_radius,
            greatest(1, trunc(grid * 0.04::DOUBLE)::INT) AS energy_radius, greatest(30, short_steps // 6) AS recalc_every,
            greatest(1, least(local_radius, trunc(grid * 0.5::DOUBLE)::INT)) AS pair_radius FROM t""",
}

QUERIES = {name: f for name, f in globals().items() if name.startswith("q_")}
