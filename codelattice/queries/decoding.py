"""Queries over nearest neighbours, votes, predictions and calibration.

The queries of the searches are the vectors whose id is divisible by 50; the memory is all vectors.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from codelattice.functions import bits as B
from codelattice.operators import decode as D
from codelattice.operators.pairs import query_blocks
from codelattice.queries.fixtures import DENSE, DENSE_SQL, LENGTH, codes

CLASSES = list(range(10))


def _memory(spark, sf_dir):
    return codes(spark, sf_dir, DENSE).select(F.col("point_id").alias("memory_id"), "label", B.pack(F.col("bits"), LENGTH).alias("words"), F.size("bits").alias("ones"))


def _queries(spark, sf_dir):
    rows = _memory(spark, sf_dir).where("memory_id % 50 = 0")
    return rows.select(F.col("memory_id").alias("query_id"), "label", "words", "ones")


def _found(spark, sf_dir):
    return query_blocks(_queries(spark, sf_dir).drop("label"), _memory(spark, sf_dir), "jaccard2")


def _voting(spark, sf_dir):
    return D.nearest(_found(spark, sf_dir))


def q_knn_global(spark, sf_dir):
    return D.nearest(_found(spark, sf_dir), k_total=50, k_per_class=0).select("query_id", "memory_id", F.round("sim", 9).alias("sim"))


def q_knn_balanced(spark, sf_dir):
    return _voting(spark, sf_dir).select("query_id", "label", "memory_id", F.round("sim", 9).alias("sim"))


def q_soft_vote(spark, sf_dir):
    return D.soft_vote(_voting(spark, sf_dir)).select("query_id", "label", F.round("weight", 6).alias("weight"), F.round("best_sim", 9).alias("best_sim"), "n")


def q_top_classes(spark, sf_dir):
    votes = D.soft_vote(_voting(spark, sf_dir)).withColumn("weight", F.round("weight", 6))
    return D.top_classes(votes)


def q_predict(spark, sf_dir):
    found = D.predictions(_queries(spark, sf_dir), D.soft_vote(_voting(spark, sf_dir)), CLASSES)
    return found.select("query_id", "predicted_class", F.round("confidence", 6).alias("confidence"))


def q_accuracy(spark, sf_dir):
    queries = _queries(spark, sf_dir)
    found = D.predictions(queries, D.soft_vote(_voting(spark, sf_dir)), CLASSES)
    return D.accuracy(found, queries).select("n", F.round("accuracy", 9).alias("accuracy"))


def q_calibrate(spark, sf_dir):
    found = D.calibrate(_voting(spark, sf_dir), _queries(spark, sf_dir), CLASSES)
    return found.select("temperature", "n", F.round("accuracy", 9).alias("accuracy"), "best")


KNN_SQL = f"""{DENSE_SQL}, met AS (
    SELECT q.point_id AS query_id, m.point_id AS memory_id, count(*) AS common
    FROM bits q JOIN bits m ON q.bit = m.bit WHERE q.point_id % 50 = 0 AND q.point_id <> m.point_id GROUP BY ALL
), found AS (
    SELECT query_id, m.label, memory_id, (common / (q.ones + m.ones - common)::DOUBLE) * (common / (q.ones + m.ones - common)::DOUBLE) AS sim
    FROM met JOIN codes q ON q.point_id = query_id JOIN codes m ON m.point_id = memory_id
), voting AS (
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, label ORDER BY sim DESC, memory_id) AS rn FROM found) WHERE rn <= 20
)"""
VOTE_SQL = f"""{KNN_SQL}, votes AS (
    SELECT query_id, t.t AS temperature, label, sum(exp((sim - top) / t.t)) AS weight, max(sim) AS best_sim, count(*) AS n
    FROM (SELECT *, max(sim) OVER (PARTITION BY query_id) AS top FROM voting), (VALUES (0.25::DOUBLE), (0.35::DOUBLE), (0.5::DOUBLE), (0.75::DOUBLE), (1::DOUBLE)) t(t)
    GROUP BY ALL
), shares AS (
    SELECT query_id, temperature, label, round(weight / sum(weight) OVER (PARTITION BY query_id, temperature), 9) AS p FROM votes
), predicted AS (
    SELECT query_id, temperature, arg_min(label, struct_pack(p := -p, l := label)) AS predicted_class, max(p) AS confidence FROM shares GROUP BY ALL
), rates AS (
    SELECT temperature, count(*) AS n, round(avg((predicted_class = label)::INT), 9) AS accuracy
    FROM predicted JOIN codes ON point_id = query_id GROUP BY temperature
)"""

ORACLE = {
    "q_knn_global": f"""WITH {KNN_SQL} SELECT query_id, memory_id, round(sim, 9) AS sim FROM
        (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, memory_id) AS rn FROM found) WHERE rn <= 50""",
    "q_knn_balanced": f"WITH {KNN_SQL} SELECT query_id, label, memory_id, round(sim, 9) AS sim FROM voting",
    "q_soft_vote": f"WITH {VOTE_SQL} SELECT query_id, label, round(weight, 6) AS weight, round(best_sim, 9) AS best_sim, n FROM votes WHERE temperature = 0.35::DOUBLE",
    "q_top_classes": f"""WITH {VOTE_SQL} SELECT query_id, rank::INT AS rank, label, weight FROM (SELECT query_id, label, round(weight, 6) AS weight,
        row_number() OVER (PARTITION BY query_id ORDER BY round(weight, 6) DESC, label) AS rank FROM votes WHERE temperature = 0.35::DOUBLE) WHERE rank <= 3""",
    "q_predict": f"WITH {VOTE_SQL} SELECT query_id, predicted_class, round(confidence, 6) AS confidence FROM predicted WHERE temperature = 0.35::DOUBLE",
    "q_accuracy": f"WITH {VOTE_SQL} SELECT n, accuracy FROM rates WHERE temperature = 0.35::DOUBLE",
    "q_calibrate": f"""WITH {VOTE_SQL} SELECT temperature, n, accuracy,
        temperature = (SELECT arg_min(temperature, struct_pack(a := -accuracy, t := temperature)) FROM rates) AS best FROM rates""",
}

QUERIES = {name: f for name, f in globals().items() if name.startswith("q_")}
