"""Queries over step logs: stop rules, schedules and thinning."""

from __future__ import annotations

from pyspark.sql import functions as F

from codelattice.operators import monitors as M
from codelattice.queries.fixtures import PAIRS_SQL, POINTS_SQL, pairs, points, step_log, table


def q_energy_stability(spark, sf_dir):
    rows = M.energy_stability(step_log(spark, sf_dir), 3, 60.0)
    return rows.select("run", "step", F.round("diff", 6).alias("diff"), F.round("max_delta", 6).alias("max_delta"), F.coalesce("stop", F.lit(False)).alias("stop"))


def q_swap_stall(spark, sf_dir):
    rows = M.swap_stall(step_log(spark, sf_dir), 2, 0.1)
    return rows.select("run", "step", F.round("ratio", 9).alias("ratio"), F.round("average", 9).alias("average"), "stop")


def q_energy_progress(spark, sf_dir):
    return M.energy_progress(step_log(spark, sf_dir)).select("run", "step", F.round("progress", 6).alias("progress"))


def q_state_log(spark, sf_dir):
    """Energies measured at the steps that swapped something over 50, carried on over the others."""
    log = step_log(spark, sf_dir).withColumn("energy", F.when(F.col("swaps") > 50, F.col("energy")))
    return M.state_log(log).select("run", "step", F.round("energy", 6).alias("energy"), "energy_step", F.round("energy_diff", 6).alias("energy_diff"))


def q_adaptive(spark, sf_dir):
    log = step_log(spark, sf_dir).select("run", F.floor(F.col("step") / 10).alias("step"), "swaps")
    log = log.groupBy("run", "step").agg(F.sum("swaps").alias("swaps"))
    rows = M.adaptive(log, start=12, end=1, total=1000, trigger=0.25, lambda_start=0.65, lambda_step=0.05)
    return rows.select("run", "step", "radius", F.round("ratio", 9).alias("ratio"), F.round("lambda", 9).alias("lambda"))


def q_log_thin(spark, sf_dir):
    log = table(spark, sf_dir, "events").select(F.col("event_type").alias("event"), F.col("event_id").alias("seq"))
    return M.thinned(log, 7)


def q_auto_radius(spark, sf_dir):
    placed = points(spark, sf_dir)
    rows = pairs(spark, sf_dir, placed).withColumn("run", F.col("seq") % 4)
    return M.auto_radius(rows).select("run", F.round("avg_distance", 6).alias("avg_distance"), "radius")


_LOG = "log AS (SELECT user_id AS run, event_id AS step, value AS energy, floor(value)::INT AS swaps, 300 AS pairs FROM events)"

ORACLE = {
    "q_energy_stability": f"""WITH {_LOG}, d AS (SELECT run, step, abs(energy - lag(energy) OVER (PARTITION BY run ORDER BY step)) AS diff FROM log)
        SELECT run, step, round(diff, 6) AS diff, round(coalesce(max(diff) OVER w, 0), 6) AS max_delta, count(diff) OVER w = 3 AND coalesce(max(diff) OVER w < 60, false) AS stop
        FROM d WINDOW w AS (PARTITION BY run ORDER BY step ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)""",
    "q_swap_stall": f"""WITH {_LOG}, r AS (SELECT run, step, swaps / pairs::DOUBLE AS ratio FROM log)
        SELECT run, step, round(ratio, 9) AS ratio, round(avg(ratio) OVER w, 9) AS average, count(*) OVER w = 2 AND avg(ratio) OVER w <= 0.1::DOUBLE AS stop
        FROM r WINDOW w AS (PARTITION BY run ORDER BY step ROWS BETWEEN 1 PRECEDING AND CURRENT ROW)""",
    "q_energy_progress": f"WITH {_LOG} SELECT run, step, round(lag(energy) OVER (PARTITION BY run ORDER BY step) - energy, 6) AS progress FROM log",
    "q_state_log": f"""WITH {_LOG}, m AS (SELECT run, step, CASE WHEN swaps > 50 THEN energy END AS energy, CASE WHEN swaps > 50 THEN step END AS seen FROM log),
        c AS (SELECT run, step, last_value(energy IGNORE NULLS) OVER w AS energy, last_value(seen IGNORE NULLS) OVER w AS energy_step FROM m
              WINDOW w AS (PARTITION BY run ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
        d AS (SELECT *, energy - lag(energy) OVER w AS diff, energy_step <> lag(energy_step) OVER w AS fresh FROM c WINDOW w AS (PARTITION BY run ORDER BY step))
        SELECT run, step, round(energy, 6) AS energy, energy_step, CASE WHEN fresh THEN round(diff, 6) END AS energy_diff FROM d""",
    "q_adaptive": f"""WITH RECURSIVE {_LOG}, steps AS (
            SELECT run, step // 10 AS step, sum(swaps) AS swaps, row_number() OVER (PARTITION BY run ORDER BY step // 10) AS rn FROM log GROUP BY run, step // 10
        ), base AS (
            SELECT *, greatest(1, round_even(12 - 11 * (step / 999::DOUBLE), 0)::INT) AS base FROM steps
        ), s AS (
            SELECT run, 0::BIGINT AS rn, NULL::BIGINT AS step, NULL::INT AS radius, NULL::DOUBLE AS ratio, 0.65::DOUBLE AS lam, NULL::BIGINT AS initial, 12 AS cap
            FROM (SELECT DISTINCT run FROM base)
            UNION ALL
            SELECT b.run, b.rn, b.step, least(b.base, s.cap), b.swaps / coalesce(s.initial, greatest(1, b.swaps))::DOUBLE,
                CASE WHEN b.swaps / coalesce(s.initial, greatest(1, b.swaps))::DOUBLE <= 0.25 THEN least(1::DOUBLE, s.lam + 0.05::DOUBLE) ELSE s.lam END,
                CASE WHEN b.swaps / coalesce(s.initial, greatest(1, b.swaps))::DOUBLE <= 0.25 THEN greatest(1, b.swaps)::BIGINT ELSE coalesce(s.initial, greatest(1, b.swaps))::BIGINT END,
                CASE WHEN b.swaps / coalesce(s.initial, greatest(1, b.swaps))::DOUBLE <= 0.25 THEN least(s.cap, greatest(1, floor(b.base * 0.5::DOUBLE)::INT)) ELSE s.cap END
            FROM s JOIN base b ON b.run = s.run AND b.rn = s.rn + 1
        ) SELECT run, step, radius, round(ratio, 9) AS ratio, round(lam, 9) AS lambda FROM s WHERE rn > 0""",
    "q_log_thin": """SELECT event, seq FROM (SELECT event_type AS event, event_id AS seq, row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS n FROM events) WHERE n % 7 = 0""",
    "q_auto_radius": f"""WITH {POINTS_SQL}, {PAIRS_SQL}, m AS (SELECT seq % 4 AS run, avg(sqrt(((y1 - y2) * (y1 - y2) + (x1 - x2) * (x1 - x2))::DOUBLE)) AS avg_distance FROM pairs GROUP BY 1)
        SELECT run, round(avg_distance, 6) AS avg_distance, greatest(1, round_even(avg_distance, 0)::INT) AS radius FROM m""",
}

QUERIES = {name: f for name, f in globals().items() if name.startswith("q_")}
