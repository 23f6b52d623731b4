"""Stop rules and adaptive schedules over step logs (run, step, ...), as window functions per run."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codelattice.tables import ordered_index, small


def _by_step(run: str, step: str):
    return Window.partitionBy(run).orderBy(step)


def energy_stability(log: DataFrame, window: int, delta: float, run: str = "run", step: str = "step", energy: str = "energy") -> DataFrame:
    """Adds diff, max_delta and stop: the last window differences are all there and below delta."""
    by = _by_step(run, step)
    last = by.rowsBetween(-(window - 1), 0)
    rows = log.withColumn("diff", F.abs(F.col(energy) - F.lag(energy).over(by)))
    full = F.count("diff").over(last) == window
    return rows.withColumn("max_delta", F.coalesce(F.max("diff").over(last), F.lit(0.0))).withColumn("stop", full & (F.max("diff").over(last) < delta))


def swap_stall(log: DataFrame, window: int, min_ratio: float, run: str = "run", step: str = "step", swaps: str = "swaps", pairs: str = "pairs") -> DataFrame:
    """Adds ratio, average and stop: the mean swap ratio of a full window is at most min_ratio."""
    last = _by_step(run, step).rowsBetween(-(window - 1), 0)
    rows = log.withColumn("ratio", F.when(F.col(pairs) > 0, F.col(swaps) / F.col(pairs)).otherwise(0.0))
    rows = rows.withColumn("average", F.avg("ratio").over(last))
    return rows.withColumn("stop", (F.count("ratio").over(last) == window) & (F.col("average") <= min_ratio))


def energy_progress(log: DataFrame, run: str = "run", step: str = "step", energy: str = "energy") -> DataFrame:
    """Adds progress: the energy before less the energy now, null at a run's first step."""
    return log.withColumn("progress", F.lag(energy).over(_by_step(run, step)) - F.col(energy))


def state_log(log: DataFrame, run: str = "run", step: str = "step", energy: str = "energy") -> DataFrame:
    """(run, step, energy, energy_step, energy_diff): the last measured energy at every step and how it changed.

    energy_diff is null where no new measurement was made since the step before, and at the first one.
    """
    by = _by_step(run, step)
    so_far = by.rowsBetween(Window.unboundedPreceding, 0)
    measured = F.when(F.col(energy).isNotNull(), F.struct(F.col(energy).alias("value"), F.col(step).alias("at")))
    rows = log.select(run, step, F.last(measured, ignorenulls=True).over(so_far).alias("now"))
    rows = rows.withColumn("before", F.lag("now").over(by))
    diff = F.when(F.col("now.at") != F.col("before.at"), F.col("now.value") - F.col("before.value"))
    return rows.select(run, step, F.col("now.value").alias("energy"), F.col("now.at").alias("energy_step"), diff.alias("energy_diff"))


def thinned(log: DataFrame, every: int, event: str = "event", seq: str = "seq") -> DataFrame:
    """Every so-many-th occurrence of each event, the first included.

    Occurrences are counted from a range-partitioned order of all rows less the event's first place
    in it, so an event that is most of the log is not counted by one task.
    """
    ranked = ordered_index(log, [F.col(event).asc(), F.col(seq).asc()], "__n")
    first = ranked.groupBy(F.col(event).alias("__event")).agg(F.min("__n").alias("__first"))
    rows = ranked.join(small(first), F.col(event).eqNullSafe(F.col("__event")))
    return rows.where((F.col("__n") - F.col("__first")) % every == 0).select(log.columns)


def decayed(step: int, start: int, end: int, total: int) -> int:
    """Linear decay from start to end over the steps, rounded half to even, not below end."""
    return end if total <= 1 else max(end, round(start - (start - end) * (step / (total - 1))))


def followed(swaps: Iterable[tuple[int, int]], start: int, end: int, total: int, trigger: float, level: float, raise_by: float | None) -> Iterator[tuple[int, float, float, int]]:
    """(radius, ratio, threshold, most) for each (step, swaps) in order: the radius of the step, the ratio of
    its swaps to the reference number, the threshold after it, and the largest radius that later steps may use.

    A ratio at or below the trigger halves the decayed radius of the step into that bound, makes the
    step the reference, and raises the threshold, to 1 at most.
    """
    most, reference = max(start, end), 0
    for step, n in swaps:
        radius = decayed(step, start, end, total)
        used, reference = min(radius, most), reference or max(1, n)
        ratio = n / reference
        if ratio <= trigger:
            most, reference = min(most, max(end, radius // 2)), max(1, n)
            level = min(1.0, level + (raise_by or 0.0))
        yield used, ratio, level, most


def adaptive(log: DataFrame, start: int, end: int, total: int, trigger: float, lambda_start: float, lambda_step: float | None, run: str = "run", step: str = "step", swaps: str = "swaps") -> DataFrame:
    """(run, step, radius, ratio, lambda): the radius used at each step, the swap ratio after it and the threshold then.

    Every step depends on all before it, so a run is followed in order by one task, in time and
    memory in proportion to its steps; runs are independent.
    """
    kind = log.schema[run].dataType.simpleString()

    def follow(key, pdf):
        pdf = pdf.sort_values("step", ignore_index=True)
        pairs = zip(pdf["step"].tolist(), pdf["swaps"].tolist())
        found = list(followed(pairs, start, end, total, trigger, float(lambda_start), lambda_step))
        return pd.DataFrame({run: [key[0]] * len(pdf), "step": pdf["step"], "radius": [f[0] for f in found], "ratio": [f[1] for f in found], "lambda": [f[2] for f in found]})

    rows = log.select(run, F.col(step).cast("long").alias("step"), F.col(swaps).cast("long").alias("swaps"))
    return rows.groupBy(run).applyInPandas(follow, f"`{run}` {kind}, step long, radius int, ratio double, lambda double")


def auto_radius(accepted: DataFrame, run: str = "run") -> DataFrame:
    """(run, avg_distance, radius): mean distance of the accepted swaps (y1, x1, y2, x2), rounded half to even, at least 1."""
    dy, dx = F.col("y1") - F.col("y2"), F.col("x1") - F.col("x2")
    mean = accepted.groupBy(run).agg(F.avg(F.sqrt((dy * dy + dx * dx).cast("double"))).alias("avg_distance"))
    return mean.withColumn("radius", F.greatest(F.lit(1), F.bround("avg_distance", 0).cast("int")))
