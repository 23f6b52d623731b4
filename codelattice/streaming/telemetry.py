"""Step logs as a stream: the stop rules of a run while it writes its log."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codelattice.operators.monitors import energy_stability, swap_stall
from codelattice.plans.layout import STEP_LOG



def read_step_log(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of a folder of Parquet files of STEP_LOG, as they arrive."""
    return spark.readStream.schema(STEP_LOG).parquet(folder)


def watch(log: DataFrame, checkpoint: str, on_stop: Callable[[DataFrame], None], window: int = 20, delta: float = 5e-4, stall_window: int = 1, min_ratio: float = 0.003):
    """Start a query that hands on_stop the steps (run, step, why) at which a run's rules ask for a stop, each once.

    The rules look back over a window of steps.  State per run holds the last steps of the window
    and the last step judged, so a batch costs its own rows; steps of a run arrive in order, and
    one that comes after a later step is left out.
    """
    keep = max(window + 1, stall_window)

    def judge(key, batches, state):
        held = list(zip(*state.get)) if state.exists else []
        last = held[-1][0] if held else -1
        out = []
        rows = sorted({tuple(r) for pdf in batches for r in pdf[["step", "swaps", "pairs", "energy"]].itertuples(index=False)})
        for step, swaps, pairs, energy in rows:
            if step <= last:
                continue
            last = step
            held = [*held, (step, swaps / pairs if pairs else 0.0, energy)]
            ratios = [r for _, r, _ in held[-stall_window:]]
            measured = [e for _, _, e in held if e == e][-window - 1 :]
            if len(ratios) == stall_window and sum(ratios) / stall_window <= min_ratio:
                out.append((key[0], step, "swaps"))
            if energy == energy and len(measured) > window and max(abs(a - b) for a, b in zip(measured, measured[1:])) < delta:
                out.append((key[0], step, "energy"))
            known = [n for n, h in enumerate(held) if h[2] == h[2]][-window - 1 :]
            held = [h for n, h in enumerate(held) if n in known or n >= len(held) - keep]
        state.update(tuple([h[k] for h in held] for k in range(3)))
        yield pd.DataFrame(out, columns=["run", "step", "why"])

    rows = log.select("run", "step", "swaps", "pairs", F.col("energy").cast("double").alias("energy"))
    stops = rows.groupBy("run").applyInPandasWithState(
        judge, "run string, step long, why string", "step array<long>, ratio array<double>, energy array<double>", "append", "NoTimeout"
    )
    return stops.writeStream.foreachBatch(lambda found, _: on_stop(found)).option("checkpointLocation", checkpoint).start()


def stops_of(log: DataFrame, window: int = 20, delta: float = 5e-4, stall_window: int = 1, min_ratio: float = 0.003) -> DataFrame:
    """(run, step, why) of a finished log: the same rules as window functions."""
    calm = energy_stability(log.where("energy is not null"), window, delta).where("stop").selectExpr("run", "step", "'energy' as why")
    idle = swap_stall(log, stall_window, min_ratio).where("stop").selectExpr("run", "step", "'swaps' as why")
    return calm.unionByName(idle)
