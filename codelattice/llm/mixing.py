"""Mixing sources to target weights by entropy balancing, with DataFrame operations only.

Of all document rates that meet each source's token target, the ones nearest (in relative
entropy) to keeping every document once are exponentially tilted: rate = exp(lambda * size / mean
size), cut at the largest rate allowed.  The multipliers solve a convex dual that separates by
source; safeguarded Newton iterations find all of them at once, each iteration one aggregation
over the (source, size) histogram.  Rates are then rounded into whole copies with a hash of the
id, and the rest that rounding leaves is settled by moving the documents nearest to a rounding
edge, found from two histograms of their distance to it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codelattice.llm.shared import BROADCAST_ROWS, discard, materialise
from codelattice.tables import ordered_index

WORD = r"[^\x20\x09-\x0D]+"
NEWTON_STEPS, STEPS_PER_JOB = 60, 4
#: Sums of fractions are taken as decimals, so that they do not depend on the order of the rows.
EXACT = "decimal(38,9)"
TOLERANCE = 1e-9
#: Bins of each of the two histograms of the rounding edge.
BINS = 4096


def word_count(text: Column) -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets_by_weight(sources: DataFrame, share: float, ceiling: float) -> DataFrame:
    """(source, source_size, weight) with target: share of all sizes by weight, none above ceiling x its size.

    The excess over a ceiling is shared again among the others by weight until none is above; each
    round is one aggregation to two numbers.
    """
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    budget = share * total
    cap = ceiling * F.col("source_size")
    level = None
    while True:
        above = F.lit(False) if level is None else F.col("weight") * F.lit(level) >= cap
        row = sources.agg(
            F.sum(F.when(above, cap).otherwise(0.0).cast(EXACT)).cast("double").alias("full"),
            F.sum(F.when(above, 0.0).otherwise(F.col("weight")).cast(EXACT)).cast("double").alias("weight"),
        ).first()
        following = (budget - row["full"]) / row["weight"] if row["weight"] else None
        if following is None or following == level:
            break
        level = following
    level = float("inf") if level is None else level
    return sources.withColumn("target", F.least(cap, F.col("weight") * F.lit(level)).cast("double"))


def rank_weights(sources: DataFrame, cycle: tuple[float, ...]) -> DataFrame:
    """Adds weight: the cycle repeated over the sources in code-point order, null last (one row per source)."""
    ranked = ordered_index(sources, [F.col("source").asc_nulls_last()], "place")
    chosen = F.element_at(F.array(*[F.lit(float(w)) for w in cycle]), (F.col("place") % len(cycle) + 1).cast("int"))
    return ranked.withColumn("weight", chosen).drop("place")


def _rate(ceiling: float) -> Column:
    return F.least(F.lit(ceiling), F.exp(F.least(F.lit(700.0), F.col("lam") * F.col("x"))))


def solve_tilts(histogram: DataFrame, targets: DataFrame, ceiling: float) -> DataFrame:
    """(source, mean, lam): the multiplier of each source, by safeguarded Newton on the dual.

    histogram: (source, size, n), targets: (source, source_size, n_docs, target).
    """
    mean = F.greatest(F.lit(1.0), F.col("source_size") / F.col("n_docs"))
    full = F.col("target") >= F.col("source_size") * F.lit(ceiling) * (1 - 1e-12)  # every rate at the ceiling
    state = targets.select(
        "source", "target", mean.alias("mean"), F.when(full, 1e12).otherwise(0.0).alias("lam"),
        F.lit(None).cast("double").alias("low"), F.lit(None).cast("double").alias("high"), full.alias("done"),
    )
    state = materialise(state, "tilts")
    few = state.count() <= BROADCAST_ROWS
    for _ in range(NEWTON_STEPS // STEPS_PER_JOB):
        following = state
        for _ in range(STEPS_PER_JOB):
            following = _newton_step(histogram, following, few, ceiling)
        following = materialise(following, "tilts")
        discard(state)
        state = following
        if not state.where("not done").limit(1).count():
            break
    return state.select("source", "mean", "lam")


def _newton_step(histogram: DataFrame, state: DataFrame, few: bool, ceiling: float) -> DataFrame:
    """The state (source, target, mean, lam, low, high, done) after one safeguarded step of every source."""
    side = F.broadcast(state) if few else state
    at = histogram.join(side, histogram["source"].eqNullSafe(side["source"])).select(
        side["source"], "target", "mean", "lam", "low", "high", "done", "size", "n", (F.col("size") / F.col("mean")).alias("x")
    )
    rate = _rate(ceiling)
    moves = F.when(rate < ceiling, F.col("n") * F.col("size") * F.col("x") * rate).otherwise(0.0)
    sums = at.groupBy("source", "target", "mean", "lam", "low", "high", "done").agg(
        F.sum((F.col("n") * F.col("size") * rate).cast(EXACT)).cast("double").alias("got"),
        F.sum(moves.cast(EXACT)).cast("double").alias("slope"),
    )
    gap = F.col("target") - F.col("got")
    low = F.when(gap > 0, F.col("lam")).otherwise(F.col("low"))
    high = F.when(gap < 0, F.col("lam")).otherwise(F.col("high"))
    newton = F.col("lam") + F.try_divide(gap, F.col("slope"))
    inside = F.coalesce(newton > F.col("low2"), F.lit(True)) & F.coalesce(newton < F.col("high2"), F.lit(True))
    halved = F.when(F.col("low2").isNull(), F.col("high2") * 2 - 1).when(F.col("high2").isNull(), F.col("low2") * 2 + 1)
    halved = halved.otherwise((F.col("low2") + F.col("high2")) / 2)
    sums = sums.select("*", low.alias("low2"), high.alias("high2"))
    # far steps are shortened: the multiplier at most about doubles
    far = 4 + F.abs("lam")
    newton = F.greatest(F.col("lam") - far, F.least(F.col("lam") + far, newton))
    near = F.col("done") | (F.abs(gap) <= TOLERANCE * F.greatest(F.lit(1.0), F.col("target")))
    stuck = F.coalesce(F.abs(F.col("high2") - F.col("low2")) < 1e-14, F.lit(False))
    return sums.select(
        "source", "target", "mean",
        F.when(near | stuck, F.col("lam")).when(newton.isNotNull() & inside, newton).otherwise(halved).alias("lam"),
        F.col("low2").alias("low"), F.col("high2").alias("high"), (near | stuck).alias("done"),
    )


def mix(
    docs: DataFrame,
    cycle: tuple[float, ...] = (3.0, 1.0, 2.0),
    share: float = 1.5,
    ceiling: int = 2,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    seed: int = 11,
    weights: DataFrame | None = None,
) -> DataFrame:
    """One row per input row: (id_col, source, size, source_size, target, rate, copies, taken).

    weights: (source, weight); without it the cycle is dealt over the sources in code-point order,
    null last.  Null or blank text: size 0, rate 1, one copy of nothing.  A null source is a source
    like any other.  copies is at most ceiling.  Rounding depends on id, size and seed alone, so
    reruns agree and rows that repeat an id and its text get equal copies.  An empty table gives an
    empty result; other columns are not looked at.
    """
    sized = materialise(
        docs.select(
            F.col(id_col).cast("long").alias("id"), F.col(source_col).cast("string").alias("source"),
            word_count(F.col(text_col)).alias("size"),
        ),
        "sizes",
    )
    histogram = materialise(sized.groupBy("source", "size").agg(F.count("*").alias("n")), "histogram")
    sources = histogram.groupBy("source").agg(
        F.sum(F.col("size") * F.col("n")).alias("source_size"), F.sum("n").alias("n_docs")
    )
    sources = materialise(sources, "sources")
    if weights is None:
        weighed = rank_weights(sources, cycle)
    else:
        named = weights.select(F.col("source").alias("w_source"), "weight")
        weighed = sources.join(named, F.col("source").eqNullSafe(F.col("w_source")), "left").drop("w_source")
        weighed = weighed.withColumn("weight", F.coalesce("weight", F.lit(0.0)))
    targets = materialise(targets_by_weight(weighed, share, ceiling), "targets")
    tilts = solve_tilts(histogram, targets, float(ceiling))
    plan = targets.join(tilts.withColumnRenamed("source", "t_source"), F.col("source").eqNullSafe(F.col("t_source"))).select(
        F.col("source").alias("p_source"), "source_size", "target", "mean", "lam"
    )
    plan = materialise(plan, "plan")
    few = plan.count() <= BROADCAST_ROWS
    spread = F.broadcast(plan) if few else plan
    noise = (F.xxhash64(F.lit(seed), F.col("id"), F.col("size")).bitwiseAND((1 << 40) - 1) + 0.5) / float(1 << 40)
    rated = (
        sized.join(spread, F.col("source").eqNullSafe(F.col("p_source")))
        .withColumn("x", F.col("size") / F.col("mean"))
        .select(F.col("id"), "source", "size", "source_size", "target", F.when(F.col("size") == 0, 1.0).otherwise(_rate(ceiling)).alias("rate"))
        .withColumn("sum", F.col("rate") + noise)
        .withColumn("copies", F.floor("sum").cast("long"))
        .withColumn("copies", F.least("copies", F.lit(ceiling)))
        .withColumn("edge", F.least(F.lit(BINS * BINS - 1), F.floor((F.col("sum") - F.floor("sum")) * (BINS * BINS)).cast("long")))
    )
    rounded = settle(rated, ceiling, few)
    return rounded.select(
        F.col("id").alias(id_col), F.col("source").alias(source_col), "size", "source_size", "target", "rate",
        "copies", (F.col("copies") * F.col("size")).alias("taken"),
    )


def settle(rated: DataFrame, ceiling: int, few: bool, rounds: int = 8, near: float = 1e-3) -> DataFrame:
    """Move documents over their rounding edge, nearest first, while the source's gap allows it.

    A source that got too little moves up documents whose sum is just below the next whole number
    (largest edge first), one that got too much moves down those just above one.  The cut in edge
    order is found from a histogram of 4096 bins and one of its boundary bin, so no task sorts a
    source's documents.  A document larger than the gap ends a round; the next round looks only at
    documents that the rest of the gap can take, until every source is near or the rounds are over.
    """
    rated = materialise(rated, "rated")
    for _ in range(rounds):
        got = rated.groupBy("source").agg(
            F.first("target").alias("want"), F.sum(F.col("copies") * F.col("size")).alias("got")
        )
        off = F.col("want") - F.col("got")
        gap = got.select(F.col("source").alias("g_source"), F.when(F.abs(off) > near * F.col("want"), off).alias("gap"))
        gap = materialise(gap.where("gap is not null"), "gaps")
        if not gap.limit(1).count():
            break
        side = F.broadcast(gap) if few else gap
        facing = rated.join(side, F.col("source").eqNullSafe(F.col("g_source")), "left").drop("g_source")
        up = F.col("gap") > 0
        facing = facing.withColumn("order", F.when(up, F.lit(BINS * BINS - 1) - F.col("edge")).otherwise(F.col("edge")))
        # copies at the ceiling cannot move up, documents with none cannot move down
        movable = (F.col("size") > 0) & F.when(up, F.col("copies") < ceiling).otherwise(F.col("copies") > 0)
        movable = F.coalesce(movable & (F.col("size") <= F.abs("gap")), F.lit(False))
        moving = facing.where(movable).select(
            "source", "size", F.abs("gap").alias("amount"),
            F.expr(f"`order` div {BINS}").alias("bin"), F.expr(f"`order` % {BINS}").alias("fine"),
        )
        coarse = materialise(_cut(moving), "coarse")
        side = coarse.select("c_source", F.col("edge_bin").alias("at"), "rest")
        side = F.broadcast(side) if few else side
        inside = moving.join(side, F.col("source").eqNullSafe(F.col("c_source")) & (F.col("bin") == F.col("at")))
        fine = _cut(inside.select("source", "size", F.col("rest").alias("amount"), F.col("fine").alias("bin")))
        fine = fine.select(F.col("c_source").alias("f_source"), F.col("edge_bin").alias("fine_bin"))
        cut = coarse.join(fine, F.col("c_source").eqNullSafe(F.col("f_source")), "left").select(
            "c_source", (F.col("edge_bin") * BINS + F.coalesce("fine_bin", F.lit(0))).alias("cut")
        )
        cut = materialise(cut, "cuts")
        side = F.broadcast(cut) if few else cut
        moved = facing.join(side, F.col("source").eqNullSafe(F.col("c_source")), "left")
        moves = movable & F.coalesce(F.col("order") < F.col("cut"), F.lit(False))
        step = F.when(moves, F.when(up, F.lit(1)).otherwise(F.lit(-1))).otherwise(F.lit(0))
        following = materialise(moved.withColumn("copies", F.col("copies") + step).select(rated.columns), "rated")
        discard(rated)
        rated = following
    return rated


def _cut(rows: DataFrame) -> DataFrame:
    """(c_source, edge_bin, rest): the first bin that the source's amount cannot take whole, and what is left for it."""
    bins = rows.groupBy("source", "bin").agg(F.sum("size").alias("mass"), F.first("amount").alias("amount"))
    running = F.sum("mass").over(Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0))
    bins = bins.select("source", "bin", "amount", running.alias("upto"))
    over = F.col("upto") > F.col("amount")
    return bins.groupBy(F.col("source").alias("c_source")).agg(
        F.coalesce(F.min(F.when(over, F.col("bin"))), F.lit(BINS)).alias("edge_bin"),
        (F.first("amount") - F.coalesce(F.max(F.when(~over, F.col("upto"))), F.lit(0))).alias("rest"),
    )
