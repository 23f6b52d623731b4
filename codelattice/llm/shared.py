"""What several corpus operators need: size-checked joins, small Arrow batches, connected components."""

from __future__ import annotations

import ctypes
import sys

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codelattice.tables import BROADCAST_ROWS, drop_stored, stored

#: Rows of an Arrow batch that a Python function turns into Python objects at once.
ROWS_AT_ONCE = 500
#: Tables in the shared folder: written, read back, and deleted when nothing reads them any more.
materialise, discard = stored, drop_stored


def sized(side: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """The side of a join broadcast if it is counted to be small, dealt out by the key with the other side if not."""
    return F.broadcast(side) if side.limit(rows + 1).count() <= rows else side.hint("merge")


def slices(batches, rows: int = ROWS_AT_ONCE):
    """Arrow batches in smaller pieces, which bounds what a worker holds as Python objects."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
        del batch
        give_back()


def small_batches(spark: SparkSession) -> SparkSession:
    """Bound the Arrow batches between the JVM and Python where the session has Spark's own, larger bounds.

    A batch of 10,000 whole texts exists several times over, on both sides; 250 rows or 4 MB are
    about as fast.  The setting stays with the session, because its plans run after the operator returns.
    """
    for key, own, wanted in (
        ("spark.sql.execution.arrow.maxRecordsPerBatch", "10000", "250"),
        ("spark.sql.execution.arrow.maxBytesPerBatch", "67108864b", "4194304b"),
    ):
        if spark.conf.get(key, own) == own:
            spark.conf.set(key, wanted)
    return spark


def give_back() -> None:
    """Return freed memory to the system: workers live on between stages, and their peaks would add up."""
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        ctypes.CDLL(None).malloc_trim(0)


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components by alternating large-star and small-star rounds.

    Takes links between long node ids and returns (node, component) for every node that reaches a
    smaller one; component is the smallest id reachable, which itself has no row.  Null ends and
    self links say nothing and are left out.  Each round is a pre-aggregated minimum per node joined back to the
    links, so a hub's links are split by the skew join; no task gathers a component.
    """
    links = (
        edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
        .select(F.greatest(a, b).cast("long").alias("u"), F.least(a, b).cast("long").alias("v"))
        .distinct()
    )
    links = materialise(links, "links")
    state = _fingerprint(links)
    while True:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        larger = _star(both, both.where("v > u"), F.least(F.col("m"), F.col("u")))
        larger = larger.select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: each node's smaller neighbours, and the node itself, link to the smallest
        smaller = _star(larger, larger, F.col("m"))
        least = larger.groupBy("u").agg(F.min("v").alias("v"))
        rest = smaller.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        following = materialise(least.unionByName(rest).distinct(), "links")
        now = _fingerprint(following)
        discard(links)
        links = following
        if now == state:
            return links.select(F.col("u").alias("node"), F.col("v").alias("component"))
        state = now


def _star(all_links: DataFrame, kept: DataFrame, smallest) -> DataFrame:
    """Each kept link (u, v) with m, the smallest neighbour of u.

    The minimum is grouped by the complement of the id: the join then deals out both sides itself, which is
    what lets Spark split the links of a hub over several tasks.
    """
    least = all_links.groupBy(F.bitwise_not("u").alias("k")).agg(F.min("v").alias("m"))
    return kept.join(least, kept["u"] == F.bitwise_not(least["k"])).select("u", "v", smallest.alias("m"))


def _fingerprint(links: DataFrame) -> tuple:
    row = links.agg(
        F.count("*").alias("n"),
        F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s"),
    ).first()
    return row["n"], row["s"]
