"""Tables in the shared folder, size-checked broadcasts, and a global order without a single task."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side of at most this many rows may be broadcast.
BROADCAST_ROWS = 50_000
_own_folder: list[str] = []
_written: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a temporary one where that is unset and driver and executors are one process.

    Any other master without the setting is an error: its executors would write to disks of their own.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _own_folder:
        _own_folder.append(tempfile.mkdtemp(prefix="codelattice-"))
        atexit.register(shutil.rmtree, _own_folder[0], True)
    return f"file://{_own_folder[0]}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back; cuts lineage and survives lost executors."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    _written.append(path)
    df.write.parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table.stored_at = path
    return table


def _delete(spark: SparkSession, where: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(where)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    if where in _written:
        _written.remove(where)


def drop_stored(*tables: DataFrame) -> None:
    """Delete stored tables that nothing will read again."""
    for table in tables:
        _delete(table.sparkSession, table.stored_at)


def written() -> int:
    """A mark in the list of stored tables, for sweep."""
    return len(_written)


def sweep(spark: SparkSession, since: int = 0, keep: tuple[DataFrame, ...] = ()) -> None:
    """Delete the tables stored since a mark but for those kept, once nothing lazy reads them any more."""
    kept = {table.stored_at for table in keep}
    for path in _written[since:]:
        if path not in kept:
            _delete(spark, path)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast a side if it is counted to be small; otherwise leave the join to the planner."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def ordered_index(df: DataFrame, order: list[Column], name: str = "index") -> DataFrame:
    """Adds the 0-based position of every row in the given order, by a range-partitioned sort.

    Rows are numbered inside their sorted partition; the partitions' sizes, one number each, give
    the offsets.  No task sees more than a partition.
    """
    place = "__place"
    sorted_rows = stored(
        df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(place, F.monotonically_increasing_id()),
        "ordered",
    )
    part = F.shiftright(place, 33)
    sizes = sorted(sorted_rows.groupBy(part.alias("part")).count().collect())
    offsets, total = [], 0
    for number, size in sizes:
        offsets += [F.lit(number), F.lit(total).cast("long")]
        total += size
    offset = F.create_map(*offsets)[part] if offsets else F.lit(0).cast("long")
    return sorted_rows.withColumn(name, offset + F.col(place).bitwiseAND((1 << 33) - 1)).drop(place)
