"""Exact dedup by content sort, with DataFrame operations only.

Sampled splitters cut the order (leading characters, hash, id) of the normalised texts into
buckets; each bucket is sorted externally by the whole normalised text, which places equal texts
next to each other; the window operator compares whole neighbouring texts and so finds the runs
of equal ones.  The id is part of the splitters: a text that holds a third of all rows is cut into
many buckets, and its runs are merged afterwards from one row per run.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codelattice.llm.shared import BROADCAST_ROWS, materialise

#: Leading characters in the sort key of the splitters; the comparison of texts itself is of whole texts.
LEAD = 32
#: Sampled rows per bucket, and buckets per shuffle partition.
SAMPLE_PER_BUCKET = 16
BUCKETS_PER_PARTITION = 6
#: Buckets at most: it bounds the sample at the driver and the cuts in the plan; larger buckets only sort externally.
MOST_BUCKETS = 32_768


def splitters(keyed: DataFrame, rows: int, buckets: int) -> list:
    """At most buckets - 1 keys (lead, hash, id) that cut the rows about evenly, from a bounded sample."""
    wanted = buckets * SAMPLE_PER_BUCKET
    key = keyed.select("lead", "hash", "id")
    if rows > 2 * wanted:
        key = key.sample(fraction=1.5 * wanted / rows, seed=7)
    sampled = [tuple(r) for r in key.where("id is not null").sort("lead", "hash", "id").collect()]
    return sorted({sampled[i * len(sampled) // buckets] for i in range(1, buckets)}) if sampled else []


def bucket_of(cuts: list, key: Column) -> tuple[Column, Callable[[Column], Column]]:
    """The number of cuts at or below key by binary search, and the cut at a place (null outside)."""
    cut_type = "array<struct<lead:string,hash:bigint,id:bigint>>"
    if not cuts:
        return F.lit(0), lambda at: F.lit(None).cast("struct<lead:string,hash:bigint,id:bigint>")
    as_json = json.dumps([{"lead": lead, "hash": hash_, "id": id_} for lead, hash_, id_ in cuts])
    array = F.from_json(F.lit(as_json), cut_type)  # one literal after constant folding
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(len(cuts).bit_length()))])
    place = F.aggregate(
        steps, F.lit(0), lambda low, step: F.when(F.get(array, low + step - 1) <= key, low + step).otherwise(low)
    )
    return place, lambda at: F.get(array, at)


def exact_groups(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    normalise: Callable[[Column], Column] = lambda text: text,
    keep: str = "smallest",
) -> DataFrame:
    """One row per input row: (id_col, keep_id, group_size, kept, text_sha256).

    Null text: as empty.  Texts are equal if their normalised forms are, byte by byte.  Of equal
    texts the row with the smallest (or, keep="largest", the largest) id stays.  Rows that repeat
    an id and its text each count in group_size, and all of them are kept if the id is.  A null id
    never wins against another one; a group of null ids only has keep_id null and kept false.  An
    empty table gives an empty result; other columns are not looked at.
    """
    if keep not in ("smallest", "largest"):
        raise ValueError("keep is smallest or largest")
    spark = docs.sparkSession
    text = normalise(F.coalesce(F.col(text_col), F.lit("")))
    keyed = docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text"))
    keyed = keyed.select("id", "text", F.substring("text", 1, LEAD).alias("lead"), F.xxhash64("text").alias("hash"))
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.count()
    buckets = max(1, min(BUCKETS_PER_PARTITION * partitions, rows // SAMPLE_PER_BUCKET, MOST_BUCKETS))
    cuts = splitters(keyed, rows, buckets)
    whole_key = F.struct("lead", "hash", F.coalesce("id", F.lit(-(1 << 63))).alias("id"))
    place, cut = bucket_of(cuts, whole_key)
    placed = keyed.select("id", "text", "lead", "hash", place.alias("bucket"))
    same = lambda at: (cut(at)["lead"] == F.col("lead")) & (cut(at)["hash"] == F.col("hash"))
    # a run may go on in another bucket only if it has the lead and hash of a cut beside its own
    goes_on = F.coalesce(same(F.col("bucket")), F.lit(False)) | F.coalesce(same(F.col("bucket") - 1), F.lit(False))
    best_first = F.col("id").asc_nulls_last() if keep == "smallest" else F.col("id").desc_nulls_last()
    run = Window.partitionBy("bucket", "text").orderBy(best_first)
    all_of_run = run.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    runs = (
        placed.repartition(partitions, "bucket")
        .select("*", goes_on.alias("open"))
        .select(
            "id",
            "text",
            "open",
            F.first("id").over(all_of_run).alias("head"),
            F.row_number().over(run).alias("place"),
            F.count("*").over(all_of_run).alias("n"),
        )
        .select(
            "id",
            "open",
            "head",
            "place",
            "n",
            F.sha2("text", 256).alias("text_sha256"),
            F.when(F.col("open") & (F.col("place") == 1), F.col("text")).alias("open_text"),
        )
    )
    runs = materialise(runs, "runs")
    heads = runs.where(F.col("open_text").isNotNull()).select("text_sha256", "open_text", "head", "n")
    pick = F.min if keep == "smallest" else F.max
    merged = (
        heads.groupBy("open_text")
        .agg(F.first("text_sha256").alias("sha"), pick("head").alias("keep_id"), F.sum("n").alias("group_size"))
        .drop("open_text")
    )
    # one row per text that goes on over a cut: bounded by the cuts, but for hash collisions
    merged = materialise(merged, "merged")
    if merged.count() <= BROADCAST_ROWS:
        merged = F.broadcast(merged)
    return runs.join(merged, F.col("open") & (F.col("text_sha256") == F.col("sha")), "left").select(
        F.col("id").alias(id_col),
        F.when(F.col("sha").isNotNull(), F.col("keep_id")).otherwise(F.col("head")).alias("keep_id"),
        F.coalesce("group_size", "n").alias("group_size"),
        F.coalesce(F.col("id") == F.when(F.col("sha").isNotNull(), F.col("keep_id")).otherwise(F.col("head")), F.lit(False)).alias("kept"),
        "text_sha256",
    )
