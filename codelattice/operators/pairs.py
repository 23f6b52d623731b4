"""Similarity joins of sparse codes over an inverted index, and over blocks of queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codelattice.functions import bits as B
from codelattice.functions.similarity import similarity
from codelattice.tables import BROADCAST_ROWS

#: Meetings over an inverted index that cost as much as one comparison of packed codes: a meeting is shuffled, a comparison is not.
MEETINGS_PER_COMPARISON = 0.05
#: Rows of one block of the right side; what a row of the left makes with it is held in memory at once.
ROWS_PER_BLOCK = 4096
#: Bytes of packed codes that one task of a comparison holds of the right side.
BYTES_PER_TASK = 32 << 20
TASKS_PER_CORE = 8


def meetings(left: DataFrame, right: DataFrame) -> tuple[int, int]:
    """(rows that an inverted index of both sides makes, largest bit + 1), from the number of codes that hold each bit."""
    held = lambda side: side.select(F.explode("bits").alias("bit")).groupBy("bit").agg(F.count("*").alias("n"))
    a, b = held(left).withColumnRenamed("n", "n_a"), held(right).withColumnRenamed("n", "n_b")
    row = a.join(b, "bit").agg(F.sum(F.col("n_a").cast("decimal(38,0)") * F.col("n_b")), F.max("bit")).first()
    return (int(row[0]), row[1] + 1) if row[0] is not None else (0, 0)


def word_columns(bits: Column, length: int, prefix: str) -> list[Column]:
    """The packed code as one column per word, prefix0 and so on, which generated code reads without a loop."""
    words = B.pack(bits, length)
    return [F.get(words, F.lit(w)).alias(f"{prefix}{w}") for w in range((length + 63) // 64)]


def common_words(prefix_a: str, prefix_b: str, length: int) -> Column:
    """Number of positions active in both codes of word_columns."""
    return sum((F.bit_count(F.col(f"{prefix_a}{w}").bitwiseAND(F.col(f"{prefix_b}{w}"))) for w in range((length + 63) // 64)), F.lit(0)).cast("int")


def crossed(left: DataFrame, right: DataFrame, by: str, upper: str | None = None, rows_per_block: int = ROWS_PER_BLOCK) -> DataFrame:
    """Every row of left beside every row of right; no pair is shuffled or stored, so disk grows with the rows only.

    by: a column of right without many equal values, which deals it out into blocks.  A block travels
    as one row and a task holds a bounded number of them, against its part of the left rows.  The
    sides' columns must not share names.  upper: left's column like by, where both sides are the same
    rows; then a pair of different rows is met once, in either order.
    """
    rows = right.count()
    blocks = max(1, -(-rows // rows_per_block))
    number = lambda c: F.pmod(F.xxhash64(c), F.lit(blocks)).cast("int")
    packed = right.groupBy(number(by).alias("__block")).agg(F.collect_list(F.struct(*right.columns)).alias("__others"))
    tasks = TASKS_PER_CORE * left.sparkSession.sparkContext.defaultParallelism
    parts = max(1, -(-rows * 16 * (len(right.columns) + 1) // BYTES_PER_TASK))
    packed = packed.repartition(parts)
    facing = left if upper is None else left.withColumn("__own", number(upper))
    # the hint keeps the blocks from being sent to the driver, and left rows from being looped over inside one block
    met = facing.repartition(max(1, -(-tasks // parts))).join(
        packed.hint("shuffle_replicate_nl"), F.lit(True) if upper is None else F.col("__own") <= F.col("__block"), "inner"
    )
    own = [*left.columns, *(["__own", "__block"] if upper else [])]
    met = met.select(*own, F.explode("__others").alias("__o")).select(*own, *[F.col(f"__o.{c}").alias(c) for c in right.columns])
    if upper is None:
        return met
    return met.where((F.col("__own") < F.col("__block")) | (F.col(upper) < F.col(by))).drop("__own", "__block")


def meeting(left: DataFrame, right: DataFrame, by: str, keep: Column | None = None, upper: str | None = None, rows_per_block: int = ROWS_PER_BLOCK) -> DataFrame:
    """All columns of both sides but bits, with common, ones_i and ones_k, of every two rows that share an active bit.

    Each side has bits and columns of its own, which tell its rows apart; by: see crossed.  Sparse
    codes meet on their bits, so pairs without a common bit, whose similarity is 0, never exist.
    Meetings are shuffled, though: where they are more than a small share of the pairs there are to
    compare, blocks of packed codes meet instead, in place.  keep: a condition on both sides' columns;
    upper: see crossed.
    """
    keep = F.lit(True) if keep is None else keep
    many, length = meetings(left, right)
    mine, others = [c for c in left.columns if c != "bits"], [c for c in right.columns if c != "bits"]
    if many <= MEETINGS_PER_COMPARISON * left.count() * right.count():
        a = left.select(*mine, F.size("bits").alias("ones_i"), F.explode("bits").alias("bit"))
        b = right.select(*others, F.size("bits").alias("ones_k"), F.explode("bits").alias("bit"))
        met = a.join(b, "bit").where(keep if upper is None else keep & (F.col(upper) < F.col(by)))
        return met.groupBy(*mine, *others, "ones_i", "ones_k").agg(F.count("*").cast("int").alias("common"))
    # words of bits up to the largest that both sides have; ones count all bits
    a = left.select(*mine, F.size("bits").alias("ones_i"), *word_columns(F.col("bits"), length, "__a"))
    b = right.select(*others, F.size("bits").alias("ones_k"), *word_columns(F.col("bits"), length, "__b"))
    met = crossed(a, b, by, upper, rows_per_block).where(keep)
    return met.select(*mine, *others, "ones_i", "ones_k", common_words("__a", "__b", length).alias("common")).where("common > 0")


def overlaps(left: DataFrame, right: DataFrame, distinct_ids: bool = True, ordered: bool = False, rows_per_block: int = ROWS_PER_BLOCK) -> DataFrame:
    """(i, k, common, ones_i, ones_k) of every pair that shares an active bit; both sides are (point_id, bits).

    See meeting.  ordered: only pairs with i < k.
    """
    a, b = left.select(F.col("point_id").alias("i"), "bits"), right.select(F.col("point_id").alias("k"), "bits")
    if ordered and left is right:  # each pair is compared once, and turned where it came in the other order
        met = meeting(a, b, "k", upper="i", rows_per_block=rows_per_block)
        turn = F.col("i") < F.col("k")
        pick = lambda one, other: F.when(turn, F.col(one)).otherwise(F.col(other))
        return met.select(pick("i", "k").alias("i"), pick("k", "i").alias("k"), "common", pick("ones_i", "ones_k").alias("ones_i"), pick("ones_k", "ones_i").alias("ones_k"))
    keep = F.col("i") < F.col("k") if ordered else (F.col("i") != F.col("k")) if distinct_ids else F.lit(True)
    return meeting(a, b, "k", keep, rows_per_block=rows_per_block).select("i", "k", "common", "ones_i", "ones_k")


def similarity_pairs(points: DataFrame, name: str, digits: int | None = None) -> DataFrame:
    """(i, j, sim) for i < j with sim > 0: the upper half of the similarity matrix without its zeros and diagonal.

    A similarity depends on the overlap and the two sizes only, which are few, so each of its values is
    computed and rounded once and looked up for the pairs.
    """
    met = overlaps(points, points, ordered=True)
    value = lambda both, a, b: (lambda s: s if digits is None else F.round(s, digits))(similarity(name, both, a, b))
    sizes = [r[0] for r in points.select(F.size("bits").alias("n")).where("n > 0").distinct().collect()]
    most = max(sizes, default=0) + 1
    if sum(min(a, b) for a in sizes for b in sizes) > BROADCAST_ROWS:
        return met.select("i", F.col("k").alias("j"), value(F.col("common"), F.col("ones_i"), F.col("ones_k")).alias("sim"))
    key = lambda both, a, b: ((both.cast("long") * most + a) * most + b).alias("key")
    size = points.sparkSession.createDataFrame([(n,) for n in sizes], "ones_i int")
    table = size.join(size.withColumnRenamed("ones_i", "ones_k"), F.lit(True)).withColumn("common", F.explode(F.sequence(F.lit(1), F.least("ones_i", "ones_k"))))
    parts = (F.col("common"), F.col("ones_i"), F.col("ones_k"))
    known = table.select(key(*parts), value(*parts).alias("sim"))
    return met.select("i", F.col("k").alias("j"), key(*parts)).join(F.broadcast(known), "key").select("i", "j", "sim")


def similarity_block(rows: DataFrame, columns: DataFrame, name: str) -> DataFrame:
    """(i, k, sim) with sim > 0 between two sets of codes; a code meets itself at similarity 1."""
    met = overlaps(rows, columns, distinct_ids=False)
    return met.select("i", "k", similarity(name, F.col("common"), F.col("ones_i"), F.col("ones_k")).alias("sim"))


def query_blocks(queries: DataFrame, memory: DataFrame, name: str, rows_per_block: int = 256, skip_self: bool = True) -> DataFrame:
    """(query_id, label, memory_id, sim) of every query code with every memory code, in blocks of queries.

    queries: (query_id, words, ones), memory: (memory_id, label, words, ones), packed codes.  A block
    of queries travels as one row and meets every memory row under the block's number; blocks are
    broadcast where they are counted to be few.
    """
    total = queries.count()
    blocks = max(1, -(-total // rows_per_block))
    number = F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int")
    packed = queries.groupBy(number.alias("block")).agg(F.collect_list(F.struct("query_id", "words", "ones")).alias("queries"))
    if total <= BROADCAST_ROWS:
        packed = F.broadcast(packed)
    facing = memory.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    met = facing.join(packed, "block").select("memory_id", "label", "words", "ones", F.explode("queries").alias("q"))
    if skip_self:
        met = met.where("q.query_id != memory_id")
    both = B.common(F.col("q.words"), F.col("words"))
    return met.select(F.col("q.query_id").alias("query_id"), "label", "memory_id", similarity(name, both, F.col("q.ones"), F.col("ones")).alias("sim"))


def pair_similarity(asked: DataFrame, points: DataFrame, length: int, name: str) -> DataFrame:
    """Adds sim to rows (i, k): the similarity of the two codes, null where an id is unknown.  points: (point_id, bits)."""
    code = lambda side: points.select(F.col("point_id").alias(f"id_{side}"), B.pack(F.col("bits"), length).alias(f"words_{side}"), F.size("bits").alias(f"ones_{side}"))
    met = asked.join(code("i"), F.col("i") == F.col("id_i"), "left").join(code("k"), F.col("k") == F.col("id_k"), "left")
    known = F.col("id_i").isNotNull() & F.col("id_k").isNotNull()
    sim = similarity(name, B.common(F.col("words_i"), F.col("words_k")), F.col("ones_i"), F.col("ones_k"))
    return met.select(*asked.columns, F.when(known, sim).alias("sim"))
