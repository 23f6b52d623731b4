"""A training-data pipeline of five stages over the table documents.

Each stage takes (spark, docs, sf_dir) and works on everything its predecessor kept; all but the
last return the columns of docs.  Whole rows travel as one struct beside the columns that a stage
looks at, so other columns may have any name.  ``run`` writes each stage's result as Parquet to the
shared folder and reads it again, so a lost executor costs a stage's tasks and no more; what a stage
has stored for itself is deleted when its result is written.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codelattice.llm import bpe, langid, lines, mixing, simhash
from codelattice.llm.shared import materialise, sized
from codelattice.tables import sweep, written


def _wrapped(docs: DataFrame, *columns: Column) -> DataFrame:
    """The columns given, and the whole row as one struct."""
    return docs.select(*columns, F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("whole_row"))


def _columns(docs: DataFrame, changed: dict[str, Column] | None = None) -> list[Column]:
    """The columns of docs out of the struct, but for those that have changed."""
    held = changed or {}
    return [(held[c] if c in held else F.col(f"whole_row.`{c}`")).alias(c) for c in docs.columns]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text some learnt language fits; null, empty and letterless texts go.

    Each row is judged by its text alone, so repeated rows and ties fare alike, and the columns come
    back as they are.  Without a labelled document no language is learnt and all rows go.
    """
    return langid.accepted(docs, langid.train(docs))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the runs of lines of 50 words or more that occur earlier; one that loses all its text goes.

    Null and empty texts stay as they are.  Rows that repeat an id and its text lose the same lines;
    of different texts under one id the one with the smaller hash counts as earlier.  n_chars, where
    it is a column, is brought up to date.
    """
    done = lines.dedup_lines(_wrapped(docs, F.col("doc_id"), F.col("text")))
    kept = done.where((F.col("removed_lines") == 0) | (F.col("text") != ""))
    changed = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.length("text").cast(docs.schema["n_chars"].dataType)
    return kept.select(_columns(docs, changed))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of texts that share four fifths of their five-word shingles, as SimHash sketches judge it.

    Of a group the row with the smallest doc_id stays, no id being the largest and the smaller hash
    winning ties.  Rows are told apart by id and text, so neither texts that share an id nor rows
    without an id are mistaken for one another; of rows that share both, one stays.  Null, empty and
    wordless texts form one group.
    """
    key = F.xxhash64(F.col("doc_id").isNull(), "doc_id", F.col("text").isNull(), "text")
    groups = simhash.similar_groups(docs.select(key.alias("g_key"), "text"), "g_key")
    named = docs.select(key.alias("d_key"), F.col("doc_id").alias("d_id")).distinct()
    first = F.min(F.struct(F.col("d_id").isNull(), "d_id", "d_key")).alias("first")
    stay = named.join(groups.hint("merge"), F.col("d_key") == F.col("g_key")).groupBy("component").agg(first)
    stay = materialise(stay.select(F.col("first.d_key").alias("stays")), "stay")
    kept = _wrapped(docs, key.alias("row_key")).join(stay.hint("merge"), F.col("row_key") == F.col("stays"), "left_semi")
    return kept.dropDuplicates(["row_key"]).select(_columns(docs))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """As many copies of each document as the mix of sources takes, none of some.

    A null source is a source like any other, and null and wordless texts, which count nothing, stay
    once.  Copies depend on id, source and size alone, so rows that repeat these fare alike.
    """
    plan = mixing.mix(docs).where("copies > 0").select(
        F.col("doc_id").alias("m_id"), F.col("source").alias("m_source"), F.col("size").alias("m_size"), F.col("copies").alias("m_copies")
    )
    plan = sized(plan.distinct())
    rows = _wrapped(docs, F.col("doc_id").cast("long").alias("id"), F.col("source").cast("string").alias("source"), mixing.word_count(F.col("text")).alias("size"))
    same = F.col("id").eqNullSafe(F.col("m_id")) & F.col("source").eqNullSafe(F.col("m_source")) & (F.col("size") == F.col("m_size"))
    copies = F.explode(F.sequence(F.lit(1), F.col("m_copies").cast("int"))).alias("copy")
    return rows.join(plan, same).select("whole_row", copies).select(_columns(docs))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document taken, with the digests of ids and of the decoded bytes."""
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return bpe.encode_documents(docs, ranks, public_tokenizers.PATTERN)


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("simhash", near_dedup),
    ("mixing", mix_sources),
    ("bpe", encode),
]

#: Language models, SimHash components and byte-pair merges are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the table documents of sf_dir."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        mark = written()
        docs = materialise(stage(spark, docs, sf_dir), name)
        sweep(spark, mark, keep=(docs,))
    return STAGES[-1][1](spark, docs, sf_dir)
