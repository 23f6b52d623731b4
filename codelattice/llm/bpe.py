"""Byte-level BPE encoding and decoding by overlapping chunks.

A pre-token match depends only on the text from its start on, so two scans that share one
boundary agree from there on.  Long texts are cut into chunks that overlap; every chunk is
scanned for pre-token boundaries from its own start, in parallel; neighbouring scans are stitched
at the first boundary that both found in their overlap; the pieces between stitches are encoded
in parallel and their ids concatenated in order.  Only boundaries between a character that is not
white space and a space or line feed are used for stitching: no match of the pattern runs over
one, and its one look-ahead concerns white space before the boundary, so a piece that ends there
is pre-tokenised alone exactly as it is inside the text.
"""

from __future__ import annotations

import base64
import functools
import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codelattice.llm.shared import materialise, slices, small_batches

#: Characters of a chunk, and of its overlap with the next one.
CHUNK = 32_768
OVERLAP = 2_048


@functools.lru_cache(maxsize=4)
def encoder(ranks_path: str, pattern: str) -> tiktoken.Encoding:
    """The encoder of a vocabulary file of ranks, once per Python worker."""
    with open(ranks_path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


@functools.lru_cache(maxsize=4)
def _compiled(pattern: str):
    return regex.compile(pattern)


def encode_text(text: str, ranks_path: str, pattern: str) -> list[int]:
    """Token ids of a text; a text whose white-space runs overflow the fast scanner is scanned piece by piece."""
    enc = encoder(ranks_path, pattern)
    try:
        return enc.encode_ordinary(text)
    except BaseException as error:  # the native scanner panics on white-space runs of some 100,000 characters
        if type(error).__name__ != "PanicException":
            raise
    ids: list[int] = []
    for match in _compiled(pattern).finditer(text):
        ids += enc._encode_single_piece(match.group())
    return ids


def decode_ids(ids, ranks_path: str, pattern: str) -> bytes:
    """The raw bytes of token ids."""
    return encoder(ranks_path, pattern).decode_bytes(list(ids))


def boundaries(chunk: str, pattern: str, begin: int, end: int, last: bool) -> list[int]:
    """Stitchable pre-token boundaries p of a scan from the chunk's start, with begin <= p < end.

    Boundaries that the chunk's end may have caused are left out unless it is the text's end: a
    match counts only if it ends before the chunk does and starts three characters before that.
    """
    found = []
    size = len(chunk)
    for match in _compiled(pattern).finditer(chunk):
        p = match.end()
        if p >= end:
            break
        if not last and (p >= size or match.start() + 3 > size):
            break
        if begin <= p < size and chunk[p] in " \n" and not chunk[p - 1].isspace():
            found.append(p)
    return found


def summary(ids: list[int], data: bytes) -> tuple[int, str, str]:
    """Number of ids, SHA-256 of the decimal ids joined by a space, SHA-256 of the decoded bytes."""
    return len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(data).hexdigest()


def encode_documents(
    docs: DataFrame,
    ranks_path: str,
    pattern: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    chunk: int = CHUNK,
    overlap: int = OVERLAP,
    with_ids: bool = True,
) -> DataFrame:
    """One row per input row: (id_col, [ids binary,] n_tokens, ids_sha256, decoded_sha256).

    ids holds the token ids as little-endian 32-bit numbers.  Null text: as empty, no tokens.
    Texts of at most a chunk and its overlap are encoded where they are; longer ones are chunked,
    stitched and encoded over many tasks and only the ids of one text meet in one task.  Where two
    scans share no boundary in their overlap (one pre-token longer than the overlap), their chunks
    are joined and encoded as one piece.  Repeated rows and ids come back as often as they came;
    an empty table gives an empty result; other columns are not looked at.
    """
    schema = "id long, " + ("ids binary, " if with_ids else "") + "n_tokens long, ids_sha256 string, decoded_sha256 string"
    names = [x.split()[0] for x in schema.split(", ")]
    small_batches(docs.sparkSession)
    limit = chunk + overlap
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def result(key, ids: list[int]) -> tuple:
        data = decode_ids(ids, ranks_path, pattern)
        own = (np.array(ids, "<i4").tobytes(),) if with_ids else ()
        return (key, *own, *summary(ids, data))

    def short(batches):
        for batch in slices(batches):
            out = [result(None, encode_text(text, ranks_path, pattern))[1:] for text in batch.column(1).to_pylist()]
            columns = [pa.array(c) for c in zip(*out)] if out else []
            if out:
                yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=names)

    def scan(batches):
        for batch in slices(batches, 50):
            heads, tails = [], []
            for at, is_last, text in zip(*[c.to_pylist() for c in batch.columns[1:]]):
                found = np.array(boundaries(text, pattern, 1, limit, is_last), np.int64)
                heads.append(found[found < overlap] + at)
                tails.append(found[found >= chunk] + at)
            lists = [pa.array(x, pa.list_(pa.int64())) for x in (heads, tails)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *lists], names=["key", "at", "heads", "tails"])

    def encode(batches):
        for batch in slices(batches, 50):
            out = [np.array(encode_text(text, ranks_path, pattern), "<i4").tobytes() for text in batch.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(out, pa.binary())], names=["key", "id", "at", "ids"])

    def gather(pdf: pd.DataFrame) -> pd.DataFrame:
        ids = np.frombuffer(b"".join(pdf.sort_values("at")["ids"]), "<i4").tolist()
        key = pdf["id"].iloc[0]
        return pd.DataFrame([result(None if pd.isna(key) else int(key), ids)], columns=names)

    here = rows.where(F.length("text") <= limit).mapInArrow(short, schema)
    # a row number of its own tells repeated ids apart
    long_ = materialise(
        rows.where(F.length("text") > limit).withColumn("key", F.monotonically_increasing_id()), "long-texts"
    )
    at = F.explode(F.expr(f"sequence(0L, length(text) - 1L, {chunk}L)"))
    chunks = long_.select("key", "text", at.alias("at")).select(
        "key",
        "at",
        (F.col("at") + limit >= F.length("text")).alias("last"),
        F.expr(f"substring(text, cast(at as int) + 1, {limit})").alias("text"),
    )
    spread = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    scanned = materialise(
        chunks.repartition(spread, "key", "at").mapInArrow(
            scan, "key long, at long, heads array<long>, tails array<long>"
        ),
        "scans",
    )
    ends = scanned.select("key", (F.col("at") + chunk).alias("at"), "tails")
    stitches = (
        scanned.drop("tails").join(ends, ["key", "at"], "left")
        .select("key", F.when(F.col("at") == 0, 0).otherwise(F.array_min(F.array_intersect("heads", "tails"))).alias("begin"))
        .where("begin is not null")
    )
    per_text = stitches.groupBy("key").agg(F.sort_array(F.collect_list("begin")).alias("begins"))
    piece = F.explode(F.expr("arrays_zip(begins, slice(begins, 2, size(begins)))"))
    pieces = (
        long_.join(per_text, "key")
        .select("key", "id", "text", piece.alias("p"))
        .select(
            "key",
            "id",
            F.col("p.begins").alias("at"),
            F.expr("substring(text, cast(p.begins as int) + 1, cast(coalesce(p.`1`, length(text)) - p.begins as int))").alias("text"),
        )
    )
    parts = pieces.repartition(spread, "key", "at").mapInArrow(encode, "key long, id long, at long, ids binary")
    there = parts.groupBy("key").applyInPandas(gather, schema)
    return here.unionByName(there).withColumnRenamed("id", id_col)
