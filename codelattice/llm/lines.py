"""Line dedup by content-defined chunks of lines.

A rolling hash slides over the hashes of a text's lines.  A chunk is a run of lines whose ends are
chosen by its content: from every line on, the shortest run of enough words, and up to every line
likewise.  Chunks overlap and their ends depend on nothing outside them, so a passage that repeats
anywhere yields the same chunks, and together they cover all of it.  Chunks whose rolling hash
occurs more than once are fetched, grouped by their whole bytes, and every line of a chunk that is
not the chunk's first occurrence goes.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codelattice.llm.shared import ROWS_AT_ONCE, materialise, slices, small_batches

#: Words of a chunk at least: shorter repeats are left alone.
MIN_WORDS = 50
#: Bits of the filter that says which texts a join may need; its 1,024 parts of 4 KB are broadcast.
FILTER_BITS = 1 << 25
#: Chunks, and bytes of chunks, that a worker holds before it hands them on, but for those of one text.
CHUNKS_AT_ONCE = 50_000
BYTES_AT_ONCE = 1 << 22
_WHITE = np.isin(np.arange(256), (9, 10, 11, 12, 13, 32))
#: Base of the rolling hash; it is odd, so it has an inverse modulo 2^64.
_M = 0x9E3779B97F4A7C15


def line_bounds(data) -> np.ndarray:
    """Where lines begin, and the end of the last one; a line's line feed belongs to it."""
    ends = np.flatnonzero(np.frombuffer(data, np.uint8) == 10) + 1
    if len(data) > (ends[-1] if len(ends) else 0):
        ends = np.append(ends, len(data))
    return np.concatenate([[0], ends]).astype(np.int64)


def _powers(base: int, count: int) -> np.ndarray:
    return np.cumprod(np.full(count, base, np.uint64), dtype=np.uint64)


def chunk_arrays(data, min_words: int = MIN_WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first lines, last lines, hashes) of every chunk of a text's bytes, each once, in order of their lines.

    Words are separated by ASCII white space.  The hash is a polynomial in the lines' hashes modulo
    2^64, line feeds left out, so a run is the same whether or not the text ends after it: with
    sums of the hashes over powers of the base up to every line, a chunk's is one difference.
    """
    none = np.empty(0, np.int64)
    bounds = line_bounds(data)
    codes = np.frombuffer(data, np.uint8)
    white = _WHITE[codes]
    begins = np.flatnonzero(white[:-1] & ~white[1:]) + 1  # but for a word that begins the text
    words = np.searchsorted(begins, bounds)
    words[1:] += len(white) > 0 and not white[0]
    if words[-1] < min_words:
        return none, none, none.view(np.uint64)
    count = len(bounds) - 1
    ends = np.searchsorted(words, words[:-1] + min_words)  # the shortest run from each line on
    first = np.flatnonzero(ends <= count)
    stops = np.flatnonzero(words >= min_words)  # and up to each line
    runs = np.unique(
        np.concatenate([first * (count + 1) + ends[first], (np.searchsorted(words, words[stops] - min_words, "right") - 1) * (count + 1) + stops])
    )
    first, end = runs // (count + 1), runs % (count + 1)
    view = memoryview(data)
    cuts = bounds.tolist()
    feeds = (codes[bounds[1:] - 1] == 10).tolist()
    hashes = np.fromiter(
        (xxhash.xxh64_intdigest(view[a : b - f]) for a, b, f in zip(cuts, cuts[1:], feeds)), np.uint64, count
    )
    sums = np.zeros(count + 1, np.uint64)
    np.cumsum(hashes * _powers(pow(_M, -1, 1 << 64), count), out=sums[1:])
    return first, end - 1, (sums[end] - sums[first]) * _powers(_M, count)[end - 1]


def line_chunks(data: bytes, min_words: int = MIN_WORDS) -> tuple[list[tuple[int, int]], list[tuple[int, int, int]]]:
    """(first byte, end byte) of every line, and (first line, last line, hash) of every chunk."""
    bounds = line_bounds(data).tolist()
    return list(zip(bounds, bounds[1:])), list(zip(*(column.tolist() for column in chunk_arrays(data, min_words))))


def needed_filter(keys: DataFrame) -> DataFrame:
    """(part, bits): the bitmap of the keys' (long key) places, in parts of 32,768 bits: at most 1,024 rows."""
    place = F.pmod(F.xxhash64("key"), F.lit(FILTER_BITS))
    return keys.select(place.alias("p")).groupBy(F.bitmap_bucket_number("p").alias("part")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("bits")
    )


def may_need(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """Adds needed: false only where the row's key is not among those of the filter.

    The filter has a fixed size, so it can be broadcast however many keys it holds; where it is
    full, rows take the join as if there were none.
    """
    place = F.pmod(F.xxhash64("key"), F.lit(FILTER_BITS))
    bit = F.bitmap_bit_position(place)
    byte = F.conv(F.hex(F.expr("substring(bits, cast(bit div 8 as int) + 1, 1)")), 16, 10).cast("int")
    set_ = F.shiftright(byte, 0).bitwiseAND(F.call_function("shiftleft", F.lit(1), (F.col("bit") % 8).cast("int"))) != 0
    marked = rows.withColumn("bit", bit).withColumn("own", F.bitmap_bucket_number(place))
    met = marked.join(F.broadcast(wanted), F.col("own") == F.col("part"), "left")
    return met.withColumn("needed", F.coalesce(set_, F.lit(False))).drop("bit", "own", "part", "bits")


def _key(identity: Column, text: Column) -> Column:
    return F.xxhash64(identity.isNull(), identity, text)


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """The table with repeated runs of lines taken out of its texts, and removed_lines, removed_chars.

    A line goes if it is part of a run of lines of min_words words or more, one line or many, that
    occurs earlier too: in a row with a smaller id, or further up in the same text, overlaps
    included.  Null ids come after all others, in the order of a hash of id and text.  Null and empty
    texts come back as they are; a text that loses every line comes back empty with removed_lines
    > 0.  Rows that repeat an id and its text count as one document, so all of them keep or lose the
    same lines.  An empty table gives an empty result.  All columns come back, whatever their names;
    columns called removed_lines and removed_chars are replaced.
    """
    small_batches(docs.sparkSession)
    own = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    rows = own.select(_key(F.col("id"), F.col("text")).alias("key"), "id", F.col("text").cast("binary").alias("data"))
    rows = rows.where("data is not null and length(data) > 0")
    names = ["key", "id", "first", "last", "hash"]

    def scan(batches):
        def handed_on(held):
            columns = [np.concatenate(c) for c in zip(*held)]
            types = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64()]
            ids = pa.array(columns[1], mask=columns[5])
            arrays = [ids if n == 1 else pa.array(columns[n]) for n in range(5)]
            return pa.RecordBatch.from_arrays([x.cast(t) for x, t in zip(arrays, types)], names=names)

        for batch in slices(batches, ROWS_AT_ONCE):
            held, size = [], 0
            for key, id_, text in zip(*(batch.column(k) for k in range(3))):
                first, last, hashes = chunk_arrays(text.as_buffer(), min_words)
                if not len(first):
                    continue
                of_text = [np.full(len(first), v, t) for v, t in ((key.as_py(), np.int64), (id_.as_py() or 0, np.int64), (not id_.is_valid, bool))]
                held.append((of_text[0], of_text[1], first, last, hashes.view(np.int64), of_text[2]))
                size += len(first)
                if size >= CHUNKS_AT_ONCE:
                    yield handed_on(held)
                    held, size = [], 0
            if held:
                yield handed_on(held)

    chunks = materialise(rows.mapInArrow(scan, "key long, id long, first int, last int, hash long"), "chunks")
    repeated = chunks.groupBy(F.bitwise_not("hash").alias("other")).agg(F.count("*").alias("n")).where("n > 1").select("other")
    # both sides of the joins are dealt out at every size: neither is bounded, and a frequent chunk is split
    found = chunks.join(repeated.hint("merge"), chunks["hash"] == F.bitwise_not("other"), "left_semi")
    spots = found.groupBy("key").agg(F.collect_set(F.struct("first", "last", "hash")).alias("spots"))
    spots = materialise(spots.select(F.col("key").alias("s_key"), "spots"), "spots")
    wanted = materialise(needed_filter(spots.select(F.col("s_key").alias("key"))), "needed")

    # the bytes themselves of every chunk whose hash repeats; rows repeated count once
    texts = may_need(rows, wanted).where("needed").select("key", "id", "data")
    fetched = texts.join(spots.hint("merge"), F.col("key") == F.col("s_key")).select("key", "id", "data", "spots")

    def cut(batches):
        def handed_on(out):
            types = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=[*names, "body"])

        for batch in slices(batches, ROWS_AT_ONCE):
            out, size = [], 0
            for key, id_, text, wanted_ in zip(*(batch.column(k) for k in range(4))):
                key, id_, data = key.as_py(), id_.as_py(), text.as_buffer()
                bounds = line_bounds(data).tolist()
                view = memoryview(data)
                for s in wanted_.as_py():
                    body = bytes(view[bounds[s["first"]] : bounds[s["last"] + 1]]).removesuffix(b"\n")
                    out.append((key, id_, s["first"], s["last"], s["hash"], body))
                    size += len(body) + 100
                    if size >= BYTES_AT_ONCE:
                        yield handed_on(out)
                        out, size = [], 0
            if out:
                yield handed_on(out)

    bodies = fetched.mapInArrow(cut, "key long, id long, first int, last int, hash long, body binary")
    bodies = materialise(bodies, "bodies")
    order = F.struct(F.col("id").isNull().alias("late"), "id", "key", "first")
    groups = bodies.groupBy(F.bitwise_not("hash").alias("other"), F.col("body").alias("g_body")).agg(
        F.min(order).alias("stays"), F.max(order).alias("end")
    )
    groups = groups.where("stays != end").hint("merge")
    going = bodies.join(groups, (F.col("hash") == F.bitwise_not("other")) & (F.col("body") == F.col("g_body")))
    going = going.where(order != F.col("stays")).select("key", "first", "last")
    lists = going.groupBy(F.col("key").alias("l_key")).agg(F.collect_set(F.struct("first", "last")).alias("going"))
    lists = materialise(lists, "going")
    changed = materialise(needed_filter(lists.select(F.col("l_key").alias("key"))), "changed")

    marked = may_need(own.select(_key(F.col("id"), F.col("text")).alias("key"), "text", "row"), changed)
    here = marked.where("not needed").select("row", "text", F.lit(0).alias("removed"))
    there = marked.where("needed").join(lists.hint("merge"), F.col("key") == F.col("l_key"), "left")
    same = there.where("going is null").select("row", "text", F.lit(0).alias("removed"))

    @F.pandas_udf("struct<text string, removed int>")
    def without(text: pd.Series, going: pd.Series) -> pd.DataFrame:
        out = []
        for value, runs in zip(text, going):
            data = value.encode()
            bounds = line_bounds(data).tolist()
            gone = np.zeros(len(bounds), np.int64)
            for run in runs:
                gone[run["first"]] += 1
                gone[run["last"] + 1] -= 1
            gone = np.cumsum(gone) > 0
            out.append((b"".join(data[a:b] for a, b, g in zip(bounds, bounds[1:], gone) if not g).decode(), int(gone.sum())))
        return pd.DataFrame(out, columns=["text", "removed"])

    touched = there.where("going is not null").select("row", without("text", "going").alias("w"))
    touched = touched.select("row", F.col("w.text").alias("text"), F.col("w.removed").alias("removed"))
    both = here.unionByName(same).unionByName(touched)
    added = ("removed_lines", "removed_chars")
    before, after = (F.coalesce(F.length(c), F.lit(0)) for c in (F.col(f"row.`{text_col}`"), F.col("text")))
    return both.select(
        *[F.col("text").alias(c) if c == text_col else F.col(f"row.`{c}`").alias(c) for c in docs.columns if c.lower() not in added],
        F.col("removed").alias("removed_lines"),
        (before - after).alias("removed_chars"),
    )
