"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints at distance r or less share a variant within r/2 of each.  Every fingerprint
therefore emits all its variants within half the radius, the variants meet in a shuffle, and
fingerprints that meet are linked after their distance is verified.  The shuffle key is a
variant's leading bits: all of a fingerprint's variants with the same leading bits travel as one
row and are written out in full only inside the task that receives them, which divides the
shuffled volume by some tens without losing a variant.
"""

from __future__ import annotations

import math
from itertools import accumulate, combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codelattice.llm.shared import components, give_back, materialise, sized, slices, small_batches

#: Fingerprints that one bucket should get on average; more only mean more leading bits.
ROWS_PER_BUCKET = 32_000
#: A task writes out variants for at most about this many fingerprints, and so many variants (some 40 bytes each), at once;
#: beyond, it splits by further bits.
ROWS_AT_ONCE, VARIANTS_AT_ONCE = 128_000, 4_000_000
#: Buckets of more than so many times their average number are cut by so many further bits.
MOST_IN_BUCKET, FURTHER_BITS = 8, 8
SEED = 42
#: Fingerprints of a text's sketch, and the leading bits of each by which texts of lower similarity meet.
TABLES, WIDTH = 6, 40


def shingle_hashes(data: bytes | None, words_per_shingle: int) -> np.ndarray:
    """XXH64 of every shingle of a text in UTF-8, repeats included; of fewer words the whole sequence; none of no word."""
    words = (data or b"").lower().split()  # of bytes: A-Z, and ASCII white space, only
    text = b" ".join(words)
    if len(words) < words_per_shingle:
        return np.array([xxhash.xxh64_intdigest(text, SEED)] if words else [], np.uint64)
    ends = list(accumulate(len(w) + 1 for w in words))
    digest = xxhash.xxh64_intdigest
    starts = [0, *ends]
    return np.fromiter(
        (digest(text[s : e - 1], SEED) for s, e in zip(starts, ends[words_per_shingle - 1 :])),
        dtype=np.uint64,
        count=len(words) - words_per_shingle + 1,
    )


def simhash(data: bytes | None, words_per_shingle: int = 4) -> int:
    """64-bit SimHash of a text in UTF-8, as an unsigned number; 0 where there is no word."""
    return majority(shingle_hashes(data, words_per_shingle))


def sketch(data: bytes | None, words_per_shingle: int, parts: int) -> list[int]:
    """So many SimHashes of a text, from as many permutations of its shingles' hashes."""
    hashes = shingle_hashes(data, words_per_shingle)
    found = []
    for part in range(parts):
        x = hashes + np.uint64((part + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        found.append(majority(x ^ (x >> np.uint64(31))))
    return found


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half of the hashes."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65_280):  # 256 x 255: byte-wide sums of 255 rows cannot overflow
        block = hashes[at : at + 65_280]
        bits = np.unpackbits(block.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        whole = len(bits) // 255 * 255
        if whole:
            counts += bits[:whole].reshape(-1, 255, 64).sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
        counts += bits[whole:].sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str, text_col: str, words_per_shingle: int = 4) -> DataFrame:
    """(id, fp): the SimHash of every whole text, as a signed long.  Null texts count as empty."""

    def run(batches):
        for batch in slices(batches):
            found = np.array([simhash(x, words_per_shingle) for x in batch.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], names=["id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("data")).mapInArrow(
        run, "id long, fp long"
    )


def leading_bits(rows: int, half: int, rows_per_bucket: int = ROWS_PER_BUCKET) -> int:
    """How many leading bits of a variant make the shuffle key, so that buckets keep their size as the input grows."""
    for bits in range(6, 31):
        if rows * _ball(bits, half) <= rows_per_bucket << bits:
            return bits
    return 30


def _ball(bits: int, radius: int) -> int:
    total, ways = 0, 1
    for k in range(radius + 1):
        total += ways
        ways = ways * (bits - k) // (k + 1)
    return total


def _masks(bits: int, radius: int) -> list[int]:
    return [sum(1 << i for i in chosen) for k in range(radius + 1) for chosen in combinations(range(bits), k)]


def link_bucket(fp: np.ndarray, prefix: int, bits: int, radius: int, width: int = 64) -> np.ndarray:
    """Links (index pairs) between fingerprints that share a variant with these leading bits.

    Fingerprints of fewer bits than 64 fill their words from the top.
    Fingerprints that meet in one variant are chained in order rather than paired: any two of
    them are within the radius, so the chain has the components of all pairs.  A bucket is split
    by the variants it makes, not its rows alone: a fingerprint that has the prefix itself makes
    hundreds, one that is half the radius away a single one.  Of a split bucket a forest of the
    nearest links is returned.
    """
    half = radius // 2
    shift = np.uint64(64 - bits)
    distance = np.bitwise_count((fp >> shift) ^ np.uint64(prefix)).astype(np.int64)
    member = np.flatnonzero(distance <= half)
    if len(member) < 2:
        return np.empty((0, 2), np.int64)
    made = sum(int(n) * _ball(width - bits, half - d) for d, n in enumerate(np.bincount(distance[member])))
    if (len(member) > ROWS_AT_ONCE or made > VARIANTS_AT_ONCE) and bits < width - 4:
        own, found = fp[member], np.empty((0, 2), np.int64)
        for more in range(16):
            links = link_bucket(own, prefix << 4 | more, bits + 4, radius, width)
            if len(links):
                found = spanning_links(own, np.concatenate([found, links]))
        return member[found]
    low = np.uint64((1 << (64 - bits)) - 1)
    base = (fp & low) | (np.uint64(prefix) << shift)
    values, owners = [], []
    for flips in range(half + 1):
        own = member[distance[member] <= half - flips]
        masks = np.array([m << (64 - width) for m in _masks(width - bits, flips) if m.bit_count() == flips], np.uint64)
        if len(own) and len(masks):
            values.append((base[own][:, None] ^ masks[None, :]).ravel())
            owners.append(np.repeat(own.astype(np.int32), len(masks)))
    values, owners = np.concatenate(values), np.concatenate(owners)
    order = np.argsort(values, kind="stable")
    values, owners = values[order], owners[order].astype(np.int64)
    meet = np.flatnonzero(values[1:] == values[:-1])
    pairs = np.stack([owners[meet], owners[meet + 1]], axis=1)
    pairs = np.unique(np.sort(pairs, axis=1), axis=0)
    return pairs[np.bitwise_count(fp[pairs[:, 0]] ^ fp[pairs[:, 1]]) <= radius]


def spanning_links(fp: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    """Of links between fingerprints a forest with the same components, the nearest links first.

    Each round keeps one link of every component that can join one of a smaller number.
    """
    label = np.arange(len(fp))
    apart = np.bitwise_count(fp[pairs[:, 0]] ^ fp[pairs[:, 1]])
    kept = [pairs[:0]]
    for distance in np.unique(apart):
        open_ = pairs[apart == distance]
        while True:
            a, b = label[open_[:, 0]], label[open_[:, 1]]
            open_ = open_[a != b]
            if not len(open_):
                break
            low, high = np.minimum(a, b)[a != b], np.maximum(a, b)[a != b]
            joined, first = np.unique(high, return_index=True)
            kept.append(open_[first])
            label = forest(len(fp), np.stack([joined, low[first]], axis=1))[label]
    return np.concatenate(kept)


def forest(size: int, pairs: np.ndarray) -> np.ndarray:
    """Smallest index reachable from each index, by hooking and pointer jumping."""
    label = np.arange(size)
    while len(pairs):
        a, b = label[pairs[:, 0]], label[pairs[:, 1]]
        low, high = np.minimum(a, b), np.maximum(a, b)
        open_ = low != high
        if not open_.any():
            break
        np.minimum.at(label, high[open_], low[open_])
        while True:
            jumped = label[label]
            if (jumped == label).all():
                break
            label = jumped
        pairs = pairs[open_]
    return label


def _buckets(prints: DataFrame, bits: int, half: int, most: int, width: int = 64) -> DataFrame:
    """(..., bits, bucket, fp): every fingerprint in each bucket of leading bits that a variant of it has.

    prints: fp, a number part that keeps fingerprints of different kinds apart, and whatever else is
    to be carried.  Buckets of more than most fingerprints are cut by further bits, as often as need
    be, before the shuffle to the tasks that write the variants out, so that no task gets a very
    frequent prefix whole.
    """
    carried = [c for c in prints.columns if c != "fp"]
    masks = F.explode(F.array(*[F.lit(m) for m in _masks(bits, half)]))
    dealt = prints.select(*carried, "fp", masks.alias("mask")).select(
        *carried, F.lit(bits).alias("bits"), F.shiftrightunsigned("fp", 64 - bits).bitwiseXOR(F.col("mask").cast("long")).alias("bucket"), "fp"
    )
    parts = None
    while True:
        large = None
        if bits + FURTHER_BITS < width - 4:
            sizes = dealt.groupBy(F.col("part").alias("p"), F.col("bucket").alias("b")).agg(F.count("*").alias("n")).where(F.col("n") > most)
            large = materialise(sizes.select("p", "b"), "large-buckets")
        if large is None or not large.limit(1).count():
            return dealt if parts is None else parts.unionByName(dealt)
        side = sized(large)
        same = (F.col("part") == F.col("p")) & (F.col("bucket") == F.col("b"))
        fits = dealt.join(side, same, "left_anti")
        parts = fits if parts is None else parts.unionByName(fits)
        further = F.explode(F.array(*[F.lit(m) for m in _masks(FURTHER_BITS, half)]))
        bits += FURTHER_BITS
        own = F.shiftrightunsigned("fp", 64 - bits)
        low = own.bitwiseAND((1 << FURTHER_BITS) - 1).bitwiseXOR(F.col("mask").cast("long"))
        deeper = dealt.join(side, same, "left_semi").select(*carried, "bucket", "fp", further.alias("mask"))
        deeper = deeper.select(*carried, F.lit(bits).alias("bits"), F.shiftleft("bucket", FURTHER_BITS).bitwiseOR(low).alias("bucket"), "fp")
        flips = F.bit_count(F.shiftrightunsigned("fp", 64 - bits).bitwiseXOR(F.col("bucket")))
        dealt = materialise(deeper.where(flips <= half), "deeper-buckets")


def differing_bits(similarity: float) -> float:
    """The share of SimHash bits in which texts of this Jaccard similarity (and about equal size) differ on average."""
    return math.acos(2 * similarity / (1 + similarity)) / math.pi


def similar_groups(
    docs: DataFrame,
    key_col: str,
    text_col: str = "text",
    words_per_shingle: int = 5,
    similarity: float = 0.8,
    tables: int = TABLES,
    width: int = WIDTH,
    radius: int = 4,
    rows_per_bucket: int = 4 * ROWS_PER_BUCKET,
) -> DataFrame:
    """(key_col, component): groups of texts whose shingle sets are about as similar as asked, or more.

    One SimHash of 64 bits whose radius covers a similarity of 0.8 would need balls of some 18 bits.
    A sketch of several SimHashes does with small ones: texts whose leading width bits of any of them
    lie within the radius meet by their variants; of those that met in a bucket a forest of the nearest
    pairs is taken, so a group of many near copies makes no more pairs than it has members, and these
    are linked if their whole sketches differ in no more bits than texts of that similarity do, plus one standard deviation.

    key_col: a long that identifies the text; rows without one, and repeated keys, count once at most.
    Groups do not depend on how rows are partitioned or in which order they come.
    Null and wordless texts have the empty sketch and link with one another only.  component is the
    smallest key reachable.  An empty table gives an empty result.
    """
    half = radius // 2
    small_batches(docs.sparkSession)

    def run(batches):
        for batch in slices(batches):
            found = np.array([sketch(x, words_per_shingle, tables) for x in batch.column(1).to_pylist()], np.uint64).reshape(-1, tables)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, found.size + 1, tables), pa.int32()), pa.array(found.ravel().view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=["node", "bits"])

    rows = docs.where(F.col(key_col).isNotNull()).select(F.col(key_col).cast("long").alias("node"), F.col(text_col).cast("binary").alias("data"))
    sketches = materialise(rows.mapInArrow(run, "node long, bits array<long>").groupBy("node").agg(F.min("bits").alias("bits")), "sketches")
    # texts of one and the same sketch are represented by one of them
    unique = materialise(sketches.groupBy("bits").agg(F.min("node").alias("rep")), "unique")
    rest = -(1 << (64 - width))
    codes = unique.select("rep", F.posexplode("bits").alias("part", "bits")).select("part", F.col("bits").bitwiseAND(rest).alias("fp"), F.col("rep").alias("node"))
    held = materialise(codes.groupBy("part", "fp").agg(F.min("node").alias("node")), "codes")
    # of texts with an equal code all but one are paired with that one
    twins = codes.alias("c").join(held.alias("h").hint("merge"), (F.col("c.part") == F.col("h.part")) & (F.col("c.fp") == F.col("h.fp")))
    twins = twins.where("c.node != h.node").select(F.col("c.node").alias("a"), F.col("h.node").alias("b"))
    bits = leading_bits(unique.count(), half, rows_per_bucket)

    def meet(key, pdf):
        pdf = pdf.sort_values("fp")  # each once: which pairs make the forest then does not depend on the shuffle
        fp = pdf["fp"].to_numpy(np.int64).view(np.uint64)
        node = pdf["node"].to_numpy(np.int64)
        found = spanning_links(fp, link_bucket(fp, int(key[2]), int(key[1]), radius, width))
        give_back()
        return pd.DataFrame({"a": node[found[:, 0]], "b": node[found[:, 1]]})

    dealt = _buckets(held, bits, half, MOST_IN_BUCKET * rows_per_bucket, width)
    met = dealt.groupBy("part", "bits", "bucket").applyInPandas(meet, "a long, b long").unionByName(twins)
    met = materialise(met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "met")
    one, other = (unique.select(F.col("rep").alias(f"rep_{n}"), F.col("bits").alias(f"bits_{n}")).hint("merge") for n in "ab")
    both = met.join(one, F.col("a") == F.col("rep_a")).join(other, F.col("b") == F.col("rep_b"))
    apart = F.aggregate(F.zip_with("bits_a", "bits_b", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda t, n: t + n)
    total, share = 64 * tables, differing_bits(similarity)
    limit = int(total * share + math.sqrt(total * share * (1 - share)))
    found = components(both.where(apart <= limit).select("a", "b"))
    rooted = unique.join(found, unique["rep"] == found["node"], "left").select(F.col("bits").alias("u_bits"), F.coalesce("component", "rep").alias("root"))
    rooted = materialise(rooted, "rooted")
    return sketches.join(rooted.hint("merge"), F.col("bits") == F.col("u_bits")).select(F.col("node").alias(key_col), F.col("root").alias("component"))


def simhash_groups(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    words_per_shingle: int = 4,
    radius: int = 4,
    rows_per_bucket: int = ROWS_PER_BUCKET,
) -> DataFrame:
    """One row per input row: (id_col, fingerprint, component_id).

    Null text: as empty, fingerprint zero, which links like any other.  Texts of fewer words than
    a shingle: the whole word sequence is the only shingle.  Equal fingerprints collapse to one
    before the ball is written out, so copies cost nothing.  component_id is the smallest id
    reachable; rows with a null id have a fingerprint, link and bridge like others, but name no
    component (a component of null ids only is null).  Repeated rows come back as often as they came.
    An empty table gives an empty result; other columns are not looked at.
    """
    half = radius // 2
    if radius % 2:
        raise ValueError("the radius must be even: both halves then meet")
    small_batches(docs.sparkSession)
    prints = materialise(fingerprints(docs, id_col, text_col, words_per_shingle), "fingerprints")
    unique = materialise(prints.groupBy("fp").agg(F.min("id").alias("rep")), "unique")
    bits = leading_bits(unique.count(), half, rows_per_bucket)

    def link(key, pdf):
        fp = pdf["fp"].to_numpy(np.int64).view(np.uint64)
        root = forest(len(fp), link_bucket(fp, int(key[1]), int(key[0]), radius))
        give_back()
        moved = np.flatnonzero(root != np.arange(len(fp)))
        return pd.DataFrame({"a": fp[moved].view(np.int64), "b": fp[root[moved]].view(np.int64)})

    dealt = _buckets(unique.select(F.lit(0).alias("part"), "fp"), bits, half, MOST_IN_BUCKET * rows_per_bucket)
    edges = dealt.groupBy("bits", "bucket").applyInPandas(link, "a long, b long")
    # fingerprints are the nodes, so those of rows without an id link, and bridge, like any other
    found = components(edges)
    root = F.coalesce("component", "fp").alias("root")
    rooted = materialise(unique.join(found, unique["fp"] == found["node"], "left").select("fp", "rep", root), "rooted")
    least = rooted.groupBy(F.bitwise_not("root").alias("r_key")).agg(F.min("rep").alias("component_id"))
    named = rooted.join(least, F.col("root") == F.bitwise_not("r_key")).select(F.col("fp").alias("ufp"), "component_id")
    return prints.join(named, prints["fp"] == named["ufp"]).select(
        F.col("id").alias(id_col),
        F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
        "component_id",
    )
