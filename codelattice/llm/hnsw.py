"""Embedding near-dedup with hierarchical navigable small-world graphs, one per shard.

Each shard builds its graph in one task and audits it: sampled vectors, of the shard and of others,
are searched as queries are and by brute force, and the beam is widened until the audit passes; a
shard whose audit does not pass is scanned whole.  Vectors travel in packed blocks.  Every block
meets every shard: a task gets a shard's graph first and then a stream of blocks, one at a time, so
it holds one graph and one block whatever their number.  What the beam returns is verified by cosine
in double precision.  A query whose whole beam is within the threshold may have more partners than
the beam is wide; it is compared with the whole shard in matrix blocks instead.  Counts of links and
a spanning forest leave the task, never all pairs of a group.
"""

from __future__ import annotations

import io

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codelattice.llm.shared import components, give_back, materialise, sized, small_batches
from codelattice.llm.simhash import forest

#: Bytes of a shard's vectors in double precision on average, and the least number of shards.
SHARD_BYTES, LEAST_SHARDS = 32 << 20, 6
#: Queries that travel and are searched together at most, and cells of the table of vectors met by them.
BLOCK_ROWS, MET_CELLS = 1_024, 1 << 25
#: Shards' worth of queries that one copy of a graph meets: copies of graphs are so much less than queries.
SHARDS_PER_SLICE, LEAST_SLICES = 8, 2
#: Links per vector: chosen at insertion, and kept in all.
CHOSEN, WIDTH = 16, 32
#: Beam at insertion; first beam of a query; vectors of a beam that are expanded at once.
BUILD_BEAM, FIRST_BEAM, EXPAND = 48, 16, 4
#: Audited vectors per shard, own, others' and made ones each, and the recall of links and of made links that passes.
AUDIT_ROWS, LINK_RECALL, MADE_RECALL = 300, 0.995, 0.99
#: Ratio of a layer's vectors to those of the layer above; a top layer is compared whole.
RATIO, TOP = 16, 48
AT_ONCE = 1_024
SLACK = 1e-3


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows at length 1, in single precision for the search."""
    wide = vectors.astype(np.float64)
    return (wide / np.linalg.norm(wide, axis=1, keepdims=True)).astype(np.float32)


def beam_search(vectors: np.ndarray, links: np.ndarray, queries: np.ndarray, entries: np.ndarray, beam: int):
    """(ids, similarities) of the best beam vectors found from the entries (distinct or -1), best first; -1 where fewer were."""
    at_once = max(16, MET_CELLS // max(1, len(links)))
    parts = [
        _beam_search(vectors, links, queries[at : at + at_once], entries[at : at + at_once], beam)
        for at in range(0, len(queries), at_once)
    ]
    return tuple(np.concatenate(x) for x in zip(*parts)) if parts else (np.empty((0, beam), np.int64), np.empty((0, beam), np.float32))


def _beam_search(vectors, links, queries, entries, beam):
    n = len(queries)
    met = np.full((n, len(links)), -1, np.int16)  # the column in which a query met a vector last
    row = np.arange(n)[:, None]
    real = entries >= 0
    met[np.broadcast_to(row, entries.shape)[real], entries[real]] = 0
    found = np.einsum("qed,qd->qe", vectors[entries], queries)
    found[~real] = -np.inf
    width = max(beam, entries.shape[1])
    ids, sims = np.full((n, width), -1, np.int64), np.full((n, width), -np.inf, np.float32)
    ids[:, : entries.shape[1]], sims[:, : entries.shape[1]] = entries, found
    if width > beam:
        top = np.argpartition(-sims, beam - 1, axis=1)[:, :beam]
        ids, sims = np.take_along_axis(ids, top, 1), np.take_along_axis(sims, top, 1)
    open_ = sims > -np.inf
    active = np.arange(n)
    k = min(EXPAND, beam)
    columns = np.arange(k * links.shape[1], dtype=np.int16)
    while len(active):
        waiting = np.where(open_[active], sims[active], -np.inf)
        best = np.argpartition(-waiting, k - 1, axis=1)[:, :k] if k < beam else np.broadcast_to(np.arange(beam), waiting.shape)
        ready = np.take_along_axis(waiting, best, 1) > -np.inf
        more = ready.any(axis=1)
        active, best, ready = active[more], best[more], ready[more]
        if not len(active):
            break
        open_[active[:, None], best] &= ~ready
        near = np.where(ready[:, :, None], links[ids[active[:, None], best]], -1).reshape(len(active), -1)
        place = np.nonzero(near >= 0)
        q, v = active[place[0]], near[place]
        fresh = met[q, v] < 0
        place, q, v = (place[0][fresh], place[1][fresh]), q[fresh], v[fresh]
        met[q, v] = columns[place[1]]  # of one vector met from several sides the last stays
        last = met[q, v] == columns[place[1]]
        place, q, v = (place[0][last], place[1][last]), q[last], v[last]
        sim = np.full(near.shape, -np.inf, np.float32)
        sim[place] = np.einsum("pd,pd->p", vectors[v], queries[q])
        all_sims = np.concatenate([sims[active], sim], axis=1)
        top = np.argpartition(-all_sims, beam - 1, axis=1)[:, :beam]
        sims[active] = np.take_along_axis(all_sims, top, 1)
        ids[active] = np.take_along_axis(np.concatenate([ids[active], near], axis=1), top, 1)
        open_[active] = np.take_along_axis(np.concatenate([open_[active], sim > -np.inf], axis=1), top, 1)
    order = np.argsort(-sims, axis=1, kind="stable")
    sims, ids = np.take_along_axis(sims, order, 1), np.take_along_axis(ids, order, 1)
    ids[sims == -np.inf] = -1
    return ids, sims


def _choose(vectors: np.ndarray, ids: np.ndarray, sims: np.ndarray, wanted: int) -> np.ndarray:
    """Of candidates sorted best first, those nearer to the vector than to any chosen before; then the best of the rest."""
    between = np.matmul(vectors[ids], vectors[ids].transpose(0, 2, 1))
    chosen = np.zeros(ids.shape, bool)
    number = np.zeros(len(ids), np.int64)
    highest = np.full(ids.shape, -np.inf, np.float32)  # of each candidate to those chosen so far
    for c in range(ids.shape[1]):
        fits = (ids[:, c] >= 0) & (highest[:, c] < sims[:, c]) & (number < wanted)
        chosen[:, c] = fits
        number += fits
        highest = np.where(fits[:, None], np.maximum(highest, between[:, c, :]), highest)
    rank = np.where(chosen, 0, 1) * ids.shape[1] + np.arange(ids.shape[1])[None, :]
    rank[ids < 0] = 10 * ids.shape[1]
    order = np.argsort(rank, axis=1)[:, :wanted]
    return np.take_along_axis(ids, order, 1)


def _connect(links: np.ndarray, vectors: np.ndarray, new: np.ndarray, picked: np.ndarray) -> None:
    """Set the new vectors' links and add the links back, keeping each vector's nearest."""
    links[new, : picked.shape[1]] = picked
    source = np.repeat(new, picked.shape[1])
    target = picked.ravel()
    real = target >= 0
    source, target = source[real], target[real]
    touched = np.unique(target)
    old = links[touched]
    held = old >= 0
    ends = np.concatenate([np.repeat(touched, WIDTH)[held.ravel()], target])
    others = np.concatenate([old.ravel()[held.ravel()], source])
    pairs = np.unique(np.stack([ends, others], axis=1), axis=0)
    near = np.einsum("pd,pd->p", vectors[pairs[:, 0]], vectors[pairs[:, 1]])
    order = np.lexsort((-near, pairs[:, 0]))
    ends, others = pairs[order, 0], pairs[order, 1]
    first = np.flatnonzero(np.concatenate([[True], ends[1:] != ends[:-1]]))
    place = np.arange(len(ends)) - np.repeat(first, np.diff(np.append(first, len(ends))))
    keep = place < WIDTH
    links[touched] = -1
    links[ends[keep], place[keep]] = others[keep]


class Graph:
    """A shard's layers over its vectors in an insertion order of its own: a layer is the first so many of them.

    Searches take and give places in the vectors as they were handed to build.  islands: vectors
    that no link path reaches from the layer above; they are compared with every query.
    """

    def __init__(self, vectors, order, sizes, links, islands=None, beam: int = FIRST_BEAM, whole: bool = False):
        self.vectors, self.order, self.sizes, self.links = vectors, order, sizes, links
        self.islands = np.empty(0, np.int64) if islands is None else islands
        self.beam, self.whole, self.recall, self.made_recall = beam, whole, 1.0, 1.0

    @classmethod
    def build(cls, vectors: np.ndarray) -> Graph:
        """A graph over unit vectors, inserted in a shuffled order: one in order of likeness would leave parts unreachable."""
        order = np.random.default_rng(3).permutation(len(vectors))
        vectors = vectors[order]
        sizes = [len(vectors)]
        while sizes[-1] > TOP or len(sizes) == 1:
            sizes.append(max(1, sizes[-1] // RATIO))
        sizes.reverse()
        graph = cls(vectors, order, sizes[:1], [])
        for size in sizes[1:]:
            links = np.full((size, WIDTH), -1, np.int32)
            begin = graph.sizes[-1]
            if graph.links:
                links[:begin] = graph.links[-1]
            else:
                for at in range(0, begin, AT_ONCE):
                    new = np.arange(at, min(begin, at + AT_ONCE))
                    _insert(vectors, links, new, np.empty((len(new), 0), np.int64))
            for at, end in _batches(begin, size):
                new = np.arange(at, end)
                ids, _ = beam_search(vectors, links, vectors[new], graph._descend(vectors[new], 8), BUILD_BEAM)
                _insert(vectors, links, new, ids)
            graph.sizes.append(size)
            graph.links.append(links)
        graph.islands = _unreached(graph.links[-1], graph.sizes[-2])
        return graph

    def _descend(self, queries: np.ndarray, beam: int, layers: int | None = None) -> np.ndarray:
        """The best vectors of the lowest of so many layers, as entries to the next."""
        top = self.vectors[: self.sizes[0]]
        k = min(beam, len(top))
        sims = queries @ top.T
        entries = np.argpartition(-sims, k - 1, axis=1)[:, :k].astype(np.int64)
        for links in self.links[:layers]:
            entries, _ = beam_search(self.vectors, links, queries, entries, beam)
        return entries

    def search(self, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """(places, similarities), best first; -1 where fewer were found."""
        beam = min(beam, len(self.vectors))
        entries = self._descend(queries, 8, len(self.links) - 1)
        if len(self.islands):
            sims = queries @ self.vectors[self.islands].T
            k = min(8, len(self.islands))
            entries = np.concatenate([entries, self.islands[np.argpartition(-sims, k - 1, axis=1)[:, :k]]], axis=1)
        ids, sims = beam_search(self.vectors, self.links[-1], queries, entries, beam)
        return np.where(ids >= 0, self.order[ids], -1), sims

    def partners(self, queries: np.ndarray, least: float):
        """Pairs (query, place) of similarity least or more, in parts: from the beam, or where it is full from all of the shard."""
        for at in range(0, len(queries), AT_ONCE):
            block = np.arange(at, min(len(queries), at + AT_ONCE))
            full = np.ones(len(block), bool)
            if not self.whole:
                ids, sims = self.search(queries[block], self.beam)
                full = (ids >= 0).all(axis=1) & (sims[:, -1] >= least) & (self.beam < len(self.vectors))
                row, col = np.nonzero((sims >= least) & (ids >= 0) & ~full[:, None])
                yield block[row], ids[row, col]
            dense = block[full]
            for begin in range(0, len(dense), 256):
                part = dense[begin : begin + 256]
                row, col = np.nonzero(queries[part] @ self.vectors.T >= least)
                yield part[row], self.order[col]

    def audit(self, threshold: float, others: np.ndarray, seed: int = 5) -> None:
        """Widen the beam until sampled vectors, and others, find all their links.

        Every link of the sample counts.  Real links may be few, and those near the threshold are the
        hardest to find, so for each sampled vector another is made at just that similarity, which
        has to find it.  If a quarter of the shard in the beam does not do, the shard is scanned
        whole, which is exact.
        """
        n = len(self.vectors)
        draw = np.random.default_rng(seed)
        own = draw.permutation(n)[:AUDIT_ROWS]
        queries = np.concatenate([self.vectors[own], others])
        itself = self.order[own]
        sims = np.empty((len(queries), n), np.float32)
        sims[:, self.order] = queries @ self.vectors.T
        sims[np.arange(len(own)), itself] = -np.inf
        linked = sims >= threshold
        made = _at_similarity(self.vectors[own], threshold, draw)
        self.beam = min(FIRST_BEAM, n)
        while True:
            found = np.zeros_like(linked)
            for q, p in self.partners(queries, threshold - SLACK):
                found[q, p] = True
            met = np.zeros(len(own), bool)
            for q, p in self.partners(made, threshold - SLACK):
                met[q[p == itself[q]]] = True
            self.recall = float((found & linked).sum() / linked.sum()) if linked.any() else 1.0
            self.made_recall = float(met.mean())
            if self.recall >= LINK_RECALL and self.made_recall >= MADE_RECALL:
                return
            if self.beam >= n / 4:
                self.whole, self.recall, self.made_recall = True, 1.0, 1.0
                return
            self.beam *= 2

    def dump(self) -> bytes:
        out = io.BytesIO()
        links = {f"links{i}": x for i, x in enumerate(self.links)}
        np.savez(out, sizes=np.array(self.sizes), order=self.order.astype(np.int32), islands=self.islands.astype(np.int32), search=np.array([self.beam, self.whole]), **links)
        return out.getvalue()

    @classmethod
    def load(cls, data: bytes, vectors: np.ndarray) -> Graph:
        saved = np.load(io.BytesIO(data))
        sizes, order = saved["sizes"].tolist(), saved["order"].astype(np.int64)
        beam, whole = saved["search"].tolist()
        return cls(vectors[order], order, sizes, [saved[f"links{i}"] for i in range(len(sizes) - 1)], saved["islands"].astype(np.int64), beam, bool(whole))


def _at_similarity(vectors: np.ndarray, similarity: float, draw: np.random.Generator) -> np.ndarray:
    """A unit vector at the given cosine from each of the unit vectors, in a drawn direction."""
    away = draw.normal(size=vectors.shape)
    away -= (away * vectors).sum(axis=1, keepdims=True) * vectors
    length = np.linalg.norm(away, axis=1, keepdims=True)
    # in one dimension there is no other direction, and the vector is its own partner
    away = np.divide(away, length, out=np.zeros_like(away), where=length > 1e-9)
    return unit(similarity * vectors + max(0.0, 1 - similarity**2) ** 0.5 * away)


def _unreached(links: np.ndarray, entries: int) -> np.ndarray:
    """The vectors of a layer that no path of links reaches from its first entries vectors."""
    reached = np.zeros(len(links), bool)
    reached[:entries] = True
    front = np.arange(entries)
    while len(front):
        near = np.unique(links[front])
        front = near[(near >= 0) & ~reached[near]]
        reached[front] = True
    return np.flatnonzero(~reached)


def _batches(begin: int, end: int):
    while begin < end:
        size = min(end - begin, AT_ONCE, max(64, begin // 2))
        yield begin, begin + size
        begin += size


def _insert(vectors: np.ndarray, links: np.ndarray, new: np.ndarray, found: np.ndarray) -> None:
    """Link a batch to what its searches found and to the nearest of the batch itself."""
    own = vectors[new] @ vectors[new].T
    np.fill_diagonal(own, -np.inf)
    k = min(CHOSEN, len(new) - 1)
    inner = new[np.argpartition(-own, k - 1, axis=1)[:, :k]] if k > 0 else np.empty((len(new), 0), np.int64)
    ids = np.concatenate([found, inner], axis=1)
    if not ids.shape[1]:
        return
    sims = np.where(ids >= 0, np.einsum("qed,qd->qe", vectors[ids], vectors[new]), -np.inf)
    order = np.argsort(-sims, axis=1, kind="stable")
    ids, sims = np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)
    _connect(links, vectors, new, _choose(vectors, ids, sims, CHOSEN))


def block_links(graph: Graph, names: np.ndarray, base: np.ndarray, copies: np.ndarray, query_names: np.ndarray, queries: np.ndarray, threshold: float):
    """(links of each query in this shard, counting copies; forest edges as two arrays of names)."""
    counts = np.zeros(len(queries), np.int64)
    wide = queries.astype(np.float64)
    length, base_length = np.linalg.norm(wide, axis=1), np.linalg.norm(base, axis=1)
    edges_a, edges_b = [names[:0]], [names[:0]]
    for q, b in graph.partners(unit(queries), threshold - SLACK):
        for begin in range(0, len(q), 200_000):
            qs, bs = q[begin : begin + 200_000], b[begin : begin + 200_000]
            cosine = np.einsum("pd,pd->p", wide[qs], base[bs]) / (length[qs] * base_length[bs])
            real = (cosine >= threshold) & (query_names[qs] != names[bs])
            qs, bs = qs[real], bs[real]
            counts += np.bincount(qs, copies[bs], len(queries)).astype(np.int64)
            kept = _spanning(query_names[qs], names[bs])
            edges_a.append(kept[0])
            edges_b.append(kept[1])
    return counts, *_spanning(np.concatenate(edges_a), np.concatenate(edges_b))


def _spanning(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A star per component of the links: each name with the smallest of its component."""
    nodes, place = np.unique(np.concatenate([a, b]), return_inverse=True)
    root = forest(len(nodes), np.stack([place[: len(a)], place[len(a) :]], axis=1))
    moved = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[moved], nodes[root[moved]]


def embedding_groups(
    table: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    threshold: float = 0.95,
    shard_bytes: int = SHARD_BYTES,
    least_shards: int = LEAST_SHARDS,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """One row per input row: (id_col, n_links, component_id, kept, audit_recall).

    Vectors that are null, empty, zero, or hold a null or non-finite component link with nothing,
    as do rows with a null id (component_id null, kept false) and vectors of other lengths.  Equal
    vectors collapse to one before the search and count as links of each other; n_links counts
    every other row linked directly.  Rows that share an id are one node of the graph.  audit_recall
    is the least share of real or made links that any shard's audit found.  An empty table gives an empty result;
    other columns are not looked at.
    """
    spark = small_batches(table.sparkSession)
    single = isinstance(table.schema[vector_col].dataType, T.ArrayType) and isinstance(table.schema[vector_col].dataType.elementType, T.FloatType)
    cell, packed_type = ("float", np.dtype("<f4")) if single else ("double", np.dtype("<f8"))
    rows = table.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast(f"array<{cell}>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = F.coalesce(F.col("id").isNotNull() & finite & F.exists("v", lambda x: x != 0), F.lit(False))
    rows = rows.select("id", F.when(usable, F.col("v")).alias("v"))
    real = rows.where("v is not null")
    unique = materialise(real.groupBy("v").agg(F.min("id").alias("rep"), F.count("*").alias("copies")).withColumn("dim", F.size("v")), "vectors")
    bytes_ = F.col("n") * F.col("s_dim") * 8
    sizes = unique.groupBy(F.col("dim").alias("s_dim")).agg(F.count("*").alias("n"))
    sizes = sizes.withColumn("shards", F.greatest(F.lit(least_shards), F.ceil(bytes_ / shard_bytes)).cast("int"))
    sizes = materialise(sizes.withColumn("slices", F.greatest(F.lit(LEAST_SLICES), F.ceil(F.col("shards") / SHARDS_PER_SLICE)).cast("int")), "sizes")
    tasks = sizes.agg(F.sum(F.col("shards") * F.col("slices"))).first()[0] or 1
    placed = unique.join(sized(sizes), F.col("dim") == F.col("s_dim")).select("*", F.pmod(F.xxhash64(F.lit("shard"), "rep"), "shards").cast("int").alias("shard"))
    every_shard = F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("shard")
    drawn = F.pmod(F.xxhash64(F.lit("probe"), "rep"), F.lit(1_000_000)) < 1e6 * AUDIT_ROWS / F.col("n")
    probes = placed.where(drawn).select("dim", every_shard, "rep", "v", F.lit(0).cast("long").alias("copies"))

    fields = ["dim", "shard", "names", "copies", "base", "graph", "recall"]

    def build(key, pdf):
        own = pdf["copies"].to_numpy() > 0
        if not own.any():
            return pd.DataFrame([], columns=fields)
        held = pdf[own].sort_values("rep", ignore_index=True)
        base = np.stack(held["v"].to_numpy()).astype(packed_type)
        others = pdf[~own & ~pdf["rep"].isin(held["rep"])].sort_values("rep")
        graph = Graph.build(unit(base))
        graph.audit(threshold, unit(np.stack(others["v"].to_numpy())) if len(others) else base[:0].astype(np.float32))
        measured = min(graph.recall, graph.made_recall)
        packed = [held["rep"].to_numpy(np.int64).tobytes(), held["copies"].to_numpy(np.int64).tobytes(), base.tobytes(), graph.dump()]
        give_back()
        return pd.DataFrame([[key[0], key[1], *packed, measured]], columns=fields)

    graphs = materialise(
        placed.select("dim", "shard", "rep", "v", "copies").unionByName(probes).groupBy("dim", "shard").applyInPandas(
            build, "dim int, shard int, names binary, copies binary, base binary, graph binary, recall double"
        ),
        "graphs",
    )
    recall = graphs.agg(F.min("recall")).first()[0]

    def pack(batches):
        """Vectors in blocks of one length each."""
        waiting: dict[int, list] = {}
        count: dict[int, int] = {}

        def block(dim):
            parts = waiting.pop(dim)
            count.pop(dim)
            columns = [[dim], [b"".join(p[0].tobytes() for p in parts)], [b"".join(p[1].tobytes() for p in parts)]]
            return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), *[pa.array(c, pa.binary()) for c in columns[1:]]], names=["dim", "names", "base"])

        for batch in batches:
            dims, names = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            flat = batch.column(2).flatten().to_numpy(zero_copy_only=False).astype(packed_type)
            ends = np.cumsum(dims)
            for dim in np.unique(dims).tolist():
                which = np.flatnonzero(dims == dim)
                cells = flat[((ends[which] - dim)[:, None] + np.arange(dim)[None, :]).ravel()].reshape(-1, dim)
                for at in range(0, len(which), block_rows):
                    part = slice(at, at + block_rows)
                    waiting.setdefault(dim, []).append((names[which[part]].astype(np.int64), cells[part]))
                    count[dim] = count.get(dim, 0) + len(which[part])
                    if count[dim] >= block_rows:
                        yield block(dim)
        for dim in list(waiting):
            yield block(dim)

    blocks = materialise(unique.select("dim", "rep", "v").mapInArrow(pack, "dim int, names binary, base binary"), "blocks")
    blocks = blocks.join(sized(sizes), F.col("dim") == F.col("s_dim")).select("*", F.pmod(F.xxhash64("names"), "slices").cast("int").alias("slice"))
    none = F.lit(None).cast("binary")
    asked = blocks.select("dim", every_shard, "slices", "slice", F.lit(1).alias("kind"), "names", none.alias("copies"), "base", none.alias("graph"))
    told = graphs.join(sized(sizes), F.col("dim") == F.col("s_dim")).select(
        "dim", "shard", "slices", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"), F.lit(0).alias("kind"), "names", "copies", "base", "graph"
    )

    def meet(batches):
        graph = at = None
        edges, many = [], 0
        out = ["a", "b", "n"]

        def spanned():
            nonlocal edges, many
            a, b = _spanning(*[np.concatenate([e[k] for e in edges]) for k in (0, 1)])
            edges, many = [(a, b)], 0
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.nulls(len(a), pa.int64())], names=out)

        for batch in batches:
            for r in range(batch.num_rows):
                dim, shard, part, kind, names, copies, base, graph_ = (batch.column(k)[r].as_py() for k in range(8))
                own = np.frombuffer(names, np.int64)
                vectors = np.frombuffer(base, packed_type).reshape(len(own), dim)
                if kind == 0:
                    if edges:
                        yield spanned()
                    edges, many, at = [], 0, (dim, shard, part)
                    held, held_copies, held_base = own, np.frombuffer(copies, np.int64), vectors.astype(np.float64)
                    graph = Graph.load(graph_, unit(vectors))
                    continue
                if at != (dim, shard, part):
                    continue  # a shard without vectors has no graph
                counts, a, b = block_links(graph, held, held_base, held_copies, own, vectors, threshold)
                linked = np.flatnonzero(counts)
                yield pa.RecordBatch.from_arrays([pa.array(own[linked]), pa.nulls(len(linked), pa.int64()), pa.array(counts[linked])], names=out)
                edges.append((a, b))
                many += len(a)
                if many > 500_000:
                    spanned()
        if edges:
            yield spanned()

    keys = ["dim", "shard", "slice"]
    stream = told.unionByName(asked).repartitionById(tasks, F.col("shard") * F.col("slices") + F.col("slice"))
    stream = stream.sortWithinPartitions(*keys, "kind").select(*keys, "kind", "names", "copies", "base", "graph")
    found = materialise(stream.mapInArrow(meet, "a long, b long, n long"), "found")
    numbers = found.where("b is null").groupBy(F.col("a").alias("c_rep")).agg(F.sum("n").alias("n"))
    groups = components(found.where("b is not null").select("a", "b"))
    named = unique.join(numbers, unique["rep"] == numbers["c_rep"], "left").join(
        groups, unique["rep"] == groups["node"], "left"
    )
    named = materialise(
        named.select(
            F.col("v").alias("u_v"),
            (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
            F.coalesce("component", "rep").alias("component"),
        ),
        "named",
    )
    linked = real.join(named, F.col("v") == F.col("u_v")).select("id", "n_links", F.col("component").alias("component_id"))
    alone = rows.where("v is null").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return linked.unionByName(alone).select(
        F.col("id").alias(id_col), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"),
        F.lit(recall).cast("double").alias("audit_recall"),
    )
