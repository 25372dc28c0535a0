"""Embedding near-dedup with a hierarchical navigable small-world graph (HNSW) for each shard.

Vectors of one label are dealt to shards of bounded size, each shard gets a graph, and every vector of the label queries
every shard of it. A query descends the upper layers greedily and runs a beam search on the lowest; while the worst vector
in its beam still links, or an audit of the shard's queries against brute force shows too little recall, the beam is
widened; a beam as wide as the shard is exact. Queries advance together as rows of numpy arrays. Links are confirmed by
cosine in double precision, and united to components.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, components

THRESHOLD = 0.93
#: Vectors in a shard.
SHARD_ROWS = 8192
#: Queries that share a task.
BLOCK_ROWS = 2048
NEIGHBOURS = 16
BEAM = 48
AUDIT_QUERIES, AUDIT_RECALL = 64, 0.995
_ROWS = 512
#: What single precision may lose of a cosine, and more.
SLACK = 1e-5


class Graph:
    """HNSW over unit vectors, built in bulk: the neighbours of a layer are chosen among the exact nearest ones.

    neighbours[l] is a table of nodes of layer l, padded with the node itself; layer 0 holds all vectors, and each node
    reaches layer l with probability NEIGHBOURS^-l, by a hash of its place.
    """

    def __init__(self, unit: np.ndarray):
        self.unit = unit
        n = len(unit)
        draw = np.random.default_rng(n).random(n)
        level = np.minimum((-np.log(1 - draw) / np.log(NEIGHBOURS)).astype(int), 8)
        level[0] = level.max() if n else 0
        self.members = [np.flatnonzero(level >= k) for k in range(int(level.max()) + 1)] if n else []
        self.neighbours = [self._link(m) for m in self.members]

    def _link(self, members: np.ndarray) -> np.ndarray:
        """Table of each member's neighbours, as rows of the layer: near but diverse ones, both ways, and a ring.

        The ring ties the layer together, so that a beam can always move on.
        """
        n = len(members)
        m = min(2 * NEIGHBOURS if n == len(self.unit) else NEIGHBOURS, n - 1)
        if m <= 0:
            return np.arange(n)[:, None]
        vectors = self.unit[members]
        want = min(n, 2 * m + 1)
        near = np.empty((n, want), np.int64)
        for at in range(0, n, _ROWS):
            sim = vectors[at : at + _ROWS] @ vectors.T
            part = np.argpartition(-sim, want - 1, axis=1)[:, :want] if want < n else np.tile(np.arange(n), (len(sim), 1))
            order = np.argsort(-np.take_along_axis(sim, part, axis=1), axis=1, kind="stable")
            near[at : at + _ROWS] = np.take_along_axis(part, order, axis=1)
        chosen = np.full((n, m), -1, np.int64)
        for at in range(0, n, _ROWS):
            rows = np.arange(at, min(at + _ROWS, n))
            cand = near[rows]
            v = vectors[cand]
            sim = (v @ vectors[rows][:, :, None])[:, :, 0]
            between = v @ v.transpose(0, 2, 1)
            taken = np.zeros(cand.shape, bool)
            count = np.zeros(len(rows), int)
            for c in range(cand.shape[1]):
                # A candidate stays if it is nearer to the node than to any neighbour taken before.
                worse = (taken & (between[:, c] > sim[:, c, None])).any(axis=1)
                ok = ~worse & (cand[:, c] != rows) & (count < m - m // 2)
                taken[ok, c] = True
                count += ok
            # The rest of the row goes to the nearest ones, which a dense group needs.
            for c in range(cand.shape[1]):
                ok = ~taken[:, c] & (cand[:, c] != rows) & (count < m)
                taken[ok, c] = True
                count += ok
            place = np.cumsum(taken, axis=1) - 1
            r, c = np.nonzero(taken)
            chosen[rows[r], place[r, c]] = cand[r, c]
        # Links both ways: each node also gets up to m of those that chose it.
        src, k = np.nonzero(chosen >= 0)
        dst = chosen[src, k]
        order = np.lexsort((k, dst))
        src, dst = src[order], dst[order]
        nth = np.arange(len(dst)) - np.searchsorted(dst, dst)
        back = np.full((n, m), -1, np.int64)
        keep = nth < m
        back[dst[keep], nth[keep]] = src[keep]
        ring = np.stack([np.roll(np.arange(n), 1), np.roll(np.arange(n), -1)], axis=1)
        table = np.concatenate([chosen, back, ring], axis=1)
        return np.where(table < 0, np.arange(n)[:, None], table)

    @cached_property
    def single(self) -> np.ndarray:
        """The vectors in single precision, which walks use; it is made where it is first needed and doesn't travel."""
        return self.unit.astype(np.float32)

    def _descend(self, queries: np.ndarray) -> np.ndarray:
        """Row of layer 0 that the greedy walk through the upper layers reaches."""
        at = np.zeros(len(queries), np.int64)  # node ids; node 0 is in every layer
        for layer in range(len(self.members) - 1, 0, -1):
            members, table = self.members[layer], self.neighbours[layer]
            row = np.searchsorted(members, at)
            best = np.einsum("qd,qd->q", queries, self.single[members[row]])
            active = np.arange(len(queries))
            while len(active):
                near = table[row[active]]
                sim = (self.single[members[near]] @ queries[active][:, :, None])[:, :, 0]
                pick = sim.argmax(axis=1)
                top = sim[np.arange(len(active)), pick]
                better = top > best[active] + 1e-6
                active, pick, top, near = active[better], pick[better], top[better], near[better]
                row[active] = near[np.arange(len(active)), pick]
                best[active] = top
            at = members[row]
        return at

    def search(self, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """Per query `beam` nodes by similarity, falling (-1 pads), and the similarities."""
        n, q, unit = len(self.unit), len(queries), self.single
        queries = queries.astype(np.float32)
        beam = min(beam, n)
        start = self._descend(queries)
        ids = np.full((q, beam), -1, np.int64)
        sims = np.full((q, beam), -np.inf, np.float32)
        open_ = np.zeros((q, beam), bool)
        seen = np.zeros((q, n), bool)
        all_q = np.arange(q)
        ids[:, 0], sims[:, 0], open_[:, 0] = start, np.einsum("qd,qd->q", queries, unit[start]), True
        seen[all_q, start] = True
        table = self.neighbours[0]
        active = all_q
        while len(active):
            # Rows are sorted, so the first open place is the best one; a few are opened at once.
            k = np.argsort(~open_[active], axis=1, kind="stable")[:, :4]
            is_open = np.take_along_axis(open_[active], k, axis=1)
            nodes = np.where(is_open, np.take_along_axis(ids[active], k, axis=1), -1)
            open_[active[:, None], k] = False
            near = np.where(nodes[:, :, None] >= 0, table[np.maximum(nodes, 0)], -1).reshape(len(active), -1)
            r, c = np.nonzero(near >= 0)
            node = near[r, c]
            fresh = ~seen[active[r], node]
            flat = np.sort(r[fresh] * n + node[fresh])
            flat = flat[np.diff(flat, prepend=-1) > 0]
            r, node = flat // n, flat % n
            seen[active[r], node] = True
            if len(r):
                sim = np.einsum("pd,pd->p", queries[active[r]], unit[node])
                use = sim > sims[active[r], -1]
                r, node, sim = r[use], node[use], sim[use]
            if len(r):
                touched, first, count = np.unique(r, return_index=True, return_counts=True)
                wide = int(count.max())
                slot = np.arange(len(r)) - np.repeat(first, count)
                row = np.repeat(np.arange(len(touched)), count)
                new_ids, new_sims = np.full((len(touched), wide), -1, np.int64), np.full((len(touched), wide), -np.inf, np.float32)
                new_ids[row, slot], new_sims[row, slot] = node, sim
                rows = active[touched]
                i = np.concatenate([ids[rows], new_ids], axis=1)
                s = np.concatenate([sims[rows], new_sims], axis=1)
                o = np.concatenate([open_[rows], new_ids >= 0], axis=1)
                order = np.argsort(-s, axis=1, kind="stable")[:, :beam]
                ids[rows], sims[rows], open_[rows] = (np.take_along_axis(x, order, axis=1) for x in (i, s, o))
            active = active[open_[active].any(axis=1)]
        return ids, sims


def _exact(graph: Graph, queries: np.ndarray, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for at in range(0, len(queries), _ROWS):
        q, node = np.nonzero(queries[at : at + _ROWS].astype(np.float32) @ graph.single.T >= threshold - SLACK)
        yield q + at, node


def linked(graph: Graph, queries: np.ndarray, threshold: float = THRESHOLD) -> tuple[np.ndarray, np.ndarray]:
    """(query, node) pairs of a similarity of at least the threshold less SLACK, sorted; the caller confirms them."""
    n = len(graph.unit)
    if not n or not len(queries):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    audit = np.unique(np.linspace(0, len(queries) - 1, min(AUDIT_QUERIES, len(queries))).astype(int))
    truth = list(_exact(graph, queries[audit], threshold))
    expected = len(np.concatenate([q for q, _ in truth]))
    beam = min(BEAM, n)
    while True:
        pairs, width = [], {}
        todo, wide = np.arange(len(queries)), beam
        while len(todo):
            full = []
            if wide >= n // 4:
                # So wide a beam visits nearly the whole shard; all of it is compared in blocks instead.
                for q, node in _exact(graph, queries[todo], threshold):
                    pairs.append((todo[q], node))
                break
            step = max(16, min(1024, 4_000_000 // (wide + n // 8)))
            for at in range(0, len(todo), step):
                part = todo[at : at + step]
                ids, sims = graph.search(queries[part], wide)
                filled = sims[:, -1] >= threshold - SLACK  # even the worst links: there may be more
                full.append(part[filled])
                q, k = np.nonzero((sims >= threshold - SLACK) & ~filled[:, None])
                pairs.append((part[q], ids[q, k]))
            todo, wide = np.concatenate(full), wide * 4
        q, node = (np.concatenate(x) for x in zip(*pairs, strict=True)) if pairs else (np.zeros(0, np.int64),) * 2
        del width
        found = int(np.isin(q, audit).sum())
        if found >= AUDIT_RECALL * expected or beam >= n:
            order = np.lexsort((node, q))
            return q[order], node[order]
        beam = min(n, beam * 2)


def _pack(keys: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    """A shard as one row: its ids, weights and graph, and apart from them its vectors as blocks of queries."""
    pdf = pdf.sort_values("vec_id", kind="stable")
    unit = np.stack([np.asarray(x, np.float64) for x in pdf["embedding"]])
    unit /= np.linalg.norm(unit / np.abs(unit).max(axis=1, keepdims=True), axis=1, keepdims=True) * np.abs(unit).max(axis=1, keepdims=True)
    graph = Graph(unit)
    ids = pdf["vec_id"].to_numpy(np.int64)
    data = pickle.dumps((ids, pdf["m"].to_numpy(np.int64), graph), protocol=5)
    blocks = [pickle.dumps((ids[a : a + BLOCK_ROWS], unit[a : a + BLOCK_ROWS]), protocol=5) for a in range(0, len(ids), BLOCK_ROWS)]
    return pd.DataFrame({"label": [keys[0]], "dim": [keys[1]], "shard": [keys[2]], "blocks": [blocks], "data": [data]})


def _roots(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Smallest node reachable from each of 0..n-1."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[u], root[v])
        before = root.copy()
        np.minimum.at(root, u, low)
        np.minimum.at(root, v, low)
        root = np.minimum(root, root[root])
        if (root == before).all():
            return root


def _query(pdf: pd.DataFrame) -> pd.DataFrame:
    """Links of one block of one shard's vectors into another shard: count for each vector, and edges that keep components."""
    row = pdf.iloc[0]
    ids, weight, graph = pickle.loads(row["data"])
    q_ids, vectors = pickle.loads(row["queries"])
    q, node = linked(graph, vectors)
    sim = np.concatenate([np.einsum("pd,pd->p", vectors[q[a : a + 100_000]], graph.unit[node[a : a + 100_000]]) for a in range(0, len(q), 100_000)] or [np.zeros(0)])
    ok = (sim >= THRESHOLD) & (q_ids[q] != ids[node])
    q, node = q[ok], node[ok]
    links = np.bincount(q, weight[node], minlength=len(q_ids)).astype(np.int64)
    # Of the links only a spanning forest leaves the task: at most one edge for each vector that takes part.
    root = _roots(len(q_ids) + len(ids), q, node + len(q_ids))
    name = np.concatenate([q_ids, ids])
    joined = np.flatnonzero(root != np.arange(len(root)))
    return pd.DataFrame({
        "u": np.concatenate([q_ids, name[joined]]), "v": np.concatenate([q_ids, name[root[joined]]]),
        "links": np.concatenate([links, np.zeros(len(joined), np.int64)]),
    })


def near_duplicates(vectors: DataFrame) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row of vectors (vec_id, embedding, label).

    Vectors that are null, empty, zero, or hold null or non-finite components, and rows with a null label, link with
    nothing; vectors of different lengths don't either. Equal vectors of a label are one node with a weight. Rows with one
    vec_id share their components; a row with a null id counts as a link of others and is its own component (null, kept).
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark)
    rows = vectors.select("vec_id", "label", F.col("embedding").cast("array<double>").alias("embedding"))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0)
    fit = F.coalesce(F.col("label").isNotNull() & finite, F.lit(False))
    rows = scratch.write(rows.withColumn("node", F.when(fit, F.xxhash64("label", "embedding"))), "vectors")
    members = rows.select("vec_id", "node")
    nodes = rows.filter("node is not null").groupBy("node", "label").agg(F.first("embedding").alias("embedding"), F.count("*").alias("m")).withColumn("dim", F.size("embedding"))
    nodes = scratch.write(nodes, "nodes")
    counts = nodes.groupBy("label", "dim").agg(F.ceil(F.count("*") / SHARD_ROWS).alias("shards"))
    dealt = nodes.join(counts, ["label", "dim"]).withColumn("shard", F.pmod(F.xxhash64(F.lit(3), "node"), F.col("shards")))
    dealt = dealt.select(F.col("node").alias("vec_id"), "m", "embedding", "label", "dim", "shard")
    types = dict(nodes.dtypes)
    schema = f"label {types['label']}, dim int, shard long, blocks array<binary>, data binary"
    index = scratch.write(dealt.groupBy("label", "dim", "shard").applyInPandas(_pack, schema), "index")
    blocks = index.select("label", "dim", F.col("shard").alias("from"), F.posexplode("blocks").alias("block", "queries"))
    pairs = blocks.join(index, ["label", "dim"]).select("label", "dim", "from", "block", "shard", "queries", "data")
    out = scratch.write(pairs.groupBy("label", "dim", "from", "block", "shard").applyInPandas(lambda pdf: _query(pdf), "u long, v long, links long"), "links")
    total = out.filter("u = v").groupBy(F.col("u").alias("node")).agg(F.sum("links").alias("links"))
    group = components(out.filter("u <> v").select("u", "v"), scratch).distinct().withColumnRenamed("component", "root")
    named = members.filter("node is not null").groupBy("node").agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("m"))
    named = scratch.write(named.join(group, "node", "left").join(total, "node", "left").withColumn("root", F.coalesce("root", "node")), "groups")
    least = named.groupBy("root").agg(F.min("vec_id").alias("component_id"))
    by_node = scratch.write(named.join(least, "root").select("node", "component_id", (F.coalesce("links", F.lit(0)) + F.col("m") - 1).alias("n_links")), "ids")
    result = members.join(by_node, "node", "left")
    result = result.withColumn("component_id", F.when(F.col("node").isNull(), F.col("vec_id")).otherwise(F.col("component_id")))
    return result.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))
