"""Where the nodes of a block go in a level of communities, worked out inside a task: all other nodes stay where they are."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Share of the nodes with a better community that move at once, and the share of all nodes below which all of them do.
AT_ONCE, FEW = 0.5, 0.01
#: A move must gain so much: well above the rounding of sums.
LEAST_GAIN = 1e-12
#: What `task` returns.
SCHEMA = "task int, node long, k double, c long, to long, alt long, went boolean, q double"


def task(batches: Iterator[pa.RecordBatch], total: float, resolution: float, salt: int) -> Iterator[pa.RecordBatch]:
    """Of each block (a number in `task`): links (node, other, weight) of its nodes, where own is null, and nodes with k, their community in
    other and its degree in weight; own tells whether a node is of the block. Gives the block's nodes with the community `to` that they
    go to, null where they stay, and q, their part of the modularity before they go."""
    rows = pa.Table.from_batches(list(batches)) if (batches := [x for x in batches if x.num_rows]) else None
    for block in pc.unique(rows["task"]).sort() if rows else []:
        of = rows.filter(pc.equal(rows["task"], block))
        links, nodes = of.filter(pc.is_null(of["own"])), of.filter(pc.is_valid(of["own"])).sort_by("node")
        ids, k, own = (nodes[x].to_numpy() for x in ("node", "k", "own"))
        a, b = (np.searchsorted(ids, links[x].to_numpy()) for x in ("node", "other"))
        order = np.lexsort((b, a))
        names, c = np.unique(nodes["other"].to_numpy(), return_inverse=True)
        tot = np.zeros(len(names))
        tot[c] = nodes["weight"].to_numpy()
        to, inside = settle(a[order], b[order], links["weight"].to_numpy()[order], c, tot, k, own, ids, total, resolution, salt + (block.as_py() << 8))
        q = inside / (2 * total) - resolution * (k * tot[c])[own] / (4 * total * total)
        mine = nodes.filter(pa.array(own))
        to = pa.array(names[to[own]], mask=(to == c)[own])
        found = {"task": mine["task"], "node": mine["node"], "k": mine["k"], "c": mine["other"], "to": to, "alt": mine["alt"], "went": mine["went"], "q": q}
        yield from pa.table(found).combine_chunks().to_batches()


def drawn(ids: np.ndarray, salt: int) -> np.ndarray:
    """A number of 64 bits for each id; different ids get different ones."""
    x = ids.astype(np.uint64) + np.uint64(salt * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ x >> np.uint64(shift)) * np.uint64(factor)
    return x ^ x >> np.uint64(31)


def settle(a: np.ndarray, b: np.ndarray, weight: np.ndarray, c: np.ndarray, tot: np.ndarray, k: np.ndarray, own: np.ndarray, ids: np.ndarray, m: float, resolution: float, salt: int) -> tuple[np.ndarray, np.ndarray]:
    """Communities once no own node would gain by a move, and the weight of each own node's links within its community at first.

    Links (a, b) go out from own nodes, in order; communities are numbered in the order of their ids. In a round, drawn nodes go to the neighbouring
    community with the largest gain, the smallest id on ties. Where that doesn't raise the modularity, only those go that are the first
    by their draw at both of their communities: these moves change nothing for each other, so their gains add up.
    """
    n, here, to, inside, turn = len(tot), np.flatnonzero(own), c.copy(), None, 0
    rest = tot - np.bincount(c[here], k[here], n)
    part, weights = np.where(own[b], 0.5, 1.0) * weight, np.concatenate((weight, np.zeros(len(here))))

    def value(to: np.ndarray, tot: np.ndarray) -> float:
        return part[to[a] == to[b]].sum() / m - resolution * (tot * tot).sum() / (4 * m * m)

    while len(here):
        key = np.concatenate((a * n + to[b], here * n + to[here]))
        order = np.argsort(key, kind="stable")
        key = key[order]
        starts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        near = np.add.reduceat(weights[order], starts)
        node, com = np.divmod(key[starts], n)
        stays = com == to[node]
        gain = np.rint((near / m - resolution * k[node] * (tot[com] - np.where(stays, k[node], 0.0)) / (2 * m * m)) / LEAST_GAIN) * LEAST_GAIN
        first = np.concatenate(([True], node[1:] != node[:-1]))
        best = np.maximum.reduceat(gain, np.flatnonzero(first))
        inside = near[stays] if inside is None else inside
        top = np.flatnonzero(gain == best[np.cumsum(first) - 1])
        top = top[np.concatenate(([True], node[top][1:] != node[top][:-1]))]
        better = best > gain[stays] + LEAST_GAIN
        x, goal = here[better], com[top][better]
        if not len(x):
            break
        turn += 1
        draw = drawn(ids[x], salt + (turn << 32))
        go = draw < np.uint64(AT_ONCE * 2**64) if len(x) >= FEW * len(here) else np.ones(len(x), bool)
        if go.any():
            then = to.copy()
            then[x[go]] = goal[go]
            after = rest + np.bincount(then[here], k[here], n)
        if not go.any() or value(then, after) <= value(to, tot) + LEAST_GAIN / 10:
            low = np.full(n, np.iinfo(np.uint64).max)
            np.minimum.at(low, to[x], draw)
            np.minimum.at(low, goal, draw)
            go = (draw == low[to[x]]) & (draw == low[goal])
            then = to.copy()
            then[x[go]] = goal[go]
            after = rest + np.bincount(then[here], k[here], n)
        to, tot = then, after
    return to, np.zeros(0) if inside is None else inside
