"""Approximate nearest neighbours: a vantage-point tree for each shard.

Vectors are scaled to length one, where the Euclidean distance orders as the
cosine does.  A block's tree splits at the median distance from a vantage
point.  A search goes down the nearer side first and skips the other side if
``factor`` times the gap between the query's distance and the split exceeds the
distance of its k-th best so far.  Factor 1 is the triangle inequality and makes
the search exact; larger factors skip more.  Queries of a block go down
together, as matrices.

A task's k best of a query so far bound the search of the next block, too.

Of equal vectors in a block only 2 k rows with the smallest ids, at most k of an
id, can be among a query's k nearest, as those of its own id don't count; the
others aren't stored, and that is exact.

How much the bounds rule out hangs on the data: vectors in clusters are searched
for a part of all pairs, while random ones of many dimensions are all about as
far from each other as from any vantage point, and nearly all pairs are scored.

Defined results: vectors that are null, empty, zero or hold null or non-finite
components take no part, nor do null ids; vectors meet only those of their
length; rows of a repeated id are candidates each, ask together, and none is a
neighbour of its own id; ties go to the smaller id; fewer candidates than k are all returned;
an empty table gives no rows; other columns play no part.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame

from .vectors import BLOCK, QUERIES, blocked, search, usable


def unit(v: np.ndarray) -> np.ndarray:
    """Vectors scaled to length one; the largest component is scaled first, so nothing overflows."""
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def _turn(group: np.ndarray) -> np.ndarray:
    """Each element's number among the equal ones, in their order."""
    by = np.argsort(group, kind="stable")
    first = np.flatnonzero(np.r_[True, group[by][1:] != group[by][:-1]])
    out = np.empty(len(by), np.int64)
    out[by] = np.arange(len(by)) - np.repeat(first, np.diff(np.r_[first, len(by)]))
    return out


def grow(ids: np.ndarray, v: np.ndarray, k: int | None, leaf: int) -> tuple | None:
    """Ids, vectors and unit vectors in leaf order, and nodes (vantage, split, inner, outer, from, to); without ``k``, of all rows."""
    some = np.abs(v).max(axis=1) > 0
    ids, v = ids[some], v[some]
    if not len(ids):
        return None
    order = np.argsort(ids, kind="stable")
    ids, v = ids[order], v[order]
    if k is not None:
        _, group = np.unique(v, axis=0, return_inverse=True)
        group = group.ravel()
        few = _turn(np.unique(np.stack([group, ids]), axis=1, return_inverse=True)[1].ravel()) < k
        ids, v, group = ids[few], v[few], group[few]
        few = _turn(group) < 2 * k
        ids, v = ids[few], v[few]
    u = unit(v)
    random = np.random.default_rng(len(ids))
    nodes: list[list] = []
    placed: list[np.ndarray] = []
    at = 0

    def split(rows: np.ndarray) -> int:
        nonlocal at
        me = len(nodes)
        nodes.append([None, 0.0, -1, -1, 0, 0])
        if len(rows) > leaf:
            vantage = u[rows[random.integers(len(rows))]]
            d = np.sqrt(np.maximum(0, 2 - 2 * (u[rows] @ vantage)))
            mu = float(np.median(d))
            inner = d < mu
            if inner.any() and not inner.all():
                nodes[me][0], nodes[me][1] = vantage, mu
                nodes[me][2], nodes[me][3] = split(rows[inner]), split(rows[~inner])
                return me
        placed.append(rows)
        nodes[me][4], nodes[me][5] = at, at + len(rows)
        at += len(rows)
        return me

    split(np.arange(len(ids)))
    order = np.concatenate(placed)
    return ids[order], v[order], u[order], nodes


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosine of each pair of rows, in double precision; equal rows give equal results.

    Rows are scaled by powers of two first, which changes no digit and keeps squares in range.
    """
    a, b = (np.ldexp(x, -np.frexp(np.abs(x).max(axis=-1, keepdims=True))[1]) for x in (a, b))
    dot, aa, bb = (np.add.reduce(x * y, axis=-1) for x, y in ((a, b), (a, a), (b, b)))
    return dot / (np.sqrt(aa) * np.sqrt(bb))


def nearest(tree: tuple, asked: tuple, k: int, factor: float, carried: np.ndarray | None = None, scored: list[int] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Query ids, ids and cosines of at least the k nearest that the relaxed search finds for each query, and the k best cosines so far.

    ``carried``: the k best of blocks before; ``scored``: takes the number of pairs that were scored.
    """
    ids, v, u, nodes = tree
    q_ids, q, qu, _ = asked
    carried = np.full((len(q_ids), k), -np.inf) if carried is None else carried
    least = carried.min(axis=1)
    wide = min(3 * k + 2, len(ids))  # k - 1 better ones and 2 k equals fit in
    best = np.full((len(q_ids), wide), -np.inf)
    best_at = np.zeros((len(q_ids), wide), np.int64)

    def visit(node: int, rows: np.ndarray) -> None:
        vantage, mu, inner, outer, a, b = nodes[node]
        if not len(rows):
            return
        if vantage is None:
            if scored is not None:
                scored.append(len(rows) * (b - a))
            s = qu[rows] @ u[a:b].T
            s[q_ids[rows][:, None] == ids[a:b][None, :]] = -np.inf
            both = np.concatenate([best[rows], s], axis=1)
            place = np.concatenate([best_at[rows], np.broadcast_to(np.arange(a, b), s.shape)], axis=1)
            top = np.argpartition(-both, wide - 1, axis=1)[:, :wide] if both.shape[1] > wide else np.arange(both.shape[1])[None, :]
            best[rows], best_at[rows] = np.take_along_axis(both, top, 1), np.take_along_axis(place, top, 1)
            return
        gap = np.sqrt(np.maximum(0, 2 - 2 * (qu[rows] @ vantage))) - mu
        near = gap < 0

        def far() -> np.ndarray:
            kth = np.maximum(np.sort(best[rows], axis=1)[:, -min(k, wide)] if wide >= k else -np.inf, least[rows])
            tau = np.sqrt(np.maximum(0, 2 - 2 * np.maximum(kth, -1)))
            return np.isneginf(kth) | (np.abs(gap) * factor <= tau + 1e-7)

        for side, first in ((inner, near), (outer, ~near)):
            visit(side, rows[first])
        also = far()
        for side, second in ((inner, ~near & also), (outer, near & also)):
            visit(side, rows[second])

    visit(0, np.arange(len(q_ids)))
    real = (best >= least[:, None] - 1e-9) & ~np.isneginf(best)
    rows = np.repeat(np.arange(len(q_ids)), real.sum(axis=1))
    at = best_at[real]
    s = cosines(q[rows], v[at])
    order = np.lexsort((ids[at], -s, rows))
    rows, at, s = rows[order], at[order], s[order]
    place = np.arange(len(rows)) - np.searchsorted(rows, rows)
    top = place < k
    rows, at, s, place = rows[top], at[top], s[top], place[top]
    new = np.full((len(q_ids), k), -np.inf)
    new[rows, place] = s
    return q_ids[rows], ids[at], s, -np.sort(-np.concatenate([carried, new], axis=1), axis=1)[:, :k]


def neighbours(vectors: DataFrame, queries: Column, k: int = 5, factor: float = 1.15, leaf: int = 128, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Rows query_id, rank, vec_id, score (cosine): the k nearest found for each row that ``queries``, a condition on ``id``, picks."""
    rows = usable(vectors, key, vector)
    data = blocked(rows, BLOCK, lambda ids, v: grow(ids, v, k, leaf))
    asked = blocked(rows.where(queries), QUERIES, lambda ids, v: grow(ids, v, None, len(ids)))
    return search(data, asked, lambda tree, q, carried: nearest(tree, q, k, factor, carried), k, "double", rows.count())
