"""Exact top-k inner products: block-at-a-time pruning.

Vectors are made of whole numbers, floor(``scale`` * x); a dimension is a term.
A data block is ordered by splits at the median of its most varied dimension
and cut into document ranges, each with its terms' maxima and minima and its
forward index (the rows themselves).  For each query the ranges are ordered by
their bounds, the summed term maxima (minima for negative query terms); ranges
are scored until the bound falls below the k-th best score, of the blocks that
the task has searched before, too.  Every range that may hold a better or equal
score is scored, so results are exact.  How many ranges the bounds rule out hangs
on the data: nearly none of random vectors of many dimensions, most of clusters.

Rows with components so large that products of 64-bit floats might be inexact
are kept apart and scored in whole numbers of any size.

Defined results: vectors that are null, empty or hold null or non-finite
components take no part, nor do null ids; vectors meet only those of their
length; rows of a repeated id are candidates each, ask together, and none is a
result of its own id; ties go to the smaller id; fewer candidates than k are all returned;
an empty table gives no rows; other columns play no part.  A score beyond the
range of a long counts, and is returned, as the range's end.
"""

from __future__ import annotations

import heapq
import math
from fractions import Fraction

import numpy as np
from pyspark.sql import Column, DataFrame

from .vectors import BLOCK, QUERIES, blocked, search, usable

#: Bits for a row's place by id in a key, below the score.
PLACE = 13
_OWN = np.iinfo(np.int64).min


_MOST = np.iinfo(np.int64).max


def index(ids: np.ndarray, v: np.ndarray, scale: float, width: int) -> tuple:
    """Ids in rising order; rows, places and bounds of the ranges; ids and rows of large vectors (whole numbers)."""
    order = np.argsort(ids, kind="stable")
    ids, raw = ids[order], v[order]
    limit = 2.0 ** ((49 - int(v.shape[1]).bit_length()) // 2)
    large = (np.abs(raw) * scale).max(axis=1) >= limit - 1
    big_ids, big = ids[large], np.array([[math.floor(Fraction(x) * Fraction(scale)) for x in row] for row in raw[large].tolist()], dtype=object).reshape(-1, v.shape[1])
    ids, v = ids[~large], np.floor(scale * raw[~large])
    ranges: list[np.ndarray] = []
    todo = [np.arange(len(ids))] if len(ids) else []
    while todo:
        rows = todo.pop()
        if len(rows) <= width:
            ranges.append(rows)
            continue
        term = int(v[rows].var(axis=0).argmax())
        by = rows[np.argsort(v[rows, term], kind="stable")]
        todo += [by[: len(by) // 2], by[len(by) // 2 :]]
    cut = np.cumsum([0, *map(len, ranges)])
    place = np.concatenate([np.empty(0, np.int64), *ranges]).astype(np.int64)
    most, least = (np.array([f(v[r], axis=0) for r in ranges]).reshape(len(ranges), v.shape[1]) for f in (np.max, np.min))
    return ids, v[place], place, cut, most, least, big_ids, big


def _large(q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, v: np.ndarray, k: int) -> list[tuple[int, int, int]]:
    """The k best (query id, id, score) of each query, in whole numbers of any size."""
    out = []
    v = v if v.dtype == object else np.array([[int(x) for x in row] for row in v.tolist()], dtype=object).reshape(v.shape)
    for one, row in zip(q_ids.tolist(), q, strict=True):
        scores = v @ np.array([int(x) for x in row], dtype=object) if len(v) else []
        ranked = ((max(-_MOST, min(_MOST, s)), i) for s, i in zip(scores, ids.tolist(), strict=True) if i != one)
        out += [(one, i, s) for s, i in heapq.nsmallest(k, ranked, key=lambda x: (-x[0], x[1]))]
    return out


def best(block: tuple, asked: tuple, k: int, carried: np.ndarray | None = None, scored: list[int] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Query ids, ids and scores of at least the block's k best of each query, and the k best scores so far.

    ``carried``: the k best of blocks before; ``scored``: takes the number of pairs that were scored.
    """
    ids, v, place, cut, most, least, big_ids, big = block
    q_ids, q_rows, q_place, _, _, _, q_big_ids, q_big = asked
    q_ids = q_ids[q_place]
    carried = np.full((len(q_ids), k), _OWN, np.int64) if carried is None else carried
    before = carried.min(axis=1)
    bound = np.maximum(q_rows, 0) @ most.T + np.minimum(q_rows, 0) @ least.T  # sums of whole numbers below 2**53 are exact
    by = np.argsort(-bound, axis=1, kind="stable")
    top = np.full((len(q_ids), k), _OWN, np.int64)
    own_from, own_to = np.searchsorted(ids, q_ids), np.searchsorted(ids, q_ids, side="right")
    for turn in range(len(cut) - 1):
        kth = top.min(axis=1)
        live = bound[np.arange(len(q_ids)), by[:, turn]] >= np.maximum(np.where(kth == _OWN, _OWN, kth >> PLACE), before)
        if not live.any():
            break
        for r in np.unique(by[live, turn]):
            rows = np.flatnonzero(live & (by[:, turn] == r))
            part = slice(cut[r], cut[r + 1])
            if scored is not None:
                scored.append(len(rows) * int(cut[r + 1] - cut[r]))
            score = (q_rows[rows] @ v[part].T).astype(np.int64)
            keys = (score << PLACE) | ((1 << PLACE) - 1 - place[part])
            keys[(own_from[rows][:, None] <= place[part]) & (place[part] < own_to[rows][:, None])] = _OWN
            both = np.concatenate([top[rows], keys], axis=1)
            top[rows] = np.partition(both, both.shape[1] - k, axis=1)[:, -k:]
    score = np.where(top == _OWN, _OWN, top >> PLACE)
    real = (top != _OWN) & (score >= before[:, None])
    keys = top[real]
    q, d, s = np.repeat(q_ids, real.sum(axis=1)), ids[(1 << PLACE) - 1 - (keys & ((1 << PLACE) - 1))], keys >> PLACE
    more = _large(q_ids, q_rows, big_ids, big, k) if len(big_ids) else []
    if len(q_big_ids):
        more += _large(q_big_ids, q_big, ids[place], v, k) + _large(q_big_ids, q_big, big_ids, big, k)
    if more:
        q, d, s = (np.concatenate([x, np.array(y, np.int64)]) for x, y in zip((q, d, s), zip(*more, strict=True), strict=True))
    return q, d, s, np.partition(np.concatenate([carried, score], axis=1), k, axis=1)[:, -k:]


def top_k(vectors: DataFrame, queries: Column, k: int = 20, scale: float = 64.0, width: int = 256, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Rows query_id, rank, vec_id, score (bigint): the k best for each row that ``queries``, a condition on ``id``, picks."""
    rows = usable(vectors, key, vector)
    data = blocked(rows, BLOCK, lambda ids, v: index(ids, v, scale, width))
    asked = blocked(rows.where(queries), QUERIES, lambda ids, v: index(ids, v, scale, len(ids)))
    return search(data, asked, lambda b, q, carried: best(b, q, k, carried), k, "bigint", rows.count())
