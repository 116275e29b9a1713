import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import neighbours, topk
from tessera.llm.queries import op4_neighbours, op6_topk

SF = "/root/testdata/sf0.01"
SCHEMA = "vec_id bigint, embedding array<float>, score int"


def vectors(spark, sf=SF):
    return {r.vec_id: np.array(r.embedding, dtype=np.float64) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()}


def best(own, queries, score, k):
    """The k best of each query id over all rows of its length and of other ids, ties to the smaller id; rows are (id, vector)."""
    rows = [*own.items()] if isinstance(own, dict) else own
    out = {}
    for q in queries:
        ranked = sorted((-score(a, v), i) for j, a in rows if j == q for i, v in rows if i != q and len(v) == len(a))[:k]
        out[q] = [(i, -s) for s, i in ranked]
    return out


def cosine(a, b):
    return float(np.add.reduce(a * b) / (np.sqrt(np.add.reduce(a * a)) * np.sqrt(np.add.reduce(b * b))))


def whole(a, b):
    return int((np.floor(64 * a) * np.floor(64 * b)).sum())


def by_query(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r["rank"])):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
    return out


def test_topk_query_is_exact(spark):
    own = vectors(spark)
    assert by_query(op6_topk(spark, SF)) == best(own, [i for i in own if i % 20 == 0], whole, 20)


@pytest.mark.parametrize("sf", [SF, "/root/testdata/sf0.1"])
def test_recall_of_neighbours(spark, sf):
    own = vectors(spark, sf)
    ids = np.array(sorted(own))
    unit = np.array([own[i] / np.linalg.norm(own[i]) for i in ids])
    got = by_query(op4_neighbours(spark, sf))
    asked = [i for i in ids.tolist() if i % 50 == 0]
    assert set(got) == set(asked)
    hit = 0
    for q in asked:
        s = unit @ unit[np.searchsorted(ids, q)]
        s[np.searchsorted(ids, q)] = -9
        hit += len({i for i, _ in got[q]} & set(ids[np.argsort(-s)[:5]].tolist()))
        assert all(math.isclose(v, cosine(own[q], own[i]), rel_tol=1e-12) for i, v in got[q])
        assert [(-v, i) for i, v in got[q]] == sorted((-v, i) for i, v in got[q])
    assert hit / (5 * len(asked)) >= 0.9


def odd_rows():
    r = random.Random(6)
    rows = [(i, [r.choice((-1.0, 0.5, 2.0)) for _ in range(3)], 0) for i in range(300)]  # many ties and equal vectors
    rows += [(1000 + i, [0.25, 0.5, 0.75], 0) for i in range(200)]
    rows += [(2000, None, 0), (2001, [], 0), (2002, [0.0, 0.0, 0.0], 0), (2003, [1.0, None, 1.0], 0), (2004, [1.0, float("nan"), 1.0], 0), (2005, [float("inf"), 1.0, 1.0], 0)]
    rows += [(3000, [1.0, 2.0], 0), (3010, [2.0, 1.0], 0), (4000, [1.0, 2.0, 3.0, 4.0], 0), (None, [1.0, 1.0, 1.0], 0), (7, [3.0, 3.0, 3.0], 0)]
    rows += [(10, [0.25, 0.5, 0.75], 0)] * 30 + [(1005, [0.25, 0.5, 0.75], 0)] * 20  # repeated ids
    return rows


def usable(zero):
    return [(i, np.array(v)) for i, v, _ in odd_rows() if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and (zero or any(v))]


def asked(own):
    return sorted({i for i, _ in own if i % 10 == 0})


def test_topk_with_ties_copies_and_unusable_vectors(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", 64)
    df = spark.createDataFrame(odd_rows(), SCHEMA)
    own = usable(True)
    got = by_query(topk.top_k(df, F.col("id") % 10 == 0, k=7, width=8))
    assert got == {q: x for q, x in best(own, asked(own), whole, 7).items() if x}


def test_exact_neighbours_with_factor_one(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK", 64)
    df = spark.createDataFrame(odd_rows(), SCHEMA)
    own = usable(False)
    got = by_query(neighbours.neighbours(df, F.col("id") % 10 == 0, k=5, factor=1.0, leaf=8))
    want = {q: x for q, x in best(own, asked(own), cosine, 5).items() if x}
    assert {q: [round(s, 12) for _, s in x] for q, x in got.items()} == {q: [round(s, 12) for _, s in x] for q, x in want.items()}
    copies = [q for q in want if 1000 <= q < 1200 or q == 10]
    assert {q: got[q] for q in copies} == {q: want[q] for q in copies}  # equal vectors: the smaller ids


def test_factor_trades_recall_for_work():
    r = np.random.default_rng(1)
    ids, v = np.arange(2000), r.normal(size=(2000, 8))
    tree = neighbours.grow(ids, v, 5, 16)
    asked = neighbours.grow(ids[:50], v[:50], None, 50)
    exact = {(a, b) for a, b in zip(*neighbours.nearest(tree, asked, 5, 1.0)[:2], strict=True)}
    loose = {(a, b) for a, b in zip(*neighbours.nearest(tree, asked, 5, 50.0)[:2], strict=True)}
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    s = unit[:50] @ unit.T
    s[np.arange(50), np.arange(50)] = -9
    assert exact == {(q, b) for q in range(50) for b in np.argsort(-s[q])[:5]}
    assert len(loose & exact) < len(exact)


def test_empty_and_lonely(spark):
    df = spark.createDataFrame(odd_rows(), SCHEMA)
    for search in (lambda d: topk.top_k(d, F.col("id") % 10 == 0), lambda d: neighbours.neighbours(d, F.col("id") % 10 == 0)):
        assert search(df.limit(0)).count() == 0
        assert search(df.where("vec_id = 4000")).count() == 0


def test_scores_of_any_size(spark):
    values = [1e15, -3e15, 1e4, 2.0, -7.5, 1e300, 4e9, 4e9 + 1]
    rows = [(i, [x, y], 0) for i, (x, y) in enumerate((x, y) for x in values for y in values)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, score int")
    own = {i: [int(math.floor(64 * x)) if abs(x) < 1e290 else int(x) * 64 for x in v] for i, v, _ in rows}
    most = 2**63 - 1
    dot = lambda a, b: max(-most, min(most, a[0] * b[0] + a[1] * b[1]))
    assert by_query(topk.top_k(df, F.col("id") % 3 == 0, k=5)) == best(own, [i for i in own if i % 3 == 0], dot, 5)


def test_large_and_small_vectors_have_their_cosine(spark):
    df = spark.createDataFrame([(0, [1e200, 1e200], 0), (1, [1e200, 0.0], 0), (2, [1e-200, 3e-200], 0), (3, [5.0, 5.0], 0)], "vec_id bigint, embedding array<double>, score int")
    got = by_query(neighbours.neighbours(df, F.col("id") == 0, k=5))[0]
    assert [i for i, _ in got] == [3, 2, 1]
    assert np.allclose([s for _, s in got], [1, 4 / math.sqrt(20), math.sqrt(0.5)])


def test_rows_of_repeated_ids_are_candidates_each(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0], 0), (7, [1.0, 0.1], 0), (7, [0.0, 1.0], 0)], SCHEMA)
    (first, second) = by_query(neighbours.neighbours(df, F.col("id") == 0, k=5))[0]
    assert first[0] == second[0] == 7
    assert np.allclose([first[1], second[1]], [1 / math.sqrt(1.01), 0], atol=1e-7)
    assert by_query(topk.top_k(df, F.col("id") == 0, k=5))[0] == [(7, 4096), (7, 0)]


def clusters(n=8192, dims=32):
    r = np.random.default_rng(5)
    return np.arange(n), r.normal(size=(64, dims))[r.integers(64, size=n)] + 0.05 * r.normal(size=(n, dims))


@pytest.mark.parametrize("block", [8192, 1024])
def test_bounds_rule_out_most_pairs_of_clustered_vectors(block):
    """With the results of a search of all pairs; the bound is carried from block to block."""
    ids, v = clusters()
    few = np.arange(0, 8192, 50)
    units = neighbours.unit(v)
    for name, floor_v in (("cosine", None), ("product", np.floor(64 * v))):
        scored, found, carried = [], {}, None
        for at in range(0, 8192, block):
            own, vs = ids[at : at + block], v[at : at + block]
            if name == "cosine":
                out = neighbours.nearest(neighbours.grow(own, vs, 5, 128), neighbours.grow(few, v[few], None, 999), 5, 1.0, carried, scored)
            else:
                out = topk.best(topk.index(own, vs, 64.0, 64), topk.index(few, v[few], 64.0, 999), 5, carried, scored)
            carried = out[3]
            for q, d, s in zip(*out[:3], strict=True):
                found.setdefault(int(q), []).append((-s, int(d)))
        every = units[few] @ units.T if name == "cosine" else floor_v[few] @ floor_v.T
        every[np.arange(len(few)), few] = -np.inf
        for i, q in enumerate(few.tolist()):
            assert [d for _, d in sorted(found[q])[:5]] == sorted(range(8192), key=lambda d: (-every[i, d], d))[:5]
        assert sum(scored) < 0.5 * len(few) * 8192
