import random

import numpy as np
import pyarrow as pa

from tessera.llm import near_dedup as N
from tessera.llm.common import plain

SCHEMA = "doc_id bigint, text string, class_id string"


def words(r, n):
    return ["".join(r.choice(("ba", "to", "ren", "li", "mo")) for _ in range(r.randint(1, 5))) for _ in range(n)]


def brute(rows, idf):
    """Classes by comparing all pairs."""
    sets = N._sets(plain(pa.array([t for _, t, *_ in rows])), idf)
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if N.similarity(sets[a], sets[b]) >= 0.8:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    least = {}
    for i, (k, *_) in enumerate(rows):
        least[find(i)] = min(k, least.get(find(i), k))
    return {k: least[find(i)] for i, (k, *_) in enumerate(rows)}


def corpus(seed=4):
    r = random.Random(seed)
    rows, passage = [], words(r, 60)
    for _ in range(60):
        base = words(r, r.choice((5, 12, 80, 300)))
        copies = r.choice((1, 1, 2, 5, 30))
        for _ in range(copies):
            own = list(base)
            for _ in range(r.choice((0, 0, 1, 2, len(base) // 25))):
                own[r.randrange(len(own))] = words(r, 1)[0]
            rows.append(" ".join(own))
        if r.random() < 0.5:
            rows.append(" ".join(words(r, 40) + passage + words(r, 40)))
    r.shuffle(rows)
    return [(3 * i, t, "old") for i, t in enumerate(rows)]


def test_classes_against_all_pairs(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, SCHEMA)
    got = {r.doc_id: r.class_id for r in N.classes(docs).collect()}
    want = brute(rows, N.idf_of(docs))
    wrong = sum(got[k] != want[k] for k in want)
    assert len(set(want.values())) < len(rows) - 50
    assert wrong <= len(rows) // 100


def test_each_pair_of_a_bucket_is_compared(spark, monkeypatch):
    """Links of two nodes outside the largest component, or of one with it, whatever the blocks."""
    from tessera.llm.common import prepare

    prepare(spark)
    r = random.Random(7)
    base, rows = words(r, 60), []
    for i in range(120):
        own = list(base)
        for _ in range(r.choice((1, 2, 4, 8))):
            own[r.randrange(60)] = words(r, 1)[0]
        rows.append((i, " ".join(own), ""))
    docs = spark.createDataFrame(rows, SCHEMA)
    none = N.Idf(np.empty(0, np.uint64), np.empty(0))
    reps = N.sketches(docs, none).withColumn("node", N.F.col("id")).checkpoint()
    members = spark.createDataFrame([(7, i) for i in range(100)] + [(8, i) for i in range(90, 120)], "key bigint, node bigint")
    sets = N._sets(plain(pa.array([t for _, t, _ in rows])), none)
    true = {(a, b) for a in range(120) for b in range(a) if N.similarity(sets[a], sets[b]) >= 0.8}
    shared = {(a, b) for a, b in true if a < 100 or b >= 90}
    for block in (1 << 18, 300):
        monkeypatch.setattr(N, "BLOCK", block)
        nodes = N.blocked(reps.select("node", N.F.lit(0).cast("bigint").alias("b")), reps).checkpoint()
        assert (nodes.select("block").distinct().count() == 1) == (block > 300)
        for given in ([], [(i, 0) for i in range(1, 40)]):
            links = spark.createDataFrame(given, "a bigint, b bigint")
            got = {(max(r.a, r.b), min(r.a, r.b)) for r in N.rest(members, links, nodes, docs, False, none, 0.8, "doc_id", "text").collect()}
            assert len(shared) > 50 and got - set(given) <= true
            assert {(a, b) for a, b in shared if not given or a >= 40} <= got  # all but those within a component


def test_joins_beyond_the_bound_give_the_same(spark, monkeypatch):
    docs = spark.createDataFrame(corpus(8)[:120], SCHEMA)
    one = sorted(N.classes(docs).collect())
    monkeypatch.setattr(N, "BROADCAST", 0)
    assert sorted(N.classes(docs).collect()) == one


def test_a_chain_of_near_copies_is_one_class(spark):
    r = random.Random(2)
    text, rows = words(r, 200), []
    for i in range(40):
        rows.append((i, " ".join(text), ""))
        for _ in range(2):
            text[r.randrange(200)] = words(r, 1)[0]
    got = {r.doc_id: r.class_id for r in N.classes(spark.createDataFrame(rows, SCHEMA)).collect()}
    idf = N.idf_of(spark.createDataFrame(rows, SCHEMA))
    want = brute(rows, idf)
    assert sum(got[k] == want[k] for k in want) >= 36


def test_exact_copies_fall_together_whatever_their_case_and_stops(spark):
    rows = [(5, "One two three four five six.", ""), (2, "one, TWO three four five six", ""), (9, "one two", ""), (8, "one two", ""), (7, "two one", "")]
    got = {r.doc_id: (r.class_id, r.keep) for r in N.classes(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {5: (2, False), 2: (2, True), 9: (8, False), 8: (8, True), 7: (7, True)}


def test_edge_cases(spark):
    long = " ".join(words(random.Random(1), 60_000))
    rows = [(1, None, ""), (2, "", ""), (3, "...!", ""), (4, "", ""), (None, "a b c d e f", ""), (None, "a b c d e f", ""), (5, long, ""), (6, long, ""), (7, "a b c d e f", "")]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = N.classes(docs).collect()
    assert len(got) == len(rows)
    known = {r.doc_id: (r.class_id, r.keep) for r in got if r.doc_id is not None}
    assert known == {1: (1, True), 2: (2, True), 3: (3, True), 4: (4, True), 5: (5, True), 6: (5, False), 7: (7, True)}
    assert all(r.class_id is None and r.keep for r in got if r.doc_id is None)
    kept = N.keep_one(docs)
    assert kept.columns == docs.columns
    assert kept.count() == 6  # of "a b c d e f" and of the long text one row each
    assert N.classes(docs.limit(0)).count() == 0
    assert N.keep_one(docs.limit(0)).count() == 0


A, B, C = "a b c d e f g", "h i j k l m n", "o p q r s t u"


def test_repeated_ids(spark):
    rows = [(1, A, ""), (1, A, ""), (2, A, ""), (3, B, ""), (3, C, "")]
    got = sorted(tuple(r) for r in N.classes(spark.createDataFrame(rows, SCHEMA)).collect())
    assert got == [(1, 1, True), (1, 1, True), (2, 1, False), (3, 3, True), (3, 3, True)]
    kept = sorted(r.text for r in N.keep_one(spark.createDataFrame(rows, SCHEMA)).collect())
    assert kept == [A, B, C]


def test_a_repeated_id_loses_only_the_row_that_is_a_copy(spark):
    docs = spark.createDataFrame([(3, A, ""), (5, A, ""), (5, B, "")], SCHEMA)
    assert sorted((r.doc_id, r.class_id, r.keep) for r in N.classes(docs).collect()) == [(3, 3, True), (5, 3, False), (5, 5, True)]
    assert sorted((r.doc_id, r.text) for r in N.keep_one(docs).collect()) == [(3, A), (5, B)]


def test_links_of_all_texts_of_a_repeated_id(spark):
    r = random.Random(5)
    one, two = (" ".join(words(r, 100)) for _ in range(2))
    docs = spark.createDataFrame([(1, one, ""), (1, two, ""), (2, one + " more", ""), (3, two + " more", "")], SCHEMA)
    assert sorted((r.doc_id, r.class_id, r.keep) for r in N.classes(docs).collect()) == [(1, 1, True), (1, 1, True), (2, 1, False), (3, 1, False)]


def test_odd_column_names(spark):
    docs = spark.createDataFrame([(3, A, 1), (5, A, 2), (5, B, 3)], "`doc id` bigint, `a.text``s` string, _row int")
    kept = N.keep_one(docs, key="doc id", text="a.text`s")
    assert kept.columns == docs.columns
    assert sorted(tuple(r) for r in kept.collect()) == [(3, A, 1), (5, B, 3)]


def test_frequencies_are_exact_and_count_over_all_documents(spark, monkeypatch):
    monkeypatch.setattr(N, "HELD", 1 << 10)
    rows = corpus(6)
    docs = spark.createDataFrame(rows, SCHEMA).repartition(7)
    found = [N.shingles(plain(pa.array([t])))[1] for _, t, _ in rows]
    h, n = np.unique(np.concatenate(found), return_counts=True)
    for rare in (0.001, 0.02, 0.2):
        monkeypatch.setattr(N, "RARE", rare)
        idf = N.idf_of(docs)
        some = n >= max(2, rare * len(rows))
        assert idf.hashes.tolist() == h[some].tolist()
        want = N.FLOOR + (1 - N.FLOOR) * np.minimum(1, np.log(len(rows) / n[some]) / np.log(1 / rare))
        assert np.allclose(idf.factors, want)
        assert np.allclose(idf(h)[some], want) and (idf(h)[~some] == 1).all()


def test_a_passage_of_many_documents_weighs_less(spark):
    """Without TF-IDF all of these texts would be near copies."""
    r = random.Random(9)
    passage = " ".join(words(r, 300))
    rows = [(i, passage + " " + " ".join(words(r, 36)), "") for i in range(60)]
    docs = spark.createDataFrame(rows, SCHEMA)
    plain_idf = N.Idf(np.empty(0, np.uint64), np.empty(0))
    one, two = (N._sets(plain(pa.array([rows[0][1], rows[1][1]])), idf) for idf in (plain_idf, N.idf_of(docs)))
    assert N.similarity(*two) < 0.77 and N.similarity(*one) > 0.8
    assert {x.class_id for x in N.classes(docs).collect()} == set(range(60))


def test_sizes_are_occurrences(spark):
    docs = spark.createDataFrame([(1, A, ""), (2, A + " " + A, ""), (3, None, "")], SCHEMA)
    drawn = {x.id: x for x in N.sketches(docs, N.Idf(np.empty(0, np.uint64), np.empty(0))).collect()}
    assert [drawn[i].size for i in (1, 2, 3)] == [3, 10, 0]


def test_samples_agree_as_often_as_weighted_sets_do():
    r = np.random.default_rng(3)
    h = r.integers(0, 2**63, 3000).astype(np.uint64)
    w = r.uniform(0.5, 3, 3000)
    a, b = np.arange(0, 2600), np.arange(400, 3000)
    a, b = a[np.argsort(h[a])], b[np.argsort(h[b])]
    want = N.similarity((h[a], w[a]), (h[b], w[b]))
    hits = 0
    for salt in range(40):  # fresh hashes each time
        g = N.H.mix(h + np.uint64(salt * 7919))
        s = N.samples(np.r_[np.zeros(len(a), int), np.ones(len(b), int)], np.r_[g[a], g[b]], np.r_[w[a], w[b]], 2)
        hits += (s[0] == s[1]).mean()
    assert abs(hits / 40 - want) < 0.05


def test_components_of_long_chains(spark):
    links = spark.createDataFrame([(i + 1, i) for i in range(200)] + [(500, 501)], "a bigint, b bigint")
    from tessera.llm.common import prepare

    prepare(spark)
    got = {r.node: r.root for r in N.components(links).collect()}
    assert got == {**dict.fromkeys(range(1, 201), 0), 501: 500}


def test_blocks_of_any_size_give_the_same(spark, monkeypatch):
    docs = spark.createDataFrame(corpus(11)[:150], SCHEMA)
    one = sorted(N.classes(docs).collect())
    monkeypatch.setattr(N, "BLOCK", 300)  # one to four texts
    assert sorted(N.classes(docs).collect()) == one
    monkeypatch.setattr(N, "BROADCAST", 0)
    assert sorted(N.classes(docs).collect()) == one


def test_pairs_are_verified_once_each_by_their_own_texts(spark, monkeypatch):
    from tessera.llm.common import prepare

    prepare(spark)
    monkeypatch.setattr(N, "BLOCK", 200)
    rows = corpus(12)[:60]
    docs = spark.createDataFrame(rows, SCHEMA)
    none = N.Idf(np.empty(0, np.uint64), np.empty(0))
    reps = N.sketches(docs, none).withColumn("node", (N.F.col("id") / 3).cast("bigint")).checkpoint()
    nodes = N.blocked(reps.select("node", N.F.lit(0).cast("bigint").alias("b")), reps).checkpoint()
    assert 10 < nodes.select("block").distinct().count() <= 60
    sets = N._sets(plain(pa.array([t for _, t, _ in rows])), none)
    pairs = [(a, b) for a in range(60) for b in range(a)]
    got = N.verified(spark.createDataFrame(pairs, "a bigint, b bigint"), nodes, docs, False, none, 0.5, "doc_id", "text").collect()
    want = {p for p in pairs if N.similarity(sets[p[0]], sets[p[1]]) >= 0.5}
    assert len(want) > 20 and len(got) == len(want) and {(r.a, r.b) for r in got} == want
