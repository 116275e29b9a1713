import zlib

import numpy as np
import pyarrow as pa
import pytest

from tessera.llm import quality, toxicity
from tessera.llm.common import plain
from tessera.llm.queries import op2_quality, op7_toxicity

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize(("query", "label", "folds", "held", "cut"), [(op2_quality, "quality", 5, 0, 0.3), (op7_toxicity, "toxic", 3, 1, 0.7)])
def test_held_out_accuracy(spark, query, label, folds, held, cut):
    got = query(spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", label), "doc_id", "left").toPandas()
    assert len(got) == 1000
    assert (got.held_out == [zlib.crc32(str(i).encode()) % folds == held for i in got.doc_id]).all()
    assert got.score.between(0, 1).all()
    assert (got.predicted == (got.score >= cut)).all()
    known = got[got.held_out & got[label].notna()]
    assert (known.predicted == known[label]).mean() > 0.93


@pytest.mark.parametrize("module", [quality, toxicity])
def test_edge_cases(spark, module):
    docs = spark.createDataFrame([(1, None, "s"), (2, "", "s"), (3, "word " * 200_000, "s"), (None, "x", "s"), (3, "word " * 200_000, "s"), (4, "\u00e9\u4e2d \U0001f600", None)], "doc_id bigint, text string, SCORE string")
    labels = spark.createDataFrame([(1, None), (2, 1), (2, 0), (9, 1), (None, 1)], f"doc_id bigint, {'quality' if module is quality else 'toxic'} int")
    out = module.classify(docs, labels).toPandas()
    assert len(out) == 6
    assert [c.lower() for c in out.columns].count("score") == 1
    assert out.score.between(0, 1).all()
    assert out[out.doc_id == 3].score.nunique() == 1
    assert module.classify(docs.limit(0), labels).count() == 0
    assert module.classify(docs, labels.limit(0)).count() == 6


def test_sample_bound(spark):
    docs = spark.range(500).selectExpr("id AS doc_id", "'a b c' AS text")
    labels = spark.range(500).selectExpr("id AS doc_id", "CAST(id % 2 AS INT) AS quality")
    assert quality.labelled_sample(docs, labels, "quality", __import__("pyspark").sql.functions.lit(True), 40).count() == 40


def test_score_is_the_sparse_dot_product():
    texts = plain(pa.array(["Some words here", "HERE!! AGAIN!! AGAIN!!", ""]))
    vectors = quality.gather(texts, 16)
    model = quality.train([(*vectors[0], 1), (*vectors[1], 0)] * 20, 16, l1=0.01)
    dense = np.zeros(1 << 16)
    dense[model.index] = model.weight
    want = [1 / (1 + np.exp(-(model.bias + dense[s] @ v))) for s, v in vectors]
    assert np.allclose(quality.predict(model, texts), want)
    assert want[0] > 0.5 > want[1]


def test_counterfactual_term_levels_identity_terms():
    # Label 1 goes with "muslims" only by accident of the sample; the swap penalty undoes that.
    toxic = ["muslims are scum"] * 30 + ["you are scum"] * 10
    fine = ["christians went to the market today"] * 30 + ["we went to the market today"] * 30
    rows = toxicity.distinct(plain(pa.array(toxic + fine)))
    y = np.array([1.0] * len(toxic) + [0.0] * len(fine))
    swaps = [p for t in set(toxic + fine) for p in toxicity.swaps(t, toxicity.IDENTITY, 9)]
    pairs = list(zip(*(toxicity.distinct(plain(pa.array([p[k] for p in swaps]))) for k in (0, 1)), strict=True))
    neutral = plain(pa.array(["muslims went to the market today", "christians went to the market today", "muslims are scum"]))
    plain_model, fair = toxicity.train(rows, y, []), toxicity.train(rows, y, pairs, cf=100.0)
    before, after = toxicity.predict(plain_model, neutral), toxicity.predict(fair, neutral)
    assert after[0] - after[1] < 0.5 * (before[0] - before[1])
    assert after[0] < 0.5 < after[2]


def test_swaps_keep_the_rest_of_a_sentence():
    assert toxicity.swaps("The Gay man. Nothing here.", (("gay", "straight"),), 2) == [("The Gay man", "The straight man")]
    text = "a b. a c. a d. d e"
    assert len(toxicity.swaps(text, (("a", "z"),), 2)) == 2
    assert toxicity.swaps(text, (("d",),), 2) == toxicity.swaps("", (("a", "z"),), 2) == []


def gaps(model, pairs):
    """By how much swaps move a score's log odds."""
    of = dict(zip(model.feature.tolist(), model.weight.tolist(), strict=True))
    return [abs(sum(of.get(f, 0) for f in a.tolist()) - sum(of.get(f, 0) for f in b.tolist())) for a, b in pairs]


def test_swaps_of_the_table_move_the_weights(spark, monkeypatch):
    """Labelled rows of the table give swaps, and the penalty levels what they change."""
    sf = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    seen, train = [], toxicity.train
    monkeypatch.setattr(toxicity, "train", lambda rows, y, pairs, **k: seen.append((rows, y, pairs)) or train(rows, y, pairs, **k))
    fair = toxicity.fit(docs, labels)
    rows, y, pairs = seen[0]
    biased = train(rows, y, pairs, cf=0.0)
    assert len(pairs) > 1000
    before, after = gaps(biased, pairs), gaps(fair, pairs)
    assert max(before) > 0.01
    assert np.mean(after) < 0.05 * np.mean(before)


def test_training_reaches_the_minimum():
    """Against projected gradient descent on dense matrices."""
    r = np.random.default_rng(4)
    words = ["idiot", "scum", "fool", "hello", "market", "garden", "muslims", "jews", "hindus", "river"]
    texts, y = [], []
    for _ in range(300):
        one = r.random() < 0.4
        own = r.choice(words[:3] if one else words[3:6], 2).tolist() + (["muslims"] if r.random() < (0.6 if one else 0.1) else r.choice(words[6:], 1).tolist())
        texts.append(" ".join(own))
        y.append(float(one != (r.random() < 0.1)))
    y = np.array(y)
    rows = toxicity.distinct(plain(pa.array(texts)))
    swaps = [p for t in texts for p in toxicity.swaps(t, toxicity.IDENTITY, 1)]
    pairs = list(zip(*(toxicity.distinct(plain(pa.array([p[k] for p in swaps]))) for k in (0, 1)), strict=True))
    l2, cf = 0.01, 2.0
    model = toxicity.train(rows, y, pairs, l2=l2, cf=cf, rounds=3000)
    x = np.array([np.isin(model.feature, f) for f in rows], float)
    d = np.array([np.isin(model.feature, a).astype(float) - np.isin(model.feature, b) for a, b in pairs])

    def loss(w, b):
        z = x @ w + b
        return (np.logaddexp(0, z) - y * z).mean() + l2 / len(y) * (w @ w) + cf * ((d @ w) ** 2).mean()

    w, b = np.zeros(x.shape[1]), 0.0
    for _ in range(40_000):
        e = 1 / (1 + np.exp(-(x @ w + b))) - y
        w = np.maximum(0, w - 0.02 * (x.T @ e / len(y) + 2 * l2 / len(y) * w + 2 * cf * d.T @ (d @ w) / len(d)))
        b -= 0.02 * e.mean()
    assert len(model.feature) > 5
    assert loss(model.weight, model.bias) <= loss(w, b) + 1e-3


@pytest.mark.parametrize(("query", "label", "remainder", "module"), [(op2_quality, "quality", lambda n: n % 5 != 0, quality), (op7_toxicity, "toxic", lambda n: n % 3 != 1, toxicity)])
def test_query_against_scores_made_one_by_one(spark, query, label, remainder, module):
    """The query's scores are those of a model fitted on the rows it may learn from, worked out by dictionaries."""
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet").toPandas()
    known = labels[[remainder(zlib.crc32(str(i).encode())) for i in labels.doc_id]]
    model = module.fit(docs, spark.createDataFrame(known[["doc_id", label]]))
    weight = dict(zip((model.index if module is quality else model.feature).tolist(), model.weight.tolist(), strict=True))
    got = {r.doc_id: r.score for r in query(spark, sf).collect()}
    for r in docs.select("doc_id", "text").collect():
        one = plain(pa.array([r.text], pa.string()))
        if module is quality:
            ((slots, values),) = quality.gather(one, model.bits)
            total = sum(weight.get(s, 0) * v for s, v in zip(slots.tolist(), values.tolist(), strict=True))
        else:
            total = sum(weight.get(f, 0) for f in toxicity.distinct(one)[0].tolist())
        assert got[r.doc_id] == pytest.approx(1 / (1 + np.exp(-(model.bias + total))), abs=1e-9)


def test_common_words_are_terms(spark):
    rows = spark.createDataFrame([("1", 1, "The scum and the rest"), ("2", 1, "the scum"), ("3", 0, "the rest"), ("4", 0, "The garden and rest"), ("5", 0, None)], "_key string, _label int, _text string")
    assert toxicity.common_kinds(rows) == (("the",),)
    assert toxicity.common_kinds(rows.limit(0)) == toxicity.common_kinds(rows.where("_label = 1")) == ()


def test_a_labelled_key_on_many_rows_is_one_example(spark):
    docs = spark.createDataFrame([(1, "b"), (1, "a"), (1, None)] * 50 + [(2, "c")], "doc_id bigint, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id bigint, quality int")
    got = quality.labelled_sample(docs, labels, "quality", __import__("pyspark").sql.functions.lit(True), 40).collect()
    assert sorted((r["_key"], r["_label"], r["_text"]) for r in got) == [(1, 1, "a"), (2, 0, "c")]


def test_long_harmless_text_hides_nothing():
    rows = toxicity.distinct(plain(pa.array(["you idiot there"] * 40 + ["hello my friend there"] * 40)))
    model = toxicity.train(rows, np.array([1.0] * 40 + [0.0] * 40), [])
    got = toxicity.predict(model, plain(pa.array(["you idiot there", "hello my friend " * 50_000 + " you idiot there"])))
    assert got[1] >= got[0] - 1e-12
