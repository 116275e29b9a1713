"""Quality classifier: hashed word n-gram logistic regression, trained by follow-the-regularised-leader.

A document's features are its lower-cased tokens, token pairs, token shapes,
shape pairs and a mark for a token that repeats the one before, each hashed to
``2**bits`` slots.  A feature's value is its share of the document's tokens
times ``SCALE``, so a score is a sparse dot product that needs one gather and
one sum by row.

Training takes a sample of at most ``sample`` labelled rows (smallest hash of
the key first), in one pass after the other of FTRL-proximal updates.  Scoring
covers every row and needs only the weights that aren't zero.

Defined results: null and empty texts have no features and score the bias;
repeated rows score alike; very long texts are read whole; a table without
usable labels, or with one class only, gives a constant score (the smoothed
share of label 1); an empty table gives no rows.  Output columns replace input
columns of the same name.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import hashing as H
from .common import fold, named, plain, replace_column, slices, tidy

SCALE = 20.0


@dataclass(frozen=True)
class Linear:
    """A sparse model: indices in rising order, their weights, and the bias."""

    bits: int
    index: np.ndarray
    weight: np.ndarray
    bias: float


def features(texts: pa.Array, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Slots and rows of all feature occurrences; tokens of each row."""
    token, shape, rows = H.tokens_and_shapes(texts)
    count = np.bincount(rows, minlength=len(texts))
    m = len(token)
    if not m:
        return np.empty(0, np.int64), np.empty(0, np.int64), count
    pair, pair_rows = H.ngrams(token, rows, 2)
    shapes, _ = H.ngrams(shape, rows, 2)
    again = np.flatnonzero((token[1:] == token[:-1]) & (rows[1:] == rows[:-1])) + 1
    salt = H.U
    all_hashes = np.concatenate([token, pair, H.mix(shape ^ salt(0x51AE)), H.mix(shapes ^ salt(0x51AF)), np.full(len(again), H.mix(np.array([0xA6A1], H.U))[0])])
    all_rows = np.concatenate([rows, pair_rows, rows, pair_rows, rows[again]])
    return (all_hashes >> salt(64 - bits)).astype(np.int64), all_rows, count


def train(examples: list[tuple[np.ndarray, np.ndarray, int]], bits: int, alpha: float = 0.3, beta: float = 1.0, l1: float = 0.5, l2: float = 0.5, passes: int = 4) -> Linear:
    """FTRL-proximal over (slots, values, label) examples; a slot occurs once in an example."""
    ones = sum(y for _, _, y in examples)
    if ones in (0, len(examples)):
        p = (ones + 1) / (len(examples) + 2)
        return Linear(bits, np.empty(0, np.int64), np.empty(0, np.float64), float(np.log(p / (1 - p))))
    size = (1 << bits) + 1
    z, n = np.zeros(size), np.zeros(size)
    bias = size - 1

    def weights(i: np.ndarray) -> np.ndarray:
        zi = z[i]
        cut = np.where(i == bias, 0.0, l1)
        return np.where(np.abs(zi) <= cut, 0.0, -(zi - np.sign(zi) * cut) / ((beta + np.sqrt(n[i])) / alpha + l2))

    order = np.random.default_rng(7)
    for _ in range(passes):
        for k in order.permutation(len(examples)):
            slots, values, y = examples[k]
            i, x = np.append(slots, bias).astype(np.int64), np.append(values, 1.0).astype(np.float64)
            w = weights(i)
            p = 1 / (1 + np.exp(-np.clip(w @ x, -35, 35)))
            g = (p - y) * x
            s = (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / alpha
            z[i] += g - s * w
            n[i] += g * g
    used = np.flatnonzero(np.abs(z[:-1]) > l1)
    return Linear(bits, used, weights(used), float(weights(np.array([bias]))[0]))


def gather(texts: pa.Array, bits: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Each row's distinct slots and their values."""
    out = []
    for a, b in slices(texts):
        slot, rows, count = features(texts.slice(a, b - a), bits)
        key, n = np.unique((rows << bits) | slot, return_counts=True)
        cut = np.searchsorted(key >> bits, np.arange(b - a + 1))
        for r in range(b - a):
            part = slice(cut[r], cut[r + 1])
            out.append((key[part] & ((1 << bits) - 1), SCALE * n[part] / max(1, count[r])))
    return out


def predict(model: Linear, texts: pa.Array) -> np.ndarray:
    """Scores between 0 and 1 of all rows."""
    out = np.empty(len(texts))
    dense = np.zeros(1 << model.bits)
    dense[model.index] = model.weight
    for a, b in slices(texts):
        slot, rows, count = features(texts.slice(a, b - a), model.bits)
        total = np.bincount(rows, weights=dense[slot], minlength=b - a)
        out[a:b] = 1 / (1 + np.exp(-np.clip(model.bias + SCALE * total / np.maximum(1, count), -35, 35)))
    tidy()
    return out


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, keep: Column, sample: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Texts and labels of at most ``sample`` labelled rows that ``keep`` admits.

    The key's smallest hashes are taken, so the sample doesn't hang on the
    order of rows.  Of several labels of a key the largest counts, of several
    texts the smallest.
    """
    chosen = (
        labels.select(named(key).alias("_key"), named(label).cast("int").alias("_label"))
        .where(F.col("_key").isNotNull() & F.col("_label").isin(0, 1))
        .where(keep)
        .groupBy("_key")
        .agg(F.max("_label").alias("_label"))
        .orderBy(F.xxhash64("_key"), "_key")
        .limit(sample)
    )
    found = docs.select(named(key).alias("_key"), named(text).alias("_text")).join(F.broadcast(chosen), "_key")
    return found.groupBy("_key", "_label").agg(F.min("_text").alias("_text"))


def fit(docs: DataFrame, labels: DataFrame, keep: Column | None = None, label: str = "quality", key: str = "doc_id", text: str = "text", sample: int = 6000, bits: int = 20) -> Linear:
    """Learns from labelled documents; ``keep`` is a condition on ``_key`` and ``_label``."""
    rows = labelled_sample(docs, labels, label, F.lit(True) if keep is None else keep, sample, key, text)

    def vectors(batches):
        for batch in batches:
            found = gather(plain(batch.column("_text")), bits)
            yield pa.RecordBatch.from_arrays(
                [batch.column("_key").cast(pa.string()), batch.column("_label"), pa.array([s.astype(np.uint32).tobytes() for s, _ in found], pa.binary()), pa.array([v.astype(np.float32).tobytes() for _, v in found], pa.binary())],
                names=["key", "label", "slots", "values"],
            )
            tidy()

    got = rows.withColumn("_key", F.col("_key").cast("string")).mapInArrow(vectors, "key string, label int, slots binary, values binary").toArrow().sort_by("key")
    examples = [(np.frombuffer(s, np.uint32), np.frombuffer(v, np.float32), y) for y, s, v in zip(got["label"].to_pylist(), got["slots"].to_pylist(), got["values"].to_pylist(), strict=True)]
    model = train(examples, bits)
    del got, examples
    tidy()
    return model


def score(docs: DataFrame, model: Linear, text: str = "text", output: str = "score") -> DataFrame:
    """Adds the probability of label 1."""

    @F.arrow_udf("double")
    def quality(t: pa.Array) -> pa.Array:
        return pa.array(predict(model, plain(t)))

    return replace_column(docs, output, quality(named(text)))


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, folds: int = 5, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """Scores every document with a model that never saw the held-out fold (remainder 0)."""
    model = fit(docs, labels, fold("_key", folds) != 0, key=key, text=text, **options)
    out = score(docs, model, text)
    out = replace_column(out, "held_out", F.coalesce(fold(key, folds) == 0, F.lit(False)))
    return replace_column(out, "predicted", (F.col("score") >= threshold).cast("int"))
