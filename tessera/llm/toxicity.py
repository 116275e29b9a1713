"""Toxicity: a logistic classifier whose scores don't move when identity terms are swapped.

Features are the distinct lower-cased words of a text and their first 4, 5 and
7 bytes, as 32-bit hashes.  Training takes at most ``sample`` labelled rows,
selects the ``most`` features that speak for label 1 best (chi-squared of at
least ``floor``, at least ``least`` rows) and those of the terms below, and minimises, over weights of 0 and more,

    mean logistic loss + l2 |w|^2 + cf mean over swaps (w . (f(s) - f(s')))^2

where s is a labelled sentence with an identity term and s' the same sentence
with another term of the same kind.  The last term drives the weights of the
identity terms together, so a neutral mention of a group adds nothing.  Terms are
those of ``IDENTITY``, and the words that at least ``COMMON`` of the rows of either
label hold: what both kinds of text mention as a matter of course is no more a
reason to call one toxic than a group's name, and invented languages have no
other terms.  At most ``swapped`` sentences of a row are used.  As no weight is
negative, harmless text can't hide a toxic sentence, however long it is.

Defined results: null and empty texts score the bias; repeated rows score
alike; very long texts are read whole; without usable labels, or with one class
only, every score is the smoothed share of label 1; an empty table gives no
rows.  Output columns replace input columns of the same name.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import hashing as H
from .common import fold, named, plain, replace_column, slices, tidy
from .quality import labelled_sample

PREFIXES = (4, 5, 7)
#: Chi-squared that a feature has at least.
FLOOR = 15.0

#: Identity terms by kind; a term is swapped for the next of its kind.  Parameter of ``fit``.
IDENTITY = (
    ("women", "men", "girls", "boys"),
    ("woman", "man", "girl", "boy"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("black", "white", "asian", "latino", "arab", "african", "european"),
    ("gay", "lesbian", "straight", "bisexual", "transgender"),
    ("immigrants", "refugees", "foreigners", "citizens"),
    ("disabled", "deaf", "blind", "elderly", "young"),
    ("frauen", "männer", "mädchen", "jungen"),
    ("muslime", "christen", "juden", "hindus", "atheisten"),
    ("ausländer", "flüchtlinge", "einwanderer", "bürger"),
    ("femmes", "hommes", "filles", "garçons"),
    ("musulmans", "chrétiens", "juifs", "hindous", "athées"),
    ("étrangers", "réfugiés", "immigrés", "citoyens"),
    ("mujeres", "hombres", "niñas", "niños"),
    ("musulmanes", "cristianos", "judíos", "hindúes", "ateos"),
    ("extranjeros", "refugiados", "inmigrantes", "ciudadanos"),
)
#: Share of the rows of either label from which on a word is a term, how many such words there are at most, and of a kind.
COMMON, FOUND, KIND = 0.02, 256, 8


@dataclass(frozen=True)
class Model:
    """Feature hashes in rising order, their weights, and the bias."""

    feature: np.ndarray
    weight: np.ndarray
    bias: float


def distinct(texts: pa.Array) -> list[np.ndarray]:
    """Each row's distinct features in rising order."""
    out: list[np.ndarray] = []
    for a, b in slices(texts):
        h, rows = H.word_prefixes(texts.slice(a, b - a), PREFIXES)
        key = np.unique((rows.astype(H.U) << H.U(32)) | (h >> H.U(32)))
        cut = np.searchsorted(key >> H.U(32), np.arange(b - a + 1, dtype=H.U))
        low = (key & H.U(0xFFFFFFFF)).astype(np.uint32)
        out += [low[cut[r] : cut[r + 1]] for r in range(b - a)]
    return out


_WORDS = re.compile(r"\w+")


def swaps(text: str, kinds: tuple[tuple[str, ...], ...], most: int) -> list[tuple[str, str]]:
    """At most so many distinct sentences with a term (smallest hashes first), each with the same sentence with the next terms of the kinds."""
    ring = {t: k[(i + 1) % len(k)] for k in kinds if len(k) > 1 for i, t in enumerate(k)}
    some = {s for s in re.split(r"[.!?\n]+", text) if not ring.keys().isdisjoint(_WORDS.findall(s.lower()))}
    chosen = sorted(some, key=lambda s: (zlib.crc32(s.encode("utf-8", "surrogatepass")), s))[:most]
    return [(s, _WORDS.sub(lambda m: ring.get(m[0].lower(), m[0]), s)) for s in chosen]


def common_kinds(rows: DataFrame, share: float = COMMON) -> tuple[tuple[str, ...], ...]:
    """Words that at least this share of the rows of either label hold, by kinds of like frequency; rows of ``labelled_sample``."""
    words = F.array_distinct(F.regexp_extract_all(F.lower("_text"), F.lit(r"([\p{L}\p{N}_]+)"), F.lit(1)))
    total = {r["_label"]: r["n"] for r in rows.groupBy("_label").agg(F.count("*").alias("n")).collect()}
    if len(total) < 2:
        return ()
    ones = F.count_if(F.col("_label") == 1)
    counts = rows.select("_label", F.explode(words).alias("word")).groupBy("word").agg(ones.alias("ones"), (F.count("*") - ones).alias("zeros"))
    # Terms of two words at least say something even in a small sample.
    often = counts.where((F.col("ones") >= max(2.0, share * total[1])) & (F.col("zeros") >= max(2.0, share * total[0])))
    found = [r.word for r in often.orderBy(F.desc("zeros"), "word").limit(FOUND).collect()]
    return tuple(tuple(found[i : i + KIND]) for i in range(0, len(found), KIND))


def train(rows: list[np.ndarray], y: np.ndarray, pairs: list[tuple[np.ndarray, np.ndarray]], most: int = 4096, least: int = 3, floor: float = FLOOR, l2: float = 1e-4, cf: float = 10.0, rounds: int = 600) -> Model:
    """Full-batch Adam on the selected features."""
    n, ones = len(rows), int(y.sum())
    none = np.empty(0, np.uint32)
    if ones in (0, n):
        p = (ones + 1) / (n + 2)
        return Model(none, np.empty(0), float(np.log(p / (1 - p))))
    feature, total = np.unique(np.concatenate([none, *rows]), return_counts=True)
    speaking, times = np.unique(np.concatenate([none, *(r for r, one in zip(rows, y, strict=True) if one)]), return_counts=True)
    hits = np.zeros(len(feature))
    hits[np.searchsorted(feature, speaking)] = times
    expected = total * ones / n
    chi = (hits - expected) ** 2 / (expected * (1 - ones / n) * (1 - total / (n + 1)))
    chi[(total < min(least, ones)) | (hits < expected)] = 0
    chosen = np.argsort(-chi, kind="stable")[: min(most, int((chi > floor).sum()))]
    # What tells terms apart is always weighed, so that the swaps have a say in it.
    terms = np.unique(np.concatenate([none, *(np.setxor1d(a, b) for a, b in pairs)]))
    feature = np.union1d(feature[chosen], np.intersect1d(feature, terms))
    k = len(feature)

    def located(f: np.ndarray) -> np.ndarray:
        i = np.searchsorted(feature, f)
        return i[(i < k) & (feature[np.minimum(i, k - 1)] == f)] if k else i[:0]

    used = [located(r) for r in rows]
    col = np.concatenate([np.empty(0, np.int64), *used])
    row = np.repeat(np.arange(n), [len(u) for u in used])

    diff = [(np.concatenate([located(a), located(b)]), len(located(a))) for a, b in pairs]
    p_col = np.concatenate([np.empty(0, np.int64), *[c for c, _ in diff]]).astype(np.int64)
    p_sign = np.concatenate([np.empty(0), *[np.r_[np.ones(m), -np.ones(len(c) - m)] for c, m in diff]])
    p_row = np.repeat(np.arange(len(diff)), [len(c) for c, _ in diff])
    w = np.zeros(k + 1)
    w[k] = np.log(ones / (n - ones))
    m1, m2 = np.zeros(k + 1), np.zeros(k + 1)
    for t in range(1, rounds + 1):
        logit = np.bincount(row, weights=w[col], minlength=n) + w[k]
        residual = (1 / (1 + np.exp(-np.clip(logit, -35, 35))) - y) / n
        g = np.append(np.bincount(col, weights=residual[row], minlength=k), residual.sum())
        g[:k] += 2 * l2 / n * w[:k]
        if len(p_col):
            gap = np.bincount(p_row, weights=p_sign * w[p_col], minlength=len(diff)) / len(diff)
            g[:k] += 2 * cf * np.bincount(p_col, weights=p_sign * gap[p_row], minlength=k)
        m1, m2 = 0.9 * m1 + 0.1 * g, 0.999 * m2 + 0.001 * g * g
        w -= 0.1 * (1 - t / (rounds + 1)) * (m1 / (1 - 0.9**t)) / (np.sqrt(m2 / (1 - 0.999**t)) + 1e-8)
        np.maximum(w[:k], 0, out=w[:k])
    return Model(feature, w[:k], float(w[k]))


def predict(model: Model, texts: pa.Array) -> np.ndarray:
    """Scores between 0 and 1; a bit table rules out most words before the exact search."""
    out = np.empty(len(texts))
    maybe = np.zeros(1 << 22, bool)
    maybe[model.feature >> 10] = True
    k = len(model.feature)
    for a, b in slices(texts):
        h, rows = H.word_prefixes(texts.slice(a, b - a), PREFIXES)
        hit = maybe[h >> H.U(42)]
        f, rows = (h[hit] >> H.U(32)).astype(np.uint32), rows[hit]
        i = np.searchsorted(model.feature, f)
        real = (i < k) & (model.feature[np.minimum(i, k - 1)] == f) if k else np.zeros(len(f), bool)
        key = np.unique(rows[real] * max(1, k) + i[real])
        total = np.bincount(key // max(1, k), weights=model.weight[key % max(1, k)] if k else None, minlength=b - a)
        out[a:b] = 1 / (1 + np.exp(-np.clip(model.bias + total, -35, 35)))
    tidy()
    return out


def fit(docs: DataFrame, labels: DataFrame, keep: Column | None = None, label: str = "toxic", key: str = "doc_id", text: str = "text", sample: int = 12000, kinds: tuple[tuple[str, ...], ...] = IDENTITY, swapped: int = 2, **training) -> Model:
    """Learns from labelled documents; ``keep`` is a condition on ``_key`` and ``_label``."""
    rows = labelled_sample(docs, labels, label, F.lit(True) if keep is None else keep, sample, key, text)
    terms = {t for k in kinds for t in k}
    kinds = (*kinds, *(tuple(t for t in k if t not in terms) for k in common_kinds(rows)))

    def vectors(batches):
        raw = lambda xs: pa.array([x.tobytes() for x in xs], pa.binary())
        for batch in batches:
            texts = plain(batch.column("_text"))
            found = distinct(texts)
            tidy()
            yield pa.RecordBatch.from_arrays([batch.column("_key"), batch.column("_label"), raw(found), pa.array([None] * len(found), pa.binary())], names=["key", "label", "a", "b"])
            both = [(k, s, o) for k, t in zip(batch.column("_key").to_pylist(), texts.to_pylist(), strict=True) for s, o in swaps(t, kinds, swapped)]
            if both:
                a, b = distinct(plain(pa.array([x[1] for x in both]))), distinct(plain(pa.array([x[2] for x in both])))
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in both], pa.string()), pa.array([None] * len(both), pa.int32()), raw(a), raw(b)], names=["key", "label", "a", "b"])

    got = rows.withColumn("_key", F.col("_key").cast("string")).mapInArrow(vectors, "key string, label int, a binary, b binary").toArrow().sort_by("key")
    of = lambda x: np.frombuffer(x, np.uint32)
    found = list(zip(got["label"].to_pylist(), got["a"].to_pylist(), got["b"].to_pylist(), strict=True))
    y = np.array([x[0] for x in found if x[0] is not None], dtype=np.float64)
    model = train([of(x[1]) for x in found if x[0] is not None], y, [(of(x[1]), of(x[2])) for x in found if x[0] is None], **training)
    del got, found
    tidy()
    return model


def score(docs: DataFrame, model: Model, text: str = "text", output: str = "score") -> DataFrame:
    """Adds the probability of label 1."""

    @F.arrow_udf("double")
    def toxicity(t: pa.Array) -> pa.Array:
        return pa.array(predict(model, plain(t)))

    return replace_column(docs, output, toxicity(named(text)))


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, folds: int = 3, held: int = 1, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """Scores every document with a model that never saw the held-out fold (remainder ``held``)."""
    model = fit(docs, labels, fold("_key", folds) != held, key=key, text=text, **options)
    out = score(docs, model, text)
    out = replace_column(out, "held_out", F.coalesce(fold(key, folds) == held, F.lit(False)))
    return replace_column(out, "predicted", (F.col("score") >= threshold).cast("int"))
