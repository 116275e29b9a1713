"""Near-duplicate detection by improved consistent weighted sampling over TF-IDF shingles.

1. Five-word shingles of lower-cased words are hashed to 64 bits.  Document
   frequencies are exact for all shingles in at least RARE of all documents, at
   most (mean shingles of a document) / RARE, whatever the number of documents:
   such a shingle lies in RARE / 2 of the documents of some group of them, and
   those that do are counted in a second pass.  A shingle weighs tf * (FLOOR + (1 - FLOOR) * idf), where
   idf is log(documents / frequency) in parts of log(1 / RARE), 1 at most, so a
   share of the documents means the same at every size.  The floor keeps large
   groups of copies, whose own shingles are frequent, from drifting apart.
2. Texts with the same shingles and counts are one node.
3. Each node gets ``BANDS * ROWS`` samples, improved consistent weighted
   sampling of its shingles' occurrences within hashed bins (empty bins borrow
   from others by a fixed order), and one key for each band of samples.
4. In each band's bucket all nodes are compared with one centre; those with a
   weighted Jaccard similarity of ``least`` or more are linked.  A second round
   takes the buckets that still hold several components and compares nodes of
   each with nodes of the bucket's largest, DRAWS pairs drawn anew for each band.
   A last round compares the nodes outside a bucket's largest component with
   all of its nodes, so each pair of a bucket is verified or lies in one component.
5. Classes are the components of the links (large-star, small-star).

Nothing is capped or gathered: buckets are aggregated before they are joined,
and a bucket or component of any size is joined by plain equi-joins that Spark
splits when they are skewed.  Texts are compared in blocks of bounded size, so a
text of a large group is sent once for each block it meets and not for each pair.  A link is lost only if no band of it agrees; the classes' recall is measured in
the tests.  Comparisons grow with the square of a bucket's nodes only as far as
these aren't near copies of each other; they are made in a task's memory, and
only links become rows.

Defined results: a document without words, or null, is a class of its own; one
of 1 to 4 words is a single shingle; very long texts are read whole; an empty
table gives no rows.  The class id is the smallest id in the class, whose
document stays.  Each row is judged by its own text: of an id on several rows
those whose texts are near copies of a smaller id's go, the others stay, and an
id that is the smallest of several classes gives its number to each.  In
``classes`` a null id has a null class and stays; ``keep_one`` numbers the rows
if ids are null or repeated, and so keeps one row of each class (of texts
without words all).
"""

from __future__ import annotations

import gc
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import hashing as H
from .common import fresh, named, plain, slices, tidy

#: Share of all documents from which on a shingle counts as frequent, and the least factor of any shingle.
RARE, FLOOR = 0.001, 0.75
#: Shingles of a group of documents, counted together in a task's memory.
HELD = 6 << 20
BANDS, ROWS = 32, 5
#: Comparisons of a component with its bucket's largest in the second round.
DRAWS = 4
BINS = BANDS * ROWS
#: Documents that a group has if there are many, for shingles in RARE / 2 of them to say something.
GROUP_BITS = 13
#: Occurrences of shingles in a block of texts that a task holds, and those that a text counts as at least.
BLOCK, LEAST_SIZE = 1 << 18, 64
#: Steps towards a node's home, each twice as far as the one before.
HOPS = 4
#: Bytes of ids up to which they go to all tasks; beyond it, they are joined by a shuffle.
BROADCAST = 64 << 20

U = H.U
_order = np.random.default_rng(20)
#: For each bin the order in which it borrows from others.
_BORROW = np.stack([_order.permutation(BINS) for _ in range(BINS)])


def shingles(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, hashes and counts of the distinct shingles, by row and hash."""
    h, rows = H.ngrams(*H.words(texts), 5, whole_short=True)
    order = np.lexsort((h, rows))
    h, rows = h[order], rows[order]
    new = np.flatnonzero(np.r_[True, (h[1:] != h[:-1]) | (rows[1:] != rows[:-1])]) if len(h) else np.empty(0, np.int64)
    return rows[new], h[new], np.diff(np.r_[new, len(h)])


@dataclass(frozen=True)
class Idf:
    """Factors of the frequent shingles, by rising hash; all others have factor 1."""

    hashes: np.ndarray
    factors: np.ndarray

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of ``h`` are frequent, and their places; a bit table rules out most before the exact search."""
        maybe = np.zeros(1 << 20, bool)
        maybe[self.hashes >> U(44)] = True
        some = np.flatnonzero(maybe[h >> U(44)])
        at = np.searchsorted(self.hashes, h[some])
        hit = at < len(self.hashes)
        some, at = some[hit], at[hit]
        hit = self.hashes[at] == h[some]
        return some[hit], at[hit]

    def __call__(self, h: np.ndarray) -> np.ndarray:
        out = np.ones(len(h))
        some, at = self.find(h)
        out[some] = self.factors[at]
        return out


def idf_of(docs: DataFrame, text: str = "text") -> Idf:
    """Exact document frequencies over all documents, and the factors of the shingles in RARE of them."""
    total = docs.count()
    tasks = max(total >> GROUP_BITS, 2 * docs.sparkSession.sparkContext.defaultParallelism)
    texts = docs.select(named(text).alias("t")).coalesce(tasks)
    least, missed = max(2, math.ceil(RARE * total)), RARE / 2 * total

    def frequent(batches):
        """The shingles in RARE / 2 of a group's documents; of any other shingle all groups leave out less than ``missed``."""
        held: list[np.ndarray] = []
        size = seen = 0

        def flush():
            h, n = np.unique(np.concatenate(held), return_counts=True)
            some = n >= RARE / 2 * seen
            return pa.RecordBatch.from_arrays([pa.array(h[some].view(np.int64)), pa.array(n[some], pa.int64())], names=["h", "n"])

        for batch in batches:
            own = plain(batch.column(0))
            for a, b in slices(own):
                held.append(shingles(own.slice(a, b - a))[1])
                size, seen = size + len(held[-1]), seen + b - a
                if size > HELD:
                    yield flush()
                    held, size, seen = [], 0, 0
        if held:
            yield flush()
        tidy()

    found = texts.mapInArrow(frequent, "h bigint, n bigint").groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") > least - missed)
    asked = Idf(np.sort(np.asarray(found.select("h").toArrow()["h"]).view(U)), np.empty(0))
    if not len(asked.hashes):
        return asked

    def exact(batches):
        """In how many of a task's documents each of these lies."""
        n = np.zeros(len(asked.hashes), np.int64)
        for batch in batches:
            own = plain(batch.column(0))
            for a, b in slices(own):
                h, rows = H.ngrams(*H.words(own.slice(a, b - a)), 5, whole_short=True)
                i, at = asked.find(h)
                n += np.bincount(np.unique(rows[i] * len(n) + at) % len(n), minlength=len(n))
        tidy()
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(asked.hashes[some].view(np.int64)), pa.array(n[some])], names=["h", "n"])

    got = texts.mapInArrow(exact, "h bigint, n bigint").groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") >= least).toArrow()
    h, n = np.asarray(got["h"]).view(U), np.asarray(got["n"]).astype(np.float64)
    order = np.argsort(h)
    idf = np.minimum(1.0, np.log(total / n[order]) / np.log(1 / RARE))
    return Idf(h[order], FLOOR + (1 - FLOOR) * idf)


def weights(h: np.ndarray, count: np.ndarray, idf: Idf) -> np.ndarray:
    """TF-IDF weights of shingles."""
    return count * idf(h)


def _uniform(h: np.ndarray, k: int) -> np.ndarray:
    return ((H.mix(h + U(0x9E3779B97F4A7C15 * k & 0xFFFFFFFFFFFFFFFF)) >> U(11)).astype(np.float64) + 0.5) * 2.0**-53


def expanded(rows: np.ndarray, h: np.ndarray, count: np.ndarray, idf: Idf) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each occurrence of a shingle as an element of its own, weighing its IDF factor.

    The sets' weighted Jaccard similarity stays the same.  A shingle that a
    document repeats a hundred times would otherwise fill one bin alone, and
    bins would agree less often than the weights do.
    """
    at = np.repeat(np.arange(len(h)), count)
    turn = np.arange(len(at)) - np.repeat(np.cumsum(count) - count, count)
    return rows[at], np.where(turn, H.mix(h[at] + turn.astype(U) * U(0x9E3779B97F4A7C15)), h[at]), weights(h, np.ones_like(count), idf)[at]


def samples(rows: np.ndarray, h: np.ndarray, w: np.ndarray, n: int) -> np.ndarray:
    """n x BINS consistent weighted samples as hashes; rows without shingles are 0."""
    out = np.zeros((n, BINS), U)
    if not len(h):
        return out
    r = -np.log(_uniform(h, 1) * _uniform(h, 2))
    c = -np.log(_uniform(h, 3) * _uniform(h, 4))
    beta = _uniform(h, 5)
    t = np.floor(np.log(w) / r + beta)
    log_a = np.log(c) - r * (t - beta) - r
    place = rows * BINS + ((H.mix(h ^ U(0x5DEECE66D)) >> U(32)) % U(BINS)).astype(np.int64)
    order = np.lexsort((log_a, place))
    first = order[np.flatnonzero(np.r_[True, place[order][1:] != place[order][:-1]])]
    filled = np.zeros(n * BINS, bool)
    flat = out.ravel()
    flat[place[first]] = H.mix(h[first] ^ (t[first].astype(np.int64).view(U) * U(0xD6E8FEB86659FD93)))
    filled[place[first]] = True
    own, have = out.copy(), filled.reshape(n, BINS)
    open_ = ~have & have.any(axis=1)[:, None]
    for k in range(BINS):
        if not open_.any():
            break
        lender = _BORROW[:, k]
        take = open_ & have[:, lender]
        out[take] = own[:, lender][take]
        open_ &= ~take
    return out


def digests(rows: np.ndarray, h: np.ndarray, count: np.ndarray, n: int) -> pa.Array:
    """For each row 16 bytes that tell its shingles and their counts; null without any."""
    one = H.mix(h ^ (count.astype(U) * U(0xE7037ED1A0B428DB)))
    out = np.zeros((n, 2), U)
    for k in range(2):
        np.add.at(out[:, k], rows, H.mix(one + U(k + 1)))
    none = np.bincount(rows, minlength=n) == 0
    return pa.array([None if e else d.tobytes() for e, d in zip(none, out, strict=True)], pa.binary())


def sketches(docs: DataFrame, idf: Idf, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows id, digest (of the shingles and their counts; null without words), keys (one for each band) and size (occurrences)."""
    kind = docs.schema[key].dataType.simpleString()

    def sketch(batches):
        for batch in batches:
            texts = plain(batch.column(1))
            for a, b in slices(texts):
                n = b - a
                rows, h, count = shingles(texts.slice(a, n))
                own = samples(*expanded(rows, h, count, idf), n)
                keys = np.zeros((n, BANDS), U)
                for k in range(ROWS):
                    keys += own[:, k * BANDS : (k + 1) * BANDS] * H._PLACES[k]
                keys = H.mix(keys + np.arange(1, BANDS + 1, dtype=U) * U(0xA0761D6478BD642F))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, n * BANDS + 1, BANDS, dtype=np.int32)), pa.array(keys.ravel().view(np.int64)))
                size = np.bincount(rows, weights=count, minlength=n).astype(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, n), digests(rows, h, count, n), lists, pa.array(size)], names=["id", "digest", "keys", "size"])
            tidy()

    return docs.select(named(key).alias("id"), named(text).alias("t")).mapInArrow(sketch, f"id {kind}, digest binary, keys array<bigint>, size bigint")


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two sets of rising hashes with weights."""
    (ha, wa), (hb, wb) = a, b
    if not len(ha) or not len(hb):
        return 0.0
    at = np.searchsorted(hb, ha)
    hit = hb[np.minimum(at, len(hb) - 1)] == ha
    common = np.minimum(wa[hit], wb[at[hit]]).sum()
    return float(common / (wa.sum() + wb.sum() - common))


def _sets(texts: pa.Array, idf: Idf) -> list[tuple[np.ndarray, np.ndarray]]:
    out = []
    for a, b in slices(texts):
        rows, h, count = shingles(texts.slice(a, b - a))
        w = weights(h, count, idf)
        cut = np.searchsorted(rows, np.arange(b - a + 1))
        out += [(h[cut[i] : cut[i + 1]], w[cut[i] : cut[i + 1]]) for i in range(b - a)]
    return out


def small(df: DataFrame, rows: int, width: int = 16) -> DataFrame:
    """With a hint to broadcast if so many rows are within the bound."""
    return F.broadcast(df) if rows * width <= BROADCAST else df


def texts_of(nodes: DataFrame, docs: DataFrame, repeated: bool, key: str, text: str) -> DataFrame:
    """Rows node, t: a text of each node (rows node, id and digest); repeated: whether an id occurs on several rows."""
    met = docs.select(named(key).alias("id"), named(text).alias("t")).join(nodes, "id")
    if not repeated:
        return met.select("node", "t")

    def own(batches):
        for batch in batches:
            texts = plain(batch.column("t"))
            found = [digests(*shingles(texts.slice(a, b - a)), b - a) for a, b in slices(texts)]
            if found:
                good = batch.select(["node", "t"]).filter(pc.equal(pa.concat_arrays(found), batch.column("digest")))
                yield good
            tidy()

    same = met.select("node", "t", "digest").mapInArrow(own, "node bigint, t string")
    return same.groupBy("node").agg(F.min("t").alias("t"))


def blocked(members: DataFrame, reps: DataFrame) -> DataFrame:
    """Rows node, id, digest and block: nodes of a home, cut by hash into blocks of about BLOCK occurrences.

    A node's home is the smallest centre of its buckets, followed to that one's home and on.
    """
    home = members.groupBy("node").agg(F.min("b").alias("home")).checkpoint()
    for _ in range(HOPS):
        onward = home.select(F.col("node").alias("home"), F.col("home").alias("next"))
        home = home.join(onward, "home").select("node", F.col("next").alias("home")).checkpoint()
    at = reps.select("node", "id", "digest", "size").join(home, "node")
    parts = at.groupBy("home").agg(F.ceil(F.sum(F.greatest("size", F.lit(LEAST_SIZE))) / BLOCK).alias("parts"))
    block = F.xxhash64("home", F.pmod(F.xxhash64("node"), "parts")).alias("block")
    return at.join(parts, "home").select("node", "id", "digest", block)


def verified(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, repeated: bool, idf: Idf, least: float, key: str, text: str) -> DataFrame:
    """The pairs of nodes (a, b) whose weighted Jaccard similarity is ``least`` or more; nodes: those of ``blocked``.

    A text is sent once to each two blocks that have pairs of it, and not once
    for each pair; a task holds the texts of two blocks at a time.
    """
    count = 2 * pairs.count()
    block = nodes.select("node", "block")
    met = pairs.join(block.withColumnsRenamed({"node": "a", "block": "x"}), "a").join(block.withColumnsRenamed({"node": "b", "block": "y"}), "b")
    met = met.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"), "a", "b").checkpoint()
    sent = met.select("x", "y", F.explode(F.array("a", "b")).alias("node")).distinct()
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    asked = nodes.select("node", "id", "digest").join(small(wanted, count), "node")
    texts = texts_of(small(asked, count, 64), docs, repeated, key, text).join(small(sent, count, 32), "node")
    both = texts.select("x", "y", F.col("node").alias("a"), F.lit(None).cast("bigint").alias("b"), "t").unionByName(met.withColumn("t", F.lit(None).cast("string")))

    def check(batches):
        group, sets = None, {}
        for batch in batches:
            texts = plain(batch.column("t"))
            for i, j in slices(texts):
                part, keep = batch.slice(i, j - i), []
                own = _sets(texts.slice(i, j - i), idf)
                for x, y, a, b, one in zip(*(part.column(c).to_pylist() for c in "xyab"), own, strict=True):
                    if group != (x, y):
                        group, sets = (x, y), {}
                    if b is None:
                        sets[a] = one
                    keep.append(b is not None and similarity(sets[a], sets[b]) >= least - 1e-12)
                good = part.select(["a", "b"]).filter(pa.array(keep))
                if good.num_rows:
                    yield good
            tidy()

    # Of two blocks the texts come first, then the pairs.
    return both.repartition("x", "y").sortWithinPartitions("x", "y", F.col("b").isNotNull()).mapInArrow(check, "a bigint, b bigint")


def repeats(docs: DataFrame, key: str) -> bool:
    """Whether an id occurs on several rows."""
    ids = docs.select(named(key).alias("id")).where("id is not null")
    return ids.groupBy("id").count().where("count > 1").limit(1).count() > 0


def release(df: DataFrame) -> None:
    """Collects the driver's garbage, upon which Spark deletes the files of shuffles that nothing refers to any more."""
    gc.collect()
    df.sparkSession.sparkContext._jvm.System.gc()


def components(links: DataFrame) -> DataFrame:
    """Rows node, root: for each linked node the smallest of its component."""
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct().checkpoint()
    before = None
    while True:
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1_000_003)).first()
        if before is not None and tuple(state) == before:
            release(links)
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = tuple(state)
        near = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = near.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u"), F.least("u", "m").alias("m"))
        large = near.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        down = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = down.union(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct().checkpoint()


def near(sets: list[tuple[np.ndarray, np.ndarray]], root: np.ndarray, one: np.ndarray, two: np.ndarray, least: float) -> list[tuple[int, int]]:
    """The pairs of a place in ``one`` and a place in ``two`` with different roots and a similarity of ``least`` or more.

    Common weights are summed over an index of the shingles of ``two``.
    """
    if not len(one) or not len(two):
        return []
    h, w = (np.concatenate([sets[j][k] for j in two]) for k in (0, 1))
    at = np.repeat(np.arange(len(two)), [len(sets[j][0]) for j in two])
    order = np.argsort(h, kind="stable")
    h, w, at = h[order], w[order], at[order]
    total, out = np.array([sets[j][1].sum() for j in two]), []
    for i in one.tolist():
        hi, wi = sets[i]
        start = np.searchsorted(h, hi)
        n = np.searchsorted(h, hi, "right") - start
        met = np.repeat(start - (np.cumsum(n) - n), n) + np.arange(n.sum())
        common = np.bincount(at[met], np.minimum(w[met], np.repeat(wi, n)), minlength=len(two))
        enough = common >= (least - 1e-12) * (wi.sum() + total - common)
        out += [(i, j) for j in two[enough & (root[two] != root[i])].tolist()]
    return out


def rest(members: DataFrame, links: DataFrame, nodes: DataFrame, docs: DataFrame, repeated: bool, idf: Idf, least: float, key: str, text: str) -> DataFrame:
    """The links with those of all pairs of a bucket whose nodes are in different components; nodes: those of ``blocked``.

    Nodes outside a bucket's largest component are compared with all of its
    nodes, block by block: two blocks that share such a bucket go to one task.
    Only links become rows.
    """
    at = members.join(components(links), "node", "left").select("key", "node", F.coalesce("root", "node").alias("root"))
    parts = at.groupBy("key", "root").agg(F.count("*").alias("n"))
    open_ = parts.groupBy("key").agg(F.max_by("root", F.struct("n", "root")).alias("top"), F.count("*").alias("n")).where("n > 1").select("key", "top").checkpoint()
    at = at.join(small(open_, open_.count()), "key").join(nodes, "node").withColumn("out", F.col("root") != F.col("top")).checkpoint()
    one, two = at.where("out").select("key", F.col("block").alias("x")).distinct(), at.select("key", F.col("block").alias("y")).distinct()
    met = one.join(two, "key").select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct().checkpoint()
    asked = at.groupBy("node", "id", "digest", "block", "root").agg(F.max("out").alias("out")).checkpoint()
    into = met.select(F.col("x").alias("block"), "x", "y").union(met.where("x <> y").select(F.col("y").alias("block"), "x", "y"))
    sent = asked.select("node", "block", "root", "out").join(small(into, 2 * met.count(), 40), "block")
    texts = texts_of(small(asked.select("node", "id", "digest"), asked.count(), 64), docs, repeated, key, text)
    both = texts.join(small(sent, sent.count(), 64), "node").select("x", "y", "block", "node", "root", "out", "t")

    def compare(rows: list[tuple], sets: list) -> pa.RecordBatch:
        x, y, block, node, root, out = (np.array(c) for c in zip(*rows, strict=True))
        left, right = block == x, block == y
        found = near(sets, root, np.flatnonzero(left & out), np.flatnonzero(right), least)
        if x[0] != y[0]:
            found += near(sets, root, np.flatnonzero(right & out), np.flatnonzero(left & ~out), least)
        a, b = node[np.array(found, np.int64).reshape(-1, 2).T]
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    def check(batches):
        rows, sets = [], []
        for batch in batches:
            texts = plain(batch.column("t"))
            for i, j in slices(texts):
                part = batch.slice(i, j - i)
                own = zip(*(part.column(c).to_pylist() for c in ("x", "y", "block", "node", "root", "out")), strict=True)
                for row, one in zip(own, _sets(texts.slice(i, j - i), idf), strict=True):
                    if rows and rows[-1][:2] != row[:2]:
                        yield compare(rows, sets)
                        rows, sets = [], []
                    rows.append(row)
                    sets.append(one)
            tidy()
        if rows:
            yield compare(rows, sets)

    return links.union(both.repartition("x", "y").sortWithinPartitions("x", "y").mapInArrow(check, "a bigint, b bigint"))


def classes(docs: DataFrame, least: float = 0.8, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows key, class_id, keep: one for each row of ``docs``."""
    idf = idf_of(docs, text)
    drawn = sketches(docs, idf, key, text).checkpoint()
    texts = drawn.where("digest is not null and id is not null").groupBy("digest")
    reps = texts.agg(F.min("id").alias("id"), F.first("keys").alias("keys"), F.first("size").alias("size")).withColumn("node", F.monotonically_increasing_id()).checkpoint()
    buckets = reps.select("node", F.explode("keys").alias("key"))
    shared = buckets.groupBy("key").agg(F.min("node").alias("b"), F.count("*").alias("n")).where("n > 1").select("key", "b")
    members = buckets.join(shared, "key").select("key", "node", "b").checkpoint()
    nodes, repeated = blocked(members, reps).checkpoint(), repeats(drawn, "id")
    verify = lambda pairs: verified(pairs, nodes, docs, repeated, idf, least, key, text)
    first = members.where("node <> b").select(F.col("node").alias("a"), "b").distinct().checkpoint()
    links = verify(first).checkpoint()
    roots = components(links)
    # Second round: buckets that still hold several components.
    rooted = members.select("key", "node").join(roots, "node", "left").select("key", "node", F.coalesce("root", "node").alias("root"))
    draws = [F.min_by("node", F.xxhash64("node", "key", F.lit(k))).alias(f"r{k}") for k in range(DRAWS)]
    parts = rooted.groupBy("key", "root").agg(F.count("*").alias("n"), F.array(*draws).alias("drawn"))
    largest = parts.groupBy("key").agg(F.max_by(F.struct("root", "drawn"), F.struct("n", "root")).alias("top"), F.count("*").alias("n")).where("n > 1").select("key", "top")
    apart = parts.join(largest, "key").where("root <> top.root")
    second = apart.select(F.explode(F.arrays_zip(F.col("drawn").alias("a"), F.col("top.drawn").alias("b"))).alias("p")).select("p.a", "p.b")
    second = second.distinct().join(first, ["a", "b"], "left_anti").checkpoint()
    links = links.union(verify(second)).checkpoint()
    release(docs)
    links = rest(members.select("key", "node"), links, nodes, docs, repeated, idf, least, key, text).checkpoint()
    rooted = reps.select("digest", "node", "id").join(components(links), "node", "left").select("digest", "id", F.coalesce("root", "node").alias("root"))
    # Of equal smallest ids in a class, the one with the smallest digest stays.
    tops = rooted.groupBy("root").agg(F.min(F.struct("id", "digest")).alias("top"))
    of_text = rooted.join(tops, "root").select("digest", F.col("top.id").alias("class_id"), (F.col("digest") == F.col("top.digest")).alias("own"))
    out = drawn.select("id", "digest").join(of_text, "digest", "left").select(F.col("id").alias(key), F.coalesce("class_id", "id").alias("class_id"), F.coalesce("own", F.lit(True)).alias("own"))
    out = out.withColumn("class_id", F.when(named(key).isNotNull(), F.col("class_id")))
    return out.select(named(key), "class_id", F.coalesce(F.col("own") & (named(key) == F.col("class_id")), F.lit(True)).alias("keep"))


def keep_one(docs: DataFrame, least: float = 0.8, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each class, that with the smallest id (the first of several)."""
    own, by = docs, key
    if docs.where(named(key).isNull()).limit(1).count() or repeats(docs, key):
        by = fresh("_row", docs)
        number = F.struct(named(key).isNull().alias("none"), named(key).alias("id"), F.monotonically_increasing_id().alias("row"))
        own = docs.withColumn(by, number).checkpoint()
    gone = classes(own, least, by, text).where(~F.col("keep")).select(named(by)).checkpoint()
    return own.join(small(gone, gone.count(), 40), by, "left_anti").select(*[named(c) for c in docs.columns])
