"""Byte-level BPE encoding and decoding with numpy matrices.

The distinct pretokens of a batch that aren't known yet are put into padded
matrices by length.  In each round every row merges its leftmost pair of
minimum rank; pairs are found in an open-addressing hash table of all pairs
that the rank file can merge, and rows are compacted after each merge.  Rows
that are done leave the matrix.  A pretoken longer than ``LONG`` bytes, where a
round would cost too much, keeps its pairs in a heap ordered by rank and
place, which merges the same pairs in the same order.

Defined results: null and empty texts have no ids; repeated rows and pretokens
give the same ids; very long texts are encoded whole; an empty table gives no
rows.  Output columns replace input columns of the same name.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, named, plain, replace_column, slices, tidy

LONG = 512
#: Pretokens that a worker remembers; beyond that it starts anew.
MEMO = 400_000
#: Cells of a matrix.
CELLS = 1 << 20
#: The largest int32, as the rank of pairs that don't merge.
NONE = np.int32(2**31 - 1)
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


class Ranks:
    """A rank file: tokens by id, and the hash table of mergeable pairs."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            pairs = [line.split() for line in f if line.strip()]
        self.tokens = {int(b): base64.b64decode(a) for a, b in pairs}
        ids = {t: i for i, t in self.tokens.items()}
        self.byte = np.array([ids[bytes([b])] for b in range(256)], dtype=np.int32)
        left, right, merged = [], [], []
        for token, i in ids.items():
            for k in range(1, len(token)):
                a, b = ids.get(token[:k]), ids.get(token[k:])
                if a is not None and b is not None:
                    left.append(a)
                    right.append(b)
                    merged.append(i)
        keys = (np.array(left, np.uint64) << np.uint64(32)) | np.array(right, np.uint64)
        self.bits = max(10, int(len(keys) * 4).bit_length())
        self.keys = np.full(1 << self.bits, np.iinfo(np.uint64).max, np.uint64)
        self.values = np.full(1 << self.bits, NONE, np.int32)
        self.pairs = dict(zip(keys.tolist(), merged, strict=True))
        self.probes = 0
        slots, todo = self._home(keys), np.arange(len(keys))
        merged_at = np.array(merged, np.int32)
        while len(todo):  # one more place to look in each round
            self.probes += 1
            at = slots[todo]
            free = self.keys[at] == np.iinfo(np.uint64).max
            first = np.zeros(len(todo), bool)
            first[np.unique(at, return_index=True)[1]] = True
            put = free & first
            self.keys[at[put]], self.values[at[put]] = keys[todo[put]], merged_at[todo[put]]
            todo = todo[~put]
            slots[todo] = (slots[todo] + 1) & ((1 << self.bits) - 1)
        most = max(self.tokens) + 1
        size = np.zeros(most, np.int64)
        for i, t in self.tokens.items():
            size[i] = len(t)
        self.size, self.start = size, np.cumsum(size) - size
        self.flat = np.frombuffer(b"".join(self.tokens[i] for i in sorted(self.tokens)), np.uint8)

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * _MULTIPLIER) >> np.uint64(64 - self.bits)).astype(np.int64)

    def lookup(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Ids (which are ranks) that pairs merge to, or NONE."""
        keys = (a.astype(np.uint64) << np.uint64(32)) | b.astype(np.uint64)
        at = self._home(keys)
        out = np.full(len(keys), NONE, np.int32)
        todo = np.arange(len(keys))
        for _ in range(self.probes):
            found = self.keys[at[todo]]
            hit = found == keys[todo]
            out[todo[hit]] = self.values[at[todo[hit]]]
            todo = todo[~hit & (found != np.iinfo(np.uint64).max)]
            if not len(todo):
                break
            at[todo] = (at[todo] + 1) & ((1 << self.bits) - 1)
        return out

    def merge_matrix(self, words: list[bytes]) -> list[list[int]]:
        """Ids of words of like length, one row of a matrix each."""
        width = max(map(len, words))
        length = np.array([len(w) for w in words])
        ids = np.full((len(words), width), -1, np.int32)
        filled = np.arange(width) < length[:, None]
        ids[filled] = self.byte[np.frombuffer(b"".join(words), np.uint8)]
        rank = np.full((len(words), width), NONE, np.int32)
        both = filled[:, 1:]
        rank[:, :-1][both] = self.lookup(ids[:, :-1][both], ids[:, 1:][both])
        out: list[list[int]] = [[]] * len(words)
        rows = np.arange(len(words))
        while len(rows):
            best = rank.argmin(axis=1)  # the leftmost of equals
            low = rank[np.arange(len(rows)), best]
            done = low == NONE
            if done.any():
                for r in np.flatnonzero(done):
                    out[rows[r]] = ids[r, : length[r]].tolist()
                live = ~done
                ids, rank, rows, length, best, low = ids[live], rank[live], rows[live], length[live], best[live], low[live]
                if not len(rows):
                    break
            n, width = ids.shape
            here = np.arange(width)
            ids[np.arange(n), best] = low
            take = np.minimum(here + (here > best[:, None]), width - 1)  # what stands right of the pair moves left
            ids, rank = np.take_along_axis(ids, take, 1), np.take_along_axis(rank, take, 1)
            length = length - 1
            rank[:, -1] = NONE
            rank[np.arange(n), length - 1] = NONE
            for at in (best - 1, best):  # the pairs beside the merged token are new
                ok = np.flatnonzero((at >= 0) & (at + 1 < length))
                if len(ok):
                    rank[ok, at[ok]] = self.lookup(ids[ok, at[ok]], ids[ok, at[ok] + 1])
            width = max(1, int(length.max()))
            ids, rank = ids[:, :width], rank[:, :width]
        return out

    def merge_long(self, word: bytes) -> list[int]:
        """Ids of one long word: the same merges, chosen from a heap."""
        ids = self.byte[np.frombuffer(word, np.uint8)].tolist()
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        get = self.pairs.get
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := get(ids[i] << 32 | ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = r, -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (s := get(r << 32 | ids[k])) is not None:
                    heapq.heappush(heap, (s, i, r, ids[k]))
            if (h := before[i]) >= 0 and (s := get(ids[h] << 32 | r)) is not None:
                heapq.heappush(heap, (s, h, ids[h], r))
        return [x for x in ids if x >= 0]

    def encode_words(self, words: list[bytes]) -> list[list[int]]:
        """Ids of each word, by matrices of words of like length."""
        out: list[list[int]] = [[]] * len(words)
        order = sorted(range(len(words)), key=lambda i: len(words[i]))
        at = 0
        while at < len(order):
            size = max(1, len(words[order[at]]))
            if size > LONG:
                out[order[at]] = self.merge_long(words[order[at]])
                at += 1
                continue
            top = 4 if size <= 4 else min(LONG, 1 << (size - 1).bit_length())
            end, limit = at, max(1, CELLS // top)
            while end < len(order) and end - at < limit and len(words[order[end]]) <= top:
                end += 1
            for i, ids in zip(order[at:end], self.merge_matrix([words[i] for i in order[at:end]]), strict=True):
                out[i] = ids
            at = end
        return out

    def decode(self, ids: np.ndarray) -> bytes:
        """Bytes of ids."""
        size = self.size[ids]
        total = int(size.sum())
        if not total:
            return b""
        shift = np.repeat(self.start[ids] - (np.cumsum(size) - size), size)
        return self.flat[shift + np.arange(total)].tobytes()


@lru_cache(maxsize=4)
def ranks(path: str) -> Ranks:
    """The rank file, once in each process."""
    return Ranks(path)


class Encoder:
    """Encodes texts; remembers pretokens."""

    def __init__(self, path: str, pattern: str):
        self.ranks, self.find, self.known = ranks(path), regex.compile(pattern).findall, {}

    def batch(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text."""
        parts = [self.find(t) for t in texts]
        new = [w for w in set().union(*parts) if w not in self.known] if parts else []
        if len(self.known) + len(new) > MEMO:
            self.known = {}
            new = list(set().union(*parts))
        for w, ids in zip(new, self.ranks.encode_words([w.encode() for w in new]), strict=True):
            self.known[w] = tuple(ids)
        get = self.known.__getitem__
        return [np.fromiter(chain.from_iterable(map(get, p)), np.int32) for p in parts]


@lru_cache(maxsize=4)
def encoder(path: str, pattern: str) -> Encoder:
    """One encoder for each process."""
    return Encoder(path, pattern)


def _text(t: pa.Array) -> list[str]:
    return t.to_pylist()


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text", output: str = "ids") -> DataFrame:
    """Adds the ids of each text as array<int>."""

    @F.arrow_udf("array<int>")
    def ids(t: pa.Array) -> pa.Array:
        own, texts, found = encoder(path, pattern), plain(t), []
        for a, b in slices(texts):
            found += own.batch(_text(texts.slice(a, b - a)))
        ends = np.cumsum([0, *map(len, found)], dtype=np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.empty(0, np.int32), *found])))

    return replace_column(docs, output, ids(F.col(text)))


def decode(docs: DataFrame, path: str, ids: str = "ids", output: str = "decoded") -> DataFrame:
    """Adds the bytes of each array of ids; null arrays give no bytes."""

    @F.arrow_udf("binary")
    def text(a: pa.Array) -> pa.Array:
        own = ranks(path)
        return pa.array([own.decode(np.asarray(x or [], np.int64)) for x in a.to_pylist()], pa.binary())

    return replace_column(docs, output, text(F.col(ids)))


def round_trip(docs: DataFrame, path: str, pattern: str, text: str = "text") -> DataFrame:
    """Adds n_tokens and the digests of the ids and of what they decode to, without keeping either."""

    @F.arrow_udf("struct<n:bigint,ids:string,decoded:string>")
    def digests(t: pa.Array) -> pa.Array:
        own, texts = encoder(path, pattern), plain(t)
        n, a_hex, b_hex = [], [], []
        words = np.array([str(i) for i in range(len(own.ranks.size))], dtype=object)
        for a, b in slices(texts):
            for ids in own.batch(_text(texts.slice(a, b - a))):
                n.append(len(ids))
                a_hex.append(hashlib.sha256(" ".join(words[ids].tolist()).encode()).hexdigest())
                b_hex.append(hashlib.sha256(own.ranks.decode(ids)).hexdigest())
        tidy()
        return pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.array(a_hex, pa.string()), pa.array(b_hex, pa.string())], names=["n", "ids", "decoded"])

    own = fresh("_bpe", docs)
    out = replace_column(docs, own, digests(named(text)))
    for name, part in (("n_tokens", "n"), ("ids_sha256", "ids"), ("decoded_sha256", "decoded")):
        out = replace_column(out, name, F.col(f"{own}.{part}"))
    return out.drop(own)
