"""Packing of documents into sequences by Karmarkar-Karp multiway differencing.

A document's ids fill whole windows of its own as far as they go.  What is
left of a group of documents is cut into pieces of at most ``piece`` ids and
dealt to windows: partial partitions with the largest imbalance are merged,
the largest sums of one with the smallest of the other, until one near-equal
partition is left.  If its largest window exceeds the capacity, the number of
windows rises by one and the differencing starts again.

Groups are made within a Spark partition, so nothing is shuffled, memory is
bounded by ``group`` documents' remainders, and a lost task repeats the same
sequences.  ``sequence_id`` is the partition's number times 2**40 plus a count.

Defined results: null and empty texts are the closing id alone; repeated rows
are packed as often as they occur; very long texts are cut into as many windows
as they need; an empty table gives no rows; a null key is kept.
"""

from __future__ import annotations

import heapq
import os
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SLICE_CHARS, plain, slices, tidy

#: Punctuation that stands behind words.
_ENDING = ".,;:!?%&$*#"
#: What plain words don't hold: characters that may combine or be taken apart, one capital whose lower case is
#: a letter and a mark, and the start of a special token.
_OTHER = "[^\\x00-\\x{24F}]|\\x{130}|<\\|"
#: Words that a worker remembers; beyond that it starts anew.
MEMO = 300_000


def differencing(sizes: list[int], k: int) -> list[list[int]]:
    """Deals items to k sets of near-equal sums; the sets are lists of item numbers."""
    links: list[tuple[int, int]] = []  # joins of two earlier nodes; items are nodes ~0, ~1, ...
    heap: list[tuple[int, int, np.ndarray, np.ndarray]] = [(-s, i, np.array([s]), np.array([~i])) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    count = len(sizes)
    while len(heap) > 1:
        _, _, a, an = heapq.heappop(heap)
        _, _, b, bn = heapq.heappop(heap)
        extra = len(a) + len(b) - k
        if extra <= 0:  # every sum of one meets an empty set of the other
            sums, nodes = np.concatenate([a, b]), np.concatenate([an, bn])
        else:  # sums fall; the last ones of each meet the last of the other
            i, j = len(a) - extra, len(b) - extra
            both = np.arange(len(links), len(links) + extra)
            links.extend(zip(an[i:].tolist(), bn[j:][::-1].tolist(), strict=True))
            sums = np.concatenate([a[:i], b[:j], a[i:] + b[j:][::-1]])
            nodes = np.concatenate([an[:i], bn[:j], both])
        order = np.argsort(-sums, kind="stable")
        sums, nodes = sums[order], nodes[order]
        gap = int(sums[0]) - (int(sums[-1]) if len(sums) == k else 0)
        count += 1
        heapq.heappush(heap, (-gap, count, sums, nodes))
    out = []
    for node in heap[0][3].tolist() if heap else []:
        items, todo = [], [node]
        while todo:
            x = todo.pop()
            if x < 0:
                items.append(~x)
            else:
                todo += links[x]
        out.append(items)
    return out


def windows(sizes: list[int], capacity: int) -> list[list[int]]:
    """Sets of items of at most ``capacity`` each; no item is larger than that."""
    if not sizes:
        return []
    k = -(-sum(sizes) // (capacity - capacity // 512))  # some slack, as sums are only near-equal
    while True:
        out = differencing(sizes, k)
        if max(sum(sizes[i] for i in x) for x in out) <= capacity:
            return out
        k += 1


class WordIds:
    """Ids of texts as bytes, by a tokenizer that drops white space and case.

    What stands between spaces and line ends is a word; in a plain word, whose
    characters normalise one by one, punctuation behind the last letter
    or digit makes a token of its own, so such words are put together from
    remembered cores and endings.  All other words are encoded whole, as they
    are.  New cores of letters, which are one pretoken each, are encoded many at
    a time and parted at the tokens that end a word.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for w, i in vocabulary.items() if w.endswith("</w>")]] = True
        self.known: dict[str, bytes] = {"": b""}

    def _encode(self, words: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]

    def _learn(self, words: set[str]) -> None:
        """Adds new cores and endings."""
        letters = [w for w in words if w.isalpha() and max(w) < "\u0250" and "\u0130" not in w]
        rest = list(words.difference(letters))
        groups = [letters[i : i + 256] for i in range(0, len(letters), 256)]
        for group, e in zip(groups, self.tokenizer.encode_batch_fast([" ".join(g) for g in groups], add_special_tokens=False), strict=True):
            ids = np.array(e.ids, "<u4")
            cut = np.flatnonzero(self.ends[ids]) + 1
            if len(cut) == len(group) and cut[-1] == len(ids):
                raw, at = ids.tobytes(), 0
                for w, end in zip(group, (4 * cut).tolist(), strict=True):
                    self.known[w] = raw[at:end]
                    at = end
            else:
                rest += group
        self.known.update(zip(rest, self._encode(rest), strict=True))

    def _flat(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For distinct words: all their ids in one array, and each one's start and length there."""
        strings = words.to_pylist()
        if new := set(strings).difference(self.known):
            self._learn(new)
        found = list(map(self.known.__getitem__, strings))
        size = np.fromiter(map(len, found), np.int64, len(found)) // 4
        return np.frombuffer(b"".join(found), "<u4"), np.cumsum(size) - size, size

    def __call__(self, texts: pa.Array) -> list[bytes]:
        """Little-endian ids of each text."""
        lists = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        coded = lists.flatten().dictionary_encode()
        word, which = coded.dictionary, np.asarray(coded.indices)
        core, ending = pc.utf8_rtrim(word, _ENDING), pc.struct_field(pc.extract_regex(word, "(?P<e>[" + _ENDING + "]*)$"), "e")
        is_plain = pc.invert(pc.match_substring_regex(word, _OTHER))
        apart = pc.and_(is_plain, pc.match_substring_regex(core, r"[\p{L}\p{N}]$"))
        core, ending = pc.if_else(apart, core, word), pc.if_else(apart, ending, "")
        core = pc.if_else(is_plain, pc.utf8_lower(core), core)
        if len(self.known) > MEMO:
            self.known = {"": b""}
        core, ending = core.dictionary_encode(), ending.dictionary_encode()
        ids, start, size = self._flat(core.dictionary)
        end_ids, end_start, end_size = self._flat(ending.dictionary)
        of_core, of_end = np.asarray(core.indices)[which], np.asarray(ending.indices)[which]
        starts, sizes = np.empty(2 * len(which), np.int64), np.empty(2 * len(which), np.int64)
        starts[::2], sizes[::2] = start[of_core], size[of_core]
        starts[1::2], sizes[1::2] = end_start[of_end] + len(ids), end_size[of_end]
        ends = np.cumsum(sizes)
        raw = np.concatenate([ids, end_ids])[np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)].tobytes()
        cut = 4 * np.r_[0, ends][2 * np.asarray(lists.offsets)]
        return [raw[x:y] for x, y in zip(cut.tolist(), cut[1:].tolist(), strict=False)]


@lru_cache(maxsize=2)
def word_ids(path: str) -> WordIds:
    """One tokenizer for each process."""
    return WordIds(path)


def pack(docs: DataFrame, tokenizer: str, capacity: int = 2048, closing: int = 1, group: int = 1024, piece: int = 512, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each piece of a document.

    Columns: key, start (ids of the document before the piece), length, ids (the
    piece's ids as little-endian unsigned 32-bit binary), doc_tokens, sequence_id
    and offset within the sequence.
    """
    kind = docs.schema[key].dataType
    schema = f"{key} {kind.simpleString()}, start bigint, length bigint, ids binary, doc_tokens bigint, sequence_id bigint, offset bigint"
    end = np.array([closing], "<u4").tobytes()
    names = [key, "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]

    def run(batches):
        own, number = word_ids(tokenizer), TaskContext.get().partitionId() << 40
        rest: list[tuple] = []
        held = 0

        def table(rows: list[tuple], like: pa.DataType) -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(columns[0], like), *(pa.array(c, pa.binary() if i == 3 else pa.int64()) for i, c in enumerate(columns) if i)], names=names)

        def flush() -> list[tuple]:
            nonlocal number, rest, held
            rows = []
            for items in windows([len(r[2]) // 4 for r in rest], capacity):
                at = 0
                for i in sorted(items):
                    k, start, ids, total = rest[i]
                    rows.append((k, start, len(ids) // 4, ids, total, number, at))
                    at += len(ids) // 4
                number += 1
            rest, held = [], 0
            return rows

        like = None
        for batch in batches:
            like, texts = batch.column(0).type, plain(batch.column(1))
            keys = batch.column(0).to_pylist()
            for a, b in slices(texts, 3 * SLICE_CHARS):
                rows = []
                for k, ids in zip(keys[a:b], own(texts.slice(a, b - a)), strict=True):
                    ids += end
                    total = len(ids) // 4
                    whole = total // capacity * capacity
                    for s in range(0, whole, capacity):
                        rows.append((k, s, capacity, ids[4 * s : 4 * (s + capacity)], total, number, 0))
                        number += 1
                    if left := total - whole:
                        cuts = np.linspace(whole, total, -(-left // piece) + 1).astype(int).tolist()
                        rest += [(k, s, ids[4 * s : 4 * e], total) for s, e in zip(cuts, cuts[1:], strict=False)]
                        held += 1
                        if held == group:
                            rows += flush()
                if rows:
                    yield table(rows, like)
            tidy()
        if rest and (rows := flush()):
            yield table(rows, like)

    return docs.select(F.col(key), F.col(text)).mapInArrow(run, schema)
