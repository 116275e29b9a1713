"""Vectorised hashes of words, word shapes and word n-grams.

A text column is hashed as one buffer of bytes.  A prefix sum of a polynomial
modulo 2**64 gives the hash of any span by one subtraction and one product, so
no Python object is made for a word.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def _table(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = 1 << max(16, (n - 1).bit_length())
        steps = np.full(size, base, dtype=U)
        steps[0] = 1
        have = _powers[base] = np.cumprod(steps, dtype=U)
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor, shift, multiply)."""
    h = h ^ (h >> U(33))
    h *= U(0xFF51AFD7ED558CCD)
    h ^= h >> U(33)
    h *= U(0xC4CEB9FE1A85EC53)
    h ^= h >> U(33)
    return h


def buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a large_string array without nulls, and the offsets of its rows."""
    off = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8)[off[0] : off[-1]] if data is not None and off[-1] > off[0] else np.empty(0, np.uint8)
    return raw, off - off[0]


def spans(inside: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and rows of the maximal runs of ``inside`` that don't cross rows."""
    n = len(inside)
    if not n:
        z = np.empty(0, np.int64)
        return z, z, z
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = inside[:-1]
    cut = off[:-1][off[:-1] < n]
    before[cut] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = inside[1:]
    last = off[1:] - 1
    after[last[last >= 0]] = False
    ends = np.flatnonzero(inside & ~after) + 1
    rows = np.searchsorted(off, starts, side="right") - 1
    return starts, ends, rows


def span_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, keep: np.ndarray | None = None) -> np.ndarray:
    """Hashes of byte spans; bytes that ``keep`` leaves out don't count."""
    n = len(raw)
    if keep is None:
        place = None
        terms = (raw.astype(U) + U(1)) * _table(_BASE, n)
    else:
        place = np.cumsum(keep) - keep
        terms = np.where(keep, (raw.astype(U) + U(1)) * _table(_BASE, n + 1)[place], U(0))
    total = np.empty(n + 1, U)
    total[0] = 0
    np.cumsum(terms, out=total[1:])
    shift = _table(_INVERSE, n + 1)[starts if place is None else place[starts]]
    return mix((total[ends] - total[starts]) * shift)


#: Bytes of words: ASCII letters, digits and all that isn't ASCII.
_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 28, 29, 30, 31, 32]] = True
_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[65:91] = 65
_SHAPE[97:123] = 97
_SHAPE[128:] = 97
_SHAPE[48:58] = 48


def words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-cased words of all rows, and each word's row."""
    raw, off = buffer(pc.utf8_lower(texts))
    starts, ends, rows = spans(_WORD[raw], off)
    return span_hashes(raw, starts, ends), rows


def word_prefixes(texts: pa.Array, lengths: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-cased words and of their first so many bytes, with each one's row."""
    raw, off = buffer(pc.utf8_lower(texts))
    starts, ends, rows = spans(_WORD[raw], off)
    out, at = [span_hashes(raw, starts, ends)], [rows]
    for n in lengths:
        long = ends - starts > n
        out.append(mix(span_hashes(raw, starts[long], starts[long] + n) ^ U(0xA5A5 + n)))
        at.append(rows[long])
    return np.concatenate(out), np.concatenate(at)


def tokens_and_shapes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the lower-cased tokens between white space, of their shapes, and rows.

    A shape has one letter for each run of capitals, other letters or digits
    and keeps all other characters.
    """
    raw, off = buffer(texts)
    starts, ends, rows = spans(~_SPACE[raw], off)
    if not len(starts):
        z = np.empty(0, U)
        return z, z, rows
    small = np.where((raw >= 65) & (raw < 91), raw + np.uint8(32), raw)
    token = span_hashes(small, starts, ends)
    kind = _SHAPE[raw]
    keep = np.ones(len(raw), bool)
    keep[1:] = (kind[1:] != kind[:-1]) | (kind[1:] < 48)
    keep[starts] = True
    return token, span_hashes(kind, starts, ends, keep), rows


#: Odd factors that tell the places in an n-gram apart.
_PLACES = [U(0xD6E8FEB86659FD93), U(0xA0761D6478BD642F), U(0xE7037ED1A0B428DB), U(0x8EBC6AF09C88C6E3), U(0x589965CC75374CC3)]


def ngrams(hashes: np.ndarray, rows: np.ndarray, n: int, whole_short: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-grams (n up to 5) within each row, and their rows.

    With ``whole_short`` a row of 1 to n - 1 words has one n-gram of all of them.
    """
    m = len(hashes)
    out, at = np.empty(0, U), np.empty(0, np.int64)
    if m >= n:
        same = rows[: m - n + 1] == rows[n - 1 :]
        total = np.zeros(m - n + 1, U)
        for j in range(n):
            total += hashes[j : m - n + 1 + j] * _PLACES[j]
        out, at = mix(total)[same], rows[: m - n + 1][same]
    if whole_short and m:
        first = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
        size = np.diff(np.r_[first, m])
        few = size < n
        if few.any():
            extra = np.zeros(few.sum(), U)
            for j in range(n - 1):
                has = size[few] > j
                extra[has] += hashes[first[few][has] + j] * _PLACES[j]
            out, at = np.concatenate([out, mix(extra)]), np.concatenate([at, rows[first[few]]])
            order = np.argsort(at, kind="stable")
            out, at = out[order], at[order]
    return out, at
