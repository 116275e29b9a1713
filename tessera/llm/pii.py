"""Personal data: candidate spans scored by gradient-boosted trees, beside fixed base patterns.

Base spans (email, ip, card, phone) come from fixed patterns, leftmost and
without overlap per kind, and always stay.  On top, high-recall generators
propose overlapping spans (every run of digit groups of a card's or phone's
size, four numbers of a dotted chain, spelled-out addresses).  Boosted trees
score each by its format and context, and those above a kind's threshold that
overlap no chosen span are added, best first.

The trees are trained here, on sentences that a seeded generator writes with
true spans and look-alikes in them; a part of these sentences is held out to
calibrate the scores (Platt) and to choose, for each kind, the lowest
threshold with the precision asked for.

Defined results: null and empty texts have no spans; repeated rows give the
same spans; very long texts are read whole, in time linear in their length;
an empty table gives no rows.  Offsets are code points, ends exclusive.
Output columns replace input columns of the same name.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import plain, replace_column, slices, tidy

KINDS = ("email", "ip", "card", "phone")
Span = tuple[int, int, int]  # start, kind's number, end

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")


def luhn(digits: str) -> bool:
    """Whether the check digit is right."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = 2 * d - 9 * (d > 4)
        total += d
    return total % 10 == 0


def octets(text: str) -> bool:
    """Whether all parts between dots are at most 255."""
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in text.split("."))


def emails(t: str) -> list[Span]:
    """Base emails; each @ is tried with the local part that may stand before it."""
    out, pos, at = [], 0, t.find("@")
    while at >= 0:
        start = at
        while start > pos and t[start - 1] in _LOCAL:
            start -= 1
        end = at + 1
        if start < at and (m := _DOMAIN.match(t, at + 1)):
            out.append((start, 0, m.end()))
            pos = end = m.end()
        else:
            pos = at + 1
        at = t.find("@", end)
    return out


def base_spans(t: str) -> list[Span]:
    """All base spans, by start and then kind."""
    out = emails(t) if "@" in t else []
    for m in _CARD.finditer(t):
        if m.end() - m.start() >= 14:
            d = _NOT_DIGIT.sub("", m[0])
            if 14 <= len(d) <= 19 and luhn(d):
                out.append((m.start(), 2, m.end()))
    if "." in t:
        out += [(m.start(), 1, m.end()) for m in _IP.finditer(t) if octets(m[0])]
    if "+" in t:
        out += [(m.start(), 3, m.end()) for m in _PHONE.finditer(t) if 10 <= len(_NOT_DIGIT.sub("", m[0])) <= 15]
    return sorted(out)


_RUNS = re.compile(r"\+?\(?[0-9]++(?:\)?[\x20.()-]{0,2}[0-9]++)*+")
_GROUP = re.compile(r"[0-9]+")
_SPELLED = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+\s?(?:@|\(at\)|\[at\]|\sat\s)\s?[A-Za-z0-9-]{1,63}(?:\s?(?:\.|\(dot\)|\[dot\]|\sdot\s)\s?[A-Za-z0-9-]{1,63})+", re.IGNORECASE)
_AT = re.compile(r"@|\(at\)|\[at\]|\sat\s", re.IGNORECASE)


def candidates(t: str) -> list[Span]:
    """Overlapping proposals.  Within a chain of digit groups a proposal starts and ends with a group."""
    out: list[Span] = []
    if _AT.search(t):
        out += [(m.start(), 0, m.end()) for m in _SPELLED.finditer(t)]
    for m in _RUNS.finditer(t):
        if m.end() - m.start() < 7:
            continue
        groups = [g.span() for g in _GROUP.finditer(t, m.start(), m.end())]
        for i, (a, _) in enumerate(groups):
            digits = 0
            for j in range(i, len(groups)):
                b, e = groups[j]
                digits += e - b
                if digits > 19:
                    break
                if digits >= 13:
                    out.append((a, 2, e))
                if 9 <= digits <= 15:
                    s = a
                    while s > m.start() and t[s - 1] in "+(":
                        s -= 1
                    out.append((s, 3, e))
                if j - i == 3 and t[a:e].count(".") == 3 and e - a <= 15:
                    out.append((a, 1, e))
    return out


_CUES = tuple(re.compile(p, re.IGNORECASE) for p in (r"mail|contact|write", r"\bip\b|host|server|addr", r"card|visa|credit|master|pay", r"tel|phone|call|mobil|fax|cell", r"token|password|key|sha|hash|order|version|serial|isbn|no\.|#"))


def features(t: str, span: Span) -> list[float]:
    """Format and context of one proposal."""
    start, kind, end = span
    s = t[start:end]
    digits = _NOT_DIGIT.sub("", s)
    before, after = t[start - 1 : start], t[end : end + 1]
    context = t[max(0, start - 40) : start]
    groups = _GROUP.findall(s)
    return [
        float(kind), float(len(digits)), float(len(s)), float(luhn(digits) if digits else 0), float(octets(s)) if kind == 1 else -1.0,
        float(s.startswith("+")), float("(" in s), float(s.count(" ")), float(s.count("-")), float(s.count(".")),
        float(len(groups)), float(len(groups[0])) if groups else 0.0, float(len(groups[-1])) if groups else 0.0, float(max(map(len, groups), default=0)),
        float(before.isalnum()), float(after.isalnum()), float(before in ("+", "-", ".", "(", '"', "=") and before != ""), float(after in ("-", '"', "@") and after != ""),
        float(bool(re.match(r"[ .-]?[0-9]", t[end : end + 2]))), float(bool(re.search(r"[0-9][ .-]?$", t[max(0, start - 2) : start]))),
        float(digits[:1] in ("3", "4", "5", "6")), float(len(set(digits))), float("@" in s), float(bool(re.search(r"[.\s)\]][A-Za-z]{2,}$", s))),
        float(s.count("(") == s.count(")")), float(len(set(map(len, groups))) <= 2),
        *(float(bool(c.search(context))) for c in _CUES),
    ]


class Boosted:
    """Depth-limited trees on binned features, for logistic loss."""

    def __init__(self, trees: int = 60, depth: int = 4, rate: float = 0.2, least: int = 8):
        self.trees, self.depth, self.rate, self.least, self.base, self.nodes = trees, depth, rate, least, 0.0, []

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        p = y.mean()
        self.base = math.log(p / (1 - p))
        total = np.full(len(y), self.base)
        cuts = [np.unique(x[:, f])[:-1] for f in range(x.shape[1])]
        cuts = [c if len(c) <= 32 else np.quantile(c, np.linspace(0, 1, 32)) for c in cuts]
        for _ in range(self.trees):
            q = 1 / (1 + np.exp(-total))
            g, h = y - q, q * (1 - q)
            tree: list[tuple] = []

            def grow(rows: np.ndarray, depth: int) -> int:
                at = len(tree)
                tree.append((-1, 0.0, 0, 0, float(self.rate * g[rows].sum() / (h[rows].sum() + 1))))
                if depth == self.depth or len(rows) < 2 * self.least:
                    return at
                gs, hs = g[rows].sum(), h[rows].sum()
                best = (1e-3, -1, 0.0)
                for f, c in enumerate(cuts):
                    if not len(c):
                        continue
                    place = np.searchsorted(c, x[rows, f])
                    n = np.cumsum(np.bincount(place, minlength=len(c) + 1))[:-1]
                    gl = np.cumsum(np.bincount(place, weights=g[rows], minlength=len(c) + 1))[:-1]
                    hl = np.cumsum(np.bincount(place, weights=h[rows], minlength=len(c) + 1))[:-1]
                    gain = gl**2 / (hl + 1) + (gs - gl) ** 2 / (hs - hl + 1) - gs**2 / (hs + 1)
                    gain[(n < self.least) | (len(rows) - n < self.least)] = -1
                    k = int(gain.argmax())
                    if gain[k] > best[0]:
                        best = (float(gain[k]), f, float(c[k]))
                if best[1] >= 0:
                    left = x[rows, best[1]] <= best[2]
                    a, b = grow(rows[left], depth + 1), grow(rows[~left], depth + 1)
                    tree[at] = (best[1], best[2], a, b, 0.0)
                return at

            grow(np.arange(len(y)), 0)
            self.nodes.append(tuple(np.array(c) for c in zip(*tree, strict=True)))
            total += self._tree(self.nodes[-1], x)
        return self

    def _tree(self, tree: tuple, x: np.ndarray) -> np.ndarray:
        f, cut, left, right, value = tree
        at = np.zeros(len(x), int)
        for _ in range(self.depth):
            inner = f[at] >= 0
            go = np.where(x[np.arange(len(x)), np.maximum(f[at], 0)] <= cut[at], left[at], right[at])
            at = np.where(inner, go, at)
        return value[at]

    def margin(self, x: np.ndarray) -> np.ndarray:
        """Log odds."""
        return self.base + sum((self._tree(t, x) for t in self.nodes), np.zeros(len(x)))


@dataclass(frozen=True)
class Model:
    """Trees, Platt's slope and intercept, and each kind's threshold."""

    trees: Boosted
    slope: float
    intercept: float
    thresholds: tuple[float, ...]

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.trees.margin(x) + self.intercept, -35, 35)))


def _card(r: random.Random) -> str:
    d = [r.choice("3456"), *(r.choice("0123456789") for _ in range(r.choice((14, 14, 14, 13))))]
    return next("".join(d) + c for c in "0123456789" if luhn("".join(d) + c))


def sentence(r: random.Random) -> tuple[str, set[Span]]:
    """A made-up line with true spans and look-alikes."""
    word = lambda: "".join(r.choice(("ba", "to", "ren", "li", "mo", "the", "an", "er")) for _ in range(r.randint(1, 4)))
    num = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    hexa = lambda n: "".join(r.choice("0123456789abcdef") for _ in range(n))
    text, spans = "", set()

    def put(s: str, kind: int = -1) -> None:
        nonlocal text
        text += " " if text else ""
        if kind >= 0:
            spans.add((len(text), kind, len(text) + len(s)))
        text += s

    for _ in range(r.randint(2, 5)):
        for _ in range(r.randint(0, 4)):
            put(word())
        k = r.randrange(16)
        sep = r.choice((" ", "-"))
        if k <= 2:
            c = _card(r)
            if len(c) == 16 and r.random() < 0.4:
                c = sep.join(c[i : i + 4] for i in range(0, 16, 4))
            if r.random() < 0.3:
                put(r.choice(("card", "visa", "pay by credit card")))
            put(c, 2)
        elif k <= 5:
            a, b, c = num(3), num(3), num(4)
            if r.random() < 0.3:
                put(r.choice(("tel", "phone", "call me at", "mobile:")))
            put(r.choice((f"+{r.randint(1, 99)} ({a}) {b}-{c}", f"+{r.randint(1, 99)} {a} {b} {c}", f"+{r.randint(1, 99)}-{a}-{b}-{c}", f"({a}) {b}-{c}", f"+{r.randint(1, 99)}.{a}.{b}.{c}")), 3)
        elif k == 6:
            put(".".join(str(r.randint(0, 255)) for _ in range(4)), 1)
        elif k == 7:
            put(f"{word()}{r.choice(('.', '_', ''))}{num(2)} {r.choice(('(at)', '[at]'))} {word()}{r.choice(('.', ' (dot) ', ' [dot] '))}{r.choice(('com', 'org', 'net', 'de'))}", 0)
        elif k == 8:
            put(f"{word()}.{num(2)}@{word()}.example.{r.choice(('com', 'org', 'net'))}", 0)
        elif k == 9:  # secrets
            put(r.choice((f'token = "{hexa(40)}"', f"password={hexa(18)}", f"sha {hexa(32)}")))
        elif k == 10:  # numbers of a card's length that aren't cards
            c = num(16)
            put(c if not luhn(c) else c[:-1] + str((int(c[-1]) + 1) % 10))
        elif k == 11:  # versions and numbers with dots
            put(r.choice((f"version {num(1)}.{num(2)}.{num(1)}.{num(3)}.{num(2)}", f"{r.randint(256, 999)}.{num(2)}.{num(3)}.{num(2)}", f"{num(3)}.{num(3)}.{num(3)}")))
        elif k == 12:
            put(f"{r.choice(('order', 'serial', 'no.', '#'))} {num(r.randint(8, 13))}")
        elif k == 13:  # dates and sums
            put(f"20{num(2)}-{num(2)}-{num(2)} {num(2)} {num(4)} {num(3)}")
        elif k == 14:
            put(f"{word()} at {word()} dot {word()}")
        else:
            put(" ".join(num(r.randint(1, 5)) for _ in range(r.randint(2, 6))))
    return text, spans


@lru_cache(maxsize=4)
def train(seed: int = 11, lines: int = 3000, precision: float = 0.995) -> Model:
    """Fits on four fifths of the lines; calibrates and sets thresholds on the rest."""
    r = random.Random(seed)
    x: list[list[float]] = []
    y: list[float] = []
    held: list[bool] = []
    for k in range(lines):
        text, spans = sentence(r)
        for c in candidates(text):
            x.append(features(text, c))
            y.append(float(c in spans))
            held.append(k % 5 == 0)
    xs, ys, hs = np.array(x), np.array(y), np.array(held)
    trees = Boosted().fit(xs[~hs], ys[~hs])
    m, t = trees.margin(xs[hs]), ys[hs]
    slope, intercept = 1.0, 0.0
    for _ in range(50):  # Newton's method
        p = 1 / (1 + np.exp(-np.clip(slope * m + intercept, -35, 35)))
        w = p * (1 - p) + 1e-9
        g = np.array([((p - t) * m).sum() + 1e-3 * (slope - 1), (p - t).sum()])
        hess = np.array([[(w * m * m).sum() + 1e-3, (w * m).sum()], [(w * m).sum(), w.sum() + 1e-3]])
        step = np.linalg.solve(hess, g)
        slope, intercept = slope - step[0], intercept - step[1]
    score = 1 / (1 + np.exp(-np.clip(slope * m + intercept, -35, 35)))
    limits = []
    for kind in range(4):
        own = xs[hs][:, 0] == kind
        s, true = score[own], t[own]
        order = np.argsort(-s)
        right = np.cumsum(true[order]) / np.arange(1, len(order) + 1)
        ok = np.flatnonzero(right >= precision)
        limits.append(max(0.5, float(s[order][ok[-1]])) if len(ok) else 1.1)
    return Model(trees, float(slope), float(intercept), tuple(limits))


class Cover:
    """Disjoint intervals in order; tells in logarithmic time whether a span meets one."""

    def __init__(self, spans: list[Span]):
        self.starts: list[int] = []
        self.ends: list[int] = []
        for a, _, b in spans:  # they rise by start
            if self.ends and a < self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], b)
            else:
                self.starts.append(a)
                self.ends.append(b)

    def meets(self, span: Span) -> bool:
        i = bisect_left(self.starts, span[2])
        return i > 0 and self.ends[i - 1] > span[0]

    def add(self, span: Span) -> None:
        """Takes a span that meets none."""
        i = bisect_left(self.starts, span[0])
        self.starts.insert(i, span[0])
        self.ends.insert(i, span[2])


def added_spans(model: Model, texts: list[str], base: list[list[Span]]) -> list[list[Span]]:
    """For each text the proposals that score above their kind's threshold, best first, overlapping no other."""
    covers = [Cover(b) for b in base]
    found = [(k, c) for k, t in enumerate(texts) for c in candidates(t) if not covers[k].meets(c)]
    out: list[list[Span]] = [[] for _ in texts]
    for at in range(0, len(found), 50_000):  # proposals of one text are scored alike wherever the cut falls
        part = found[at : at + 50_000]
        score = model.score(np.array([features(texts[k], c) for k, c in part]))
        limit = np.array(model.thresholds)[[c[1] for _, c in part]]
        for i in np.flatnonzero(score >= limit):
            out[part[i][0]].append((part[i][1], round(float(score[i]), 9)))
    for k, own in enumerate(out):
        chosen = []
        for c, _ in sorted(own, key=lambda x: (-x[1], x[0][0] - x[0][2], x[0])):
            if not covers[k].meets(c):
                covers[k].add(c)
                chosen.append(c)
        out[k] = chosen
    return out


_TYPE = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())]))


def _spans(model: Model, texts: list[str]) -> list[list[tuple[Span, bool]]]:
    base = [base_spans(t) for t in texts]
    more = added_spans(model, texts, base)
    return [sorted([(s, True) for s in b] + [(s, False) for s in m]) for b, m in zip(base, more, strict=True)]


def _each(model: Model, t: pa.Array) -> Iterator[tuple[str, list[tuple[Span, bool]]]]:
    """Each text with its spans, a slice at a time."""
    texts = plain(t)
    for a, b in slices(texts):
        own = texts.slice(a, b - a).to_pylist()
        yield from zip(own, _spans(model, own), strict=True)
    tidy()


def find(docs: DataFrame, text: str = "text", output: str = "pii", model: Model | None = None) -> DataFrame:
    """Adds array<struct<kind, start, end, base>> by start and then kind; base tells the fixed patterns' spans."""
    own = model or train()

    @F.arrow_udf("array<struct<kind:string,start:bigint,end:bigint,base:boolean>>")
    def pii(t: pa.Array) -> pa.Array:
        out = []
        for _, row in _each(own, t):
            out.append([{"kind": KINDS[k], "start": a, "end": b, "base": is_base} for (a, k, b), is_base in row])
        return pa.array(out, _TYPE)

    return replace_column(docs, output, pii(F.col(text)))


def redact(docs: DataFrame, text: str = "text", mark: str = "[{}]", model: Model | None = None) -> DataFrame:
    """Puts the kind's mark in place of each span; of overlapping spans one mark stands for their union.  A null text stays null."""
    own = model or train()

    @F.arrow_udf("string")
    def clean(t: pa.Array) -> pa.Array:
        out = []
        for s, row in _each(own, t):
            parts, at = [], 0
            for (a, k, b), _ in row:
                if a >= at:
                    parts += [s[at:a], mark.format(KINDS[k])]
                at = max(at, b)
            out.append("".join([*parts, s[at:]]) if row else s)
        return pc.if_else(pc.is_null(t), pa.scalar(None, pa.string()), pa.array(out, pa.string()))

    return replace_column(docs, text, clean(F.col(text)))


def joined(spans: list[Span]) -> str:
    """kind:start:end by start and then kind, with commas."""
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def digest(text: str) -> str:
    """Lowercase hex SHA-256."""
    return hashlib.sha256(text.encode()).hexdigest()
