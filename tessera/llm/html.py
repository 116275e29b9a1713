"""HTML extraction by equivalence-class template deduction.

Pages of a host are made from one template.  A token is a tag at its path (tag
names and class or id from the root), or a block's text at its path.  Tokens
with the same occurrence vector over the host's pages form an equivalence
class; a vector is told by a fingerprint that adds up over pages, so classes
come from one aggregation and no page is gathered by host.  Classes of several
tokens on at least ``support`` of the host's pages are then checked on all
pages: a class is valid if its tokens come in the same turn each time (ordered)
and its runs lie in the same gap of the same other class, cut by none (nested).
Valid classes are the host's template, and what lies in their gaps fills slots.

A page's article is what lies in its article (or main) element, else in its
region, the lowest container of all its text that is neither links nor the
template's, with all that is nested there: without menus, headers, footers,
sidebars, notices, adverts, forms, scripts and comments (told by element,
class, id or role), and without template text outside plain content elements,
if its container holds no slot's text.  A host's pages count by distinct text of
their articles, so copies aren't taken for a template.

Defined results: null and empty html gives an empty text; a null URL belongs to
the host ''; repeated rows give the same text; unclosed, stray and deeply nested
tags are read in linear time; very long pages are read whole; an empty table
gives no rows.  Output columns replace input columns of the same name.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from dataclasses import dataclass
from hashlib import blake2b
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, named, plain, replace_column, slices
from .urls import host_of

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>", re.DOTALL)
#: For the rest of a page after a tag whose quotes don't match, so that none is read to the page's end twice.
_SIMPLE = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>", re.DOTALL)
_NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)", re.IGNORECASE)
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|/|$)|display\s*:\s*none", re.IGNORECASE)

_TELLING = re.compile(r"class|id|role|hidden|style", re.IGNORECASE)

INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
#: Elements that are never part of an article.
OUTSIDE = frozenset("head nav aside footer form button select option template object svg canvas audio video dialog menu dialog fieldset".split()) | RAW
#: Words of a class, id or role that tell what isn't the article.
BOILERPLATE = frozenset(
    "ad ads adbox advert adverts advertisement advertising adsense banner promo sponsor sponsored nav navbar navigation menu breadcrumb breadcrumbs sidebar aside footer masthead contentinfo complementary "
    "cookie cookies consent notice notices gdpr popup modal overlay comment comments disqus respond replies share sharing social related recommended newsletter subscribe signup login search pagination pager toolbar".split()
)
#: Elements whose text is an article's own, even if it recurs on other pages.
CONTENT = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd td th blockquote pre figcaption caption article main section".split())
#: Elements that end an open element of their group.
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}


def _hash(*parts: object) -> int:
    return int.from_bytes(blake2b("\x1f".join(map(str, parts)).encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


@dataclass(slots=True)
class Open:
    """An open element."""

    tag: str
    path: int
    plain: bool  # without class, id or role
    out: bool
    article: int  # 2 in an article, 1 in a main element
    container: int  # path of the nearest element that isn't a content element
    link: bool
    children: dict  # elements made before, by tag and attributes
    up: Open | None


#: What stands above all elements; equal paths on all pages of a process share their elements.
_roots: list[Open] = []
#: Elements that a process remembers, and how many it does.
ELEMENTS = 20_000
_made = [0]


def _root() -> Open:
    if not _roots or _made[0] > ELEMENTS:
        _made[0] = 0
        _roots[:] = [Open("", 0, True, False, 0, 0, False, {}, None)]
    return _roots[0]


def _element(up: Open, tag: str, attributes: str) -> Open:
    _made[0] += 1
    names = " ".join(x.strip("\"'") for x in _NAMES.findall(attributes)).lower() if attributes else ""
    words = set(re.split(r"[^a-z0-9]+", names)) if names else ()
    inside = up.article or (2 if tag == "article" else 1 if tag == "main" or "main" in words and "role" in attributes.lower() else 0)
    out = up.out or tag in OUTSIDE or (tag == "header" or "header" in words) and not up.article
    if tag not in ("html", "body", "article", "main") and words:
        out = out or not BOILERPLATE.isdisjoint(words)
    elif words and tag == "article":
        out = out or not {"comment", "comments", "reply", "related", "ad"}.isdisjoint(words)
    out = out or bool(attributes) and bool(_HIDDEN.search(attributes))
    path = _hash(up.path, tag, re.sub(r"\d+", "0", names))
    container = path if tag not in CONTENT and tag not in INLINE else up.container
    return Open(tag, path, not names, out, inside if tag != "article" else 2, container, up.link or tag == "a", {}, up)


@dataclass(slots=True)
class Block:
    """A run of text between block elements."""

    text: str
    element: Open
    links: int
    at: int  # tags before its end


def parse(html: str) -> tuple[list[Block], list[int]]:
    """Blocks and the paths of tags, both in page order."""
    stack, open_tags = [_root()], defaultdict(int)
    tags: list[int] = []
    blocks: list[Block] = []
    pieces: list[str] = []
    links = 0
    low = None

    def close() -> None:
        nonlocal pieces, links
        if pieces:
            text = " ".join("".join(pieces).split())
            if text:
                at = len(stack) - 1
                while at and stack[at].tag in INLINE:
                    at -= 1
                blocks.append(Block(text, stack[at], links, len(tags)))
            pieces, links = [], 0

    def text(s: str) -> None:
        nonlocal links
        if s:
            s = unescape(s) if "&" in s else s
            pieces.append(s)
            if stack[-1].link:
                links += len(s)

    def pop(tag: str) -> None:
        while stack[-1].tag != tag:
            open_tags[stack.pop().tag] -= 1
        open_tags[stack.pop().tag] -= 1

    at, n, tag_at = 0, len(html), _TAG
    while at < n:
        lt = html.find("<", at)
        if lt < 0:
            text(html[at:])
            break
        m = tag_at.match(html, lt)
        if not m and tag_at is _TAG:
            tag_at = _SIMPLE
            m = tag_at.match(html, lt)
        if not m and html.find(">", lt) < 0:
            text(html[at:])
            break
        if not m:
            text(html[at : lt + 1])
            at = lt + 1
            continue
        text(html[at:lt])
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if tag == "br":
            pieces.append(" ")
            continue
        if tag not in INLINE and tag not in ("img", "wbr"):
            close()
        if m[1]:
            if open_tags[tag] > 0:
                pop(tag)
            continue
        if tag in VOID:
            continue
        if tag in RAW:
            if low is None:
                low = html.lower() if html.isascii() else re.sub(r"[A-Z]+", lambda x: x[0].lower(), html)
            end = low.find("</" + tag, at)
            gt = html.find(">", end) if end >= 0 else -1
            up = stack[-1]
            element = up.children.get((tag, "")) or up.children.setdefault((tag, ""), _element(up, tag, ""))
            tags.append(element.path)
            at = gt + 1 if gt >= 0 else n
            continue
        if tag not in INLINE:
            if open_tags["p"] > 0:
                pop("p")
            for other in CLOSES.get(tag, ()):
                near = next((e.tag for e in reversed(stack[-8:]) if e.tag in (*CLOSES[tag], "ul", "ol", "dl", "table")), "")
                if near == other:
                    pop(other)
        attributes = m[3]
        if attributes and not _TELLING.search(attributes):
            attributes = ""
        up = stack[-1]
        element = up.children.get((tag, attributes))
        if element is None:
            element = _element(up, tag, attributes)
            up.children[tag, attributes] = element
        tags.append(element.path)
        stack.append(element)
        open_tags[tag] += 1
    close()
    return blocks, tags


def tokens(blocks: list[Block], tags: list[int]) -> list[int]:
    """A page's tokens in page order."""
    out: list[int] = []
    at = 0
    for b in blocks:
        out += tags[at : b.at]
        out.append(_hash(b.element.path, "text", b.text))
        at = b.at
    return out + tags[at:]


def checked(page: list[int], classes: dict[int, int]) -> list[tuple[int, int, int]]:
    """Rows class, order, place for a page; classes: each token's class.

    A class is ordered if its tokens come in the same turn each time, and nested
    if none of its runs is cut by the end of a run of another; order is 0 if not.
    Place tells the run and the gap in it that a class lies in; 0 if it varies.
    """
    seen = [(t, classes[t]) for t in page if t in classes]
    turn: dict[int, dict[int, int]] = defaultdict(dict)
    for t, c in seen:
        turn[c].setdefault(t, len(turn[c]))
    bad: set[int] = set()
    place: dict[int, int] = {}
    stack: list[list[int]] = []  # class and tokens seen of open runs
    for t, c in seen:
        if c in bad:
            continue
        k = turn[c][t]
        while stack and stack[-1][0] in bad:
            stack.pop()
        if k == 0 and not (stack and stack[-1][0] == c):
            if any(o[0] == c for o in stack):
                bad.add(c)
                continue
            at = _hash(*stack[-1]) if stack else 1
            place[c] = at if place.get(c, at) == at else 0
            stack.append([c, 1])
        elif stack and stack[-1] == [c, k]:
            stack[-1][1] = k + 1
        else:
            # Out of turn, or across another's run: of two that cross the one with fewer tokens isn't nested.
            i = next((i for i in range(len(stack) - 1, -1, -1) if stack[i] == [c, k]), -1)
            over = {o[0] for o in stack[i + 1 :] if o[0] not in bad} if i >= 0 else set()
            if i < 0 or any((len(turn[o]), o) > (len(turn[c]), c) for o in over):
                bad.add(c)
                continue
            bad |= over
            del stack[i + 1 :]
            stack[-1][1] = k + 1
        if stack[-1][1] == len(turn[c]):
            stack.pop()
    bad.update(o[0] for o in stack)
    return [(c, 0 if c in bad else _hash(*own), place.get(c, 0)) for c, own in turn.items()]


def _common(elements: list[Open]) -> Open:
    """The lowest element that all of these lie in."""
    rank: dict[int, int] = {}
    chain: list[Open] = []
    e = elements[0]
    while e is not None:
        rank[id(e)] = len(chain)
        chain.append(e)
        e = e.up
    low, seen = 0, set()
    for e in elements:
        while id(e) not in rank and id(e) not in seen:
            seen.add(id(e))
            e = e.up
        low = max(low, rank.get(id(e), 0))
    return chain[low]


def _within(e: Open, top: Open, known: dict[int, bool]) -> bool:
    """Whether an element is ``top`` or lies in it; known: what was found before."""
    walked = []
    while e is not None and e is not top and id(e) not in known:
        walked.append(id(e))
        e = e.up
    inside = e is top or e is not None and known[id(e)]
    known.update(dict.fromkeys(walked, inside))
    return inside


def inside(blocks: list[Block]) -> list[Block]:
    """The blocks of the article (or main) element, or all of a page without one, that aren't told to be outside."""
    own = [b for b in blocks if not b.element.out]
    level = max((b.element.article for b in own), default=0)
    return [b for b in own if b.element.article == level]


def article(blocks: list[Block], template: frozenset[int]) -> str:
    """The text of a page's article."""
    own = inside(blocks)
    if own and not own[0].element.article:
        # The region: the lowest container of all text that is neither links nor the template's.
        slots = [b.element for b in own if b.links < len(b.text) and _hash(b.element.path, "text", b.text) not in template]
        if slots:
            top = _common(slots)
            while top.up is not None and top.path != top.container:
                top = top.up
            known: dict[int, bool] = {}
            own = [b for b in own if _within(b.element, top, known)]
    # Template text goes only if its container has no slot; a page without slots stays whole.
    filled = {b.element.container for b in own if _hash(b.element.path, "text", b.text) not in template}
    return " ".join(b.text for b in own if not filled or b.element.container in filled or b.element.plain and b.element.tag in CONTENT)


def templates(pages: DataFrame, support: float = 0.5, url: str = "url", html: str = "html") -> DataFrame:
    """Rows host and template (tokens of its valid classes), for hosts with more than one page."""

    def occurrences(batches):
        for batch in batches:
            hosts, texts = plain(batch.column("host")), plain(batch.column("html"))
            for a, b in slices(texts):
                parsed = [parse(h) for h in texts.slice(a, b - a).to_pylist()]
                found = [tokens(*p) for p in parsed]
                names = [_hash(*(x.text for x in inside(p[0]))) for p in parsed]
                yield pa.RecordBatch.from_arrays([hosts.slice(a, b - a).cast(pa.string()), pa.array(names, pa.int64()), pa.array(found, pa.list_(pa.int64()))], names=["host", "page", "tokens"])

    seen = pages.select(F.coalesce(host_of(named(url)), F.lit("")).alias("host"), named(html).alias("html"))
    # Pages of a host with the same own text are one page, else an article with many copies would be its host's template.
    each = seen.mapInArrow(occurrences, "host string, page bigint, tokens array<bigint>").groupBy("host", "page").agg(F.min("tokens").alias("tokens")).checkpoint()
    total = each.groupBy("host").agg(F.count("*").alias("of"))

    def counts(batches):
        for batch in batches:
            rows = [(h, t, n, p) for h, p, own in zip(*(batch.column(c).to_pylist() for c in ("host", "page", "tokens")), strict=True) for t, n in Counter(own).items()]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows, strict=True), (pa.string(), *[pa.int64()] * 3), strict=True)], names=["host", "token", "n", "page"])

    by_token = each.mapInArrow(counts, "host string, token bigint, n bigint, page bigint").groupBy("host", "token").agg(F.count("*").alias("pages"), F.bit_xor(F.xxhash64("page", "n")).alias("vector"))
    # A token on one page of many has no say; what is left of a host is bounded by its pages' mean size over support.
    frequent = by_token.where("pages > 1").join(total, "host").where(F.col("pages") >= F.lit(support) * F.col("of"))
    classes = frequent.groupBy("host", "vector", "pages").agg(F.array_sort(F.collect_list("token")).alias("own"))
    # A token alone, often an article's own text that recurs, says nothing of the template.
    classes = classes.where("size(own) > 1").select("host", F.xxhash64("vector", "pages").alias("class"), "own").checkpoint()
    def check(batches):
        for batch in batches:
            known: dict[str, dict[int, int]] = {}
            rows = []
            hosts = batch.column("host").to_pylist()
            for i, (h, own) in enumerate(zip(hosts, batch.column("tokens").to_pylist(), strict=True)):
                if h not in known:
                    known[h] = {x["token"]: x["class"] for x in batch.column("known")[i].as_py()}
                rows += [(h, *r) for r in checked(own, known[h])]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows, strict=True), (pa.string(), *[pa.int64()] * 3), strict=True)], names=["host", "class", "turn", "place"])

    # Those out of turn go first, then those that aren't nested, as a class may lie in one that goes.
    while True:
        of_host = classes.groupBy("host").agg(F.flatten(F.collect_list(F.transform("own", lambda t: F.struct(t.alias("token"), F.col("class").alias("class"))))).alias("known"))
        size = classes.agg(F.sum(F.size("own") * 16 + 64)).first()[0] or 0
        told = each.join(F.broadcast(of_host) if size <= BROADCAST else of_host, "host").mapInArrow(check, "host string, class bigint, turn bigint, place bigint")
        told = told.groupBy("host", "class").agg(F.min("turn").alias("a"), F.max("turn").alias("b"), F.min("place").alias("c"), F.max("place").alias("d"))
        wrong = told.select("host", "class", F.expr("a <> b or a = 0").alias("unordered"), F.expr("c <> d or c = 0").alias("unnested")).where("unordered or unnested").checkpoint()
        found = wrong.agg(F.count("*"), F.count_if("unordered")).first()
        if not found[0]:
            return classes.groupBy("host").agg(F.array_sort(F.flatten(F.collect_list("own"))).alias("template"))
        classes = classes.join(wrong.where("unordered") if found[1] else wrong, ["host", "class"], "left_anti").checkpoint()


#: Bytes of templates up to which they go to all tasks; beyond it, pages and templates are joined by a shuffle.
BROADCAST = 16 << 20


def extract(pages: DataFrame, support: float = 0.5, url: str = "url", html: str = "html", output: str = "text") -> DataFrame:
    """Adds the article's text to each page."""
    made = templates(pages, support, url, html).checkpoint()
    size = made.agg(F.sum(F.size("template") * 8 + F.length("host") + 64)).first()[0] or 0
    own_host, own_template = fresh("_host", pages), fresh("_template", pages)
    made = made.withColumnsRenamed({"host": own_host, "template": own_template})
    left = replace_column(pages, own_host, F.coalesce(host_of(named(url)), F.lit("")))
    joined = left.join(F.broadcast(made) if size <= BROADCAST else made, own_host, "left")

    @F.arrow_udf("string")
    def text(h: pa.Array, host: pa.Array, template: pa.Array) -> pa.Array:
        known: dict[str, frozenset[int]] = {}
        out = []
        for i, (page, own) in enumerate(zip(plain(h).to_pylist(), host.to_pylist(), strict=True)):
            if own not in known:
                known[own] = frozenset(template[i].as_py() or ())
            out.append(article(parse(page)[0], known[own]))
        return pa.array(out, pa.string())

    return replace_column(joined, output, text(named(html), F.col(own_host), F.col(own_template))).drop(own_host, own_template)
