import html as entities
import random
import re

from tessera.llm import html
from tessera.llm.queries import op8_html


def brute(page):
    """The article element's text of the test tables' pages."""
    inner = page[page.index("<article>") : page.index("</article>")]
    inner = re.sub(r"<(?:/?(?:p|h1|h2|li|ul|article)|br)[^>]*>", " ", inner)
    return " ".join(entities.unescape(re.sub(r"<[^>]+>", "", inner)).split())


def test_query(spark):
    sf = "/root/testdata/sf0.01"
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    got = op8_html(spark, sf).collect()
    assert len(got) == len(pages)
    for r in got:
        assert r.text == brute(pages[r.page_id])
        assert r.n_chars == len(r.text)


def extracted(spark, rows):
    df = spark.createDataFrame([(i, u, h, "x") for i, (u, h) in enumerate(rows)], "page_id int, url string, html string, TEXT string")
    out = html.extract(df)
    assert [c.lower() for c in out.columns].count("text") == 1
    return [r.text for r in out.orderBy("page_id").collect()]


LONG = "Words of the article number {} that go on for a good while, so that it is the largest."


def test_article_without_its_surroundings(spark):
    page = """<html><head><title>T</title><style>p{{}}</style></head><body class="has-sidebar"><header><h1>Site</h1></header><nav><a href="/">Home</a></nav>
<div class="cookie-notice">We use cookies</div><article class="post"><header><h1>Head &amp; tail {0}</h1></header><p>One&nbsp;<b>bo</b>ld
 text<br>and &lt;more&gt;.<div class="ad">Buy</div><p>Two<form><input><p>Name</p></form><script>var a = "<p>no</p>";</script><ul><li>a<li>b</ul>
<aside>Side</aside><section class="comments"><article><p>First!</p></article></section></article><footer>&copy; site</footer></body></html>"""
    want = "Head & tail {} One bold text and <more>. Two a b"
    assert extracted(spark, [(f"http://h.org/{i}", page.format(i)) for i in range(4)]) == [want.format(i) for i in range(4)]


def test_template_of_pages_without_an_article_element(spark):
    page = '<body><div id="top"><span>Fine site</span></div><div class="m"><p>{0}</p><p>Same line on all pages.</p><div class="tool">Print this</div></div><div class="foot"><p>All rights of this fine site and of all that is in it, for ever and ever.</p></div></body>'
    got = extracted(spark, [("http://a.org/1", page.format(LONG.format(i))) for i in range(6)])
    assert got == [f"{LONG.format(i)} Same line on all pages." for i in range(6)]


def test_template_text_in_an_article_goes_only_outside_content_elements(spark):
    page = '<article><h1>{0}</h1><div class="byline">Share it</div><p>A line that is on all pages.</p><p>{0} body</p></article>'
    got = extracted(spark, [("http://a.org/1", page.format(f"T{i}")) for i in range(5)])
    assert got == [f"T{i} A line that is on all pages. T{i} body" for i in range(5)]


def test_a_region_is_taken_with_all_that_is_nested_in_it(spark):
    page = '<body><div id="top"><span>Fine site</span></div><div class="post"><p>{0}</p><ul><li>Item {0}</li></ul><table><tr><td>Cell {0}</td></tr></table><div><p>Inner {0}</p></div></div></body>'
    assert extracted(spark, [(f"http://a.org/{i}", page.format(i)) for i in range(4)]) == [f"{i} Item {i} Cell {i} Inner {i}" for i in range(4)]
    split = '<body><div id="all"><div class="one"><p>First {0}</p></div><div class="two"><p>Second {0}, longer</p></div></div></body>'
    assert extracted(spark, [(f"http://a.org/{i}", split.format(i)) for i in range(4)]) == [f"First {i} Second {i}, longer" for i in range(4)]
    assert extracted(spark, [("http://a.org/", split.format(1))]) == ["First 1 Second 1, longer"]


def test_occurrence_vectors_make_classes(spark):
    pages = spark.createDataFrame([("http://a/" + str(i), f"<body><i>x</i><p>t{i}</p>{'<table></table>' if i < 2 else ''}</body>") for i in range(4)] + [("http://b/", "<p>one</p>")], "url string, html string")
    made = {r.host: r for r in html.templates(pages).collect()}
    assert set(made) == {"a"}  # one page alone has no template
    _, tags = html.parse("<body><i>x</i><p>t</p></body>")
    assert set(tags) <= set(made["a"].template)


def test_only_ordered_and_nested_classes_are_the_template(spark):
    box = '<div class="a">Alpha</div>', '<div class="b">Beta</div>'
    pages = [(f"http://a/{i}", f"<body><div class='t'>Top</div>{''.join(box[:: -1 if i % 2 else 1])}<p>t{i}</p></body>") for i in range(4)]
    made = html.templates(spark.createDataFrame(pages, "url string, html string"))
    assert made.count() == 0  # all are one class, whose tokens come in two turns
    assert [r[1] != 0 for r in html.checked([1, 5, 2, 3, 5, 4, 9], {1: 7, 2: 7, 3: 7, 4: 7, 5: 8, 9: 8})] == [True, False]  # runs that cross
    told = {c: (turn != 0, place) for c, turn, place in html.checked([1, 5, 6, 5, 6, 2], {1: 7, 2: 7, 5: 8, 6: 8})}
    assert told == {7: (True, 1), 8: (True, html._hash(7, 1))}


def made_page(r, i):
    """A page without an article element, with its slots' text: fixed parts around slots of one to five blocks, and rows that some pages lack."""
    slots = [[f"Slot {i} {k} {j} {r.randrange(10**6)}" for j in range(r.randint(1, 5))] for k in range(2)]
    rows = "".join(f"<div class='row{k}'><i>Note {k}</i></div>" for k in "abc" if r.random() < 0.8)
    page = "<div id='top'><span>Site</span><ul><li>Home</li><li>About it</li></ul></div><div id='main'><div class='one'>{}</div><div class='rule'>Go on</div><div class='two'>{}</div></div><div id='low'>{}<em>The end of it</em></div>"
    return "<body>" + page.format(*("".join(f"<p>{t}</p>" for t in s) for s in slots), rows) + "</body>", " ".join(t for s in slots for t in s)


def brute_template(pages):
    """Tokens of the classes of two or more that half of the pages hold: exact vectors, each class's tokens in one turn."""
    found = [html.tokens(*html.parse(p)) for p in pages]
    by_vector = {}
    for t in {t for own in found for t in own}:
        by_vector.setdefault(tuple(own.count(t) for own in found), set()).add(t)
    out = set()
    for vector, own in by_vector.items():
        held = sum(n > 0 for n in vector)
        if len(own) > 1 and held > 1 and 2 * held >= len(found):
            turns = {tuple(t for t in page if t in own) for page in found} - {()}
            first = min(turns, key=len)[: len(own)]
            if all(t == first * (len(t) // len(first)) for t in turns):
                out |= own
    return out


def test_template_and_slots_against_exact_vectors(spark):
    """Without its template, a page's text would hold the fixed parts, too."""
    r = random.Random(12)
    made = [made_page(r, i) for i in range(20)]
    pages = [("http://a.org/" + str(i), p) for i, (p, _) in enumerate(made)]
    template = {t for row in html.templates(spark.createDataFrame(pages, "url string, html string")).collect() for t in row.template}
    assert template == brute_template([p for p, _ in made])
    got = extracted(spark, pages)
    assert got == [want for _, want in made]
    bare = [html.article(html.parse(p)[0], frozenset()) for p, _ in made]
    assert all("About it" in b and b != g for b, g in zip(bare, got, strict=True))


def test_columns_of_any_name_are_kept(spark):
    df = spark.createDataFrame([("http://a/1", "<p>x</p>", 1, 2, 3)], "`the url` string, `a``b` string, _host int, _template int, text int")
    out = html.extract(df, url="the url", html="a`b")
    assert [tuple(r) for r in out.select("_host", "_template", "text").collect()] == [(1, 2, "x")]


def test_copies_keep_their_text(spark):
    page = '<nav><a>Menu {0}</a></nav><article class="post"><div>Whole text</div></article>'
    assert extracted(spark, [("http://a.org/1", page.format(0))] * 2) == ["Whole text"] * 2
    assert extracted(spark, [(f"http://a.org/{i}", page.format(i)) for i in range(4)]) == ["Whole text"] * 4
    near = '<article class="post"><p class="x">Same on all.</p><p class="x">Only {0}</p></article>'
    assert extracted(spark, [(f"http://a.org/{i}", near.format(i)) for i in range(4)]) == [f"Same on all. Only {i}" for i in range(4)]
    tail = '<article><h1 class="t">{0}</h1><div class="body">{1}</div></article>'
    rows = [(f"http://a.org/{i}", tail.format(i, "Shared" if i < 3 else f"Own {i}")) for i in range(4)]
    assert extracted(spark, rows) == ["0 Shared", "1 Shared", "2 Shared", "3 Own 3"]


def test_edge_cases(spark):
    deep = "<div>" * 20_000 + "deep" + "</b>" * 1000
    rows = [
        (None, None), ("http://a", ""), ("no url", "plain text  only"), ("http://a", "<p>a<p>b"), ("http://c", deep), ("http://d", "<" * 5000), ("http://e", '<a href="' * 3000), ("http://f", "x < y <b>z"),
        ("http://g", "<!-- <p>no</p> --><p>yes</p><!-- open"), ("http://h", "<script>never closed <p>x"), ("http://i", "<article>" + "w " * 200_000 + "</article>"), ("http://j", "<article>&#x41;&eacute;&bogus;</article>"),
    ]
    got = extracted(spark, rows)
    assert got[:5] == ["", "", "plain text only", "a b", "deep"]
    assert got[7] == "x < yz" or got[7] == "x < y z"
    assert got[8] == "yes"
    assert got[9] == ""
    assert len(got[10]) == 399_999
    assert got[11] == "Aé&bogus;"
    assert extracted(spark, rows[:2] * 2) == [""] * 4
    df = spark.createDataFrame([], "page_id int, url string, html string")
    assert html.extract(df).count() == 0


def test_templates_beyond_the_bound_are_joined_by_a_shuffle(spark, monkeypatch):
    monkeypatch.setattr(html, "BROADCAST", -1)
    page = "<article><h1>{0}</h1><p>body</p></article>"
    assert extracted(spark, [(f"http://h{i % 2}.org/", page.format(i)) for i in range(6)]) == [f"{i} body" for i in range(6)]
