from __future__ import annotations

import itertools
import random
import re
import time
from html.parser import HTMLParser

import xxhash

from corpuslens.llm import htmltext, queries

from .helpers import clash


def xx(t):
    return xxhash.xxh64_intdigest(t) >> 1


class Article(HTMLParser):
    """Blocks of article elements by the standard parser."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.depth, self.out, self.held = 0, [], []

    def flush(self):
        if t := " ".join("".join(self.held).split()):
            self.out.append(t)
        self.held = []

    def handle_starttag(self, tag, attrs):
        if tag == "article":
            self.depth += 1
        elif tag in ("p", "h1"):
            self.flush()
        elif tag == "br":
            self.held.append(" ")

    def handle_endtag(self, tag):
        if tag in ("p", "h1", "article"):
            self.flush()
        if tag == "article":
            self.depth -= 1

    def handle_data(self, data):
        if self.depth:
            self.held.append(data)


def test_whole_table(spark, sf_dir):
    got = {r["page_id"]: r for r in queries.op8_html_text(spark, sf_dir).collect()}
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").collect()
    assert len(got) == len(pages)
    for r in pages:
        p = Article()
        p.feed(r["html"])
        assert got[r["page_id"]]["text"] == "\n\n".join(p.out) and got[r["page_id"]]["n_chars"] == len("\n\n".join(p.out)) > 0


def test_lcs_equals_the_table():
    rng = random.Random(3)
    for _ in range(400):
        a, b = ([rng.randrange(5) for _ in range(rng.randrange(0, 14))] for _ in range(2))
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        got = [a[i] for i in sorted(htmltext.aligned(a, b))]
        it = iter(b)
        assert len(got) == t[-1][-1] and all(x in it for x in got)


def test_markup_that_isnt_well_formed():
    kept = {
        "<html><head><title>t</title><body><p>a</p>": ["a"], "<head><meta name=x><p>a": ["a"], "<body><p class=ad>buy<p>a</p><p>b": ["a", "b"], "<ul><li class=menu>m<li>a</ul>": ["a"], "<p class=ad>buy<div>a</div>": ["a"],
        '<article><div class="entry-header"><h1>T</h1></div><h2 class="section-header">S</h2><p>a</article>': ["T", "S", "a"], '<p>see <a href="x>this</a> a</p><p>b</p>': ["see this a", "b"], "<p>a</p><textarea>b<p>c": ["a", "b", "c"],
        "<p>a</p><script>b<p>c": ["a"], '<p>x <img alt="1 < 2"> y <img alt="2 > 1"> z</p>': ["x y z"], '<div class="header">no</div><h1 class="header">yes</h1>': ["yes"], "<table><tr><td class=ad>n<td>a<tr><td>b</table>": ["a", "b"],
    }
    assert {k: htmltext.blocks(k)[0] for k in kept} == kept


def test_what_a_page_keeps():
    t = ["top", "a" * 50, "b" * 60, "end"]
    none = [False] * 4
    assert htmltext.chosen(t, none, [1, 2, 3, 4], [[1, 9, 4], [2]]) == t[1:3]
    assert htmltext.chosen(t, none, [1, 2, 3, 4], [[1, 2, 3, 4], [4, 8]]) == t[:3]  # a mirror, then the other neighbour
    assert htmltext.chosen(t, none, [1, 2, 3, 4], [[2, 3], None]) == t
    assert htmltext.chosen(t, [True, False, False, False], [1, 2, 3, 4], [[4], None]) == t[:3]  # a teaser is not the page
    assert htmltext.chosen(t, [False, True, True, False], [1, 2, 3, 4], [[2, 4], None]) == t[1:3]
    assert htmltext.chosen(t, none, [1, 2, 3, 4], [[1, 2, 3, 7], None]) == t  # all but a short line


def test_nearest_of_a_whole_table(spark):
    """Neighbours by rank equal those of a sorted list, whatever the partitions and buckets, and differencing equals the plain loop."""
    rng = random.Random(5)
    rows, words = {}, [f"w{i}" for i in range(400)]
    for i in range(600):
        host, section = rng.choice(["a.org", "a.org", "b.org", "c.org"]), rng.randrange(6)
        own = "".join(f"<p>{' '.join(rng.sample(words, 9))}</p>" for _ in range(3))
        rows[i] = (f"http://{host}/s{section}/{rng.randrange(150)}?q={rng.randrange(2)}#x", f"<div>{host} home</div><p>section {section}</p>{own}<div>terms of {host}</div>")
    df = spark.createDataFrame([(k, *v) for k, v in rows.items()] + [(700, *rows[0]), (701, *rows[1])], "page_id long, url string, html string")
    rows |= {700: rows[0], 701: rows[1]}
    split = lambda u: (u.split("/")[2], "/" + u.split("/", 3)[3].split("#")[0])
    first = {}
    for k in sorted(rows):
        first.setdefault(split(rows[k][0]), k)
    order = sorted(first, key=lambda x: tuple(s.encode() for s in x))
    lines = {p: [xx(t) for t in htmltext.blocks(rows[k][1])[0]] for p, k in first.items()}
    slim = spark.createDataFrame([(*p, lines[p]) for p in order], "_host string, _loc string, _lines array<bigint>")
    near = {(r["_host"], r["_loc"]): (r["_loc0"], r["_loc1"]) for r in htmltext.neighbours(slim, per_bucket=7).collect()}
    want = {}
    for i, p in enumerate(order):
        side = [order[j] if 0 <= j < len(order) and order[j][0] == p[0] else None for j in (i - 1, i + 1)]
        assert near[p] == tuple(x and x[1] for x in side)
        common = [sum(1 for _ in itertools.takewhile(lambda z: z[0] == z[1], zip(p[1], x[1] if x else "", strict=False))) for x in side]
        want[p] = side if common[0] >= common[1] else side[::-1]
    got = {r["page_id"]: r["text"] for r in htmltext.extract(df).collect()}
    for k, (u, h) in rows.items():
        texts, inside = htmltext.blocks(h)
        assert got[k] == "\n\n".join(htmltext.chosen(texts, inside, [xx(t) for t in texts], [lines.get(x) for x in want[split(u)]]))
    assert sum("home" in t for t in got.values()) < 5 and got[700] == got[0]


PAGE = '<html><head><title>t</title></head><body><div id=top>Site name</div>{}<p>Imprint and terms</p></body></html>'


def test_differencing_and_markup(spark):
    chrome = '<nav>menu</nav><header>head</header><aside>side</aside><div class="cookie-notice">ok?</div><section id="comments"><p>first!</p></section><form>f</form><script>if (a<b) x()</script><style>p{}</style><div class="ad">buy</div><footer>foot</footer>'
    rows = [
        (1, "https://a.org/x/1", PAGE.format("<p>Own  text\n one</p><p>more &amp; more&nbsp;x</p>")), (2, "https://a.org/x/2", PAGE.format("<p>Own text two</p><p>Site name</p>")),
        (3, "https://b.org/", f"<body>{chrome}<article><header><h1>Title</h1></header><p>One<br>two <b>bold</b>text<p>Three</article>{chrome}"), (4, "https://c.org/q", PAGE.format("<p>alone</p>")),
        (5, None, None), (6, "no url", ""), (7, "https://d.org/1", "<main><p>mirrored</p></main>"), (8, "https://d.org/2", "<main><p>mirrored</p></main>"), (9, "https://e.org", "<p>cut &lt;tag&gt; 1 < 2 <a hre"),
        (10, "https://f.org", "<p>" + "long " * 100_000 + "</p>"), (10, "https://f.org", "<p>" + "long " * 100_000 + "</p>"), (11, "https://g.org", "<article></article>"), (14, "https://h.org", '<body class="menu"><div id="wrap" class="has-sidebar"><article class="post comments-open"><p>kept</p><aside>no</aside><article class="comment"><p>said</p></article></article></div>'),
        (12, None, "<p>x</p>"), (13, None, "<p>x</p>"),
    ]
    df = clash(spark.createDataFrame(rows, "page_id long, url string, html string"), "text", "_host", "_path", "_n")
    got = {r["page_id"]: r["text"] for r in htmltext.extract(df).collect()}
    assert got == {
        1: "Own text one\n\nmore & more x", 2: "Own text two\n\nSite name", 3: "Title\n\nOne two boldtext\n\nThree", 4: "Site name\n\nalone\n\nImprint and terms", 5: "", 6: "", 7: "mirrored", 8: "mirrored",
        9: "cut <tag> 1 < 2", 10: ("long " * 100_000).strip(), 11: "", 12: "x", 13: "x", 14: "kept",
    }
    assert htmltext.extract(df.limit(0)).count() == 0


def test_large_hosts_are_dealt_out(spark):
    rows = [(i, f"https://a.org/{i // 10}/{i}", PAGE.format(f"<p>own {i}</p>")) for i in range(300)]
    got = {r["page_id"]: r["text"] for r in htmltext.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: f"own {i}" for i in range(300)}
    assert re.match("own", got[0])


def text_of(html):
    return htmltext.blocks(html)[0]


def test_what_only_looks_like_chrome():
    body = "<p>One two three.</p><p>Four five six seven.</p>"
    assert text_of(f"<body><form id=aspnet action='/'><div>{body}<label>Go</label></div></form></body>")[:2] == ["One two three.", "Four five six seven."]
    assert text_of(f"<article>{body}</article><form><label>Mail</label><input></form>") == ["One two three.", "Four five six seven."]
    assert text_of(f"<nav><ul><li>Home<li>News</ul><article><h1>Title</h1>{body}</article>") == ["Title", "One two three.", "Four five six seven."]
    assert text_of(f"<nav><h1>Menu</h1></nav><aside>Side<h1>Title</h1>{body}") == ["Title", "One two three.", "Four five six seven."]
    for odd in ('<h2 id="search">X</h2>', '<h2 id="social-context">X</h2>', '<section id="related-work">X</section>', '<div class="notice-period">X</div>', '<div class="search-algorithms">X</div>'):
        assert text_of(f"<article>{odd}{body}</article>")[0] == "X", odd
        assert text_of(f"<div>{odd}{body}</div>")[0] == "X", odd
    assert text_of(f'<div class="post-header"><h1>Title</h1></div>{body}')[0] == "Title"
    assert text_of(f'<div class="site-header">X</div>{body}') == ["One two three.", "Four five six seven."]
    for chrome in ('<div class="ad">X</div>', '<div id="share-buttons">X</div>', '<section class="comments-area">X</section>', '<div class="cookie-notice">X</div>', '<ul class="related-posts"><li>X</ul>', '<div class="ad-300x250">X</div>'):
        assert text_of(f"<article>{body}{chrome}</article>") == text_of(f"{chrome}{body}") == ["One two three.", "Four five six seven."], chrome


ADVERSE = {
    "tags without an end": "<a" * 500_000, "quotes": '<a "' * 250_000, "more quotes": "<a \"'>" * 200_000, "open": "<div>" * 200_000, "selects": "<select>" * 125_000, "closing": "<div>" * 100_000 + "</p>" * 100_000, "comments": "<!--" * 250_000,
    "marks": "<!" * 500_000, "headings": "<nav><h1>" * 100_000, "forms": "<form>" * 150_000, "names": '<p class="' + "ad-" * 300_000 + '">', "entities": "&amp" * 250_000, "lists": "<ul><li>" * 120_000, "scripts": "<script>" * 120_000,
}


def test_long_odd_pages_take_linear_time():
    for name, html in ADVERSE.items():
        began = time.process_time()
        htmltext.blocks(f"<p>before {html}")
        htmltext.blocks(f"<p>before {html}> <p>after")
        assert time.process_time() - began < 15, name
