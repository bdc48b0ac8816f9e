"""Main text of web pages, by differencing with the nearest page.

A page's HTML becomes blocks of text. A block in a menu, page header, footer, sidebar, notice, advert, form or reader comment, as its
elements, roles and class names say, is no candidate. The locations (path and query) of a host are sorted, each is paired with
that neighbour which has the longer beginning in common, the lines of the two pages are aligned by a longest common
subsequence, and lines that both share are deleted as template text. A neighbour that leaves less than a tenth of a page's text is a mirror of
it and no template, so then the other neighbour is taken, or nothing is deleted. Where an article or main element holds at least half of
a page's text, what stands beside it goes, and its own lines stay even if the neighbour quotes the same passage.

A form about half of the text and more is how a page is made (all of it stands in one) and no form to fill in. A menu, sidebar or the like that the page never closes ends
where a main or article element or the first heading begins. Class names and ids count as wholes (`site-header`, `share-buttons`, but not `notice-period`), and never on headings.

White space inside a block is one space; blocks are joined by an empty line. Null or empty HTML gives an empty text; cut-off, unclosed
and odd markup is read as far as it goes; very long pages are read whole. Pages without a host, or alone on it, have no pair. Rows of one
location, repeated ones too, have the same neighbours and never each other; of a location, the row with the least key stands for it.
An empty table gives an empty result. Only the named columns are read, so others can have any names.

Locations get ranks in their order over the whole table (a sort by ranges), and neighbours are joined by rank: a host of any size has
its exact neighbours without a task of its own.
"""

from __future__ import annotations

import json
import re
from html import unescape

import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import durable, map_columns

# a tag's quoted values hold no "<", or no ">"; a tag with an odd quote ends at its first ">". Nothing is given back, so a page takes linear time.
_TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<(/?)([A-Za-z][^\s/><]*+)(?:((?:[^<>"']++|"[^"<]*+"|'[^'<]*+')*+)>|((?:[^<>"']++|"[^">]*+"|'[^'>]*+')*+)>|([^>]*+)>)|<[!?][^>]*+>""", re.S
)
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""")

# Elements of HTML by what they mean here.
SKIPPED = frozenset("script style noscript template textarea select svg math iframe object canvas audio video title".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img input ins kbd label mark output q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
OF_HEAD = frozenset("title meta link style script base noscript template".split())
ENDED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option"}}  # p by any block
CHROME = frozenset("nav footer aside dialog menu button head".split())
MAIN = frozenset("article main".split())
CHROME_ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog menu menubar form".split())
# Names of what isn't main text, and words that stand behind such a name without another meaning.
_CHROME_WORDS = (
    r"nav(?:bar|igation)?|menu|breadcrumbs?|header|masthead|footer|sidebar|side-?bar|cookies?|consent|gdpr|notice|alert|banner|ads?|advert(?:s|isement|ising)?|sponsor(?:ed)?|promo(?:tion)?|share|sharing|social|comments?"
    r"|respond|disqus|related|recommended|subscribe|newsletter|signup|login|popup|modal|overlay|widget|search|pagination|pager|skip|toolbar"
)
_BEHIND = (
    r"bar|box|list|links?|slot|unit|wrap(?:per)?|container|area|section|block|buttons?|form|posts?|articles?|stories|items?|top|bottom|left|right|main|inner|outer|panel|toggle|icons?|media|content|text|thread|"
    r"message|policy|nav|menu|header|footer|group|row|col(?:umn)?|primary|secondary|mobile|desktop|[0-9]+(?:x[0-9]+)?"
)
#: A class or id counts whole: such a name with words behind it that only say what it is made of (share-buttons), or, as _LAST has it, such a name at its end (site-header).
CHROME_NAMES = re.compile(rf"(?:{_CHROME_WORDS})(?:[-_]+(?:{_BEHIND}|{_CHROME_WORDS}))+", re.I)
_LAST = re.compile(rf"(?:^|[-_])(?:{_CHROME_WORDS})$", re.I)
_OWN_HEADER = re.compile(r"(?:^|[-_])(?:header|masthead)$", re.I)
_HEADER_OF_TEXT = re.compile(r"^(?:post|article|entry|story|content|news|title)[-_]+header$", re.I)
_STATE = re.compile(r"^(?:has|with|without|no|is)[-_]|[-_](?:open|closed)$", re.I)  # classes that say what else a page has
_COMMENT = re.compile(r"(?:^|\s)(?:comments?|reply|response)(?:$|\s)", re.I)


def _is_chrome_name(name: str) -> bool:
    return bool((_LAST.search(name) or CHROME_NAMES.fullmatch(name)) and not _HEADER_OF_TEXT.search(name))


def _never_closed(html: str) -> set[str]:
    """Elements about a text that are opened more often than closed."""
    low = html.lower()
    return {t for t in ("nav", "aside", "header", "footer", "dialog", "menu") if len(re.findall(rf"<{t}[\s>]", low)) > low.count(f"</{t}")}


def blocks(html: str | None) -> tuple[list[str], list[bool]]:
    """Texts of the blocks that may be main text, in page order, and whether each stands in an article or main element."""
    html = html or ""
    texts: list[str] = []
    inside: list[bool] = []
    forms: list[int] = []  # the number of the outermost form about a block, or 0
    stack: list[tuple[str, bool, bool, int]] = []  # element, chrome, main, form; with what is around it
    places: dict[str, list[int]] = {}  # where in the stack an element is
    held: list[str] = []
    chrome = main = False
    form = n_forms = 0
    unclosed = _never_closed(html)
    without_end: set[str] = set()  # skipped elements that nothing closes any more

    def flush() -> None:
        if held:
            if not chrome and (t := " ".join(unescape("".join(held)).split())):
                texts.append(t)
                inside.append(main)
                forms.append(form)
            held.clear()

    def cut(k: int) -> None:
        """Leaves the stack's elements from the k-th on."""
        nonlocal chrome, main, form
        for x in stack[k:]:
            places[x[0]].pop()
        del stack[k:]
        _, chrome, main, form = stack[-1] if stack else ("", False, False, 0)

    at, end, last = 0, len(html), html.rfind(">")
    while at < end:
        m = _TOKEN.search(html, at, last + 1) if at <= last else None
        if not m:
            rest = html[at:]
            if (comment := rest.find("<!--")) >= 0:
                rest = rest[:comment]
            mark = rest.rfind("<")  # markup cut off at the end of the page
            held.append(rest[:mark] if mark >= 0 and re.match(r"<[/!?A-Za-z]", rest[mark:] + "x" if len(rest) == mark + 1 else rest[mark:]) else rest)
            break
        if m[0].startswith("<!--") and not m[0].endswith("-->"):
            held.append(html[at : m.start()])
            break
        held.append(html[at : m.start()])
        at = m.end()
        if not m[2]:
            continue
        tag, inner = m[2].lower(), m[3] or m[4] or m[5]
        if m[1]:
            if tag not in INLINE:
                flush()
            if places.get(tag):
                cut(places[tag][-1])
            continue
        if tag in SKIPPED:
            if tag not in ("svg", "math"):
                flush() if tag not in INLINE else None
            close = None if tag in without_end else re.compile(rf"</{re.escape(tag)}\s*+>", re.I).search(html, at)
            if close is None:
                without_end.add(tag)
            at = close.end() if close else end if tag in ("script", "style") else at  # others without an end hold nothing
            continue
        if tag == "br":
            held.append(" ")
        if tag in VOID:
            if tag == "hr":
                flush()
            continue
        if tag in INLINE and not inner:
            continue
        if tag not in INLINE and stack:
            if places.get("head") and tag not in OF_HEAD:
                flush()
                cut(places["head"][0])
            elif stack[-1][0] == "p" or tag in ENDED_BY.get(stack[-1][0], ()):
                flush()
                cut(len(stack) - 1)
        attributes = {a[0].lower(): a[1].strip("\"'") for a in _ATTRIBUTE.findall(inner)} if inner else {}
        role = attributes.get("role", "").lower()
        is_main = tag in MAIN or role == "main"
        if (is_main or tag == "h1") and (around := [places[t][0] for t in unclosed if places.get(t)]):
            flush()
            cut(min(around))
        names = [x for x in f"{attributes.get('class', '')} {attributes.get('id', '')}".split() if not _STATE.search(x)] if tag not in HEADINGS else []
        if main:
            names = [x for x in names if not _OWN_HEADER.search(x)]
        is_chrome = (
            tag in CHROME
            or (tag == "header" and not main)
            or role in CHROME_ROLES
            or "hidden" in attributes
            or "display:none" in attributes.get("style", "").replace(" ", "")
            or (tag not in ("body", "html", "main") and (bool(_COMMENT.search(" ".join(names))) if tag == "article" else any(map(_is_chrome_name, names))))
        )
        if tag in INLINE and not is_chrome:
            continue
        if tag not in INLINE or is_chrome:
            flush()
        if tag in ("p", "li", "dt", "dd", "tr", "td", "th", "option") and not is_chrome:
            continue  # they close themselves, so they never hold what follows
        if tag == "form" and not form:
            n_forms += 1
            form = n_forms
        stack.append((tag, chrome or is_chrome, main or is_main, form))
        places.setdefault(tag, []).append(len(stack) - 1)
        _, chrome, main, form = stack[-1]
    flush()
    # a form about most of the page is how the page is made, and no form to fill in
    size, total = {}, sum(map(len, texts))
    for t, f in zip(texts, forms, strict=True):
        size[f] = size.get(f, 0) + len(t)
    kept = [not f or 2 * size[f] >= total for f in forms]
    return [t for t, k in zip(texts, kept, strict=True) if k], [i for i, k in zip(inside, kept, strict=True) if k]


def aligned(a: list[int], b: list[int]) -> set[int]:
    """Places of a that lie on a longest common subsequence of a and b.

    Lines that only one side has are left out first. A row of the table is one integer with a bit for each line of b, so a row
    costs a few operations on whole integers.
    """
    common = set(a) & set(b)
    ia, b = [i for i, x in enumerate(a) if x in common], [x for x in b if x in common]
    out: set[int] = set()
    while ia and b and a[ia[0]] == b[0]:
        out.add(ia.pop(0))
        b.pop(0)
    while ia and b and a[ia[-1]] == b[-1]:
        out.add(ia.pop())
        b.pop()
    if not ia or not b:
        return out
    where: dict[int, int] = {}
    for j, x in enumerate(b):
        where[x] = where.get(x, 0) | 1 << j
    full = (1 << len(b)) - 1
    rows = [full]
    for i in ia:
        v = rows[-1]
        u = v & where.get(a[i], 0)
        rows.append(((v + u) | (v - u)) & full)
    i, j = len(ia), len(b)
    while i and j:
        if a[ia[i - 1]] == b[j - 1]:
            out.add(ia[i - 1])
            i, j = i - 1, j - 1
        elif rows[i] >> (j - 1) & 1:
            j -= 1
        else:
            i -= 1
    return out


def _shared_beginning(a: str | None, b: str | None) -> int:
    n = 0
    for x, y in zip(a or "", b or "", strict=False):
        if x != y:
            break
        n += 1
    return n


_URL = r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)([^#]*)"


def neighbours(lines: DataFrame, per_bucket: int = 4096) -> DataFrame:
    """lines (_host, _loc, _lines; distinct _host and _loc) with what lies before and after each on its host: _loc0, _lines0, _loc1, _lines1.

    A sort by ranges gives each row its place in its partition; with the partitions' sizes, of which there are as many as
    partitions, places become ranks. Runs of per_bucket ranks are shuffled once, with the rows at their ends in both runs.
    """
    spark = lines.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = durable(lines.repartitionByRange(tasks, "_host", "_loc").sortWithinPartitions("_host", "_loc").withColumn("_id", F.monotonically_increasing_id()), "page-lines")
    part = F.shiftright("_id", 33)
    sizes = {r["p"]: r["n"] for r in placed.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect()}
    starts, total = [], 0
    for p in sorted(sizes):
        starts.append((p, total))
        total += sizes[p]
    starts = spark.createDataFrame(starts, "_p long, _start long")
    ranked = placed.join(F.broadcast(starts), part == F.col("_p")).withColumn("_rank", F.col("_start") + F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))).drop("_p", "_start", "_id")
    bucket = F.floor(F.col("_rank") / per_bucket)
    also = F.when(F.col("_rank") % per_bucket == 0, bucket - 1).when(F.col("_rank") % per_bucket == per_bucket - 1, bucket + 1)
    dealt = ranked.select("*", bucket.alias("_own"), F.explode(F.array_compact(F.array(bucket, also))).alias("_bucket"))
    order = Window.partitionBy("_bucket").orderBy("_rank")
    near = {f"_{n}{k}": f(n_, 1).over(order) for k, f in ((0, F.lag), (1, F.lead)) for n, n_ in (("host", "_host"), ("loc", "_loc"), ("lines", "_lines"))}
    out = dealt.withColumns(near).filter(F.col("_own") == F.col("_bucket"))
    same = lambda c, k: F.when(F.col(f"_host{k}") == F.col("_host"), F.col(c)).alias(c)
    return out.select("_host", "_loc", same("_loc0", 0), same("_lines0", 0), same("_loc1", 1), same("_lines1", 1))


def chosen(texts: list[str], inside: list[bool], lines: list[int], pairs: list[list[int] | None], mirror: float = 0.9, bulk: float = 0.5) -> list[str]:
    """The texts that are left after differencing with the first of pairs that is no mirror."""
    size = [len(t) for t in texts]
    total, shared = sum(size), set()
    for pair in pairs:
        found = aligned(lines, pair) if pair else set()
        if found and sum(size[i] for i in found) <= mirror * total:
            shared = found
            break
    if sum(n for n, i in zip(size, inside, strict=True) if i) >= bulk * total:
        return [t for t, i in zip(texts, inside, strict=True) if i]
    return [t for i, t in enumerate(texts) if i not in shared]


def extract(df: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """key, url and text for each row of df."""
    kind = df.schema[key].dataType.simpleString()
    place = F.lower(F.regexp_extract(F.col(url), _URL, 1)), F.regexp_extract(F.col(url), _URL, 2)
    located = df.select(F.col(key), F.col(url), F.col(html), F.coalesce(place[0], F.lit("")).alias("_host"), F.coalesce(place[1], F.lit("")).alias("_loc"))
    hashed = lambda texts: [xxhash.xxh64_intdigest(t) >> 1 for t in texts]

    def lines_of(keys: list, htmls: list, hosts: list, locs: list) -> dict[str, list]:
        return {"_key": keys, "_host": hosts, "_loc": locs, "_lines": [hashed(blocks(h)[0]) for h in htmls]}

    lines = map_columns(located.filter("_host <> ''"), [key, html, "_host", "_loc"], f"_key {kind}, _host string, _loc string, _lines array<bigint>", lines_of)
    near = neighbours(lines.groupBy("_host", "_loc").agg(F.min_by("_lines", F.struct("_key", "_lines")).alias("_lines")))

    def parse(keys: list, urls: list, htmls: list, hosts: list, locs: list) -> dict[str, list]:
        got = [zstandard.compress(json.dumps(blocks(h)).encode("utf-8", "surrogatepass")) for h in htmls]
        return {key: keys, url: urls, "_host": hosts, "_loc": locs, "_blocks": got}

    parsed = map_columns(located, [key, url, html, "_host", "_loc"], f"`{key}` {kind}, `{url}` string, _host string, _loc string, _blocks binary", parse)
    paired = parsed.join(near, ["_host", "_loc"], "left").select(key, url, "_loc", "_blocks", "_loc0", "_lines0", "_loc1", "_lines1")

    def own(keys: list, urls: list, locs: list, packed: list, loc0: list, lines0: list, loc1: list, lines1: list) -> dict[str, list]:
        out = []
        for loc, b, p0, l0, p1, l1 in zip(locs, packed, loc0, lines0, loc1, lines1, strict=True):
            texts, inside = json.loads(zstandard.decompress(b))
            before_first = _shared_beginning(loc, p0) >= _shared_beginning(loc, p1)
            out.append("\n\n".join(chosen(texts, inside, hashed(texts), [l0, l1] if before_first else [l1, l0])))
        return {key: keys, url: urls, "text": out}

    return map_columns(paired, paired.columns, f"`{key}` {kind}, `{url}` string, text string", own)
