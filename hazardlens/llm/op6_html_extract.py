"""Main text of web pages by line-block distribution.

Markup is stripped into lines, one per block element. A line's weight is the
length of its text; lines inside menus, headers, footers, sidebars, notices,
adverts, forms and comments weigh nothing, nor do lines made of links mostly.
Weights are summed over sliding windows of ``WINDOW`` lines: text begins where
the sum surges above the threshold and ends where it dives to nothing. The
lines with weight between a surge and its dive are kept.

Where a page marks its article (``article``, ``main``), the marked lines stand
whole, and the heaviest window of marked lines is the threshold for the others:
text outside the mark is kept where its windows surge above it, as on pages
whose mark holds a teaser only. Where the text kept has no ``h1``, the last one
before it belongs to it.

A block stays one line of text when an inline element in it (a button, an
advert) is left out.

A class or id only suggests that an element is outside. Words behind
with/no/has/without say nothing. An element that holds more than half of the
text outside links (of the marked text, where there is any) is a wrapper; one
named like an advert, a comment or a notice is one only if it holds the page's
one article. Inside the article only the words in ``INSIDE_WORDS`` count.

Null or empty html gives an empty text. Unclosed and misnested elements are
closed by the next end tag that fits. Equal pages give equal texts; an empty
table gives an empty result; extra columns are dropped.
"""

from __future__ import annotations

import html as _html
import re
from itertools import accumulate

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .common import map_batches, table

WINDOW = 3
SURGE = 40  # characters in a window at least

SKIPPED = frozenset("script style noscript template textarea select svg math iframe object canvas head title".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
OUTSIDE = frozenset("nav footer aside form button dialog menu fieldset datalist".split())
BLOCKS = frozenset("""address article aside blockquote body caption center dd details dialog dir div dl dt fieldset
figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option
p pre search section summary table tbody td tfoot th thead tr ul""".split())
OUTSIDE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
OUTSIDE_WORDS = frozenset("""ad ads advert adverts advertisement advertising adsense banner sponsor sponsored sponsors promo
promotion nav navbar navigation menu menubar breadcrumb breadcrumbs header masthead footer sidebar aside cookie cookies
consent gdpr notice notices alert popup modal overlay comment comments commentlist disqus respond reply replies related
recommended share sharing social newsletter subscribe subscription signup login search pagination pager widget widgets
copyright legal disclaimer toolbar topbar skip tags""".split())
# Elements that hold no page, and those that no article has as text of its own.
NOTICE_WORDS = frozenset("""ad ads advert adverts advertisement advertising adsense sponsor sponsored sponsors promo promotion
cookie cookies consent gdpr popup modal comment comments commentlist disqus respond reply replies newsletter subscribe
subscription signup login""".split())
INSIDE_WORDS = NOTICE_WORDS | frozenset("nav navbar navigation menu menubar breadcrumb breadcrumbs sidebar search pagination pager share sharing".split())
NOT_ARTICLE_WORDS = frozenset("comment comments ad promo related reply".split())
NEGATIONS = frozenset("with no has without".split())
_ATTRIBUTES = re.compile(r"""\b(class|id|role|hidden|itemprop)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.IGNORECASE)
_TAG = re.compile(r"""</?([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>"']|"[^"]*"|'[^']*')*)>|</?([a-zA-Z][a-zA-Z0-9:-]*)([^>]*)>""")
_SPLIT = re.compile(r"[\s_-]+|(?<=[a-z])(?=[A-Z])")


class _Line:
    """Text of one block or, around inline elements that are left out, of a part of it."""
    __slots__ = ("parts", "linked", "outside", "main", "block", "title")

    def __init__(self, outside: bool, main: bool, block: int, title: bool):
        self.parts: list[str] = []
        self.linked = 0
        self.outside = outside
        self.main = main
        self.block = block
        self.title = title


class _Named:
    """An element whose class or id suggests that it is outside: its lines
    [first, end), and whether an article begins in it."""
    __slots__ = ("first", "end", "notice", "article")

    def __init__(self, first: int, notice: bool):
        self.first, self.end, self.notice, self.article = first, -1, notice, False


def _words(value: str) -> set[str]:
    """Words of class names and ids, without those behind a negation."""
    out: set[str] = set()
    for name in value.split():
        for w in _SPLIT.split(name):
            if w.lower() in NEGATIONS:
                break
            out.add(w.lower())
    return out


def _kind(tag: str, attributes: str, in_main: bool) -> str:
    """What an element holds: 'outside' the article, by its name perhaps
    something outside ('notice', 'layout'), the article ('main'), or ''."""
    if tag in OUTSIDE or tag == "header" and not in_main:
        return "outside"
    kind = "main" if tag in ("article", "main") else ""
    if attributes:
        words: set[str] = set()
        for key, a, b, c in _ATTRIBUTES.findall(attributes):
            key, value = key.lower(), a or b or c
            if key == "hidden" and not value:
                return "outside"
            if key == "role" and value.lower() in OUTSIDE_ROLES:
                return "outside"
            if key == "role" and value.lower() in ("main", "article") or key == "itemprop" and value == "articleBody":
                kind = "main"
            elif key in ("class", "id"):
                words |= _words(value)
        if tag not in ("html", "body", "main"):
            words &= NOT_ARTICLE_WORDS if kind == "main" else INSIDE_WORDS if in_main else OUTSIDE_WORDS
            if words:
                return "notice" if words & NOTICE_WORDS else "layout"
    return kind


def lines(page: str) -> list[_Line]:
    """The page's lines, one per block or part of it, with what surrounds them."""
    out: list[_Line] = []
    stack: list[tuple[str, str]] = []
    outside = main = links = titles = block = 0
    line = _Line(False, False, 0, False)
    named: list[_Named] = []
    within: list[_Named] = []

    def turn(whole: bool = True) -> None:
        nonlocal line, block
        if line.parts:
            out.append(line)
        block += whole
        line = _Line(outside > 0, main > 0, block, titles > 0)

    def leave() -> str:
        nonlocal outside, main, links, titles
        if stack[-1][1] in ("outside", "notice", "layout"):
            turn(stack[-1][0] in BLOCKS)  # text behind the element is not part of it
        tag, kind = stack.pop()
        outside -= kind == "outside"
        main -= kind == "main"
        links -= tag == "a"
        titles -= tag == "h1"
        if kind in ("notice", "layout"):
            e = within.pop()
            e.end = len(out)
            if within and e.article:
                within[-1].article = True
        if not line.parts:
            line.outside, line.main, line.title = outside > 0, main > 0, titles > 0
        return tag

    at, end = 0, len(page)
    while at < end:
        lt = page.find("<", at)
        if lt < 0:
            lt = end
        if lt > at:
            text = page[at:lt]
            line.parts.append(text)
            if links and not text.isspace():
                line.linked += len(text)
        if lt == end:
            break
        if page.startswith("<!--", lt):
            close = page.find("-->", lt + 4)
            at = end if close < 0 else close + 3
            continue
        if page.startswith(("<!", "<?"), lt):
            close = page.find(">", lt)
            at = end if close < 0 else close + 1
            continue
        m = _TAG.match(page, lt)
        if not m:  # a lone "<" is text
            line.parts.append("<")
            at = lt + 1
            continue
        tag, attributes, at = (m.group(1) or m.group(3)).lower(), m.group(2) or m.group(4) or "", m.end()
        if page[lt + 1] == "/":
            if any(t == tag for t, _ in stack):
                if tag in BLOCKS:
                    turn()
                while leave() != tag:
                    pass
                if tag in BLOCKS:
                    turn()
            elif tag in BLOCKS:
                turn()
            continue
        if tag in SKIPPED and not attributes.endswith("/"):
            close = re.compile(rf"</{tag}\s*>", re.IGNORECASE).search(page, at)
            at = close.end() if close else (end if tag in ("script", "style") else at)
            continue
        if tag in BLOCKS:
            if tag == "p" or tag.startswith("h") and len(tag) == 2:  # a paragraph ends where the next block begins
                while stack and stack[-1][0] in ("p", "b", "i", "em", "strong", "span", "a", "u", "font") and any(t == "p" for t, _ in stack):
                    if leave() == "p":
                        break
            turn()
        elif tag == "br":
            line.parts.append(" ")
        if tag in VOID or attributes.endswith("/"):
            if tag in BLOCKS:
                turn()
            continue
        kind = _kind(tag, attributes, main > 0)
        stack.append((tag, kind))
        if kind in ("outside", "notice", "layout"):  # an inline element outside the article has a line of its own
            turn(False)
        outside += kind == "outside"
        main += kind == "main"
        links += tag == "a"
        titles += tag == "h1"
        if kind in ("notice", "layout"):
            within.append(_Named(len(out), kind == "notice"))
            named.append(within[-1])
        elif kind == "main" and within:
            within[-1].article = True
        if tag in BLOCKS or kind == "outside":
            turn(tag in BLOCKS)
    turn()
    while stack:
        leave()
    if named:
        _leave_out(out, named)
    return out


def _leave_out(found: list[_Line], named: list[_Named]) -> None:
    """Marks the lines of named elements that wrap neither article nor page."""
    weights = [0 if x.outside else max(0, len(" ".join("".join(x.parts).split())) - x.linked) for x in found]
    marked = any(w and x.main for w, x in zip(weights, found))
    if marked:
        weights = [w if x.main else 0 for w, x in zip(weights, found)]
    upto = [0, *accumulate(weights)]

    def covered(elements: list[_Named]) -> list[int]:
        edge = [0] * (len(found) + 1)
        for e in elements:
            edge[e.first] += 1
            edge[e.end] -= 1
        return list(accumulate(edge))[:-1]

    free = any(w and not c for w, c in zip(weights, covered([e for e in named if e.notice])))

    def wraps(e: _Named) -> bool:
        held = upto[e.end] - upto[e.first]
        return 2 * held > upto[-1] and (marked or held > SURGE) and (not e.notice or marked and e.article and not free)

    for x, c in zip(found, covered([e for e in named if not wraps(e)])):
        x.outside = x.outside or c > 0


def extract(page: str | None) -> str:
    """The article's blocks, one per line."""
    found = lines(page or "")
    raw = [_html.unescape("".join(x.parts)) for x in found]
    rows = [(i, len(" ".join(t.split())), x) for i, (t, x) in enumerate(zip(raw, found)) if t and not t.isspace()]
    marked = [n if x.main and not x.outside else 0 for _, n, x in rows]
    free = [0 if x.main or x.outside or 2 * x.linked > n else n for _, n, x in rows]
    ranges = _surges(marked, 0)
    heaviest = max(_windows(marked), default=0)
    if heaviest:
        ranges += _surges(free, max(SURGE, heaviest))
    else:
        sums = max(_windows(free), default=0)
        ranges = _surges(free, SURGE if sums > SURGE else 0)  # a page of few words is its heaviest windows
    kept = {rows[k][0] for a, b in ranges for k in range(a, b) if marked[k] or free[k]}
    if heaviest and not any(found[i].title for i in kept):
        titles = [i for i, _, x in rows if x.title and not x.outside and i < min(kept)]
        kept.update(i for i in titles if found[i].block == found[titles[-1]].block)
    blocks: dict[int, list[str]] = {}
    for i, x in enumerate(found):
        if i in kept or raw[i].isspace():
            blocks.setdefault(x.block, []).append(raw[i])
    return "\n".join(t for t in (" ".join("".join(parts).split()) for parts in blocks.values()) if t)


def _windows(weights: list[int]) -> list[int]:
    return [sum(weights[i:i + WINDOW]) for i in range(len(weights))]


def _surges(weights: list[int], limit: int) -> list[tuple[int, int]]:
    """Line ranges from surge to dive."""
    sums = _windows(weights)
    found, i, n = [], 0, len(weights)
    while i < n:
        if weights[i] and sums[i] > limit:
            j = i
            while j < n and sums[j] > 0:
                j += 1
            found.append((i, j))
            i = j
        else:
            i += 1
    return found


PAGE_SCHEMA = T.StructType([T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()),
                            T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])


def extracted(pages: DataFrame) -> DataFrame:
    def make():
        def run(cols):
            texts = [extract(h) for h in cols["html"]]
            return {"page_id": cols["page_id"], "url": cols["url"], "text": texts, "n_chars": [len(t) for t in texts]}
        return run

    return map_batches(pages.select("page_id", "url", "html"), make, PAGE_SCHEMA)


def op6_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extracted(table(spark, sf_dir, "pages"))
