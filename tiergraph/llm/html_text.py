"""Main text of web pages by the maximum-scoring subsequence.

A page is a sequence of words and tags. A word scores by where it stands: above zero in elements that hold articles,
far below in those that hold menus, adverts and the like. A tag scores below zero. A linear scan finds the contiguous
part with the largest sum; it is widened to the container that holds it, and words that score below zero there go.
Weights are log-odds of element names and class words over labelled pages, of which a small set is given below.
"""

from __future__ import annotations

import html
import math
import re
from bisect import bisect_left, bisect_right
from collections import Counter, defaultdict
from functools import lru_cache
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content isn't page text.
RAW = "script|style|noscript|template|textarea|title|svg|iframe|object|canvas|math"
#: Elements that don't end a block.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: An opening tag of these ends an open paragraph.
ENDS_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
#: An opening tag of these ends an open element of its kind in the same list or table.
SIBLINGS = {"li": "ul ol menu", "dt": "dl", "dd": "dl", "tr": "table", "td": "tr table", "th": "tr table", "option": "select"}
ENDS_SIBLING = {name: frozenset(lists.split()) for name, lists in SIBLINGS.items()}
ARTICLES = frozenset(("article", "main"))
#: Elements that hold a piece of a text, not the text: a part inside one is widened to what is around it.
PIECES = INLINE | frozenset("blockquote caption dd details dl dt figcaption figure h1 h2 h3 h4 h5 h6 header hgroup li ol p pre summary table tbody td tfoot th thead tr ul".split())
TAG_COST = -0.2
LEAST = -1.0
#: Share of a page's words from which on the class of the element that holds them doesn't speak against it.
NEARLY_ALL = 0.7
_TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<({RAW})\b(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([A-Za-z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|</?[A-Za-z][^>]*+(?:>|\Z)|<[!?/][^>]*+(?:>|\Z)",
    re.S | re.I,
)
_CLASS = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.I)
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|/|$)|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", re.I)

#: Labelled pages: what stands between {{ and }} is main text.
LABELLED = (
    '<html><head><title>a</title></head><body><header class="site-header top"><div class="logo">Daily site name</div><nav class="navbar main-nav menu"><ul><li><a>home</a></li><li><a>news</a></li></ul></nav></header>'
    '<div class="breadcrumb breadcrumbs">home news</div><main><article class="post entry"><header class="entry-header article-header">{{<h1>A title of some words that stands in a header of its own</h1>}}</header><div class="content entry-content body">{{<p>One long paragraph with <b>bold</b> and <a>linked</a> words that goes on.</p><p>More words follow here.</p><ul><li>a point made</li><li>another point</li></ul>}}'
    '<aside class="pullquote related related-posts">read this too</aside><div class="ad ads advert advertisement adbox">buy things now</div>{{<p>The end of it all comes here.</p>}}</div><footer class="post-footer tags">tagged as news</footer></article></main>'
    '<aside class="sidebar widget">popular today</aside><section id="comments" class="comments comment-list"><div class="comment">nice read</div><div class="reply">i do not agree</div></section><footer class="site-footer footer">&copy; the site</footer></body></html>',
    '<html><body><div id="nav" class="navigation nav">home about</div><div class="cookie cookies cookie-banner consent notice gdpr">we use cookies here</div><div id="main" class="wrapper page container">{{<h2>On the making of things</h2><p>A text of many words in a plain page.<br>A second line of it.</p><p>See <a>this linked page</a>, <a>that other one</a> and <a>the long list of all pages that were ever linked</a>.</p><ul class="list top"><li>first in the list</li><li><a>second in the list</a></li></ul><blockquote>what someone said</blockquote><table><tr><td>cell one</td><td>cell two</td></tr></table>}}'
    '<div class="share social social-share">share this page</div><form class="newsletter subscribe signup search"><label>your mail</label><button>join</button></form><div class="promo sponsored sponsor banner">sponsored link</div></div><div id="footer" class="copyright legal">all rights kept</div></body></html>',
    '<html><body><nav><ul><li><a>one</a></li><li><a>two</a></li></ul></nav><div class="ad">a short advert text of words</div><article>{{<h1>Some head line</h1><p><b>First words of the text.<br><p>Then the next paragraph of it.</p><p>And one more.</p><pre>code line</pre><figure><figcaption>a caption</figcaption></figure>}}</article><footer>&copy; site</footer></body></html>',
    '<html><body><div class="topbar header masthead">a name</div><div class="alert warning notification popup modal overlay dialog">please note this</div><section class="story text">{{<h3>Part</h3><p>Words of a section that matter.</p><dl><dt>term</dt><dd>what it means</dd></dl><details><summary>more</summary>inner words</details>}}</section>'
    '<div class="pagination pager">next page</div><div hidden>not shown here</div><div style="display:none" class="x">nor is this</div><div class="recommended recommendations trending outbrain taboola">you may like</div><menu class="toolbar">tools</menu><select><option>pick me</option></select><dialog>an offer</dialog><div class="disqus respond feedback">say something</div><div class="skip breadcrumbs tagcloud">skip to text</div></body></html>',
    '<html><body><div class="toc contents-table">part one part two</div><div class="infobox factbox">short facts about it</div><article><div class="teaser teasers more-stories more stories readmore">other stories to read</div>{{<h1>A head line of words</h1><p>Words of the story that go on for a while.</p>}}<div class="paywall meter regwall premium">pay to read on</div>{{<p>The story ends with these words.</p>}}</article>'
    '<section class="discussion discussions thread threads">what readers say here</section><div class="responses response replies">their answers to it</div><div class="talkback guestbook reader-comments user-comments">more of what they say</div></body></html>',
    '<html><body><div role="navigation">go there</div><div role="banner">name</div><div role="search">find</div><div role="complementary">aside words</div><div role="main">{{<section><h2>Head</h2><p>Long text of words and more words.</p></section>}}</div><div role="contentinfo">who made it</div><address class="byline author">by a writer</address></body></html>',
)


def _features(name: str, attributes: str, in_article: bool) -> list[str]:
    """What an element is known by: its name (apart inside articles) and the words of its class, id and role."""
    out = ["article/" + name if name == "header" and in_article else name]
    if attributes:
        for found in _CLASS.finditer(attributes):
            value = (found[1] or found[2] or found[3] or "").lower()
            for part in value.split():
                out.append("." + part)
                out += ["." + word for word in re.findall(r"[a-z]+", part) if word != part]
        if _HIDDEN.search(attributes):
            out.append("hidden")
    return out


def tokens(page: str):
    """(kind, value): text runs, and tags as (is_end, name, attributes). Raw elements and comments are passed over."""
    at = 0
    for found in _TOKEN.finditer(page):
        if found.start() > at:
            yield "text", page[at : found.start()]
        at = found.end()
        if found[3]:
            yield "tag", (bool(found[2]), found[3].lower(), found[4])
        elif found[1]:
            yield "raw", found[1].lower()
    if at < len(page):
        yield "text", page[at:]


class Element:
    __slots__ = ("features", "first", "last", "name", "parent", "weight")

    def __init__(self, name: str, parent: Element | None, features: list[str], first: int):
        self.name, self.parent, self.features, self.weight, self.first, self.last = name, parent, features, 1.0, first, first

    def line(self):
        """The element and those around it, outwards, without the root."""
        element = self
        while element.parent:
            yield element
            element = element.parent


#: Elements at which the search for an open paragraph or sibling stops.
_STOPS = ENDS_P | {"p", "td", "th", "li"}
_LISTED = frozenset(ENDS_SIBLING) | {x for lists in ENDS_SIBLING.values() for x in lists}


class _Open:
    """The open elements, and the places in them of those that decide what an opening tag ends."""

    def __init__(self, root: Element):
        self.stack, self.count = [root], Counter()
        self.stops: list[int] = []
        self.listed: list[int] = []

    def push(self, element: Element) -> None:
        if element.name in _STOPS:
            self.stops.append(len(self.stack))
        if element.name in _LISTED:
            self.listed.append(len(self.stack))
        self.stack.append(element)
        self.count[element.name] += 1

    def close(self, to: int, at: int) -> None:
        while len(self.stack) > to:
            element = self.stack.pop()
            element.last = at
            self.count[element.name] -= 1
        for places in (self.stops, self.listed):
            while places and places[-1] >= to:
                places.pop()

    def end(self, name: str, at: int) -> None:
        if self.count[name]:
            k = len(self.stack) - 1
            while self.stack[k].name != name:
                k -= 1
            self.close(k, at)

    def begin(self, name: str, at: int) -> None:
        """End what the opening tag of name ends."""
        if name in ENDS_P:
            if self.stops and self.stack[self.stops[-1]].name == "p":
                self.close(self.stops[-1], at)
        elif name in ENDS_SIBLING:
            alike = {"td": ("td", "th"), "th": ("td", "th"), "dt": ("dt", "dd"), "dd": ("dt", "dd")}.get(name, (name,))
            if any(self.count[x] for x in alike):
                for k in reversed(self.listed):
                    if self.stack[k].name in alike:
                        self.close(k, at)
                        break
                    if self.stack[k].name in ENDS_SIBLING[name]:
                        break


def outline(page: str, known: dict[str, float]):
    """Text runs (place, element, text), places of tags that end a block, and the number of tokens."""
    root = Element("", None, [], 0)
    tree, runs, breaks, elements = _Open(root), [], [], []
    at = 0
    for kind, value in tokens(page):
        if kind == "text":
            runs.append((at, tree.stack[-1], value))
        elif kind == "tag":
            end, name, attributes = value
            if name not in INLINE:
                breaks.append(at)
            if end:
                tree.end(name, at)
            else:
                tree.begin(name, at)
                if name not in VOID and not attributes.endswith("/"):
                    inside = any(tree.count[x] for x in ARTICLES)
                    elements.append(Element(name, tree.stack[-1], _features(name, attributes, inside), at))
                    tree.push(elements[-1])
        at += 1
    tree.close(0, at)
    _weigh(elements, runs, known)
    return runs, breaks, at


def _weigh(elements: list[Element], runs: list, known: dict[str, float]) -> None:
    """Words score 1 unless an element around them speaks clearly against main text.

    What the words of an element's class say is added up, so one of them doesn't outweigh the others. Classes don't
    speak against an element that holds nearly all words of the page.
    """
    places = [place for place, _, _ in runs]
    before = [0, *accumulate(len(text.split()) for _, _, text in runs)]
    for e in elements:  # outer ones come first
        own = [known.get(f, 0.0) for f in e.features]
        worst = own[0] if e.features[-1] != "hidden" else min(own[0], own[-1])
        classes = sum(own[1:])
        if classes < LEAST and min(own[1:]) < LEAST:
            words = before[bisect_right(places, e.last)] - before[bisect_left(places, e.first)]
            if words < NEARLY_ALL * before[-1]:
                worst = min(worst, min(own[1:]))
        e.weight = min(worst if worst < LEAST else 1.0, e.parent.weight)


@lru_cache(maxsize=4)
def weights(pages: tuple[str, ...] = LABELLED) -> dict[str, float]:
    """Log-odds of main text for words in an element with a feature, from labelled pages."""
    inside, outside = Counter(), Counter()
    for page in pages:
        main = False
        # marks are texts of their own, so that a run is wholly inside or outside
        for _, element, text in outline(page.replace("{{", "<wbr>{{<wbr>").replace("}}", "<wbr>}}<wbr>"), {})[0]:
            if text in ("{{", "}}"):
                main = text == "{{"
            elif count := len(text.split()):
                for f in {f for e in element.line() for f in e.features}:
                    (inside if main else outside)[f] += count
    return {f: math.log((inside[f] + 0.5) / (outside[f] + 0.5)) for f in inside.keys() | outside.keys()}


def best_part(scores: list[tuple[int, float]]) -> tuple[int, int] | None:
    """First and last place of the contiguous part with the largest sum; places without a score are tags."""
    best, total, start, found, last = 0.0, 0.0, 0, None, -1
    for place, score in scores:
        total += TAG_COST * (place - last - 1)
        last = place
        if total <= 0:
            total, start = 0.0, place
        total += score
        if total > best:
            best, found = total, (start, place)
    return found


def extract(page: str, known: dict[str, float] | None = None) -> str:
    """Blocks of main text, a line each."""
    known = weights() if known is None else known
    runs, breaks, count = outline(page, known)
    runs = [(place, element, html.unescape(text)) for place, element, text in runs]
    scores = [(place, element.weight * len(text.split())) for place, element, text in runs]
    part = best_part(scores)
    if not part:
        return ""
    first, last = part
    words = [(place, e) for place, e, text in runs if e.weight > 0 and not text.isspace()]
    around = [e for place, e in words if first <= place <= last]
    # elements are nested, so one around the first word holds them all if it ends behind the last
    furthest = max(place for place, _ in words if first <= place <= last)
    shared = [e for e in around[0].line() if e.last >= furthest]
    outer = max((k for k, e in enumerate(shared) if e.name in ARTICLES), default=-1)
    places = [place for place, _ in words]
    # words that score below zero have gone, so no element around the others speaks against main text
    for k, holder in enumerate(shared):
        if holder.name in PIECES:
            continue
        begin, end = bisect_left(places, holder.first), bisect_right(places, holder.last)
        alone = begin == end or first <= places[begin] and places[end - 1] <= last
        if alone and k < outer:
            continue  # wraps this part only, and an article is around it
        first, last = min(first, holder.first), max(last, holder.last)
        break
    else:  # no container: the page itself
        first, last = 0, count
    blocks, held, k = [], [], 0
    for place, element, text in runs:
        if first <= place <= last and element.weight > 0:
            while k < len(breaks) and breaks[k] < place:
                if held:
                    blocks.append("".join(held))
                    held = []
                k += 1
            held.append(text)
    blocks.append("".join(held))
    return "\n".join(b for b in (" ".join(b.split()) for b in blocks) if b)


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", labelled: tuple[str, ...] = LABELLED) -> DataFrame:
    """One row per input row: page_id, url, text, n_chars (code points).

    Null html is empty; a page without main text gives an empty text. Cut-off pages, unclosed tags and comments that
    don't end are read as far as they go. Rows that repeat are each extracted. Other columns aren't read.
    """
    kind, url_kind = pages.schema[id_col].dataType.simpleString(), pages.schema[url_col].dataType.simpleString()
    plain = pages.select(pages[id_col].alias("page_id"), pages[url_col].alias("url"), F.coalesce(pages[html_col], F.lit("")).alias("html"))
    known = weights(labelled)

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [extract(page, known) for page in batch.column(2).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return arrow_map(plain, one, f"page_id {kind}, url {url_kind}, text string, n_chars bigint")
