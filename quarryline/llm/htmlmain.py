"""Main text of HTML pages by the maximum-scoring subsequence of words and tags.

A page is a sequence of text runs and tags. Words score positive and tags negative; the weights are log odds learned
from pages whose markup labels the article (exactly one <article> element). One linear scan finds the contiguous
region with the highest score, another all maximal ones; those with at least SHARE of the best score count too, so a
second article, or what follows a long table, stays. The blocks that the regions touch are the main text, each whole, and
with them those that lie next to them in the same element, or between two regions, and are not lists of links. Blocks in
menus, headers, footers, sidebars, notices, adverts, forms and reader comments are left out. Elements that claim the main text and hold at least half of the page's plain
words change scores: words beside them count against the region.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from html import unescape

import numpy as np
import pandas as pd
import pyarrow as pa
import regex as re
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

#: Expected number of pages that weights are learned from, drawn by a hash of id and html.
MAX_LABELLED = 1000
#: The score, as a share of the best region's, from which another region counts.
SHARE = 0.3
#: Links, in blocks of links only one after the other between two regions, that are still text and not a list of links.
LINKS = 2

# Both patterns take each character in one way only, so a match or a failure costs the length of what is left at most once.
_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<[!?][^>]*+>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+'|[\"'])*+)>", re.S)
_PLAIN_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<[!?][^>]*+>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)([^>]*+)>", re.S)
_OPENS = re.compile(r"<(?:/?[a-zA-Z]|[!?])")
_ATTRIBUTE = re.compile(r"([^\s=>\"'/]++)(?:\s*+=\s*+(?:\"([^\"]*+)\"?|'([^']*+)'?|([^\s>]++)))?", re.S)
_NO_DISPLAY = re.compile(r"(?:^|;)\s*+display\s*+:\s*+none", re.I)
_RAW = {"script", "style", "textarea", "title", "noscript", "template", "iframe", "noframes", "xmp", "svg", "math", "object", "select", "canvas"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
#: Of _RAW, those that hold text only, up to their literal end tag.
_TEXT_ONLY = {"script", "style", "textarea", "title", "iframe", "noframes", "xmp"}
_INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var img br wbr".split())
#: Names with weights of their own; all others count as one, "other".
_KNOWN = _RAW | _VOID | _INLINE | set(
    "html head body div main article section nav aside header footer hgroup search form fieldset legend label button dialog menu details summary figure figcaption blockquote center "
    "p h1 h2 h3 h4 h5 h6 ul ol dl li dt dd pre address table caption colgroup thead tbody tfoot tr td th optgroup option datalist output progress meter audio video picture map slot font dir frame frameset".split()
)
_LEAF = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "dt", "dd", "pre", "td", "th", "tr", "hr", "figcaption", "caption", "summary", "address", "option"}
_OUT_TAGS = {"nav", "header", "footer", "aside", "form", "button", "dialog", "menu", "fieldset", "head"}
_OUT_NAMES = set(
    "ad ads advert adverts advertisement advertising adbox adsense sponsor sponsored promo promotion banner nav navbar navigation menu sidebar side aside footer header "
    "masthead cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended "
    "comment comments commentlist discussion replies reply disqus respond breadcrumb breadcrumbs pagination pager widget toolbar search complementary contentinfo".split()
)
#: Start tags that end a leaf block whose own end tag may be left out, and elements inside it in which they don't.
_CLOSED_BY = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option", "optgroup"}, set()),
    "td": ({"td", "th", "tr", "tbody", "thead", "tfoot"}, {"table"}), "th": ({"td", "th", "tr", "tbody", "thead", "tfoot"}, {"table"}),
    "tr": ({"tr", "tbody", "thead", "tfoot"}, {"table"}), "select": ({"select", "input", "textarea"}, set()),
}
#: Start tags that end an <svg> or <math> left open, outside of these elements.
_BREAK_OUT = set("p div h1 h2 h3 h4 h5 h6 ul ol li dl dd dt table pre blockquote section article main nav header footer aside form body".split())
_FOREIGN = {"foreignobject", "annotation-xml", "desc", "mtext"}
_HOLDERS = {"li", "dt", "dd", "td", "th", "tr", "figcaption", "caption", "address", "summary"}
#: Of these, the ones that hold reader comments: they may well have most of a page's words.
_COMMENT_NAMES = set("comment comments commentlist discussion replies reply disqus respond".split())
#: Beside a word of _OUT_NAMES these make a name of the same sense: site-header, comment-list, sidebar-left.
_NEUTRAL = set(
    "site page main global top bottom left right primary secondary container wrapper wrap inner outer box block area section list bar item items unit slot text link links form "
    "posts articles stories news button buttons icon icons card cards label logo trail pills row col column panel group holder fixed sticky mobile desktop region module".split()
)
#: A name that begins so says what an element has or lacks, not what it is.
_MODIFIERS = {"has", "no", "not", "non", "with", "without", "is"}
#: Words of _OUT_NAMES that also name everyday things. Alone, they leave nothing out in an <article> but link lists.
_EVERYDAY = {"banner", "menu", "share", "sharing", "side", "search", "header", "related", "recommended", "respond", "discussion"}
#: Elements that stand in a line of text: what they hold is left out, but they don't end a block.
_CONTROLS = {"button", "select", "input", "textarea", "svg", "math", "canvas", "object", "iframe", "noscript", "script", "style", "template", "label", "output", "meter", "progress", "audio", "video", "map", "datalist"}
_HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
_MAIN_TAGS = {"article", "main"}
_MAIN_NAMES = {"article", "main", "content", "post", "entry", "story", "body-text", "articlebody", "post-content", "entry-content", "article-body", "main-content"}
_SPLIT = re.compile(r"[^a-z0-9]+")
_SPACE = re.compile(r"\s+")


class _Page:
    """The tokens of a page, found one after the other, in time linear in its length.

    A quoted value may hold '>'. From the first tag on whose quotes don't let it end, tags end at the next '>'. A tag that
    the page ends in is dropped with what is left, as browsers do.
    """

    def __init__(self, html: str):
        self.html = html
        self.plain = len(html)  # from here on, quotes don't count
        self.last = html.rfind(">")
        self.comment = html.rfind("<!--")

    def next(self, at: int):
        """The first token at or after ``at``; None if there is none."""
        while (m := _OPENS.search(self.html, at)) and (m.start() < self.last or m.start() <= self.comment):
            start = m.start()
            if start < self.plain:
                if found := _TOKEN.match(self.html, start):
                    return found
                self.plain = min(self.plain, start)
            if found := _PLAIN_TOKEN.match(self.html, start):
                return found
            at = start + 1
        return None

    def end(self, at: int) -> int:
        """Where the text after the last token ends: at a tag that the page ends in, or at the page's end."""
        m = _OPENS.search(self.html, at)
        return m.start() if m else len(self.html)


def _attributes(attrs: str) -> dict[str, str]:
    """Values by lower-case name, empty where there is none; the first of those that repeat."""
    out: dict[str, str] = {}
    for m in _ATTRIBUTE.finditer(attrs):
        out.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")
    return out


def _names(attrs: str, ids: bool = True) -> list[list[str]]:
    """The names in class, id and role, each as the words between its hyphens; names such as has-sidebar are left out."""
    own = _attributes(attrs) if attrs else {}
    values = [own[a].lower() for a in ("class", "id", "role") if a in own and (ids or a != "id")]
    split = [[w for w in _SPLIT.split(n) if w] for v in values for n in v.split()]
    return [n for n in split if n and (len(n) == 1 or n[0] not in _MODIFIERS)]


def _out_names(names: list[list[str]], article: bool) -> set[str]:
    """The words of _OUT_NAMES in names that as a whole say so; none if another name says main text."""
    if any("-".join(n) in _MAIN_NAMES for n in names):
        return set()
    if article and all(len(n) == 1 and n[0] in _EVERYDAY or not any(w in _OUT_NAMES for w in n) for n in names):
        return set()
    held = {w for n in names if all(w in _OUT_NAMES or w in _NEUTRAL or w[0].isdigit() or i and w in ("content", "body") for i, w in enumerate(n)) for w in n if w in _OUT_NAMES}
    return held - {"header"} if article else held


def _unseen(attrs: str) -> bool:
    own = _attributes(attrs) if attrs else {}
    return "hidden" in own or own.get("aria-hidden", "").strip().lower() == "true" or bool(_NO_DISPLAY.search(own.get("style", "")))


class _Element:
    """own: why it is out itself, if it is: 'tag', 'wrapper', 'name', 'comment' or 'unseen'. settle() sets the rest."""

    __slots__ = ("tag", "names", "parent", "own", "out", "main", "article", "marked", "named", "within", "everyday")

    def __init__(self, tag: str, names: list[list[str]], parent: "_Element | None", attrs: str):
        self.tag, self.names, self.parent = tag, names, parent
        self.within = tag == "article" or parent is not None and parent.within  # in an <article>, out or not
        inside = parent is not None and parent.within
        said = _out_names(names, self.within) if names and tag not in ("html", "body", "article", "main") else ()
        #: Has an everyday name in an <article>: out if it turns out to be a list of links.
        self.everyday = inside and not said and tag not in _LEAF and bool(_out_names(names, False))
        self.own = (
            "unseen" if _unseen(attrs)
            else "comment" if said and said & _COMMENT_NAMES or tag == "article" and any(n[0] in ("comment", "comments", "reply") for n in names)
            else "wrapper" if tag in ("form", "fieldset")
            else "tag" if tag in _OUT_TAGS and not (tag == "header" and self.within)
            else "name" if said else ""
        )
        self.settle()

    def settle(self) -> None:
        up = self.parent
        self.out = bool(self.own) or up is not None and up.out
        self.article = up is not None and up.article or self.tag == "article"
        self.main = not self.out and (self.tag in _MAIN_TAGS or self.tag not in ("html", "body") and any(w in _MAIN_NAMES for n in self.names for w in [*n, "-".join(n)]))
        self.marked = not self.out and self.tag in _MAIN_TAGS or up is not None and up.marked
        self.named = self.main or up is not None and up.named


def page_tokens(html: str) -> list[tuple[str, str, _Element, bool]]:
    """The tokens of scan, once forms and elements that are out by name are taken in again where they wrap the main text:
    where every <article> and <main> would be out, those around the one with the most words; where there is none to hold,
    those with more than half of the page's plain words, unless they are comments."""
    tokens = list(scan(html))
    elements = list({id(e): e for _, _, e, _ in tokens}.values())  # parents before children
    _settle_everyday(tokens, elements)
    wraps = {id(e) for e in elements if e.own in ("wrapper", "name", "comment") and e.tag not in _LEAF and e.tag != "article"}
    if not wraps or any(e.tag in _MAIN_TAGS and not e.out for e in elements):
        return tokens
    words: Counter = Counter()
    for kind, value, e, link in tokens:
        if kind == "text" and not link:
            words[id(e)] += len(value.split())
    for e in reversed(elements):
        if e.parent is not None:
            words[id(e.parent)] += words[id(e)]
    shut = set()  # elements that stay out
    for e in elements:
        if e.own and id(e) not in wraps or e.parent is not None and id(e.parent) in shut:
            shut.add(id(e))
    if mains := [e for e in elements if e.tag in _MAIN_TAGS and id(e) not in shut]:
        x = max(mains, key=lambda e: words[id(e)])
        while x is not None:
            x.own, x = "", x.parent
    else:
        half = max(words.values(), default=0) / 2
        for e in elements:
            if id(e) in wraps and e.own != "comment" and words[id(e)] > half:
                e.own = ""
    for e in elements:
        e.settle()
    return tokens


def _settle_everyday(tokens: list[tuple[str, str, _Element, bool]], elements: list[_Element]) -> None:
    """Elements with an everyday name in an <article> are out where links hold more of their words than plain text does."""
    if not any(e.everyday for e in elements):
        return
    plain: Counter = Counter()
    for kind, value, e, link in tokens:
        if kind == "text":
            plain[id(e)] += len(value.split()) * (-1 if link else 1)
    for e in reversed(elements):
        if e.parent is not None:
            plain[id(e.parent)] += plain[id(e)]
    for e in elements:
        if e.everyday and not e.own and plain[id(e)] < 0:
            e.own = "tag"
    for e in elements:
        e.settle()


def _end_of(page: _Page, at: int, tag: str, here: _Element) -> int:
    """Where the leaf block or raw element ``tag`` that begins before ``at`` ends: at its end tag, at a tag that closes it
    without one, or at its parent's end. One that must have an end tag but has none ends at the next block."""
    html = page.html
    if tag in _TEXT_ONLY:
        end = re.compile(rf"</{tag}(?![\w-])[^>]*+>", re.I).search(html, at)
        return end.start() if end else len(html)
    above = {"body", "html"}
    x = here
    while x is not None:
        above.add(x.tag)
        x = x.parent
    closers, shields = _CLOSED_BY.get(tag, (set(), set()))
    if tag in ("svg", "math"):
        closers, shields = _BREAK_OUT, _FOREIGN
    lenient = tag == "p" or tag in _CLOSED_BY or tag in _RAW
    opened: Counter = Counter()
    block = stop = None
    while stop is None and (m := page.next(at)):
        at = m.end()
        if not m[2]:
            continue
        name, closing = m[2].lower(), bool(m[1])
        if closing:
            if opened[name]:
                opened[name] -= 1
            elif name == tag:
                return m.start()
            elif name in above or name in _HOLDERS or name == "p" and tag in _RAW:
                stop = m.start()
        elif name in _TEXT_ONLY:
            end = re.compile(rf"</{name}[^>]*+>", re.I).search(html, at)
            at = end.end() if end else len(html)
        elif name not in _VOID and name not in _INLINE or name == "hr":
            drawn = opened["svg"] or opened["math"]
            if tag == "p" and (name in _BREAK_OUT or not drawn and name not in _RAW) or name in closers and not any(opened[s] for s in shields):
                return m.start()
            if block is None and name not in _RAW:
                block = m.start()
            if name == tag and not lenient:
                stop = m.start()
            elif name != "hr" and not m[3].endswith("/"):
                opened[name] += 1
    stop = len(html) if stop is None else stop
    return stop if lenient or block is None else block


def scan(html: str) -> Iterator[tuple[str, str, _Element, bool]]:
    """(kind, value, element, link) in page order. kind 'text': value is raw text; 'tag': its name ('/' before an end).

    Elements that form the page's structure nest; leaf blocks and inline tags only pass by, closed or not.
    """
    at, top = 0, _Element("html", [], None, "")
    here, link, n = top, False, len(html)
    page = _Page(html)
    while at < n:
        m = page.next(at)
        if m is None:
            yield "text", html[at : page.end(at)], here, link
            return
        if m.start() > at:
            yield "text", html[at : m.start()], here, link
        at = m.end()
        if not m[2]:
            continue
        tag, closing = m[2].lower(), bool(m[1])
        if tag in _RAW and not closing:
            if not m[3].endswith("/"):
                at = _end_of(page, at, tag, here)
                own = re.compile(rf"</{tag}(?![\w-])[^>]*+>", re.I).match(html, at)
                at = own.end() if own else at
            yield "tag", tag, here, link
            continue
        if tag == "a":
            link = not closing
        elif tag in _INLINE or tag in _VOID or tag in _LEAF:
            if tag in _LEAF:
                link = False
            names = _names(m[3], tag not in _HEADINGS) if tag in _LEAF and m[3] and not closing else None
            if names and tag != "hr" and _out_names(names, here.within):  # a leaf block that is a notice or the like, up to its end
                stop = _end_of(page, at, tag, here)
                inner = _Element(tag, names, here, m[3])
                yield "tag", tag, inner, link
                yield "text", re.sub(r"<[^>]*>", " ", html[at:stop]), inner, link
                at = stop
                continue
        elif not closing:
            if not m[3].endswith("/"):
                here = _Element(tag, _names(m[3]), here, m[3])
            link = False
        else:
            x = here
            while x is not top and x.tag != tag:
                x = x.parent
            if x is not top:
                here = x.parent
            link = False
        yield "tag", "/" + tag if closing else tag, here, link


def _tag_key(value: str) -> str:
    name = value.lstrip("/")
    return "tag:" + (name if name in _KNOWN else "other")


def _word_key(element: _Element, link: bool) -> str:
    return "out" if element.out else "link" if link else "word"


def default_weights() -> dict[str, float]:
    return {"word": 1.0, "link": -0.5, "out": -2.0, "tag": -1.0, "beside": -1.0}


def count_tokens(html: str) -> Counter | None:
    """(key, inside the article) counts of a page with exactly one <article>; None for others."""
    tokens = page_tokens(html or "")
    articles = sum(kind == "tag" and value == "article" for kind, value, _, _ in tokens)
    if articles != 1:
        return None
    out: Counter = Counter()
    for kind, value, element, link in tokens:
        key = _tag_key(value) if kind == "tag" else _word_key(element, link)
        out[key, element.article] += 1 if kind == "tag" else len(value.split())
    return out


def learn(counts: dict[tuple[str, bool], int]) -> dict[str, float]:
    """Weights: words get the log odds of lying inside, at least a little above 0 in plain text; tags at most -0.2."""
    weights = default_weights()
    inside, outside = (sum(n for (_, i), n in counts.items() if i is side) + 1 for side in (True, False))
    for key in {k for k, _ in counts}:
        odds = math.log((counts.get((key, True), 0) + 0.5) / inside) - math.log((counts.get((key, False), 0) + 0.5) / outside)
        if key.startswith("tag:"):
            weights[key] = -0.2 - min(3.0, max(0.0, -odds))
        else:
            weights[key] = max(0.25, min(2.0, odds)) if key == "word" else min(-0.1, max(-4.0, odds))
    return weights


def best_region(scores: list[float]) -> tuple[int, int]:
    """(first, end) of the contiguous run with the largest sum, in one scan; (0, 0) if no score is positive."""
    best, span, total, start = 0.0, (0, 0), 0.0, 0
    for i, s in enumerate(scores):
        if total <= 0:
            total, start = 0.0, i
        total += s
        if total > best:
            best, span = total, (start, i + 1)
    return span


def maximal_regions(scores: list[float]) -> list[tuple[int, int, float]]:
    """(first, end, sum) of all maximal contiguous runs, in order: none can be made longer or shorter for a higher sum. One
    scan: a positive score begins a run; a run swallows the runs back to the nearest that began lower, if that ended
    lower too. Each run knows that nearest one."""
    runs: list[tuple[int, int, float, float, int]] = []  # first, end, sum before, sum behind, the nearest that began lower
    total = 0.0
    for i, s in enumerate(scores):
        first, low, total = i, total, total + s
        if s <= 0:
            continue
        while True:
            j = len(runs) - 1
            while j >= 0 and runs[j][2] >= low:
                j = runs[j][4]
            if j < 0 or runs[j][3] >= total:
                runs.append((first, i + 1, low, total, j))
                break
            first, low = runs[j][0], runs[j][2]
            del runs[j:]
    return [(a, b, high - low) for a, b, low, high, _ in runs]


def kept_regions(scores: list[float], share: float = SHARE) -> list[tuple[int, int]]:
    """The best region and all maximal ones with at least a share of its sum, in order."""
    first, end = best_region(scores)
    least = share * sum(scores[first:end])
    return sorted({(first, end), *((a, b) for a, b, s in maximal_regions(scores) if s >= least and (b <= first or a >= end))})


def _claim(tokens: list[tuple[str, str, _Element, bool]]) -> str | None:
    """Which elements claim the main text: the first of article, marked, named that holds half of the plain words."""
    # links count where an element says that it is the text: an article may be no more than a link
    plain = [(e, len(v.split())) for k, v, e, link in tokens if k == "text" and not e.out and (not link or e.article or e.marked)]
    half = sum(n for _, n in plain) / 2
    for kind in ("article", "marked", "named"):
        held = sum(n for e, n in plain if getattr(e, kind))
        if held and held >= half:
            return kind
    return None


def token_scores(tokens: list[tuple[str, str, _Element, bool]], weights: dict[str, float]) -> list[float]:
    """The score of each token. In an <article> or <main> that claims the page, all words are text and tags cost nothing."""
    claim = _claim(tokens)
    out = []
    for kind, value, e, link in tokens:
        inside = claim is not None and getattr(e, claim)
        if inside and e.out:
            s = 0.0  # left out anyway; it must not part the text before it from the text after it
        elif kind == "tag":
            s = weights.get(_tag_key(value), weights["tag"])
            s = s if not inside else max(s, -0.2) if claim == "named" else 0.0
        else:
            key = _word_key(e, link)
            key = key if claim is None else "word" if inside and claim != "named" else "beside" if not inside and key == "word" else key
            s = weights[key] * len(value.split())
        out.append(s)
    return out


def extract(html: str | None, weights: dict[str, float] | None = None) -> str:
    """The main text: blocks in page order, joined by two line breaks; empty where there is none."""
    weights = weights or default_weights()
    tokens = page_tokens(html or "")
    regions = kept_regions(token_scores(tokens, weights))
    inside = np.zeros(len(tokens) + 1, np.int8)
    for first, end in regions:
        inside[first] += 1
        inside[end] -= 1
    inside = np.cumsum(inside).astype(bool).tolist()
    low, high = regions[0][0], regions[-1][1]
    around = {id(e) for (k, v, e, _), i in zip(tokens, inside, strict=False) if i and k == "text" and not e.out and not v.isspace() and e.tag not in ("html", "body")}
    blocks: list[str] = []
    waiting: list[str] = []  # blocks of links only since the last block that counts
    parts: list[str] = []
    touched = plain = between = False
    links = held = 0  # links in the open block, and in those that wait

    def close() -> None:
        nonlocal touched, plain, between, links, held
        if parts:
            text = _SPACE.sub(" ", unescape("".join(parts))).strip()
            parts.clear()
            if text and touched:
                if held <= LINKS:
                    blocks.extend(waiting)
                waiting.clear()
                held = 0
                blocks.append(text)
            elif text and between and not plain:
                waiting.append(text)
                held += links
        touched = plain = between = False
        links = 0

    for i, (kind, value, e, link) in enumerate(tokens):
        if kind == "tag":
            name = value.lstrip("/")
            if name == "br":
                parts.append(" ")
            elif name not in _INLINE and name not in _CONTROLS:
                close()
            elif value == "a":
                links += 1
        elif e.out:
            if e.tag in _CONTROLS:
                parts.append(" ")
            else:
                close()
        else:
            parts.append(value)
            if not value.isspace():
                touched = touched or inside[i] or not link and (low <= i < high or id(e) in around)
                between = between or low <= i < high
                plain = plain or not link
    close()
    return "\n\n".join(blocks)


def train(pages: DataFrame, bound: int = MAX_LABELLED) -> dict[str, float]:
    """Weights from about ``bound`` pages at most, whole, drawn by a hash of id and html; defaults if none is labelled. Only
    counts for a fixed set of names reach the driver, however many equal pages are drawn."""
    small_batches(pages.sparkSession, 500)
    share = min(1.0, bound / max(1, pages.select("page_id").count()))
    sample = pages.where("html is not null").where(F.pmod(F.xxhash64("page_id", "html"), F.lit(1 << 30)) < int(share * (1 << 30))).select("html")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: Counter = Counter()
        for b in batches:
            for html in b["html"]:
                total.update(count_tokens(html) or {})
        rows = [(k, i, n) for (k, i), n in total.items()]
        yield pd.DataFrame(rows, columns=["key", "inside", "n"])

    sums = sample.mapInPandas(run, "key string, inside boolean, n long").groupBy("key", "inside").agg(F.sum("n").alias("n"))
    return learn({(r["key"], r["inside"]): r["n"] for r in sums.collect()})  # at most two rows for each key of a fixed set


def main_text(pages: DataFrame) -> DataFrame:
    """One row per page: page_id, url, text, n_chars (code points).

    Null or empty html has the empty text. Malformed html is read as browsers do where a tag is left open, and a page of any
    length is read whole, in time linear in it. Of regions with equal scores the first counts. Repeated rows stay rows of their own, null ids and urls are passed on, and
    an empty table gives no rows. Other columns are not read.
    """
    weights = train(pages)
    small_batches(pages.sparkSession, 500)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [extract(h.as_py(), weights) for h in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")
