"""Main text of web pages from flat text blocks and a decision tree.

A page is cut into flat text blocks at block-level tags. Each block has its word count and link density, those of
its neighbours, the longest plain text before and after it and the plain text of its container against that of the page's fullest, so that
short headings, lines of dialogue and paragraphs of one link go by the text around them. Then there is what markup says of its place:
inside an article, inside an element for menus, footers, asides or forms, or inside one whose class or id has a name of page furniture. Names of layout (sidebar, header, related) are a weak sign and names of
adverts, notices and reader comments a stronger one. A decision tree on these features, trained here on the labelled pages below,
tells main text from the rest.

Null html gives an empty text. Comments and quotes without an end, scripts and styles end at the end of the page; other embedded
elements (svg, iframe, select, ...) that are self-closed or never closed are skipped alone. Open links and paragraphs end with the
block around them. Pages without text, and pages of furniture only, give an empty text. Very long pages are read whole, in linear
time. Rows with equal page_id are extracted one by one; columns beside page_id, url and html are not read. An empty table gives no
rows.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<[!?][^>]*+>"
    r"|<(/?)([A-Za-z][A-Za-z0-9:-]*+)((?:[^>\"']|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|</?[A-Za-z][^>]*+>",
    re.S,
)
_NAMES = re.compile(r"\b(?:class|id|role|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_HIDDEN = re.compile(r"(?:^|\s)hidden(?=[\s=]|$)|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", re.I)
# Tags and name parts that mark places of a page.
BLOCK_TAGS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre search section summary table tbody td tfoot th thead title tr ul".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW_TAGS = frozenset("script style".split())
EMBEDDED_TAGS = frozenset("noscript template iframe object svg math textarea select canvas audio video".split())
OUTSIDE_TAGS = frozenset("nav footer aside form menu dialog head title button option fieldset label search".split())
LAYOUT_NAMES = frozenset(
    "banner banners nav navbar navigation navi menu menus breadcrumb breadcrumbs sidebar side aside footer foot header masthead topbar toolbar related recommended share sharing social "
    "pagination pager widget widgets search searchform contentinfo complementary skip tags promo promotion login".split()
)
FOREIGN_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored sponsors cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup "
    "comment comments commentlist disqus reply replies respond discussion hidden".split()
)
CONTAINER_TAGS = frozenset("html body div section article main center td header footer aside nav form".split())
_SPLIT = re.compile(r"[^a-z]+")


class Block:
    __slots__ = ("text", "words", "links", "article", "outside", "named", "heading", "item", "container")


def _named(attrs: str) -> int:
    """0 nothing, 1 a name of layout, 2 a name of adverts, notices or comments, or hidden."""
    if _HIDDEN.search(attrs):
        return 2
    found = 0
    for m in _NAMES.finditer(attrs):
        for part in _SPLIT.split((m[1] or m[2] or m[3] or "").lower()):
            if part in FOREIGN_NAMES:
                return 2
            if part in LAYOUT_NAMES:
                found = 1
    return found


class _Reader:
    """Open elements and the text gathered for the next block."""

    def __init__(self):
        self.out: list[Block] = []
        self.stack: list[tuple[str, bool, int, bool, int, bool]] = []  # tag, outside, named, in an article, container, inline and foreign
        self.containers = 0
        self.parts: list[str] = []
        self.linked: list[str] = []
        self.foreign: list[str] = []  # text of inline adverts and the like, which stand inside a block without being part of it
        self.anchors = self.inline = 0
        self.own = "p"

    def place(self) -> tuple[bool, int, bool]:
        return self.stack[-1][1:4] if self.stack else (False, 0, False)

    def _block(self, parts: list[str], linked: list[str], named: int) -> None:
        text = " ".join(html.unescape("".join(parts)).split())
        if text:
            b = Block()
            b.text, b.words = text, text.count(" ") + 1
            b.links = min(b.words, len(html.unescape(" ".join(linked)).split()))
            b.outside, own, b.article = self.place()
            b.named = max(own, named)
            b.container = self.stack[-1][4] if self.stack else 0
            b.heading, b.item = self.own[0] == "h" and self.own[1:].isdigit(), self.own in ("li", "dt", "dd", "td", "th")
            self.out.append(b)

    def flush(self) -> None:
        if self.parts:
            self._block(self.parts, self.linked, 0)
            self.parts = []
        if self.foreign:
            self._block(self.foreign, [], 2)
            self.foreign = []
        self.linked = []

    def take(self, text: str) -> None:
        if not text:
            return
        if self.inline:
            self.foreign.append(text)
            return
        self.parts.append(text)
        if self.anchors:
            self.linked.append(text)

    def cut(self, k: int) -> None:
        """Close the elements from place ``k`` on."""
        for tag, *_, inline in self.stack[k:]:
            self.anchors -= tag == "a"
            self.inline -= inline
        del self.stack[k:]

    def close(self, tag: str) -> None:
        for k in range(len(self.stack) - 1, -1, -1):
            if self.stack[k][0] == tag:
                self.cut(k)
                return

    def close_inside(self, tags: tuple[str, ...], until) -> None:
        """Close the innermost open element of ``tags`` unless one of ``until`` is nearer."""
        for k in range(len(self.stack) - 1, -1, -1):
            if self.stack[k][0] in tags:
                self.cut(k)
                return
            if self.stack[k][0] in until:
                return

    def open(self, tag: str, attrs: str) -> None:
        outside, named, article = self.place()
        block = tag in BLOCK_TAGS
        if block:
            self.close_inside(("p",), BLOCK_TAGS)
            if tag == "li":
                self.close_inside(("li",), ("ul", "ol", "menu"))
            elif tag in ("td", "th", "tr"):
                self.close_inside(("td", "th") if tag != "tr" else ("tr",), ("table", "tr") if tag != "tr" else ("table",))
            outside, named, article = self.place()
        elif tag == "a" and self.anchors:
            self.close("a")
        inside = tag in ("article", "main")
        if inside and named == 1:
            named = 0  # a name of the layout around an article says nothing of the article
        own = 0 if tag in ("html", "body") or inside or not attrs else _named(attrs)
        if tag == "header" and article:
            own = 0  # the heading part of an article
        inline = not block and own == 2 and tag != "a"
        if not block:
            own = 0  # inside a block only foreign names count, and only for the text in them
        self.anchors += tag == "a"
        self.inline += inline
        outside = outside or tag in OUTSIDE_TAGS or tag == "header" and not article
        if tag in CONTAINER_TAGS and not (article and not max(named, own) and not outside):  # an article is one container with all its sections
            self.containers += 1
            container = self.containers
        else:
            container = self.stack[-1][4] if self.stack else 0
        self.stack.append((tag, outside, max(named, own), article or inside, container, inline))


def blocks(page: str) -> list[Block]:
    """Flat text blocks of a page in order."""
    r, low, ends = _Reader(), None, {}
    at = 0
    while m := _TOKEN.search(page, at):
        if m.start() > at:
            r.take(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        tag, closing = m[2].lower(), m[1] == "/"
        if tag == "br":
            r.take(" ")
            continue
        if tag in RAW_TAGS or tag in EMBEDDED_TAGS:
            if closing or (m[3][-1:] == "/" and tag not in RAW_TAGS):
                continue
            if low is None:
                low = page.lower() if page.isascii() else re.sub("[A-Z]", lambda c: c[0].lower(), page)  # keeps all positions
            close = _next(low, f"</{tag}", at, ends)
            if close < 0:
                if tag in RAW_TAGS:
                    at = len(page)
                continue
            again = _next(low, f"<{tag}", at, ends)
            if tag in EMBEDDED_TAGS and 0 <= again < close:
                continue  # never closed: the end tag belongs to the next one
            at = close
            continue
        if tag in BLOCK_TAGS:
            r.flush()
            if not closing:
                r.own = tag
        if tag in VOID_TAGS:
            continue
        if closing:
            r.close(tag)
        elif m[3][-1:] != "/" or tag == "a":
            r.open(tag, m[3])
    r.take(page[at:])
    r.flush()
    return r.out


def _next(text: str, what: str, at: int, known: dict[str, int]) -> int:
    """Place of ``what`` from ``at`` on, -1 if there is none; found places are kept, so that a page is searched once."""
    if what not in known or 0 <= known[what] < at:
        known[what] = text.find(what, at)
    return known[what]


FEATURES = ("words", "links", "words_before", "links_before", "words_after", "links_after", "place", "heading", "item", "page_has_article", "text_before", "text_after", "share")


def features(found: list[Block]) -> np.ndarray:
    """One row of ``FEATURES`` a block: its words and link density, those of the blocks before and after, its place and its share.

    Plain text are the words outside links of blocks that markup does not call furniture. The place is 0 in furniture by its tag or a
    strong name, 1 under a name of layout, 2 under none of them and 3 in an article without them.
    """
    n = len(found)
    x = np.zeros((n, len(FEATURES)))
    for k, b in enumerate(found):
        x[k, 0], x[k, 1] = b.words, b.links / b.words
        x[k, 6:9] = 0 if b.outside or b.named == 2 else 1 if b.named else 2 + b.article, b.heading, b.item
    x[1:, 2:4] = x[:-1, 0:2]
    x[:-1, 4:6] = x[1:, 0:2]
    if n:
        x[:, 9] = any(b.article for b in found)
        plain = np.array([(b.words - b.links) * (not b.outside and not b.named) for b in found])
        x[1:, 10] = np.maximum.accumulate(plain)[:-1]
        x[:-1, 11] = np.maximum.accumulate(plain[::-1])[::-1][1:]
        held = np.bincount([b.container for b in found], plain)
        x[:, 12] = held[[b.container for b in found]] / max(1, held.max())
    return x


# The labelled pages: {12} stands for twelve words, [3] for a link of three, and @ begins a block that is main text.
_MENU = "<nav><ul><li>[1]<li>[2]<li>[1]<li>[1]</ul></nav>"
_FOOT = "<footer><p>{9}</p><p>[2] [2] [1]</p></footer>"
LABELLED = [
    f"<head><title>{{6}}</title></head><body>{_MENU}<article><h1>@{{6}}</h1><p>@{{60}}<p>@{{30}} [4]<p>@{{3}}<p>@{{1}}<p>@{{45}}</article>{_FOOT}",
    f"<head><title>{{6}}</title></head>{_MENU}<div class=ad><p>{{12}}</p></div><article><h1>@{{4}}</h1><p>@{{1}}<p>@{{120}}<ul><li>@{{5}}<li>@{{7}}<li>@{{2}} [2]</ul></article>{_FOOT}",
    f"<header><p>{{5}}</p></header>{_MENU}<article><p>@{{40}}<p>@{{2}}<div class=share>[1] [1] [2]</div></article><aside><p>{{30}} [6]</p></aside><div class=comments><p>{{45}}</p><p>{{8}}</p></div>{_FOOT}",
    f"<div class='cookie notice'><p>{{20}} [2]</p></div>{_MENU}<main><h1>@{{8}}</h1><p>@{{50}} [3]<p>@{{15}} [15]<p>@{{25}}</main><div class=sidebar><p>{{18}}</p><p>[3]</p></div><form><p>{{6}}</p></form>",
    "<ul><li>[1]<li>[2]<li>[1]</ul><h1>@{7}</h1><p>@{55}<p>@{80} [2]<p>@{22} [3]<p>@{14}<p>@{61}<p>{1}",
    "<div><a href=x>{3}</a> {1}</div><div>[4]</div><div>@{70}</div><div>@{14}</div><div>@{90}</div><div>@{9}</div><div>@{64}</div><ul><li>[3]<li>[3]</ul><div>{2}</div>",
    f"{_MENU}<div class=newsletter><p>{{40}}</p></div><div class=content><h2>@{{5}}</h2><p>@{{45}} [5]<p>@{{20}}<p>@{{33}}</div><div class=related><ul><li>[9]<li>[8]<li>[7]</ul></div>{_FOOT}",
    "<article><p>@{2}<p>@[4]<p>@{1}</article><footer><p>{40}</p></footer>",
    "<div class=ad><p>{60}</p></div><article><h1>@{12}</h1><p>@{12}<p>@{15}<table><tr><td>@{2}<td>@{3}<tr><td>@{4}<td>@{1}</table></article><div class=comment><p>{90}</p></div>",
    "<ul><li>[2]<li>[2]<li>[3]</ul><p>{1}</p><p>{6}</p><ul><li>[2]<li>[2]</ul>",
    f"{_MENU}<div class=ad><p>{{9}}</p></div><article><p>@{{60}}<div class=ad><p>{{20}}</p></div><p>@{{70}} <span class=ad>{{5}}</span><div class=share><p>{{3}} [3]</p></div><p>@{{40}}<div class=comments><p>{{50}}</p><p>{{30}}</p></div></article>",
    f"<div class=ad><p>{{14}}</p></div><article><h1>@{{20}}</h1><p>@{{25}}<div class=related><ul><li>[8]<li>[9]</ul></div><div class=newsletter><p>{{25}}</p></div><p>@{{4}}</article>{_FOOT}",
    "<div id=cookie><p>{30}</p></div><div class=ad><p>{25}</p></div><p>@{80}</p><p>@{60}</p><div class=ad><p>{35}</p></div><p>@{44} [4]</p><p>@{12}</p><p>@{50}</p><div id=comments><p>{60}</p><p>{25}</p></div>",
    "<div class=banner><p>{10}</p></div><main><h1>@{15}</h1><p>@{66}<aside><p>{40}</p></aside><p>@{18}<aside><p>{16}</p></aside><p>@{90}</main>",
    "<div class='page has-sidebar'><h1>@{6}</h1><p>@{75}</p><p>@{90}</p><p>@{48} [2]</p><p>@{110}</p></div><div class=sidebar><p>{20} [3]</p><ul><li>[2]<li>[4]</ul></div>",
    f"{_MENU}<article><h1>@{{5}}</h1><section class='related work'><h2>@{{2}}</h2><p>@{{80}}</p><p>@{{66}} [3]</p></section><section id=header-format><p>@{{70}}</p><p>@{{52}}</p></section></article><div class='footer links'><p>{{8}}</p><p>[2] [2]</p></div>",
    "<div class=header><p>{4}</p><p>[2] [2]</p></div><h1>@{9}</h1><p>@{35}<p>@{12}<p>@{8}<p>@{40}<p>@{28}<div class=footer><p>{12}</p></div>",
    "<div class=sidebar><p>{35}</p><p>{22} [4]</p></div><div><p>@{52}</p><p>@{24}</p><p>@{31}</p></div><div class=menu><p>[1] [1]</p></div><div class=promo><p>{26}</p></div>",
    f"<head><title>{{6}}</title></head><body>{_MENU}<div class=content><h1>@{{4}}</h1><p>@{{55}}</p><h2>@{{2}}</h2><p>@{{60}}</p><p>@{{3}}</p><p>@{{58}}</p><p>@[10]</p><p>@{{50}}</p><p>@{{2}}</p></div>{_FOOT}",
    "<div id=top><p>[2] [2] [1]</p></div><div id=text><h1>@{3}</h1><p>@{2}</p><p>@{4}</p><p>@{6}</p><p>@{48}</p><p>@{5}</p><p>@{3}</p><p>@{70}</p><p>@{4}</p></div><div><p>{5}</p><p>[2] [1]</p></div>",
    f"{_MENU}<section><h1>@{{7}}</h1><h3>@{{2}}</h3><p>@{{52}}</p><ul><li>@{{3}}<li>@{{2}}<li>@{{9}}<li>@[5]</ul><p>@{{57}}</p><blockquote>@{{6}}</blockquote><p>@{{1}}</p></section><div class=sidebar><p>[4]</p><p>{{5}}</p></div>{_FOOT}",
    "<table><tr><td><p>[1]</p><p>[2]</p><p>[1]</p><p>[3]</p></td><td><h2>@{5}</h2><p>@{66}</p><p>@{3}</p><p>@{59} [2]</p><p>@[9]</p><p>@{44}</p></td><td><p>{12} [3]</p><p>[4]</p></td></tr></table>",
    f"{_MENU}<article><h1>@{{5}}</h1><p>@{{50}}</p><p>@[10]</p><p>@[14]</p><p>@{{3}}</p><ul><li>@[7]<li>@[12]</ul><p>@{{61}}</p><div class=related><ul><li>[9]<li>[12]</ul></div></article>{_FOOT}",
    "<ul><li>[1]<li>[1]<li>[2]</ul><h1>@{5}</h1><p>@{60}</p><h2>@{3}</h2><p>@{52}</p><p>@{4}</p><p>@{55}</p><p>@{2}</p><hr><div>{6} [2]</div><div>[1] [1]</div>",
    "<p>@{60}<p>@{33}<p>{1}", "<h1>@{4}</h1><p>@{75}<p>@{20}<p>{1}", "<ul><li>[1]<li>[1]</ul><p>@{90}<p>@{44}<p>{1}", "<p>@{50}<p>@{20}<p>@{40}<p>{1}",
    "<p>@{12}</p>", "<div><p>@{4}</p><p>@{30}</p></div>", "<h1>@{3}</h1><p>@{18}</p><p>@{2}</p>",
    "<div><div>[1] [2]</div><div>{3}</div></div><div><div>@{50}</div><div>@{4}</div><div>@{65}</div><div>@{2}</div><div>@[8]</div><div>@{58}</div></div><div><div>{7}</div><div>[1] [2] [1]</div></div>",
    "<div class=header>{3}</div><div><h2>@{6}</h2><p>@{25}</p><p>@{8}</p><p>@{31}</p></div><div class=related><p>[7]</p><p>[6]</p></div><div class=comments><p>{40}</p><p>{3}</p></div><div class=footer><p>{6}</p></div>",
]


# Parts of labelled pages: furniture before and after the main text, the main text, and what holds it.
BEFORE = ["", _MENU, "<ul><li>[2]<li>[1]<li>[1]</ul>", "<div id=top><p>[2] [2] [1]</p></div>", "<div class='cookie notice'><p>{20} [2]</p></div>", "<div class=ad><p>{14}</p></div>", "<div class=ad>{60}</div>", "<header><p>{5}</p></header>", "<div class=sidebar><h3>{2}</h3><p>{35}</p><p>{22} [4]</p><ul><li>[3]</ul></div>"]
AFTER = ["", _FOOT, "<div class=comments><h3>{2}</h3><p>{45}</p><p>{4}</p><p>{50}</p></div>", "<div class=related><h3>{2}</h3><ul><li>[9]<li>[8]</ul></div>", "<aside><h3>{3}</h3><p>{25}</p><p>[3]</p></aside>", "<div>{4}</div><div>[1] [1]</div>", "<p>{1}", "<form><p>{6}</p></form>", "<footer>{12}</footer>", "<div class=sponsor><p>{60}</p></div>", "<div class=sidebar><h3>{2}</h3><p>{24}</p><ul><li>[4]<li>[3]</ul></div>"]
BODIES = [
    "<h1>@{5}</h1><p>@{55}<h2>@{2}</h2><p>@{60}<p>@{3}<p>@{58}<p>@[10]<p>@{50}<p>@{3}",
    "<h1>@{3}</h1><p>@{40}<p>@{4}<p>@{2}<p>@{6}<p>@{1}<p>@{48}<p>@{5}<p>@{3}",
    "<h1>@{6}</h1><p>@{70}<p>@{12}<p>@{66}<blockquote>@{5}</blockquote><p>@{59}",
    "<h2>@{4}</h2><p>@{64}<ul><li>@{3}<li>@{8}<li>@[4]<li>@{2}</ul><p>@{2}<p>@{49}",
    "<p>@{250}<p>@{3}<p>@{400}<p>@[6]<p>@{90}",
    "<h1>@{7}</h1><p>@{35}<h3>@{1}</h3><p>@{42}<p>@{6}",
    "<h1>@{4}</h1><p>@{44}<div class=ad><p>{20}</p></div><p>@{3}<p>@{51}<div class=share>[1] [1]</div><p>@{47}",
    "<div><h2>@{4}</h2><p>@{30}<p>@{25}</div><div><h2>@{2}</h2><p>@{62}<p>@{3}<p>@{9}</div><div><p>@{58}<h3>@{1}</h3><p>@{40}</div>",
    "<h1>@{2}</h1><div class=lead>@{22}</div><section><h2>@{4}</h2><p>@{33}</section><section><h2>@{3}</h2><p>@{71}<p>@{20}<p>@{4}</section>",
]
SMALL = ["<p>@{9}", "<h1>@{3}</h1><p>@{6}<p>@[9]", "<p>@[7]<p>@[15]<p>@{5}", "<h1>@{2}</h1><p>@[5]<p>@{11}<p>@[20]<p>@[3]", "<h1>@{8}</h1><p>@{140}<p>@{90}<p>@{1}", "<p>@{300}<p>@{1}<p>@{200}<p>@[3]<p>@{2}", "<p>@{80}<p>@{45}<p>@[4]<p>@{1}", "<h1>@{2}</h1><p>@{7}<p>@[12]", "<h1>@{3}</h1><p>@{5}<p>@{1}<div class=comments><p>{1}</p><p>{6}</p></div>", "<p>@{9}<p>@{12}<div hidden>{2}</div><p>@{14}<span class=ad>{3}</span><p>@{2}", "<h1>@{4}</h1><p>@{8}<div class=ad>{12}</div><p>@{6}<aside>{3}</aside><p>@{3}"]  # in articles only
HOLDERS = ["<article>%s</article>", "<main>%s</main>", "<div>%s</div>", "<div class=content>%s</div>", "<section>%s</section>", "%s"]
COMPOSED, SCALES = 360, (0.7, 1.0, 1.5)


def composed_pages() -> list[str]:
    """``COMPOSED`` labelled pages put together from the parts above; the same ones each time."""
    rng = np.random.default_rng(5)
    one = lambda parts: parts[rng.integers(len(parts))]
    held = lambda i: HOLDERS[i % len(HOLDERS)].replace("%s", one(SMALL if i % len(HOLDERS) == 0 and one((True, False)) else BODIES))
    return [one(BEFORE) + one(BEFORE) + held(i) + (one(AFTER) + one(AFTER) if one((True, True, False)) else "") for i in range(COMPOSED)]


def _rendered(page: str, scale: float) -> str:
    words = lambda m: " ".join(["w"] * max(1, round(int(m[1]) * scale)))
    page = re.sub(r"\[(\d+)\]", lambda m: f"<a href=x>{words(m)}</a>", page)
    return re.sub(r"\{(\d+)\}", words, page)


def labelled_rows() -> tuple[np.ndarray, np.ndarray]:
    """Features of all blocks of the labelled pages, each as it is and with shorter and longer texts, and 1 for main text."""
    found = [blocks(_rendered(p, scale)) for p in LABELLED for scale in SCALES]
    found += [blocks(_rendered(p, SCALES[i % len(SCALES)])) for i, p in enumerate(composed_pages())]
    return np.concatenate([features(f) for f in found]), np.array([int(b.text.startswith("@")) for f in found for b in f])


def _disorder(n: int, ones: int) -> float:
    """Entropy of ``n`` labels, summed over them."""
    return sum(k * float(np.log2(n / k)) for k in (ones, n - ones) if k)


def grow(x: np.ndarray, y: np.ndarray, depth: int = 9, least: int = 4):
    """A decision tree by entropy as nested tuples (feature, threshold, low side, high side), leaves 0 or 1."""
    vote = int(2 * y.sum() >= len(y))
    if depth == 0 or len(y) < 2 * least or y.min() == y.max():
        return vote
    best = None
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        for t in (values[1:] + values[:-1]) / 2:
            low = x[:, f] <= t
            if least <= low.sum() <= len(y) - least:
                score = sum(_disorder(len(s), int(s.sum())) for s in (y[low], y[~low]))
                if best is None or score < best[0] - 1e-12:
                    best = (score, f, float(t), low)
    if best is None:
        return vote
    _, f, t, low = best
    return (f, t, grow(x[low], y[low], depth - 1, least), grow(x[~low], y[~low], depth - 1, least))


def classify(tree, row) -> int:
    while isinstance(tree, tuple):
        f, t, low, high = tree
        tree = low if row[f] <= t else high
    return tree


def main_text(page: str, tree) -> str:
    found = blocks(page)
    rows = features(found).tolist()
    return "\n".join(b.text for b, r in zip(found, rows, strict=True) if classify(tree, r))


def _extract_task(tree):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                texts = [main_text(h or "", tree) for h in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return run


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every row of ``pages(page_id, url, html)``."""
    plain = pages.select(pages["page_id"].cast("long").alias("page_id"), pages["url"].cast("string").alias("url"), pages["html"].cast("string").alias("html"))
    return plain.mapInArrow(_extract_task(grow(*labelled_rows())), "page_id long, url string, text string, n_chars long")
