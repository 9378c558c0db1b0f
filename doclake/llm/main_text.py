"""The main text of web pages by tag-path ratios.

A page is a sequence of text blocks, each under a path of block-level tags from the root. Per path the
length of unlinked text and the punctuation marks of its blocks are averaged (the path's ratios), smoothed
over neighbouring blocks, fused into one score and compared with a threshold that the page itself sets.
Names that mark an element as the article, or as something else, weigh paths by one or nought. The blocks
of the paths that pass, and whatever stands between them in the element that holds them, are the text.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
from pyspark.sql import DataFrame

#: Share of the page's best path score that a path needs.
THRESHOLD = 0.2
#: Weights of a block and its neighbours on either side.
KERNEL = np.array([0.25, 0.5, 0.25])
#: A path of so many blocks, most of it links and without punctuation, is a menu.
MENU_BLOCKS, MENU_LINKS = 3, 0.8
#: Share of the chosen text that an element must hold to be taken whole.
HOLDS = 0.8
BATCH_BYTES = 1 << 24

# What HTML calls its elements, and names that authors give to what is not the article.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
INLINE = set(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr output q ruby rb rp rt s "
    "samp small span strike strong sub sup time tt u var wbr".split()
)
CLOSES_P = set(
    "address article aside blockquote center details dialog dir div dl dd dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre search section summary table ul".split()
)
#: Elements that end an open one of the same group, up to the element that holds them.
SIBLINGS = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}),
}
SCOPES = {"table", "td", "th", "caption", "button", "object", "html", "body"}
NOT_TEXT = set(
    "head title script style noscript template iframe object svg math canvas audio video select datalist textarea "
    "button option map".split()
)
HEADINGS = set("h1 h2 h3 h4 h5 h6".split())
NOT_ARTICLE = set("nav footer aside form menu dialog search fieldset".split())
ROLES = set(
    "navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar tablist".split()
)
NAMES = set(
    "ad ads adv advert adverts advertisement advertising adsense adbox sponsor sponsored sponsors promo promotion "
    "banner nav navbar navigation menu submenu breadcrumb breadcrumbs header masthead topbar footer sidebar sidebars "
    "aside widget widgets cookie cookies consent gdpr notice notices notification notifications alert popup modal "
    "overlay newsletter subscribe subscription signup login search searchbox share sharing social related "
    "recommended recommendations pagination pager toolbar copyright disclaimer".split()
)
REPLIES = set("comment comments commentlist disqus reply replies respond responses discussion".split())
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_TAG = re.compile("</?[A-Za-z]")
_PUNCTUATION = re.compile(r"[.,;:!?…。，、；：！？]")


class Element:
    """An open or closed element: its tag, parent, path and whether its content can be the article."""

    __slots__ = ("tag", "up", "path", "inline", "out", "named", "replies", "holds")

    def __init__(self, tag: str, up: Element | None, path: int, inline: bool) -> None:
        self.tag, self.up, self.path, self.inline = tag, up, path, inline
        self.out = self.named = self.replies = self.holds = False


class Blocks(HTMLParser):
    """A page's text blocks in order: text, characters in links, element and path.

    Tags left open or closed out of turn are read as browsers do, as far as blocks are concerned: a
    paragraph ends where another block begins, cells, items and rows end where the next begin, and inline
    tags never end a block.
    """

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Element("", None, 0, False)
        self.stack = [self.root]
        self.open: Counter = Counter()
        self.paths: dict[tuple[int, str], int] = {}
        self.found: list[tuple[str, int, Element]] = []
        self.parts: list[str] = []
        self.linked = 0
        self.link: Element | None = None
        self.skipped = 0

    # --- elements ---

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in INLINE:
            if tag == "a":
                self._end_inline("a")
            self._push(tag, attrs, True)
            return
        if tag == "br":
            self.parts.append(" ")
        if tag in VOID and tag != "hr":
            return
        if self.open["head"] and tag not in NOT_TEXT:
            self._close({"head"}, SCOPES)  # its end tag may be left out
        if tag in CLOSES_P and self.open["p"]:
            self._close({"p"}, SCOPES)
        if tag in SIBLINGS:
            self._close(*SIBLINGS[tag])
        self._flush()
        if tag not in VOID:
            self._push(tag, attrs, False)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        # a slash in the tag of an element that is not void means nothing in HTML
        self.handle_starttag(tag, attrs)
        if tag in ("svg", "math"):
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        if tag == "br":
            self.parts.append(" ")
        elif not self.open[tag]:
            if tag not in INLINE:
                self._flush()
        elif tag in INLINE:
            self._end_inline(tag)
        else:
            self._flush()
            self._close({tag}, SCOPES - {tag} if tag not in ("table", "body", "html") else set())

    def _push(self, tag: str, attrs: list, inline: bool) -> None:
        up = self.stack[-1]
        given = dict(attrs)
        label = tag if inline or tag[0] == "h" or tag in ("p", "li") else f"{tag}.{given.get('class') or ''}"
        path = up.path if inline else self.paths.setdefault((up.path, label), len(self.paths) + 1)
        element = Element(tag, up, path, inline)
        self._judge(element, given)
        self.stack.append(element)
        self.open[tag] += 1
        self.skipped += tag in NOT_TEXT
        if tag == "a" and given.get("href") is not None:
            self.link = element

    def _judge(self, element: Element, given: dict) -> None:
        tag = element.tag
        inside = any(self.open[t] for t in ("article", "main"))
        role = (given.get("role") or "").lower()
        hidden = "hidden" in given or (given.get("aria-hidden") or "").lower() == "true"
        hidden = hidden or "display:none" in (given.get("style") or "").replace(" ", "").lower()
        element.out = tag in NOT_ARTICLE or (tag == "header" and not inside) or role in ROLES or hidden
        if tag in ("html", "body", "main"):
            element.out = False
        elif given.get("class") or given.get("id"):
            names = {n.lower() for n in _NAME.findall(f"{given.get('class') or ''} {given.get('id') or ''}")}
            element.replies = bool(names & REPLIES)
            if inside or tag in HEADINGS:
                names.discard("header")  # of the article itself
            element.named = bool(names & NAMES)
        if tag == "main" or (tag == "h1" and self.open["article"]):
            # what holds the article is no box beside it, whatever its name
            up = element.up
            while up is not None and not (up.holds or up.out or up.replies):
                up.holds, up = True, up.up

    def _pop(self) -> None:
        element = self.stack.pop()
        self.open[element.tag] -= 1
        self.skipped -= element.tag in NOT_TEXT
        if element is self.link:
            self.link = None

    def _close(self, tags: set[str], scopes: set[str]) -> None:
        """End the innermost open element of ``tags`` and all within, unless one of ``scopes`` holds it."""
        for at in range(len(self.stack) - 1, 0, -1):
            tag = self.stack[at].tag
            if tag in tags:
                self._flush()
                while len(self.stack) > at:
                    self._pop()
                return
            if tag in scopes:
                return

    def _end_inline(self, tag: str) -> None:
        if tag == "a":
            self.link = None
        for at in range(len(self.stack) - 1, 0, -1):
            if self.stack[at].tag == tag:
                # what was opened inside and is still open ends with it; it holds inline elements only
                while len(self.stack) > at:
                    self._pop()
                return
            if not self.stack[at].inline:
                return

    # --- text ---

    def handle_data(self, data: str) -> None:
        if self.skipped:
            return
        if self.stack[-1].inline:
            element = self.stack[-1]
            while element.inline:
                if element.out or element.named or element.replies:
                    return
                element = element.up
        self.parts.append(data)
        if self.link is not None:
            self.linked += len(data)

    def _flush(self) -> None:
        if self.parts:
            text = " ".join("".join(self.parts).split())
            if text:
                element = self.stack[-1]
                while element.inline:
                    element = element.up
                self.found.append((text, min(self.linked, len(text)), element))
            self.parts, self.linked = [], 0

    def close(self) -> None:
        super().close()
        self._flush()


def _known(element: Element, judged: dict[Element, bool], by_name: bool = True) -> bool:
    """Whether ``element`` lies in nothing that a tag, or (``by_name``) a class or id, marks as not the article."""
    above = []
    while element is not None and element not in judged:
        above.append(element)
        element = element.up
    fine = judged[element] if element is not None else True
    for e in reversed(above):
        fine = fine and not (e.out or e.replies or (by_name and e.named and not e.holds))
        judged[e] = fine
    return fine


def _within(element: Element, held: set[Element], seen: dict[Element, bool]) -> bool:
    above = []
    while element is not None and element not in seen and element not in held:
        above.append(element)
        element = element.up
    inside = element is not None and (element in held or seen[element])
    for e in above:
        seen[e] = inside
    return inside


def path_scores(lengths: np.ndarray, linked: np.ndarray, marks: np.ndarray, paths: np.ndarray) -> np.ndarray:
    """The score of each block's path: ratios by path, smoothed over the page, fused, averaged by path.

    The geometric mean of a path's own and its smoothed score is taken, so that a long neighbour alone does not
    carry a block.
    """
    _, path = np.unique(paths, return_inverse=True)
    blocks = np.bincount(path)
    text = (np.bincount(path, lengths - linked) / blocks)[path]
    punctuation = (np.bincount(path, marks) / blocks)[path]
    smooth = [np.convolve(np.pad(x, 1, "edge"), KERNEL, "valid") for x in (text, punctuation)]
    fused = np.sqrt(text * (1 + punctuation) * smooth[0] * (1 + smooth[1]))
    return (np.bincount(path, fused) / blocks)[path]


def main_blocks(html: str | None) -> list[str]:
    """The blocks of a page's main text, in page order."""
    html = html or ""
    if html.rfind("<") > html.rfind(">") and _TAG.match(html, html.rfind("<")):
        html = html[: html.rfind("<")]  # a tag that the page's end cuts off
    page = Blocks()
    page.feed(html)
    page.close()
    judged: dict[Element, bool] = {}
    found = [b for b in page.found if _known(b[2], judged)]
    articles = _outermost([b[2] for b in found])
    if not found:  # an article in a box that is named like something else
        judged = {}
        found = [b for b in page.found if _known(b[2], judged, by_name=False)]
        articles = _outermost([b[2] for b in found])
        found = found if articles else []
    if articles:
        seen: dict[Element, bool] = {}
        found = [b for b in found if _within(b[2], articles, seen)]
    if not found:
        return []
    lengths, linked = (np.array([f(b) for b in found], float) for f in (lambda b: len(b[0]), lambda b: b[1]))
    marks = np.array([len(_PUNCTUATION.findall(b[0])) for b in found], float)
    paths = np.array([b[2].path for b in found])
    scores = path_scores(lengths, linked, marks, paths)
    chosen = scores >= THRESHOLD * scores.max()
    # a path of nothing but links has no text of its own
    _, path = np.unique(paths, return_inverse=True)
    menu = (np.bincount(path, linked) > MENU_LINKS * np.bincount(path, lengths)) & (np.bincount(path, marks) == 0)
    menu = (menu & (np.bincount(path) >= MENU_BLOCKS))[path]
    chosen &= ~menu
    held = _holder([b[2] for b, c in zip(found, chosen) if c], lengths[chosen])
    seen = {}
    return [
        b[0] for b, c, m in zip(found, chosen, menu) if c or (not m and _within(b[2], held, seen))
    ]


def _outermost(elements: list[Element]) -> set[Element]:
    """The outermost elements above ``elements`` that are named as the article: ``article``, else ``main``."""
    tops: dict[str, set[Element]] = {"article": set(), "main": set()}
    top: dict[Element, tuple] = {}
    for element in elements:
        above = []
        while element is not None and element not in top:
            above.append(element)
            element = element.up
        here = top[element] if element is not None else (None, None)
        for e in reversed(above):
            here = (here[0] or (e if e.tag == "article" else None), here[1] or (e if e.tag == "main" else None))
            top[e] = here
        for tag, e in zip(("article", "main"), here):
            if e is not None:
                tops[tag].add(e)
    return tops["article"] or tops["main"]


def _holder(elements: list[Element], lengths: np.ndarray) -> set[Element]:
    """The innermost element that holds most of the chosen text."""
    own: dict[Element, float] = {}
    for element, length in zip(elements, lengths):
        own[element] = own.get(element, 0) + length
    total, held = sum(own.values()), dict(own)
    # elements are summed upwards from the deepest
    depth: dict[Element, int] = {}
    for element in list(own):
        above = []
        while element is not None and element not in depth:
            above.append(element)
            element = element.up
        at = depth[element] if element is not None else -1
        for e in reversed(above):
            at += 1
            depth[e] = at
    order = sorted(depth, key=depth.__getitem__, reverse=True)
    for element in order:
        if element.up is not None:
            held[element.up] = held.get(element.up, 0) + held.get(element, 0)
    blocks = HEADINGS | {"p", "li", "pre", "blockquote", "td", "th"}
    return {next(e for e in order if held.get(e, 0) >= HOLDS * total and e.tag not in blocks)} if order else set()


def extract(pages: DataFrame) -> DataFrame:
    """``page_id``, ``url``, ``text`` and ``n_chars`` (code points) of every row of ``pages``; one narrow pass.

    Blocks are joined by two line feeds; white space within one is a single space, line breaks included. A
    null or empty page, and one without main text, has an empty text. Repeated rows give a row each; null
    ids and urls are kept; other columns are ignored; an empty table gives no rows.
    """

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            begin, texts, size = 0, [], 0
            for at, html in enumerate(batch.column(2)):
                texts.append("\n\n".join(main_blocks(html.as_py())))
                size += len(texts[-1])
                if size > BATCH_BYTES or at == batch.num_rows - 1:
                    some = batch.slice(begin, len(texts))
                    columns = [some.column(0), some.column(1), pa.array(texts, pa.string())]
                    columns.append(pa.array([len(t) for t in texts], pa.int64()))
                    yield pa.RecordBatch.from_arrays(columns, names=["page_id", "url", "text", "n_chars"])
                    begin, texts, size = at + 1, [], 0

    narrow = pages.selectExpr("cast(page_id AS long) AS page_id", "url", "html")
    return narrow.mapInArrow(run, "page_id long, url string, text string, n_chars long")


def oracle() -> str:
    """The articles of the given tables' pages, which all hold headings, paragraphs and bold type alone."""
    return r"""
WITH articles AS (
  SELECT page_id, url, regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)(</article>|<footer>|$)', 1) AS body
  FROM pages),
blocks AS (
  SELECT page_id, url, list_transform(
    string_split_regex(replace(regexp_replace(body, '</?h1>', '<p>', 'g'), '</p>', '<p>'), '<p>'),
    lambda b: trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(
      regexp_replace(replace(b, '<b>', ''), '<[^>]*>', ' ', 'g'),
      '&lt;?', '<', 'g'), '&gt;?', '>', 'g'), '&quot;?', '"', 'g'), '&amp;?', '&', 'g'), '\s+', ' ', 'g'))) AS parts
  FROM articles),
texts AS (SELECT page_id, url, array_to_string(list_filter(parts, lambda b: b <> ''), chr(10) || chr(10)) AS text FROM blocks)
SELECT page_id, url, text, length(text) AS n_chars FROM texts
"""
