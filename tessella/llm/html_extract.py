"""Main text of web pages by a maximum-scoring subsequence of words and tags.

A page is one stream of tokens, words and tags, each with a score: words in running text score positive, words in
links and most tags negative. The scores are smoothed log odds of a token's class inside and outside the article of
the labelled pages. A linear scan finds the contiguous region with the largest total, the earliest and shortest of
equals. The region is then completed: article and main elements that it meets are taken whole; in a page without them,
text elements (paragraphs, headings, lists, tables) that stand beside it in its own parent, lists of links apart.

Words of parts that can never be article text - scripts, menus, page headers and footers, sidebars, forms, hidden parts,
and elements whose class, id or role names an advert, notice, menu, share bar or reader comments - score nothing and
are left out of the region's text. A name counts only if no word of it speaks against it ("related-posts", not
"related-work"), never on headings and paragraphs, and not on an element that holds the article or the title.

The region's text is cut into blocks at block tags. Character references are decoded, white space inside a block
becomes one space, blocks are trimmed, and those not empty are joined by two line feeds. Null or empty pages, and
pages without a positive region, give an empty text. Unclosed tags, comments and references are read to the end.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.columns import passing
from tessella.llm.labelled_pages import PAGES
from tessella.runtime import ship, small_batches

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*'|[\"'])*?)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"([a-zA-Z_:][-\w:.]*)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))")
SPACE = re.compile(r"\s+")

# Fixed sets of HTML element names, from the public standard.
RAW = frozenset("script style noscript template textarea title iframe svg math xmp noembed noframes".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split())
NEVER = frozenset("nav aside footer form menu dialog button select option label fieldset head".split())
ENDS_P = BLOCK - {"body", "html"}
# Words of class names and ids that name a part of a page which is no article text, and words that may stand beside them in such a name.
HINT = re.compile(
    r"(?:ads?|ad(?:box|slot|unit|banner)s?|advert\w*|adsense|banners?|sponsor\w*|promo\w*|cookies?|consent|gdpr|notices?|alerts?|popup\w*|modal|overlay|nav|navbar\w*|navigation"
    r"|menus?|menubar|breadcrumbs?|sidebars?|widgets?|related|recommended|recommendations|share|sharing|sharebar|social|disqus\w*|respond|replies|footers?|masthead|toolbar|topbar"
    r"|pagination|pager|newsletters?|subscri\w*|signup|login|search|skip)(?:bar|box|list|banner|block|wrap)?\d*",
    re.I,
)
BESIDE = frozenset(
    "posts post articles article stories story links link items item list lists box boxes bar bars area block blocks container wrapper wrap inner outer section sections panel unit slot row col column columns"
    " top bottom left right site page global main primary secondary header head title button buttons icon icons form forms input media policy message msg thread to and the by of us me up in".split()
)
COMMENTS = re.compile(r"(?:^|[-_])comments?(?:$|[-_\d]|list|form|area|body)", re.I)
WHOLE = frozenset("side header site-header global-header top-header top-bar bottom copyright disclaimer".split())
STATES = ("has-", "with-", "no-", "is-", "without-")
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form".split())
LINK, HEADING, LIST = "word:link", "word:heading", "word:list"


NAMED = frozenset("article aside blockquote div dl figure form header li main ol section span table td tr ul".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that complete a region as its neighbours.
CONTENT = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl table pre blockquote figure".split())


def named(name: str) -> bool:
    """Whether a class name or id names a part without article text: one word says so and no other word speaks against it."""
    if COMMENTS.search(name):
        return True
    words = [w for w in re.split("[-_]+", name) if w and not w.isdigit()]
    return any(HINT.fullmatch(w) for w in words) and all(HINT.fullmatch(w) or w in BESIDE for w in words)


class Element:
    """An open or closed element: what its tag and attributes say, and its place in the stream."""

    __slots__ = ("article", "first", "holds", "last", "never", "off", "parent", "tag")

    def __init__(self, tag: str, attributes: str, parent: Element | None, first: int):
        self.tag, self.parent, self.first, self.last = tag, parent, first, -1
        self.never, self.article, self.holds, self.off = tag in NEVER or tag == "header", tag in ("article", "main"), "", False
        if tag in ("html", "body"):
            return
        flags = re.split(r"[\s=]+", re.sub(r"\"[^\"]*\"|'[^']*'", "", attributes.lower())) if "hidden" in attributes.lower() else ()
        a = {m[0].lower(): m[1] or m[2] or m[3] for m in ATTRIBUTE.findall(attributes)} if "=" in attributes else {}
        role = a.get("role", "").lower()
        names = [t for k in ("class", "id") for t in a.get(k, "").lower().split() if not t.startswith(STATES)] if tag in NAMED else ()
        hinted = any(t in WHOLE or named(t) for t in names)
        self.article = self.article and not hinted or role in ("main", "article")
        self.never = self.never or role in ROLES or a.get("aria-hidden") == "true" or "hidden" in flags
        self.holds = "named" if hinted and role != "main" else ""

    def settle(self) -> None:
        """Decide whether text in here is left out, once all that it holds is known and its parent is settled."""
        inside = self.parent is not None and self.parent.article
        barred = self.never and not (self.tag == "header" and inside) and self.holds not in ("article",)
        self.off = self.parent is not None and self.parent.off or barred or self.holds == "named"
        self.article = (self.article or inside) and not self.off


def parse(page: str) -> tuple[list[tuple[str, str, bool]], list[Element]]:
    """The stream of (class, text, break before) of runs of text and tags, and the elements. Text comes decoded; tags and excluded text come empty."""
    stream: list[tuple[str, str, bool, Element | None]] = []
    elements: list[Element] = []
    stack: list[Element] = []
    open_: Counter = Counter()
    at, n = 0, len(page)

    def text(raw: str) -> None:
        links, headings = open_["a"], any(open_[h] for h in HEADINGS)
        kind = LINK if links else HEADING if headings else LIST if open_["li"] else "word:text"
        stream.append((kind, raw, False, stack[-1] if stack else None))

    def pop() -> str:
        e = stack.pop()
        e.last = len(stream)
        open_[e.tag] -= 1
        return e.tag

    def close(tag: str) -> None:
        if open_[tag]:
            while pop() != tag:
                pass

    for m in TOKEN.finditer(page):
        if m.start() < at:
            continue
        if m.start() > at:
            text(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            if m[0].startswith("<![CDATA["):
                text(m[0][9:].removesuffix("]]>"))
            continue
        tag, breaks = m[2].lower(), m[2].lower() in BLOCK
        if m[1]:
            close(tag)
            stream.append((f"/{tag}", "", breaks, None))
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\b[^>]*(?:>|\Z)", re.I).search(page, at)
            at = end.end() if end else n
            stream.append((tag, "", tag in BLOCK, None))
            continue
        if tag in ENDS_P and any(e.tag == "p" for e in stack[-4:]):
            close("p")
        if tag == "li" and (open_["li"] or open_["ul"] or open_["ol"] or open_["menu"]):
            depth = next((k for k in range(len(stack) - 1, -1, -1) if stack[k].tag in ("li", "ul", "ol", "menu")), None)
            if depth is not None and stack[depth].tag == "li":
                while len(stack) > depth:
                    pop()
        stream.append((tag, "", breaks, None))
        if tag in VOID:
            if tag == "br":
                stream.append(("off", " ", False, stack[-1] if stack else None))
            continue
        e = Element(tag, m[3] or "", stack[-1] if stack else None, len(stream) - 1)
        elements.append(e)
        stack.append(e)
        open_[tag] += 1
        # An element that holds the article is not left out for its name, nor for its tag.
        if e.article or tag == "h1":
            mark, up = ("article" if e.article else "h1"), e.parent
            while up is not None and up.holds != "article" and up.holds != mark and not (mark == "h1" and up.never):
                up.holds, up = mark, up.parent
    if at < n:
        text(page[at:])
    while stack:
        pop()
    for e in elements:
        e.settle()
    out = [("off", " " if kind == "off" and not e.off else "", b) if e is not None and (e.off or kind == "off") else (kind, entities.unescape(t) if e is not None or kind.startswith("word:") else t, b) for kind, t, b, e in stream]
    return out, elements


def tokens(page: str) -> Iterator[tuple[str, str, bool]]:
    yield from parse(page)[0]


def learn(pages: list[list[tuple[str, int]]]) -> dict[str, float]:
    """Log odds of each token class in and outside labelled articles, within -4 and 4, smoothed by one."""
    seen = {0: Counter(), 1: Counter()}
    for page in pages:
        marks = [("", 0)] + [(f"{piece}{chr(0xE000 + label)}", label) for piece, label in page]
        held: list[tuple[str, int]] = []
        for kind, text, _ in tokens("".join(p for p, _ in marks)):
            words = 0
            for part in re.split("([\ue000\ue001])", text):
                if part in ("\ue000", "\ue001"):
                    held.append((kind, words))
                    for k, w in held:
                        seen[ord(part) - 0xE000][k] += max(w, not k.startswith("word"))
                    held, words = [], 0
                else:
                    words += len(part.split())
            held.append((kind, words))
    total = {k: sum(c.values()) for k, c in seen.items()}
    kinds = set(seen[0]) | set(seen[1])
    odds = {k: math.log((seen[1][k] + 1) / (total[1] + len(kinds))) - math.log((seen[0][k] + 1) / (total[0] + len(kinds))) for k in kinds if k != "off"}
    return {k: max(-4.0, min(4.0, v)) for k, v in odds.items()}


def complete(span: tuple[int, int], stream: list[tuple[str, str, bool]], elements: list[Element]) -> tuple[int, int]:
    """The region with the articles it meets made whole; without any, with the text elements that stand beside it in its own parent."""
    start, end = span
    roots = [e for e in elements if e.article and not e.off and (e.parent is None or not e.parent.article)]
    met = [e for e in roots if e.first < end and e.last > start]
    if met:
        return min(start, *(e.first for e in met)), max(end, *(e.last for e in met))
    around = [e for e in elements if e.first <= start and e.last >= end and e.tag not in CONTENT]
    parent = around[-1] if around else None
    beside = [e for e in elements if e.tag in CONTENT and not e.off and (e.parent is parent or parent is None and e.parent is None)]
    links = lambda e: not any(k.startswith("word:") and k != LINK and t.strip() for k, t, _ in stream[e.first : e.last])
    blank = lambda a, b: not any(t.strip() or k in BLOCK for k, t, _ in stream[a:b])
    for e in beside:
        if end <= e.first and blank(end, e.first) and not links(e):
            end = e.last + 1
        elif e.first < end < e.last:
            end = e.last
    for e in reversed(beside):
        if e.last <= start and blank(e.last + 1, start) and not links(e):
            start = e.first
        elif e.first < start < e.last:
            start = e.first
    return start, end


class Extractor:
    def __init__(self, pages: list[list[tuple[str, int]]] = PAGES):
        self.weights = learn(pages)
        self.other = -1.0
        for kind, least in (("word:text", 0.5), (HEADING, 0.1), (LIST, 0.1)):
            self.weights[kind] = max(self.weights.get(kind, least), least)

    def score(self, kind: str, text: str) -> float:
        if kind == "off":
            return 0.0
        weight = self.weights.get(kind, 0.0 if kind.startswith("word:") else self.other)
        return weight * len(text.split()) if kind.startswith("word:") else weight

    def extract(self, page: str | None) -> str:
        if not page:
            return ""
        stream, elements = parse(page)
        best, total, start, span = 0.0, 0.0, 0, (0, 0)
        for k, (kind, text, _) in enumerate(stream):
            if total <= 0:
                total, start = 0.0, k
            total += self.score(kind, text)
            if total > best + 1e-12:
                best, span = total, (start, k + 1)
        if best > 0:
            span = complete(span, stream, elements)
        blocks, held = [], []
        for _, text, breaks in [*stream[span[0] : span[1]], ("", "", True)]:
            if breaks:
                block = SPACE.sub(" ", "".join(held)).strip()
                if block:
                    blocks.append(block)
                held = []
            elif text:
                held.append(text)
        return "\n\n".join(blocks)


def extract_text(pages: DataFrame, html: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """keep columns, text (empty if none) and n_chars of every page, in one pass."""
    keep = passing(keep, ("text", "n_chars"))
    spark = pages.sparkSession
    ship(spark)
    small_batches(spark)
    rows = pages.select(*keep, F.coalesce(F.col(html), F.lit("")).alias("__html"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pages.select(*keep).schema.fields)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        x = Extractor()
        for b in batches:
            text = [x.extract(h) for h in b["__html"]]
            yield b[list(keep)].assign(text=text, n_chars=[len(t) for t in text])

    return rows.mapInPandas(run, f"{kinds}, text string, n_chars long")
