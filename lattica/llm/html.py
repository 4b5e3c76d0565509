"""Main text of web pages by tree scoring: paragraphs pass points for their length and commas to the elements around them, an element's
points are discounted by its share of link text, and the best container is kept with those siblings that carry text like it.

Everything is linear in a page: one pass of a tokenizer builds the tree in arrays, one pass up sums text, links and points, one pass down
emits text. Pages are independent, so rows stay where they are read.
"""

from __future__ import annotations

import re
from html import unescape

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?:svg|math)(?=[\s/>])(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+(?<=/)>"
    r"|<(?P<raw>script|style|noscript|template|svg|iframe|textarea|title|select|object|math|canvas)(?=[\s/>])(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<[!?][^>]*+(?:>|\Z)|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*+)(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>|[^>]*+>)",
    re.S | re.I,
)
ATTRIBUTE = re.compile(r"""(class|id|role|style|aria-hidden|hidden|itemprop)\b\s*(?:=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body br button caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul option".split())
#: An opening tag on the left ends an open element of the right that stands above the nearest element of CONTAINER.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
CLOSES_P = BLOCK - {"br", "button", "option", "td", "th", "tr", "tbody", "thead", "tfoot", "caption"}
CONTAINER = frozenset("article aside body div footer form header html main nav section table ul ol dl td th blockquote button".split())
DROPPED_TAGS = frozenset("nav footer aside button dialog menu fieldset input label head".split())
DROPPED_ROLES = frozenset("navigation banner complementary contentinfo search alert alertdialog dialog menu menubar toolbar form tooltip status".split())
#: Words of class and id that name what is no part of an article. They, LAYOUT names and forms are believed of elements that hold less than half
#: the text, and of larger ones beside which there are paragraphs without such a name (BESIDE): not of one that wraps the page.
DROPPED_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adsense adbox sponsor sponsored sponsors promo promoted cookie cookies consent gdpr notice notices notification alert popup newsletter subscribe subscription signup login share sharing social related recommended recommendations comment comments disqus reply replies respond breadcrumb breadcrumbs pagination pager footer copyright skip hidden noprint feedback survey paywall".split()
)
LAYOUT = frozenset("nav navbar navigation menu sidebar aside header masthead banner modal overlay widget toolbar topbar rail".split())
CONTENT_TAGS = {"article": 25.0, "main": 20.0, "div": 5.0, "section": 5.0, "pre": 3.0, "td": 3.0, "blockquote": 3.0, "form": -3.0, "ol": -3.0, "ul": -3.0, "dl": -3.0, "li": -3.0, "th": -5.0}
CONTENT_WORDS = frozenset("article articlebody body content entry main post story text blog".split())
PARAGRAPHS = frozenset("p pre td blockquote li dd div section article main h2 h3 h4 h5 h6 figcaption".split())
LEAST_POINTS_TEXT = 25
#: Characters in paragraphs beside an element from which its name is believed however long it is, if they are a tenth of its text or more.
BESIDE = 140


class Tree:
    """Elements in page order: tag, parent, what their attributes say, and a list of (element, text) and (element, None) for block ends.

    The open elements are a stack; `places` has for each name the places where it is on the stack, and `walls` those of containers, so that no
    tag, however deep or badly nested, needs a walk over the stack."""

    def __init__(self, page: str):
        self.tag, self.parent, self.drop, self.layout, self.bonus, self.pieces = ["#"], [-1], [False], [False], [0.0], []
        self.stack, self.places, self.walls = [0], {}, [0]
        pieces, stack, at = self.pieces, self.stack, 0
        for m in TOKEN.finditer(page):
            if m.start() > at:
                pieces.append((stack[-1], page[at : m.start()]))
            at = m.end()
            name = m["tag"]
            if name is None:
                continue
            name = name.lower()
            if m["end"]:
                self._close(name)
            else:
                self._open(name, m["attrs"])
        if at < len(page):
            pieces.append((stack[-1], page[at:]))

    def _last(self, name: str) -> int:
        """The place of the innermost open element of a name, 0 if there is none."""
        places = self.places.get(name)
        return places[-1] if places else 0

    def _cut(self, k: int) -> None:
        """Ends the open elements from place k on."""
        while len(self.stack) > k:
            self.places[self.tag[self.stack.pop()]].pop()
        while self.walls[-1] >= k:
            self.walls.pop()

    def _close(self, name: str) -> None:
        if name in BLOCK:
            self.pieces.append((self.stack[-1], None))
        k = self._last(name)
        # a container's end reaches over other containers but not out of the body, another end not out of its container
        if k and k >= (self._last("body") if name in CONTAINER else self.walls[-1]):
            self._cut(k)

    def _open(self, name: str, attrs: str) -> None:
        if name in BLOCK:
            self.pieces.append((self.stack[-1], None))
        k = max([self._last("p") if name in CLOSES_P else 0, *map(self._last, ENDS.get(name, ()))])
        if k and k >= self.walls[-1]:
            self._cut(k)
        if name in VOID or name in ("html", "body") and self._last(name):
            return
        here = self.stack[-1]
        drop, layout, bonus = name in DROPPED_TAGS, name == "form", 0.0
        inside = self._last("article") or self._last("main")
        if name == "header" and not inside:
            drop = True
        if len(attrs) > 2:
            for k, v in ATTRIBUTE.findall(attrs):
                k, v = k.lower(), v.strip("\"'")
                if k == "hidden" or k == "aria-hidden" and v.lower() == "true" or k == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", v, re.I):
                    drop = True
                elif k == "role":
                    drop |= v.lower() in DROPPED_ROLES
                    bonus += 25 * (v.lower() in ("main", "article"))
                elif k == "itemprop":
                    bonus += 25 * (v.lower() == "articlebody")
                elif k in ("class", "id") and name not in ("html", "body"):
                    words = {w.lower() for w in PARTS.findall(v)}
                    layout |= bool(words & DROPPED_WORDS)
                    layout |= bool(words & LAYOUT) and not (inside and words & {"header"})
                    bonus += 25 * bool(words & CONTENT_WORDS) * (not words & LAYOUT)
        # an article's own names say what it has or is about; in another one it can be a comment or a teaser
        layout &= not (name == "main" or name == "article" and not inside or bonus >= 25 and "articlebody" in attrs.lower())
        self.tag.append(name)
        self.parent.append(here)
        self.drop.append(drop or self.drop[here])
        self.layout.append(layout)
        self.bonus.append(bonus)
        self.places.setdefault(name, []).append(len(self.stack))
        if name in CONTAINER:
            self.walls.append(len(self.stack))
        self.stack.append(len(self.tag) - 1)


def main_text(page: str | None) -> str:
    """The article of a page: its blocks in page order, white space made one space. Empty for null, for a page without text, and for one
    that is navigation only."""
    if not page:
        return ""
    t = Tree(page)
    n = len(t.tag)
    pieces = [(e, None if s is None else unescape(s) if "&" in s else s) for e, s in t.pieces]
    size, links, commas, own = [0] * n, [0] * n, [0] * n, [0] * n
    in_link, stop = [False] * n, [False] * n
    for e in range(1, n):
        in_link[e] = t.tag[e] == "a" or in_link[t.parent[e]]
    for e, s in pieces:
        if s and not t.drop[e] and (k := len(" ".join(s.split()))):
            size[e] += k
            links[e] += k * in_link[e]
            commas[e] += sum(map(s.count, ",،、，;"))
            own[e] += k
            stop[e] |= "." in s
    inline = [t.tag[e] not in BLOCK for e in range(n)]
    total = size[:]
    total_links = links[:]
    for e in range(n - 1, 0, -1):
        p = t.parent[e]
        total[p] += total[e]
        total_links[p] += total_links[e]
        if inline[e]:
            own[p] += own[e]
            commas[p] += commas[e]
    # text of paragraphs in an element, outside of elements in it that have a name of layout
    clear = [own[e] if t.tag[e] in PARAGRAPHS and own[e] >= LEAST_POINTS_TEXT and not t.drop[e] else 0 for e in range(n)]
    for e in range(n - 1, 0, -1):
        if not t.layout[e]:
            clear[t.parent[e]] += clear[e]
    named = [0] * n  # the innermost element with such a name around each one
    for e in range(1, n):
        p = t.parent[e]
        named[e] = p if t.layout[p] else named[p]
        beside = clear[named[e]]
        t.drop[e] = t.drop[e] or t.drop[p] or t.layout[e] and (2 * total[e] < total[0] or beside >= BESIDE and 10 * beside >= total[e])
    points = [0.0] * n
    scored = [False] * n
    for e in range(1, n):
        if t.drop[e] or t.tag[e] not in PARAGRAPHS or own[e] < LEAST_POINTS_TEXT:
            continue
        gain = (1 + commas[e] + min(own[e] / 100, 3)) * (1 - min(1, links[e] / own[e]))
        targets, p, share = [], t.parent[e] if t.tag[e] in ("p", "pre", "td", "blockquote", "li", "dd", "h2", "h3", "h4", "h5", "h6", "figcaption") else e, 1.0
        while p > 0 and len(targets) < 5:
            targets.append(p)
            p = t.parent[p]
        for level, p in enumerate(targets):
            if not scored[p]:
                scored[p] = True
                points[p] += CONTENT_TAGS.get(t.tag[p], 0.0) + t.bonus[p]
            points[p] += gain / (1 if level == 0 else 2 if level == 1 else level * 3)
    final = [points[e] * (1 - total_links[e] / total[e]) if scored[e] and total[e] else 0.0 for e in range(n)]
    best = max((e for e in range(1, n) if scored[e] and not t.drop[e]), key=lambda e: (final[e], -e), default=None)
    if best is None:
        best = next((e for e in range(1, n) if t.tag[e] in ("article", "main") and not t.drop[e] and total[e]), None)
        if best is None:
            best = next((e for e in range(1, n) if t.tag[e] == "body"), 0)
            if not total[best] or 2 * total_links[best] > total[best]:
                return ""
    around, e = best, best
    while (e := t.parent[e]) > 0:  # a part of an article stands for the article
        if t.tag[e] == "article":
            around = e
            break
    best = around
    kept = {best}
    if t.tag[best] not in ("article", "main", "body") and best:
        least = max(10.0, 0.2 * final[best])
        for e in range(1, n):
            if t.parent[e] == t.parent[best] and e != best and not t.drop[e] and total[e]:
                density = total_links[e] / total[e]
                if scored[e] and final[e] >= least or t.tag[e] in ("p", "h1", "h2", "h3", "blockquote", "pre") and (density < 0.25 and total[e] > 80 or not density and t.tag[e][0] == "h" or not density and stop[e]):
                    kept.add(e)
    inside = [False] * n
    if best == 0:
        inside[0] = True
    for e in range(1, n):
        inside[e] = (e in kept or inside[t.parent[e]]) and not t.drop[e]
    return " ".join("".join(" " if s is None else s for e, s in pieces if s is None or inside[e]).split())


def extract(pages: DataFrame, html: str = "html", text: str = "text") -> DataFrame:
    """Every row with the main text of its html and n_chars, its code points; a column that has one of these names is replaced. Null and empty
    html, and pages of navigation alone, have an empty text; pages may have any length and nesting; repeated rows are rows of their own, and an
    empty table stays empty."""

    @F.pandas_udf("string")
    def run(column: pd.Series) -> pd.Series:
        return column.map(main_text, na_action=None)

    return pages.withColumn(text, run(F.col(html))).withColumn("n_chars", F.length(text).cast("long"))
