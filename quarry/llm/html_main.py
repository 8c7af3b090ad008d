"""Main text of web pages by tag-path ratios.

A page becomes its text nodes in order, each with its root-to-leaf tag path. Text length and punctuation are aggregated
per path and divided by the path's nodes, each ratio is smoothed along the page, the two are fused by multiplication,
and paths whose mean is above a part of the page's standard deviation are content. The content nodes decide which
element is the article: from the root down to the child that holds nearly all of their text, stopping at an article or
at an element that has its heading. All blocks of that element are the text. Scripts, styles and the like never show.
Menus, headers, footers, sidebars, notices, adverts, forms and reader comments are known by element, role or, for
containers only, class and id; the content nodes overrule a name or a form: an element that holds half of their text, or
the page's article, stays, and so does one with a name that articles use themselves (a notice, a discussion) if its text
is mostly content and a tenth or more of the page's. Inside an article only whole class names count, but for comments,
sidebars, consent and sign-up, which any part of a class or id names.

Defined cases: a null or empty page, and one without content, give an empty text; cut-off and badly nested markup is
closed as browsers do in the common cases, and what is not closed at the end takes the rest with it; character references are decoded; all white space, the no-break space
included, is one space inside a block; very long pages take time in proportion to their length; repeated rows get equal
answers; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Element, role and class names.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
GONE = set("head title script style noscript template iframe svg canvas object audio video textarea select option datalist".split())
HIDDEN = set("button nav aside form footer dialog menu label fieldset".split())
INLINE_HIDDEN = {"button", "label"}  # words of a sentence where they stand in one
CONTAINERS = set("div section ul ol dl table aside nav header footer form fieldset details figure center td".split())
COMMENT_NAMES = set("comment comments commentlist respond replies disqus".split())
BLOCK = set(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption".split()
)
TEXTUAL = set("p h1 h2 h3 h4 h5 h6 ul ol dl li dt dd table tbody thead tfoot tr td th blockquote pre figure figcaption caption address details summary".split())
HIDDEN_ROLES = set("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
HIDDEN_NAMES = set(
    "ad ads adv advert adverts advertisement advertising adsense adslot adbox sponsor sponsored promo promos promotion banner cookie cookies consent gdpr notice "
    "notices notification popup modal overlay sidebar sidebars aside rail widget widgets menu menus nav navbar navigation breadcrumb breadcrumbs pager pagination "
    "masthead topbar footer footers copyright comment comments commentlist respond replies disqus discussion share sharing social related recommended "
    "recommendations trending newsletter subscribe subscription signup login search skip toolbar form".split()
)
#: Of the names for comments, sidebars, consent and sign-up, those that count inside an article too, by any part of class or id.
ALWAYS_NAMES = COMMENT_NAMES | set("sidebar sidebars cookie cookies consent gdpr newsletter subscribe subscription signup".split())
#: Names that articles use for parts of their own as well.
WEAK_NAMES = set("discussion notice notices notification widget widgets".split())
HEADINGS = {"h1", "h2"}
SENTENCES = set("p h1 h2 h3 h4 h5 h6 blockquote dd figcaption".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
WITHIN = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}}
PUNCTUATION = re.compile(r"[.,;:!?…。、，！？]")
NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
OPENS = re.compile(r"<(/?[a-zA-Z]|[!?/])")
TAG = re.compile(r"[^\s/>]*")
BETWEEN = re.compile(r"[\s/]*")
ATTRIBUTE = re.compile(r"([^\s/>][^\s/>=]*)(?:\s*=\s*([\"']?))?")
UNQUOTED = re.compile(r"[^\s>]*")
RAW = {t: re.compile(rf"</{t}(?=[\s/>])", re.IGNORECASE) for t in ("script", "style", "title", "textarea", "xmp", "iframe", "noembed", "noframes")}


def tokens(html: str) -> Iterator[tuple[str, str, list[tuple[str, str]]]]:
    """The page in one pass: ("text", data, []), ("start" or "empty", tag, attributes) and ("end", tag, []). What is not
    closed before the page ends (a tag, a quoted value, a comment) takes the rest with it, so no part is read twice."""
    at, n = 0, len(html)
    while at < n:
        opens = OPENS.search(html, at)
        i = opens.start() if opens else n
        if i > at:
            yield "text", unescape(html[at:i]), []
        if not opens:
            return
        kind = opens.group(1)
        if kind in "!?/":  # a comment, a declaration, or an end without a name
            comment = html.startswith("<!--", i)
            end = html.find("-->" if comment else ">", i + (4 if comment else 2))
            if end < 0:
                return
            at = end + (3 if comment else 1)
            continue
        name = TAG.match(html, i + 1 + len(kind))  # from the second letter on
        tag, at, attributes = (kind[-1] + name.group()).lower(), BETWEEN.match(html, name.end()).end(), []
        while at < n and html[at] != ">":
            part = ATTRIBUTE.match(html, at)
            value, at = "", part.end()
            if part.group(2):
                end = html.find(part.group(2), at)
                if end < 0:
                    return
                value, at = html[at:end], end + 1
            elif part.group(2) is not None:
                value = UNQUOTED.match(html, at).group()
                at += len(value)
            attributes.append((part.group(1).lower(), unescape(value)))
            at = BETWEEN.match(html, at).end()
        if at >= n:
            return
        at += 1
        ends = kind[0] == "/"
        yield "end" if ends else "empty" if html[at - 2] == "/" else "start", tag, attributes
        if not ends and tag in RAW:
            closing = RAW[tag].search(html, at)
            end = closing.start() if closing else n
            if end > at:
                yield "text", html[at:end], []
            at = end


class Page:
    """Elements as parallel lists, and text nodes as (element, block, text). Tag paths are numbers, and open elements are
    counted by tag, so that deep nesting costs no more than its elements."""

    def __init__(self) -> None:
        self.tag, self.parent, self.path, self.gone, self.soft = [""], [-1], [0], [False], [""]
        self.paths: dict[tuple[int, str], int] = {}
        self.open = [0]
        self.count: dict[str, int] = defaultdict(int)
        self.block = 0
        self.texts: list[tuple[int, int, str]] = []

    def _soft(self, tag: str, attrs: list[tuple[str, str | None]]) -> str:
        """Why an element may be no content: "element", "name", "weak" or "comment"; empty if nothing says so."""
        in_article = bool(self.count["article"] or self.count["main"])
        if tag in INLINE_HIDDEN and any(self.count[x] for x in SENTENCES):
            return ""
        if tag in HIDDEN:
            return "name" if tag in ("form", "fieldset") else "element"
        if tag == "header":
            return "" if in_article else "element"
        names: set[str] = set()
        for k, v in attrs:
            if k in ("class", "id"):
                parts = {x.lower() for x in NAME.findall(v)}
                names.update(parts & ALWAYS_NAMES | (set(v.lower().split()) if k == "class" else set()) if in_article else parts)
            elif (k == "role" and v.lower() in HIDDEN_ROLES) or k == "hidden" or (k == "aria-hidden" and v == "true") or (k == "style" and re.search(r"display\s*:\s*none", v)):
                return "name" if k == "role" else "element"
        if tag == "article" or tag in CONTAINERS:
            if names & COMMENT_NAMES:
                return "comment"
            if tag != "article" and (names & HIDDEN_NAMES or ("header" in names and not in_article)):
                return "name" if names & (HIDDEN_NAMES - WEAK_NAMES) or "header" in names else "weak"
        return ""

    def _close(self, at: int) -> None:
        for e in self.open[at:]:
            self.count[self.tag[e]] -= 1
        del self.open[at:]

    def feed(self, html: str) -> None:
        for kind, value, attributes in tokens(html):
            if kind == "text":
                self.handle_data(value)
            elif kind == "end":
                self.handle_endtag(value)
            else:
                self.handle_starttag(value, attributes)
                if kind == "empty" and value in ("svg", "math", "path"):
                    self.handle_endtag(value)

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in BLOCK:
            self.block += 1
            for at in range(len(self.open) - 1, 0, -1) if self.count["p"] else ():  # a block ends an open paragraph
                name = self.tag[self.open[at]]
                if name == "p":
                    self._close(at)
                    break
                if name in BLOCK:
                    break
        elif tag == "br":
            self.handle_data(" ")
        if tag in VOID:
            return
        if tag in CLOSES:
            left = sum(self.count[x] for x in CLOSES[tag])
            for at in range(len(self.open) - 1, 0, -1):
                if not left:
                    break
                name = self.tag[self.open[at]]
                if name in CLOSES[tag]:
                    left -= 1
                    self._close(at)
                if name in WITHIN[tag]:
                    break
        up = self.open[-1]
        self.soft.append(self._soft(tag, attrs))
        self.tag.append(tag)
        self.parent.append(up)
        self.path.append(self.paths.setdefault((self.path[up], tag), len(self.paths) + 1))
        self.gone.append(self.gone[up] or tag in GONE)
        self.open.append(len(self.tag) - 1)
        self.count[tag] += 1

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCK:
            self.block += 1
        if not self.count[tag]:
            return
        for at in range(len(self.open) - 1, 0, -1):
            if self.tag[self.open[at]] == tag:
                self._close(at)
                return

    def handle_data(self, data: str) -> None:
        if not self.gone[self.open[-1]]:
            self.texts.append((self.open[-1], self.block, data))


def hidden_elements(page: Page, weight: list[float], plain: list[float], holds: list[bool]) -> list[bool]:
    """Which elements are no content, with all in them. ``weight``: the content nodes' text in an element; ``plain``: all
    text in it; ``holds``: whether it holds the page's article. Where there is one, text elsewhere does not count."""
    hidden, within = [False] * len(page.tag), [False] * len(page.tag)
    for e in range(1, len(page.tag)):
        within[e] = within[page.parent[e]] or page.tag[e] in ("article", "main")
        half = weight[e] > 0 and weight[e] >= 0.5 * weight[0] and plain[e] >= 0.3 * plain[0] and holds[e] == holds[0]
        # a weak name gives way where its text is mostly content, a good part of the page's, and in the article if there is one
        mostly = plain[e] and weight[e] >= 0.5 * plain[e] and weight[e] >= 0.1 * weight[0] and (within[e] or not holds[0])
        stays = {"name": half or holds[e], "weak": half or holds[e] or mostly, "comment": half and holds[e]}.get(page.soft[e], False)
        hidden[e] = hidden[page.parent[e]] or (bool(page.soft[e]) and not stays)
    return hidden


def totals(page: Page, own: list[float]) -> list[float]:
    """Sums over each element and all in it."""
    out = list(own)
    for e in range(len(page.tag) - 1, 0, -1):  # children come after their parents
        out[page.parent[e]] += out[e]
    return out


def _smooth(x: np.ndarray) -> np.ndarray:
    """A Gaussian mean over the node and the two on either side, with the ends repeated."""
    if len(x) < 2:
        return x
    weights = np.exp(-0.5 * np.arange(-2, 3) ** 2)
    return np.convolve(np.pad(x, 2, mode="edge"), weights / weights.sum(), mode="valid")


def content_nodes(page: Page, part: float = 0.2) -> list[bool]:
    """For each text node, whether its tag path is content."""
    lengths = np.array([len(" ".join(t.split())) for _, _, t in page.texts], dtype=float)
    points = np.array([len(PUNCTUATION.findall(t)) for _, _, t in page.texts], dtype=float)
    of = defaultdict(list)
    for i, (e, _, _) in enumerate(page.texts):
        if lengths[i]:
            of[page.path[e]].append(i)
    seen = np.flatnonzero(lengths)
    text_ratio, point_ratio = np.zeros(len(lengths)), np.zeros(len(lengths))
    for rows in of.values():
        text_ratio[rows], point_ratio[rows] = lengths[rows].mean(), points[rows].mean()
    fused = np.zeros(len(lengths))
    fused[seen] = _smooth(text_ratio[seen]) * _smooth(point_ratio[seen])
    limit = part * fused[seen].std() if len(seen) else 0.0
    chosen = [False] * len(lengths)
    for rows in of.values():
        if fused[rows].mean() >= limit and points[rows].any():
            for i in rows:
                chosen[i] = True
    return chosen


def main_text(html: str) -> str:
    page = Page()
    page.feed(html)
    own, plain = [0.0] * len(page.tag), [0.0] * len(page.tag)
    for (e, _, text), good in zip(page.texts, content_nodes(page), strict=True):
        own[e] += len(text) * good
        plain[e] += len(text)
    articles = totals(page, [float(t in ("article", "main") and page.soft[e] != "comment") for e, t in enumerate(page.tag)])
    hidden = hidden_elements(page, totals(page, own), totals(page, plain), [x > 0 for x in articles])
    page.texts = [x for x in page.texts if not hidden[x[0]]]
    own = [0.0] * len(page.tag)
    for (e, _, text), good in zip(page.texts, content_nodes(page), strict=True):  # again, of what is left
        if good:
            own[e] += len(text)
    weight = totals(page, own)
    children = defaultdict(list)
    for e in range(1, len(page.tag)):
        if not hidden[e]:
            children[page.parent[e]].append(e)
    root = 0
    while weight[0] and page.tag[root] != "article" and not any(page.tag[c] in HEADINGS for c in children[root]):
        inner = [c for c in children[root] if weight[c] >= 0.8 * weight[root] and page.tag[c] in BLOCK and page.tag[c] not in TEXTUAL]
        if not inner:
            break
        root = inner[0]
    inside = [False] * len(page.tag)
    inside[root] = True
    for e in range(root + 1, len(page.tag)):
        inside[e] = inside[page.parent[e]]
    blocks: dict[int, list[str]] = defaultdict(list)
    for e, block, text in page.texts:
        if inside[e]:
            blocks[block].append(text)
    lines = (" ".join("".join(x).split()) for x in blocks.values())
    return "\n".join(x for x in lines if x)


def extract(df: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """One row per row of ``df``: id, text and n_chars."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h.as_py() or "") for h in batch.column("html")]
            own = [batch.column("id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays(own, names=["id", "url", "text", "n_chars"])

    url = F.col("url").cast("string") if "url" in df.columns else F.lit(None).cast("string")
    return df.select(F.col(id_col).cast("long").alias("id"), url.alias("url"), F.col(html_col).alias("html")).mapInArrow(run, "id long, url string, text string, n_chars long")
