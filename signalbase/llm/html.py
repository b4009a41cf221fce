"""Main text of web pages by tag-path ratios.

A page's text nodes (stretches of text between block boundaries) are grouped
by their tag path, the tags and class names from the root to the leaf. For
each path the mean text length and the mean number of punctuation marks of its
nodes are its two ratios. Both are smoothed twice: in page order by a Gaussian
window, so that titles and short paragraphs gain from the text around them,
and down the tree, where a path has a share of the ratios of the paths that
enclose it, so that lists and tables gain from their article. The smoothed
ratios are fused by multiplication; the nodes of the paths whose fused ratio
(the median of their nodes') reaches a threshold, a share of the text-weighted
mean, are the main text.

Tags that mark navigation, headers, footers, sidebars and forms, and class or
id names of adverts, notices, sidebars and reader comments, are a prior: a
factor on the ratios of the paths below them, small enough to decide against
them. It is not applied where the element holds the page's article all the same
(a main or article element, the title, or for a doubtful name most of the text).
What no name speaks against is left to the ratios.

Defined cases: a null, empty or textless page gives an empty text; unclosed
and stray tags are closed as browsers do for paragraphs, list items and table
cells, else ignored; a tag that never ends is text; a page of which every
text lies in such elements has no main text; pages of any length take linear
time, however deep their elements are nested; repeated rows and ties give equal results; an empty table
gives an empty result; columns named like the results are replaced.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signalbase.llm.common import by_size

#: A tag with quoted attributes. Its parts are possessive, so that one attempt reads a character once.
TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>")
PLAIN_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>")
ATTRIBUTE = re.compile(r"\b(class|id|role)\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>\"']++))", re.I)
#: Elements whose content is no text of the page.
OPAQUE = frozenset("script style template noscript textarea svg iframe select".split())
CLOSING = {tag: re.compile(rf"</{tag}\s*+>", re.I) for tag in OPAQUE}
LEFT_OUT = frozenset("nav header footer aside head button dialog menu".split())
LEFT_OUT_NAMES = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|adsense|banner|sponsor\w*|promo\w*|cookies?|consent|gdpr|notices?|alerts?|popup|modal|newsletter|subscri\w*|sidebar|aside|widget|related|recommend\w*|"
    r"share|sharing|social|comments?|commentlist|disqus|respond|replies|reply|discussion|nav\w*|menu\w*|breadcrumbs?|pagination|pager|footer|masthead|site-header|page-header|topbar|login|signup|search|toc)(?:$|[\s_-])|(?:^|\s)tags?(?:[_-](?:list|links|cloud|s))?(?:$|\s)",
    re.I,
)
#: Of those, names that articles' own subjects and frames have as well: an element that holds most of a page's text is not held to be one of them.
DOUBTFUL_NAMES = re.compile(
    r"(?:^|(?<=[\s_-]))(?:promo\w*|notices?|alerts?|widget|related|recommend\w*|share|sharing|social|replies|reply|discussion|login|signup|search|tags?|toc)(?=$|[\s_-])",
    re.I,
)
#: Names of a page's layout that only say whether it has such a part.
LAYOUT_NAMES = re.compile(r"(?<![^\s_-])(?:has|with|no|without|show|hide)[-_]\w+", re.I)
ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("table", "tr"), "th": ("table", "tr")}
PARAGRAPH_ENDS = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
HOLDS_PARAGRAPHS = frozenset("td th table article".split())
MARKS = str.maketrans("", "", ".,;:!?…。，；：！？、")
SPACE_RUN = re.compile(r"\s+")
NUMBERS = re.compile(r"[0-9]+")

#: Nodes on either side that page-order smoothing reaches.
WINDOW_NODES = 2
#: What an enclosing path's ratio counts for one level further down.
INHERITED = 0.6
#: The factor on ratios below an element that is likely no article.
PRIOR = 0.02
#: The share of the text-weighted mean of fused ratios that a path needs.
THRESHOLD = 0.05


class Page:
    """Text nodes in page order, and the tree of tag paths that they lie on.

    ``paths[k]`` is (path above it or -1, its label); ``nodes`` are (path,
    text, innermost mistrusted element around it or 0). ``trusted[k]`` says
    whether mistrusted element k and all such elements around it are trusted
    after all; ``outer[k]`` is the next one outwards.
    """

    def __init__(self, page: str):
        self.paths: list[tuple[int, str]] = [(-1, "")]
        self.nodes: list[tuple[int, str, int]] = []
        self.outer: list[int] = [0]
        self.trusted: list[bool] = [True]
        self._known: dict[tuple[int, str], int] = {}
        self._parts: list[str] = []
        self._where = (0, 0)
        # Of each open element: its tag, its path, the innermost mistrusted element of those around it and itself.
        self._open: list[tuple[str, int, int]] = [("", 0, 0)]
        self._at: dict[str, list[int]] = {}
        self._blocks: list[int] = []
        self._doubtful: list[bool] = [False]
        self._in_article = 0
        self._parse(page)
        self._end_node()
        self._trust()

    def _parse(self, page: str) -> None:
        at, size, last_end, quoted = 0, len(page), page.rfind(">"), True
        while at < size:
            start = page.find("<", at)
            if start < 0 or start > last_end and not page.startswith("<!--", start):
                self._text(page[at:])  # no tag ends after this place
                return
            if start > at:
                self._text(page[at:start])
            if page.startswith("<!--", start):
                end = page.find("-->", start + 4)
                at = size if end < 0 else end + 3
                continue
            if page[start + 1 : start + 2] in ("!", "?"):
                at = page.find(">", start) + 1
                continue
            found = TAG.match(page, start) if quoted else None
            if found is None:
                found = PLAIN_TAG.match(page, start)
                # A quote that never ends: from here on a tag ends at the next bracket.
                quoted = quoted and found is None
            if found is None:
                self._text("<")
                at = start + 1
                continue
            at, tag = found.end(), found[2].lower()
            if tag in OPAQUE and not found[1]:
                end = CLOSING[tag].search(page, at)
                if end is None:
                    return  # as browsers do, the rest of the page belongs to it
                at = end.end()
                if tag not in INLINE:
                    self._end_node()
            elif found[1]:
                self._close(tag)
            else:
                self._start(tag, found[3])

    def _text(self, raw: str) -> None:
        if not self._parts:
            k = self._blocks[-1] if self._blocks else 0
            self._where = self._open[k][1], self._open[-1][2]
        self._parts.append(raw)

    def _end_node(self) -> None:
        if self._parts:
            text = SPACE_RUN.sub(" ", entities.unescape("".join(self._parts))).strip()
            if text:
                self.nodes.append((self._where[0], text, self._where[1]))
            self._parts.clear()

    def _push(self, tag: str, path: int, mistrusted: int) -> None:
        self._at.setdefault(tag, []).append(len(self._open))
        if tag not in INLINE:
            self._blocks.append(len(self._open))
        self._in_article += tag in ("article", "main")
        self._open.append((tag, path, mistrusted))

    def _pop_to(self, k: int) -> None:
        while len(self._open) > k:
            tag = self._open.pop()[0]
            self._at[tag].pop()
            if tag not in INLINE:
                self._blocks.pop()
            self._in_article -= tag in ("article", "main")

    def _close(self, tag: str) -> None:
        if tag not in INLINE:
            self._end_node()
        if places := self._at.get(tag):
            held = max((self._at[x][-1] for x in HOLDS_PARAGRAPHS if self._at.get(x)), default=0)
            if places[-1] > held or tag not in ("p", "li", "span"):
                self._pop_to(places[-1])

    def _start(self, tag: str, attributes: str) -> None:
        if tag not in INLINE:
            self._end_node()
        if tag in CLOSES or tag in PARAGRAPH_ENDS:
            self._imply_ends(tag)
        if tag in VOID or attributes.endswith("/") and tag in INLINE:
            return
        above, around = self._open[-1][1:]
        label, likely_not, doubt = self._judge(tag, attributes)
        if tag in ("main", "h1") or tag == "article" and not likely_not:
            # Whatever holds the article is the page's frame.
            at = around
            while not self.trusted[at]:  # what is trusted has only trusted elements around it
                self.trusted[at] = True
                at = self.outer[at]
        if tag in INLINE:
            # Inline elements are no part of a path, but a name of theirs may still tell.
            path = above
        else:
            path = self._known.setdefault((above, label), len(self.paths))
            if path == len(self.paths):
                self.paths.append((above, label))
        if likely_not:
            self.outer.append(around)
            self.trusted.append(False)
            self._doubtful.append(doubt)
            around = len(self.outer) - 1
        self._push(tag, path, around)

    def _imply_ends(self, tag: str) -> None:
        """Ends what a start tag ends by itself: a paragraph right around it, and items, cells and rows of the same list or table."""
        last = lambda names: max((self._at[x][-1] for x in names if self._at.get(x)), default=0)
        if tag in PARAGRAPH_ENDS and self._blocks and self._open[self._blocks[-1]][0] == "p":
            self._pop_to(self._blocks[-1])
        if tag in CLOSES:
            bound = last(SCOPES.get(tag, ()))
            ended = [self._at[x][-1] for x in CLOSES[tag] if self._at.get(x) and self._at[x][-1] > bound]
            if ended and (tag != "p" or self._blocks[-1] == ended[0]):
                self._pop_to(min(ended))

    def _judge(self, tag: str, attributes: str) -> tuple[str, bool, bool]:
        """An element's label in paths, whether tag or names say that it is likely no article, and whether its share of the text may refute that."""
        by_tag = tag in LEFT_OUT and not (tag == "header" and self._in_article)
        if "=" not in attributes:
            return tag, by_tag or tag == "form", tag == "form" and not by_tag
        found = [(k.lower(), a or b or c) for k, a, b, c in ATTRIBUTE.findall(attributes)]
        classes = " ".join(sorted(NUMBERS.sub("", " ".join(v for k, v in found if k == "class")).lower().split()))
        label = f"{tag}.{classes}" if classes else tag
        if tag in ("html", "body", "main"):
            return label, False, False
        values = [LAYOUT_NAMES.sub("", v) for _, v in found]
        named = [v for v in values if LEFT_OUT_NAMES.search(v) or v.lower() in ROLES]
        sure = by_tag or any(LEFT_OUT_NAMES.search(DOUBTFUL_NAMES.sub("", v)) or v.lower() in ROLES - {"form", "search", "alert"} for v in named)
        likely_not = by_tag or tag == "form" or bool(named)
        return label, likely_not, likely_not and not sure

    def _trust(self) -> None:
        """Elements of doubtful names that hold most of the text that nothing else speaks against; then trust from the outside inwards."""
        open_, share = [True], [0] * len(self.outer)
        for k in range(1, len(self.outer)):  # elements come after those around them
            open_.append(open_[self.outer[k]] and (self.trusted[k] or self._doubtful[k]))
        for _, text, around in self.nodes:
            if open_[around]:
                share[around] += len(text)
        total = share[0] + sum(share[1:])
        for k in range(len(self.outer) - 1, 0, -1):
            share[self.outer[k]] += share[k]
        for k in range(1, len(self.outer)):
            believed = self.trusted[k] or self._doubtful[k] and 2 * share[k] > total
            self.trusted[k] = believed and self.trusted[self.outer[k]]


def scores(page: Page) -> tuple[np.ndarray, float]:
    """The fused ratio of each node's path, and its text-weighted mean."""
    lengths = np.array([len(t) for _, t, _ in page.nodes], float)
    marks = np.array([len(t) - len(t.translate(MARKS)) for _, t, _ in page.nodes], float)
    prior = np.array([1.0 if page.trusted[around] else PRIOR for *_, around in page.nodes])
    # A path below a mistrusted element and one of the same tags elsewhere are two.
    named: dict[tuple[int, bool], int] = {}
    of = np.array([named.setdefault((p, f == 1.0), len(named)) for (p, *_), f in zip(page.nodes, prior)])
    count = np.bincount(of)
    mean = lambda x: np.bincount(of, x) / count
    above = np.array([p for p, _ in page.paths])
    inside = np.bincount([p for p, *_ in page.nodes], prior, len(above))
    text, mark = (np.bincount([p for p, *_ in page.nodes], x * prior, len(above)) for x in (lengths, marks))
    for k in range(len(above) - 1, 0, -1):  # paths come after those that enclose them
        for x in (inside, text, mark):
            x[above[k]] += x[k]
    every = [x[0] / inside[0] for x in (text, mark)]
    common = inside >= inside[0] * (1 - 1e-9)  # what encloses everything says nothing about a part
    text, mark = (np.where(common, 0.0, x / np.maximum(inside, 1e-9)) for x in (text, mark))
    for k in range(1, len(above)):
        for x in (text, mark):
            x[k] = max(x[k], INHERITED * x[above[k]])
    reach = np.arange(-WINDOW_NODES, WINDOW_NODES + 1)
    kernel = np.exp(-(reach**2) / 2.0)
    window = lambda x: np.convolve(x, kernel)[WINDOW_NODES:-WINDOW_NODES]
    weight = window(np.ones(len(lengths)))
    at = np.array([max(above[p], 0) for p, *_ in page.nodes])
    title = np.array([page.paths[p][1].partition(".")[0] == "h1" for p, *_ in page.nodes])

    def smooth(own: np.ndarray, tree: np.ndarray, of_all: float) -> np.ndarray:
        near = window(mean(own * prior)[of]) / weight
        # A page's title may stand apart from its text; it has a share of the whole page's ratio.
        enclosing = np.where(title, np.maximum(tree[at], of_all), tree[at])
        return np.maximum(near, INHERITED * enclosing * prior)

    fused = smooth(lengths, text, every[0]) * (1 + smooth(marks, mark, every[1])) * prior
    # A path's score is the median of its nodes', so that a few beside the article do not lift the rest.
    score = fused[np.lexsort((fused, of))[np.cumsum(count) - count + (count - 1) // 2]][of]
    weight = lengths * prior
    return score, score @ weight / weight.sum()


def main_text(page: str | None, threshold: float = THRESHOLD) -> str:
    """The text of the nodes whose paths reach the threshold, in page order, joined by one space."""
    parsed = Page(page or "")
    if not any(parsed.trusted[around] for *_, around in parsed.nodes):
        return ""
    score, usual = scores(parsed)
    return " ".join(t for (_, t, _), s in zip(parsed.nodes, score) if s >= threshold * usual)


def extract_text(df: DataFrame, html: str = "html", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``df`` without ``html``, with the main text and its number of code points."""
    rest = [c for c in df.columns if c not in (html, text, "n_chars")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_size(batches):
            found = [main_text(x, threshold) for x in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(found, pa.string()), pa.array(map(len, found), pa.int64())], [*rest, text, "n_chars"])

    schema = "".join(f"`{c}` {df.schema[c].dataType.simpleString()}, " for c in rest) + f"`{text}` string, n_chars bigint"
    return df.select(F.col(html).alias("_html"), *(df[c] for c in rest)).mapInArrow(run, schema)
