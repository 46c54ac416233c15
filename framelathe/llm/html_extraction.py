"""Main text of HTML pages from flat text blocks and a decision tree.

A page becomes a list of text blocks without nesting.  Each block has its word
count and link density, those of its neighbours, and which kind of element it
lies in (and whether any lies in an article's); a decision tree, trained on the small labelled table below, says
whether it belongs to the article.
"""

from __future__ import annotations

import html as entities
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import balanced

NAME = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)")
#: The rest of a tag; a ``>`` in quotes doesn't end it.  Nothing is tried twice.
REST = re.compile(r"((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>")
#: What they hold is no text, up to their end tag or the end of the page.
RAW = {
    t: re.compile(rf"</{t}\s*+>", re.I)
    for t in "script style title noscript template svg iframe textarea select button object math canvas".split()
}
#: Tags of a page whose quotes never close; after so many quotes are no longer looked at, so a page takes linear time.
UNCLOSED = 8
LONG_NUMBER = re.compile(r"&#[0-9]{8,}+;?")
HINTED = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
BLOCK = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that close themselves when a block of their kind, or their parent, begins or ends.
LOOSE = frozenset("p li dt dd tr td th option b i a span em strong u font".split())
BOILER_TAGS = frozenset("nav footer aside form dialog menu fieldset".split())
MAIN_TAGS = frozenset("article main".split())
#: Words of class, id and role that mark what is not the article.  Fixed values.
BOILER_WORDS = frozenset(
    "ad ads adv advert adverts advertisement adsense sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert "
    "popup modal overlay newsletter subscribe signup login sidebar menu menubar nav navbar navigation breadcrumb breadcrumbs topbar toolbar header masthead "
    "footer contentinfo complementary share sharing social related recommended widget search form comment comments commentlist disqus reply replies "
    "respond discussion".split()
)
COMMENT_WORDS = frozenset("comment comments commentlist disqus reply replies respond discussion".split())
MAIN_WORDS = frozenset("article content main post entry story".split())

#: The labelled table: words, link density, words and density of the block before and of the one after,
#: place (1 in the article's element or one named like it, -1 in a boilerplate element, 0 in neither, -0.5 in neither
#: on a page that has an <article> or <main>), heading; label (1: article).
LABELLED = (
    (1, 1.0, 0, 0.0, 1, 1.0, -1, 0, 0), (1, 1.0, 1, 1.0, 1, 1.0, -1, 0, 0), (2, 1.0, 1, 1.0, 9, 0.0, -1, 0, 0),
    (12, 0.0, 2, 1.0, 8, 0.0, -1, 0, 0), (30, 0.0, 1, 1.0, 60, 0.0, -1, 0, 0), (45, 0.1, 80, 0.0, 6, 0.0, -1, 0, 0),
    (9, 0.0, 70, 0.0, 0, 0.0, -1, 0, 0), (60, 0.0, 40, 0.0, 20, 0.0, -1, 0, 0), (6, 0.5, 40, 0.0, 3, 1.0, -1, 0, 0),
    (4, 0.0, 1, 1.0, 25, 0.0, -1, 1, 0), (120, 0.0, 9, 0.0, 0, 0.0, -1, 0, 0), (3, 0.0, 5, 0.0, 4, 0.0, -1, 0, 0),
    (8, 0.0, 12, 0.0, 70, 0.0, 1, 1, 1), (70, 0.0, 8, 0.0, 1, 0.0, 1, 0, 1), (1, 0.0, 70, 0.0, 55, 0.0, 1, 0, 1),
    (2, 0.0, 1, 0.0, 1, 0.0, 1, 0, 1), (55, 0.2, 1, 0.0, 9, 0.0, 1, 0, 1), (6, 0.0, 1, 1.0, 0, 0.0, 1, 0, 1),
    (140, 0.0, 20, 0.0, 9, 0.0, 1, 0, 1), (3, 1.0, 80, 0.0, 60, 0.0, 1, 0, 1), (10, 0.4, 2, 1.0, 30, 0.0, 1, 0, 1),
    (1, 0.0, 1, 1.0, 1, 1.0, 1, 0, 1), (25, 1.0, 25, 1.0, 25, 1.0, 1, 0, 0), (2, 0.0, 0, 0.0, 0, 0.0, 1, 0, 1),
    (1, 1.0, 0, 0.0, 1, 1.0, 0, 0, 0), (2, 1.0, 1, 1.0, 3, 1.0, 0, 0, 0), (5, 0.8, 2, 1.0, 9, 0.0, 0, 0, 0),
    (3, 0.0, 2, 1.0, 2, 1.0, 0, 0, 0), (4, 0.0, 5, 0.8, 3, 0.6, 0, 0, 0), (7, 0.0, 90, 0.0, 0, 0.0, 0, 0, 0),
    (14, 0.9, 60, 0.0, 12, 0.9, 0, 0, 0), (30, 0.7, 12, 0.9, 4, 0.0, 0, 0, 0), (6, 0.0, 2, 1.0, 80, 0.0, 0, 1, 1),
    (9, 0.0, 70, 0.0, 65, 0.0, 0, 0, 1), (5, 0.0, 60, 0.0, 90, 0.0, 0, 1, 1), (40, 0.0, 3, 1.0, 60, 0.0, 0, 0, 1),
    (85, 0.05, 40, 0.0, 70, 0.1, 0, 0, 1), (70, 0.1, 85, 0.0, 5, 0.8, 0, 0, 1), (22, 0.0, 60, 0.0, 3, 0.0, 0, 0, 1),
    (35, 0.2, 6, 0.0, 28, 0.0, 0, 0, 1), (150, 0.0, 2, 1.0, 2, 1.0, 0, 0, 1), (18, 0.0, 20, 0.0, 16, 0.0, 0, 0, 1),
    (4, 0.0, 30, 0.0, 40, 0.0, 0, 0, 1), (2, 0.0, 50, 0.0, 25, 0.0, 0, 0, 1), (2, 0.0, 3, 0.0, 2, 1.0, 0, 0, 0),
    (3, 0.0, 0, 0.0, 2, 1.0, 0, 0, 0), (6, 0.0, 6, 0.0, 3, 0.9, 0, 0, 0), (24, 0.0, 0, 0.0, 30, 0.0, 0, 0, 1),
    (1, 1.0, 1, 1.0, 75, 0.0, 0, 0, 0), (2, 1.0, 0, 0.0, 60, 0.0, 0, 0, 0), (4, 1.0, 2, 1.0, 120, 0.0, 0, 0, 0), (6, 0.9, 3, 0.0, 45, 0.1, 0, 0, 0),
    (85, 0.0, 40, 0.0, 0, 0.0, 0, 0, 1), (60, 0.0, 0, 0.0, 0, 0.0, 0, 0, 1), (95, 0.1, 2, 1.0, 90, 0.0, 0, 0, 1), (45, 0.0, 70, 0.0, 1, 1.0, 0, 0, 1),
    # lists of links in the article's element, and single links and text beside links there
    (1, 1.0, 1, 1.0, 1, 1.0, 1, 0, 0), (2, 1.0, 2, 1.0, 3, 1.0, 1, 0, 0), (6, 0.9, 4, 1.0, 5, 1.0, 1, 0, 0), (12, 1.0, 9, 1.0, 8, 1.0, 1, 0, 0),
    (3, 1.0, 60, 0.0, 3, 1.0, 1, 0, 0), (3, 1.0, 3, 1.0, 60, 0.0, 1, 0, 0), (2, 1.0, 80, 0.1, 2, 1.0, 1, 0, 0), (5, 1.0, 4, 1.0, 0, 0.0, 1, 0, 0),
    (60, 1.0, 40, 1.0, 50, 1.0, 1, 0, 0), (8, 0.8, 9, 0.9, 7, 0.8, 1, 0, 0), (4, 1.0, 4, 1.0, 30, 0.0, 1, 0, 0),
    (6, 1.0, 40, 0.0, 50, 0.0, 1, 0, 1), (2, 1.0, 0, 0.0, 70, 0.0, 1, 0, 1), (1, 1.0, 30, 0.1, 9, 0.0, 1, 0, 1), (25, 1.0, 60, 0.0, 40, 0.0, 1, 0, 1),
    (8, 1.0, 70, 0.0, 0, 0.0, 1, 0, 1), (1, 1.0, 0, 0.0, 0, 0.0, 1, 0, 1), (30, 0.4, 40, 0.1, 30, 0.4, 1, 0, 1), (14, 0.5, 9, 0.3, 2, 1.0, 1, 0, 1),
    (3, 0.0, 4, 1.0, 5, 1.0, 1, 0, 1), (40, 0.0, 2, 1.0, 2, 1.0, 1, 0, 1), (12, 0.0, 9, 1.0, 60, 0.0, 1, 0, 1), (90, 0.0, 3, 1.0, 70, 0.0, 1, 0, 1),
    (5, 0.3, 4, 1.0, 6, 1.0, 1, 0, 1), (2, 0.5, 3, 1.0, 3, 1.0, 1, 0, 1),
)

#: Blocks outside the article's element of a page that has one, with the same columns.
OUTSIDE = (
    (3, 0.0, 0, 0.0, 9, 0.0, -0.5, 0, 0), (40, 0.0, 2, 1.0, 60, 0.0, -0.5, 0, 0), (12, 0.0, 30, 0.0, 80, 0.0, -0.5, 0, 0), (5, 0.0, 1, 1.0, 45, 0.0, -0.5, 1, 0),
    (90, 0.0, 70, 0.0, 0, 0.0, -0.5, 0, 0), (25, 0.4, 6, 0.0, 20, 0.0, -0.5, 0, 0), (2, 1.0, 2, 1.0, 2, 1.0, -0.5, 0, 0), (60, 0.1, 9, 0.0, 150, 0.0, -0.5, 0, 0),
)


def grow(x: np.ndarray, y: np.ndarray, depth: int = 7):
    """A classification tree by Gini impurity: a label, or (feature, threshold, tree up to it, tree above)."""
    if depth == 0 or len(set(y.tolist())) == 1:
        return int(y.mean() >= 0.5)
    gini = lambda v: len(v) * (v.mean() * (1 - v.mean())) if len(v) else 0.0
    best = (gini(y) - 1e-9, None)
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        for t in (values[1:] + values[:-1]) / 2:
            low = x[:, f] <= t
            cost = gini(y[low]) + gini(y[~low])
            if cost < best[0] - 1e-9:
                best = (cost, (f, float(t)))
    if best[1] is None:
        return int(y.mean() >= 0.5)
    f, t = best[1]
    low = x[:, f] <= t
    return (f, t, grow(x[low], y[low], depth - 1), grow(x[~low], y[~low], depth - 1))


def train(rows=LABELLED + OUTSIDE):
    table = np.array(rows, float)
    return grow(table[:, :-1], table[:, -1])


def says(tree, x) -> int:
    while not isinstance(tree, int):
        tree = tree[2] if x[tree[0]] <= tree[1] else tree[3]
    return tree


def place_of(tag: str, attrs: str, above: float, fixed: bool) -> tuple[float, bool]:
    """Place of what an element holds, given that of the element around it; fixed: nothing below changes it.

    0.5 stands for elements only named like an article's: a class may mark a title or a byline alone.
    """
    if fixed:
        return above, True
    words: set[str] = set()
    for m in HINTED.finditer(attrs):
        words.update(re.split(r"[^a-z0-9]+", (m[1] or m[2] or m[3] or "").lower()))
    if tag in BOILER_TAGS or words & COMMENT_WORDS and tag not in ("html", "body"):
        return -1, True
    if tag in ("html", "body"):
        return above, False
    if tag in MAIN_TAGS:
        return (-1 if words & BOILER_WORDS - {"header", "related", "share"} else 1), False
    if tag == "header":
        return (above if above > 0 else -1), False
    if words & BOILER_WORDS:
        return -1, False
    if above == 0 and words & MAIN_WORDS:
        return 0.5, False
    return above, False


def unescape(text: str) -> str:
    """Character references decoded; numbers beyond any character are U+FFFD, however long they are."""
    return entities.unescape(LONG_NUMBER.sub("\ufffd", text) if "&#" in text else text)


def tags(page: str):
    """``start, end, closing, tag, attributes`` of each tag in order, other markup with an empty tag; one pass.

    Comments end at ``-->``, raw elements with their end tag, both else with the page.  A tag whose quotes never close
    ends at its first ``>``; a ``<`` without any ``>`` after it is text.
    """
    at, last, unclosed = 0, page.rfind(">"), 0
    while True:
        at = page.find("<", at)
        if at < 0:
            return
        if page.startswith("<!--", at):
            end = page.find("-->", at + 4)
            end = len(page) if end < 0 else end + 3
            yield at, end, False, "", ""
            at = end
            continue
        if at > last:
            at = page.find("<!--", at)  # only a comment needs no end
            if at < 0:
                return
            continue
        name = NAME.match(page, at)
        if name:
            rest = REST.match(page, name.end()) if unclosed < UNCLOSED else None
            if rest:
                attrs, end = rest[1], rest.end()
            else:
                unclosed += 1
                stop = page.index(">", at)
                attrs, end = page[name.end() : stop], stop + 1
            tag = name[2].lower()
            if not name[1] and tag in RAW:
                close = RAW[tag].search(page, end)
                end = close.end() if close else len(page)
                yield at, end, False, "", ""
            else:
                yield at, end, bool(name[1]), tag, attrs
            at = end
        elif page[at + 1 : at + 2] in ("!", "?", "/"):
            end = page.index(">", at) + 1
            yield at, end, False, "", ""
            at = end
        else:
            at += 1


class Stack:
    """Open elements.  Where each kind is open is known, so that no end tag looks through all of them."""

    def __init__(self):
        self.held: list[tuple[str, float, bool, bool, bool]] = []  # tag, place, fixed, in a link, in a heading
        self.where: dict[str, list[int]] = {}
        self.firm: list[int] = []  # those that don't close themselves

    def top(self) -> tuple[str, float, bool, bool, bool]:
        return self.held[-1] if self.held else ("", 0, False, False, False)

    def push(self, tag: str, *state) -> None:
        self.where.setdefault(tag, []).append(len(self.held))
        if tag not in LOOSE:
            self.firm.append(len(self.held))
        self.held.append((tag, *state))

    def cut(self, depth: int) -> None:
        while len(self.held) > depth:
            tag = self.held.pop()[0]
            self.where[tag].pop()
            if tag not in LOOSE:
                self.firm.pop()

    def close(self, kinds, within: bool) -> None:
        """Close the innermost element of these kinds; within: unless it is around one that doesn't close itself."""
        depth = max((self.where[t][-1] for t in kinds if self.where.get(t)), default=-1)
        if depth >= 0 and not (within and self.firm and self.firm[-1] > depth):
            self.cut(depth)


def blocks(page: str) -> list[tuple[str, int, int, float, int]]:
    """Flat blocks: text, words, words in links, place, heading."""
    out: list[tuple[str, int, int, float, int]] = []
    stack = Stack()
    place, fixed, link, heading = 0, False, False, False
    parts: list[tuple[str, bool]] = []
    at = 0

    def flush() -> None:
        if parts:
            text = " ".join(unescape("".join(p for p, _ in parts)).split())
            if text:
                inside = sum(len(unescape(p).split()) for p, a in parts if a)
                words = text.count(" ") + 1
                out.append((text, words, min(inside, words), place, int(heading)))
            parts.clear()

    for start, end, closing, tag, attrs in tags(page):
        if start > at:
            parts.append((page[at:start], link))
        at = end
        if not tag:
            continue
        if tag in BLOCK:
            flush()
        if tag in VOID:
            continue
        if closing:
            stack.close((tag,), tag in LOOSE)  # a stray end tag doesn't close what is around it
        else:
            if tag in ("p", "li", "dt", "dd", "tr", "td", "th", "option") or tag in BLOCK and stack.top()[0] == "p":
                stack.close({"dt", "dd", "p"} if tag in ("dt", "dd") else {"td", "th", "p"} if tag in ("td", "th") else {tag, "p"}, True)
            _, above, hard, linked, headed = stack.top()
            if tag in BLOCK or tag in MAIN_TAGS or attrs:
                above, hard = place_of(tag, attrs, above, hard)
            if not attrs.endswith("/") or tag in BLOCK:
                stack.push(tag, above, hard, linked or tag == "a", headed or tag in ("h1", "h2", "h3", "h4", "h5", "h6"))
        _, place, fixed, link, heading = stack.top()
    if at < len(page):
        parts.append((page[at:], link))
    flush()
    return out


def main_text(page: str | None, tree) -> str:
    found = blocks(page or "")
    edge = ("", 0, 0, 0, 0)
    outside = -0.5 if any(b[3] == 1 for b in found) else 0
    kept = []
    for k, (text, words, linked, place, heading) in enumerate(found):
        before = found[k - 1] if k else edge
        after = found[k + 1] if k + 1 < len(found) else edge
        x = (words, linked / words, before[1], before[2] / max(1, before[1]), after[1], after[2] / max(1, after[1]), 1 if place > 0 else place or outside, heading)
        if says(tree, x):
            kept.append(text)
    return " ".join(kept)


def extract(pages: DataFrame, labelled=LABELLED + OUTSIDE) -> DataFrame:
    """``page_id, url, text, n_chars`` for every row of ``pages``.

    Null and empty html give an empty text.  Character references are decoded,
    white space inside a block is one space, and kept blocks are joined in page
    order by one space.  Rows stand alone and repeat as they do in ``pages``;
    other columns are not looked at.  Very long pages and unclosed markup take
    time in proportion to their length.  Empty table: empty.
    """
    tree = train(labelled)

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 500):
                part = b.slice(at, 500)
                text = [main_text(x, tree) for x in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(text, pa.string())], names=["page_id", "url", "text"])

    plain = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    return balanced(plain).mapInArrow(run, "page_id long, url string, text string").withColumn("n_chars", F.length("text").cast("long"))


def op5_query(spark, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
