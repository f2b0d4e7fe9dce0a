"""Main text of HTML pages: flat text blocks judged by a decision tree.

A page is cut into flat blocks of text at block-level tags. Each block is described by its own word count and
link density, those of its neighbours, and what encloses it: whether an article or main element, and whether an element
that by its name or class holds navigation, notices, adverts, forms or reader comments. A decision tree,
grown by Gini impurity from the small labelled table below, tells main text from the rest. On pages without such elements
words and links of a block and of its neighbours decide; what stands in an article and in nothing apart within it is all kept.

An element around the article is no menu or form, whatever its class says, and neither are ``html`` and ``body``; a form around an article
or a first-level heading is one around the page, any other holds no main text, however long. Where a page would be left without any text,
its articles count although they stand in a sidebar, as in one that is never closed. An unclosed declaration is text. The scan takes time in proportion to the page.

A null or empty page has an empty text. Character references are decoded once, white space within a block becomes
one space, and the blocks of the main text are joined in page order by one space. Pages are judged one by one, so repeated rows
have equal texts; a leaf of the tree with as many rows of either label is main text.
"""

from __future__ import annotations

import html
import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tidemark.llm.common import add_columns

#: Elements that don't end a block of text.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q ruby rb rp rt s samp small span strike strong sub sup"
    " time tt u var wbr img".split()
)
#: Elements without content or end tag.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no text of the page.
UNSEEN = ("script", "style", "noscript", "template", "textarea", "iframe", "svg", "title", "select", "object")
#: Elements that hold no main text.
APART = frozenset("nav footer aside header form menu dialog button fieldset head".split())
#: Words of classes, ids and roles that mark elements without main text.
MARKS = frozenset(
    "ad ads advert adverts advertisement adverts banner sponsor sponsored promo promotion nav navbar navigation menu breadcrumb breadcrumbs sidebar"
    " footer header masthead cookie cookies consent gdpr notice notices alert popup modal overlay comment comments reply replies disqus"
    " share sharing social related recommended newsletter subscribe subscription signup login search widget pagination pager toolbar copyright"
    " contentinfo complementary".split()
)
#: Of these, the words of elements that may hold articles of their own, which are not the page's.
SIDE = frozenset(
    "ad ads advert adverts advertisement adverts sponsor sponsored promo promotion sidebar comment comments reply replies disqus related recommended"
    " share sharing social newsletter".split()
)
#: Words of class names that tell the state of an element and not what it holds.
STATES = frozenset("has no is with without show hide open opened closed enabled disabled active expanded collapsed fixed sticky toggle".split())
ARTICLE = frozenset(("article", "main"))
#: Elements of running text; only words of SIDE mark them.
RUNNING = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd td th blockquote pre figcaption".split())
#: Elements that end an open one of the same name.
SAME = frozenset("li dt dd td th tr option".split())
_ATTRIBUTES = r"((?:[^<>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')|=)*+)>"
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<svg\b[^<>]*/>|<(" + "|".join(UNSEEN) + r")\b" + _ATTRIBUTES.replace("((?:", "(?:(?:", 1) + r".*?(?:</\1\s*>|\Z)"
    r"|<[!?][^<>]*+>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)" + _ATTRIBUTES,
    re.S | re.I,
)
NAMED = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
FEATURES = ("words", "link_density", "words_before", "link_density_before", "words_after", "link_density_after", "article", "apart")
#: The labelled table: values of FEATURES, then 1 for main text.
LABELLED = (
    # Blocks of an article.
    (120, 0.0, 40, 0.0, 80, 0.0, 1, 0, 1), (35, 0.0, 9, 0.0, 60, 0.0, 1, 0, 1), (9, 0.0, 8, 0.0, 35, 0.0, 1, 0, 1),
    (1, 0.0, 60, 0.0, 40, 0.0, 1, 0, 1), (2, 0.0, 8, 0.0, 3, 0.0, 1, 0, 1), (3, 0.0, 2, 0.0, 12, 0.0, 1, 0, 1),
    (60, 0.2, 30, 0.0, 45, 0.1, 1, 0, 1), (4, 1.0, 50, 0.0, 70, 0.0, 1, 0, 1), (14, 0.6, 22, 0.1, 18, 0.0, 1, 0, 1),
    (300, 0.0, 1, 0.0, 12, 0.0, 1, 0, 1), (8, 0.0, 8, 0.0, 12, 0.0, 1, 0, 1), (25, 0.0, 3, 0.0, 10, 0.1, 1, 0, 1),
    (43, 0.0, 58, 0.0, 2, 0.0, 1, 0, 1), (10, 0.0, 1, 1.0, 30, 0.0, 1, 0, 1), (1, 0.0, 1, 1.0, 1, 0.0, 1, 0, 1),
    (11, 0.0, 3, 1.0, 2, 1.0, 1, 0, 1), (2, 0.0, 1, 0.0, 1, 0.0, 1, 0, 1), (64, 0.0, 1, 1.0, 1, 1.0, 1, 0, 1), (5, 0.5, 12, 0.6, 1, 1.0, 1, 0, 1),
    (3, 1.0, 30, 0.0, 12, 0.0, 1, 0, 1), (6, 1.0, 9, 0.0, 20, 0.0, 1, 0, 1), (2, 1.0, 40, 0.0, 9, 0.0, 1, 0, 1), (5, 1.0, 12, 0.1, 0, 0.0, 1, 0, 1),
    (4, 1.0, 3, 1.0, 25, 0.0, 1, 0, 1), (2, 1.0, 25, 0.0, 3, 1.0, 1, 0, 1),
    # Lists of links and lines between them within an article.
    (3, 1.0, 2, 1.0, 1, 1.0, 1, 0, 1), (2, 1.0, 4, 1.0, 3, 1.0, 1, 0, 1), (6, 1.0, 5, 1.0, 7, 1.0, 1, 0, 1), (8, 0.0, 30, 0.0, 3, 1.0, 1, 0, 1),
    (20, 0.8, 15, 0.9, 25, 0.7, 1, 0, 1), (7, 0.6, 40, 0.0, 2, 1.0, 1, 0, 1), (12, 0.7, 80, 0.0, 2, 1.0, 1, 0, 1), (3, 0.7, 90, 0.0, 0, 0.0, 1, 0, 1),
    (1, 1.0, 0, 0.0, 0, 0.0, 1, 0, 1), (4, 0.0, 3, 1.0, 5, 0.9, 1, 0, 1), (9, 0.0, 5, 1.0, 4, 1.0, 1, 0, 1), (6, 0.9, 4, 1.0, 20, 0.0, 1, 0, 1),
    # Blocks of elements that stand apart.
    (1, 1.0, 0, 0.0, 1, 1.0, 0, 1, 0), (1, 1.0, 1, 1.0, 1, 1.0, 0, 1, 0), (2, 1.0, 1, 1.0, 8, 0.0, 0, 1, 0),
    (8, 0.0, 1, 1.0, 9, 0.0, 0, 1, 0), (12, 0.0, 2, 1.0, 7, 0.0, 0, 1, 0), (45, 0.0, 3, 1.0, 60, 0.0, 0, 1, 0),
    (10, 0.0, 70, 0.0, 0, 0.0, 0, 1, 0), (17, 0.1, 25, 0.0, 0, 0.0, 0, 1, 0), (6, 0.5, 120, 0.0, 2, 1.0, 0, 1, 0),
    (30, 0.0, 25, 0.0, 40, 0.0, 1, 1, 0), (5, 0.0, 60, 0.0, 22, 0.0, 1, 1, 0), (70, 0.0, 50, 0.0, 80, 0.0, 1, 1, 0),
    # Pages without such elements: long blocks, and short ones beside long ones.
    (150, 0.0, 12, 0.0, 90, 0.0, 0, 0, 1), (40, 0.0, 150, 0.0, 60, 0.0, 0, 0, 1), (25, 0.1, 90, 0.0, 10, 0.2, 0, 0, 1),
    (18, 0.0, 30, 0.0, 45, 0.1, 0, 0, 1), (16, 0.2, 60, 0.0, 3, 1.0, 0, 0, 1), (80, 0.0, 2, 1.0, 2, 1.0, 0, 0, 1),
    (4, 0.0, 60, 0.0, 80, 0.0, 0, 0, 1), (2, 0.0, 45, 0.0, 120, 0.0, 0, 0, 1), (9, 0.0, 3, 1.0, 40, 0.0, 0, 0, 1),
    (6, 0.0, 1, 1.0, 150, 0.0, 0, 0, 1), (3, 0.0, 70, 0.0, 25, 0.1, 0, 0, 1), (11, 0.1, 30, 0.0, 28, 0.0, 0, 0, 1),
    (7, 0.0, 5, 0.0, 40, 0.0, 0, 0, 1), (10, 0.0, 9, 0.0, 8, 0.0, 0, 0, 1), (5, 0.0, 0, 0.0, 0, 0.0, 0, 0, 1),
    (30, 0.4, 50, 0.1, 60, 0.0, 0, 0, 1), (8, 0.2, 40, 0.1, 35, 0.0, 0, 0, 1), (3, 0.0, 4, 0.0, 5, 0.0, 0, 0, 1),
    # And what surrounds it there: menus, lists of links, captions of menus, lines between them.
    (3, 1.0, 2, 1.0, 2, 1.0, 0, 0, 0), (1, 0.0, 1, 1.0, 2, 1.0, 0, 0, 0), (6, 0.9, 4, 1.0, 20, 0.0, 0, 0, 0),
    (20, 0.8, 15, 0.9, 25, 0.7, 0, 0, 0), (4, 0.0, 3, 1.0, 5, 0.9, 0, 0, 0), (7, 0.6, 40, 0.0, 2, 1.0, 0, 0, 0),
    (2, 1.0, 0, 0.0, 3, 1.0, 0, 0, 0), (2, 1.0, 2, 1.0, 9, 0.0, 0, 0, 0), (5, 0.0, 2, 1.0, 3, 1.0, 0, 0, 0),
    # A page of one block.
    (12, 0.0, 0, 0.0, 0, 0.0, 0, 0, 1), (20, 0.0, 0, 0.0, 0, 0.0, 0, 0, 1), (3, 0.0, 0, 0.0, 0, 0.0, 0, 0, 1), (9, 0.1, 0, 0.0, 0, 0.0, 0, 0, 1),
    # Lines at the foot of a page, and notices between a menu and a short heading.
    (8, 0.0, 60, 0.0, 0, 0.0, 0, 0, 0), (15, 0.0, 30, 0.0, 0, 0.0, 0, 0, 0), (6, 0.0, 12, 0.0, 0, 0.0, 0, 0, 0), (12, 0.0, 9, 0.0, 0, 0.0, 0, 0, 0),
    (10, 0.0, 5, 0.0, 0, 0.0, 0, 0, 0), (18, 0.0, 100, 0.0, 0, 0.0, 0, 0, 0), (60, 0.0, 45, 0.0, 0, 0.0, 0, 0, 1), (35, 0.0, 20, 0.0, 0, 0.0, 0, 0, 1),
    (90, 0.0, 8, 0.0, 0, 0.0, 0, 0, 1), (70, 0.0, 0, 0.0, 0, 0.0, 0, 0, 1), (30, 0.0, 90, 0.0, 0, 0.0, 0, 0, 1),
    (8, 0.0, 1, 1.0, 10, 0.0, 0, 0, 0), (6, 0.0, 2, 1.0, 9, 0.0, 0, 0, 0), (10, 0.0, 3, 1.0, 5, 0.0, 0, 0, 0), (9, 0.0, 1, 1.0, 2, 0.0, 0, 0, 0),
    (9, 0.0, 20, 0.0, 1, 0.0, 0, 0, 1), (15, 0.0, 40, 0.0, 2, 0.0, 0, 0, 1), (6, 0.0, 9, 0.0, 1, 0.0, 0, 0, 1), (1, 0.0, 30, 0.0, 9, 0.0, 0, 0, 1),
    (2, 0.0, 12, 0.0, 6, 0.0, 0, 0, 1), (1, 0.0, 8, 0.0, 18, 0.0, 0, 0, 1), (2, 0.0, 5, 0.0, 2, 0.0, 0, 0, 1), (18, 0.0, 15, 0.0, 8, 0.0, 0, 0, 1),
    (12, 0.0, 2, 1.0, 12, 0.0, 0, 0, 0), (5, 0.0, 1, 1.0, 30, 0.0, 0, 0, 1), (8, 0.0, 2, 1.0, 60, 0.0, 0, 0, 1),
    (9, 0.0, 5, 1.0, 4, 1.0, 0, 0, 0), (3, 0.7, 90, 0.0, 0, 0.0, 0, 0, 0), (12, 0.7, 80, 0.0, 2, 1.0, 0, 0, 0), (2, 0.0, 3, 1.0, 1, 1.0, 0, 0, 0),
)


def grow(rows, depth: int = 8):
    """A tree as nested tuples (feature, limit, at most, above), or a leaf 0 or 1."""
    ones = sum(r[-1] for r in rows)
    if depth == 0 or ones in (0, len(rows)):
        return int(2 * ones >= len(rows))
    best = None
    for f in range(len(FEATURES)):
        values = sorted({r[f] for r in rows})
        for a, b in zip(values, values[1:], strict=False):
            low = [r for r in rows if r[f] <= (a + b) / 2]
            high = [r for r in rows if r[f] > (a + b) / 2]
            mixed = sum(len(s) - (sum(r[-1] for r in s) ** 2 + sum(1 - r[-1] for r in s) ** 2) / len(s) for s in (low, high))
            if best is None or mixed < best[0]:
                best = (mixed, f, (a + b) / 2, low, high)
    if best is None:
        return int(2 * ones >= len(rows))
    _, f, limit, low, high = best
    return f, limit, grow(low, depth - 1), grow(high, depth - 1)


@lru_cache(maxsize=1)
def tree():
    return grow(LABELLED)


def is_main(features: tuple[float, ...], node) -> bool:
    while isinstance(node, tuple):
        f, limit, low, high = node
        node = low if features[f] <= limit else high
    return bool(node)


def _marks(attributes: str) -> frozenset[str] | set[str]:
    """The words of MARKS in the classes, id and role of an element; names with a word of STATES don't count."""
    found: set[str] = set()
    for m in NAMED.findall(attributes):
        for name in "".join(m).lower().split():
            said = re.split(r"[^a-z0-9]+", name)
            if not STATES.intersection(said):
                found |= MARKS.intersection(said)
    return found


def blocks(page: str) -> list[tuple[str, int, int, int, int, int]]:
    """(text, words, words in links, within an article, within something apart, apart within the article) of each flat block that has text."""
    found: list[list] = []
    said: list[str] = []
    # Open block-level elements: name, whether an article, whether apart, whether that holds around an article, first block, whether around one.
    open_: list[list] = []
    counts: dict[str, int] = {}
    forms: list[tuple[int, int, int]] = []  # first and last block of forms that aren't around the page, and whether within an article
    links = article = apart = outside = seen = headed = 0  # ``outside``: what is apart around the outermost article; so many open ones had an article, a heading
    linked: list[str] = []

    def close() -> None:
        nonlocal said, linked
        text = " ".join("".join(said).split())
        if text:
            found.append([text, text.count(" ") + 1, len("".join(linked).split()), int(article > 0), int(apart > 0), int(apart > outside)])
        said, linked = [], []

    def take(data: str) -> None:
        data = html.unescape(data)
        said.append(data)
        if links:
            linked.append(data)

    def leave() -> str:
        nonlocal article, apart, outside, seen, headed
        name, was_article, was_apart, _, first, around = open_.pop()
        counts[name] -= 1
        article -= was_article
        apart -= was_apart
        seen, headed = min(seen, len(open_)), min(headed, len(open_))
        if not article:
            outside = 0
        if name == "form" and not around and first < len(found):
            forms.append((first, len(found), int(article > 0)))
        return name

    at = 0
    for m in TOKEN.finditer(page):
        if m.start() > at:
            take(page[at : m.start()])
        at = m.end()
        name = m[3]
        if name is None:
            continue
        name = name.lower()
        if name in INLINE:
            if name == "a":
                if m[2]:
                    links = 0
                    linked.append(" ")
                else:
                    links = 1
            continue
        close()
        if name in VOID:
            continue
        if not m[2]:
            while open_ and (open_[-1][0] == "p" or open_[-1][0] == name in SAME):
                leave()
            marks = _marks(m[4]) if m[4] and name not in ("html", "body") else frozenset()
            side = bool(SIDE.intersection(marks))
            is_article = int(name in ARTICLE and not side)
            # A header within an article holds its heading, and is main text unless it is marked.
            by_name = name in APART and name != "form" and not (name == "header" and article)
            is_apart = int(by_name or side or bool(marks) and not is_article and name not in RUNNING)
            if is_article:
                for o in open_[seen:]:  # what stands around the article is no menu or form; those below have been seen to
                    if o[2] and not o[3]:
                        apart -= 1
                        o[2] = 0
                    o[5] = 1
                seen = len(open_)
                if not article:
                    outside = apart
            elif name == "h1":
                for o in open_[headed:]:
                    o[5] = 1
                headed = len(open_)
            if not m[4].endswith("/"):
                open_.append([name, is_article, is_apart, by_name or side, len(found), 0])
                counts[name] = counts.get(name, 0) + 1
                article += is_article
                apart += is_apart
        elif counts.get(name):
            links = 0
            while leave() != name:
                pass
    if at < len(page):
        take(page[at:])
    close()
    while open_:
        leave()
    starts, ends = [0] * (len(found) + 1), [0] * (len(found) + 1)  # how many forms, and forms within articles, begin less those that end here
    for first, last, inside in forms:
        for change, at in ((1, first), (-1, last)):
            starts[at] += change
            ends[at] += change * inside
    held = inner = 0
    for k, b in enumerate(found):
        held, inner = held + starts[k], inner + ends[k]
        b[4], b[5] = int(b[4] or held > 0), int(b[5] or inner > 0)
    return [tuple(b) for b in found]


def main_text(page: str | None) -> str:
    """The main text of one page."""
    if not page:
        return ""
    found = blocks(page)
    # Next to the edge of a page stands an empty block.
    shape = [(0, 0.0)] + [(b[1], min(1.0, b[2] / b[1])) for b in found] + [(0, 0.0)]
    for place in (4, 5):  # an article within something apart counts if nothing else does
        kept = []
        for k, b in enumerate(found, 1):
            if (place == 4 or b[3]) and is_main((*shape[k], *shape[k - 1], *shape[k + 1], b[3], b[place]), tree()):
                kept.append(b[0])
        if kept:
            break
    return " ".join(kept)


def extract(pages: DataFrame, html_col: str = "html", text_col: str = "text") -> DataFrame:
    """Add ``text_col``, the main text of each page; a column of that name is replaced, all others stay."""

    def start():
        return lambda column: [[main_text(p) for p in column.to_pylist()]]

    return add_columns(pages, [html_col], [T.StructField(text_col, T.StringType())], start)
