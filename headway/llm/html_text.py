"""Main text of web pages: flat text blocks, classified by a decision tree over their own and their neighbours' features.

The features of a block are its words and link density, those of the blocks before and after, whether it is in an
article, one flag for each kind of surrounding that its page names (menu, header, footer, sidebar, form, notice,
advert, comments) and the number of these other than menu. The tree is grown from a labelled table.
"""

from __future__ import annotations

import html
import random
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# HTML element names.
RAW = {"script", "style", "textarea", "title", "template", "iframe", "noscript", "noembed", "xmp", "svg", "select", "object", "canvas"}
TEXT_ONLY = {"script", "style", "textarea", "title", "iframe", "noembed", "xmp"}
BLOCK = set("address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
CONTAINER = {"article", "aside", "body", "button", "details", "dialog", "div", "fieldset", "figure", "footer", "form", "header", "main", "menu", "nav", "ol", "section", "table", "ul", "dl", "td", "li", "label"}
KINDS = ["menu", "header", "footer", "sidebar", "form", "notice", "advert", "comments"]
ELEMENTS = {"nav": "menu", "menu": "menu", "footer": "footer", "aside": "sidebar", "form": "form", "button": "form", "fieldset": "form", "label": "form", "dialog": "notice"}
CUES = {
    "menu": "nav navbar navigation menu breadcrumb breadcrumbs pagination pager toolbar skip".split(),
    "header": "header masthead topbar".split(),
    "footer": "footer copyright".split(),
    "sidebar": "sidebar sidenav related recommended widget widgets share sharing social".split(),
    "form": "login signup subscribe newsletter search".split(),
    "notice": "cookie cookies consent gdpr notice notices alert popup modal overlay".split(),
    "advert": "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner".split(),
    "comments": "comment comments disqus reply replies respond".split(),
}
# Words that may stand beside a cue in a class name; with any other word ("side-effects", "share-price") the name is no cue.
NEUTRAL = set("site page main global top bottom left right box bar wrap wrapper container content list item items block section area panel inner outer row column group primary secondary post article user reader text links link form button footer header nav menu".split())
CUE_KIND = {word: kind for kind, words in CUES.items() for word in words}

TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)", re.S)
NAMED = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
SPLIT = re.compile(r"[^a-z]+")

FEATURES = ["words", "link_density", "previous_words", "previous_link_density", "next_words", "next_link_density", "in_article", "kinds_but_menu", *KINDS]

# The labelled table: one line a kind of page. An entry stands for a run of blocks: how many, their words, the share of
# words in links, surroundings (A: in an article or main; else the first letter of the kind, o: form), 1 for main text.
# Numbers a-b are drawn anew for each page, and each page gets up to three blocks of STRAY at any place.
LABELLED = """
4-8:1-3/1/m/0 0-1:4-14/0/a/0 1:3-14/0/A/1 3-9:15-140/0-.2/A/1 1:5-20/0-.3/f/0
3-6:1-3/1/hm/0 1:3-12/0/A/1 0-1:2-5/0-1/A/1 2-5:10-90/0-.3/A/1 1-3:5-60/0-.5/s/0 2-5:1-4/1/f/0 1:20-90/0/f/0
1-2:1-8/0-1/h/0 3-6:1-3/1/m/0 1:2-9/0/A/1 1-2:3-12/0/A/1 2-6:20-120/0-.15/A/1 1:5-50/0/Aa/0 2-4:20-120/0-.2/A/1 2-6:3-70/0-.2/c/0
1:10-60/0-.3/n/0 3-6:1-3/1/m/0 1:3-10/0/A/1 2-5:20-120/0-.1/A/1 2-6:3-80/0-.2/Ac/0 1-3:1-6/0-1/o/0
1:2-8/0/A/1 2-4:20-90/0-.1/A/1 1-3:1-8/0-1/Ao/0 1-3:15-80/0-.2/A/1 1-4:2-8/1/As/0 1:10-40/0/An/0
1:3-9/0/A/1 1-2:10-60/0/A/1 3-8:1-12/0-1/A/1 1:10-60/0-.2/A/1 2-5:2-8/1/Am/0
5-9:1-3/1/-/0 1:3-12/0/-/1 4-9:18-140/0-.3/-/1 4-8:2-9/1/-/0 1:4-12/0/-/0
3-6:1-4/1/-/0 1:3-10/0/-/1 1-2:25-120/0-.2/-/1 1-2:3-14/0/-/1 2-4:20-120/0-.3/-/1 3-6:3-9/.8-1/-/0
2-4:1-3/1/-/0 1:3-10/0/-/1 1:2-5/0-.5/-/1 3-5:18-100/0-.35/-/1 5-9:1-8/.9-1/-/0 1:3-9/0-.3/-/0 2-4:1-3/1/-/0
1-3:15-60/0-.1/-/1
1:2-9/0/-/1 1-4:12-70/0-.2/-/1
6-12:1-8/.9-1/-/0
2-4:1-3/1/-/0 1:4-10/.9-1/-/0 1:15-40/.6-1/-/0 1:4-10/.9-1/-/0 1:15-40/.6-1/-/0 3-5:1-3/1/-/0
4-8:1-3/1/m/0 1:3-10/0/m/1 3-7:18-140/0-.3/m/1
4-8:1-3/1/m/0 2-5:20-140/0-.2/m/1 1:3-12/0-.3/mf/0
3-6:1-3/1/m/0 1:2-9/0/A/1 1:1-8/0/A/1
1-3:1-3/1/A/1 1:10-40/0/A/1 1:2-6/1/A/1
1:1-30/0-.3/A/1
1-3:1-14/0/A/1
3-6:1-3/1/-/0 1-2:1-14/0/A/1 3-6:1-3/1/-/0
1:20-90/0/s/0 1:3-12/0/A/1 2-4:15-90/0-.2/A/1 1-2:20-90/0-.2/s/0 1:20-90/0/n/0
1:15-80/0/a/0 1:3-12/0/-/1 3-6:20-120/0-.3/-/1 1:15-80/0/a/0 1-3:20-120/0-.2/-/1 1-4:5-90/0-.2/c/0
2-6:5-60/0-.2/c/0 1-4:1-6/0-1/o/0 1-3:10-60/0-.4/f/0
"""
STRAY = ["1:1-90/0-1/h/0", "1:1-90/0-1/f/0", "1:1-90/0-1/s/0", "1:1-90/0-1/o/0", "1:1-90/0-1/n/0", "1:1-90/0-1/a/0", "1:1-90/0-1/c/0"]
LETTERS = dict(zip("mhfsonac", KINDS, strict=True))
PAGES_A_LINE = 24


def with_neighbours(rows: np.ndarray) -> np.ndarray:
    """rows: words, link density, in article, kinds. Adds the number of kinds but menu, and words and link density of the blocks before and after (0 and 1 at the ends)."""
    edge = np.array([[0.0, 1.0]])
    before, after = np.vstack([edge, rows[:-1, :2]]), np.vstack([rows[1:, :2], edge])
    return np.hstack([rows[:, :2], before, after, rows[:, 2:3], rows[:, 4:].sum(axis=1, keepdims=True), rows[:, 3:]])


def labelled_table() -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of the blocks of the labelled pages."""
    rng = random.Random(0)
    x, y = [], []

    def drawn(text: str, whole: bool) -> float:
        low, _, high = text.partition("-")
        low, high = float(low), float(high or low)
        return rng.randint(int(low), int(high)) if whole else rng.uniform(low, high)

    for line in LABELLED.strip().splitlines() * PAGES_A_LINE:
        blocks = []
        for entry in line.split():
            many, rest = entry.split(":")
            words, share, marks, label = rest.split("/")
            for _ in range(int(drawn(many, True))):
                n = drawn(words, True)
                flags = [float("A" in marks)] + [float(any(LETTERS.get(m) == k for m in marks)) for k in KINDS]
                blocks.append([n, round(n * drawn(share, False)) / n, *flags, float(label)])
        for _ in range(rng.randint(0, 3)):
            words, share, marks, label = rng.choice(STRAY).split(":")[1].split("/")
            n = drawn(words, True)
            place = rng.randint(0, len(blocks))
            inside = blocks[min(place, len(blocks) - 1)][2]
            blocks.insert(place, [n, round(n * drawn(share, False)) / n, inside, *[float(LETTERS[marks] == k) for k in KINDS], float(label)])
        rows = np.array(blocks)
        x.append(with_neighbours(rows[:, :-1]))
        y.append(rows[:, -1].astype(int))
    return np.vstack(x), np.concatenate(y)


def grow(x: np.ndarray, y: np.ndarray, depth: int = 10, least: int = 8) -> tuple | int:
    """A binary decision tree by Gini impurity: (feature, threshold, tree if <=, tree if >) or a class. A leaf has at least `least` blocks."""
    ones = int(y.sum())
    if depth == 0 or ones in (0, len(y)) or len(y) < 2 * least:
        return int(2 * ones > len(y))
    best = None
    for f in range(x.shape[1]):
        order = np.argsort(x[:, f], kind="stable")
        v, low = x[order, f], np.cumsum(y[order])[:-1]
        n = np.arange(1, len(y))
        impurity = low * (1 - low / n) + (ones - low) * (1 - (ones - low) / (len(y) - n))
        impurity[(v[1:] == v[:-1]) | (n < least) | (len(y) - n < least)] = np.inf
        k = int(np.argmin(impurity))
        if np.isfinite(impurity[k]) and (best is None or impurity[k] < best[0] - 1e-9):
            best = (impurity[k], f, float(v[k] + v[k + 1]) / 2)
    if best is None:
        return int(2 * ones > len(y))
    _, f, cut = best
    below = x[:, f] <= cut
    low, high = grow(x[below], y[below], depth - 1, least), grow(x[~below], y[~below], depth - 1, least)
    return low if low in (0, 1) and low == high else (f, cut, low, high)


def classify(tree: tuple | int, x: np.ndarray) -> np.ndarray:
    if isinstance(tree, int):
        return np.full(len(x), tree, bool)
    f, cut, low, high = tree
    return np.where(x[:, f] <= cut, classify(low, x), classify(high, x))


@lru_cache(1)
def trained_tree() -> tuple | int:
    return grow(*labelled_table())


def surroundings(name: str, attributes: str, inside: bool) -> int:
    """The kinds that an element names, by its name, class, id or role, as bits in the order of KINDS. A header within an article is none."""
    if name == "header":
        return 0 if inside else 1 << KINDS.index("header")
    found = 1 << KINDS.index(ELEMENTS[name]) if name in ELEMENTS else 0
    if attributes and name not in ("body", "main", "article"):
        for m in NAMED.finditer(attributes):
            for token in "".join(filter(None, m.groups())).split():
                words = [w for w in SPLIT.split(re.sub(r"(?<=[a-z])(?=[A-Z])", "-", token).lower()) if w]
                kinds = [CUE_KIND[w] for w in words if w in CUE_KIND]
                if kinds and all(w in CUE_KIND or w in NEUTRAL for w in words):
                    found |= 1 << KINDS.index(kinds[0])
    return found


# An element that opens closes these if they were left open.
CLOSES = {"main": {"nav", "header", "aside", "form"}, "article": {"nav"}, "section": {"nav"}, "footer": {"nav", "aside", "form"}}


def blocks_of(page: str) -> list[tuple[str, int, int, int]]:
    """(text, words in links, kinds of surroundings as bits, in article) of each block that has text, in page order."""
    out: list[tuple[str, int, int, int]] = []
    parts: list[str] = []
    linked, link, at = 0, 0, 0
    stack: list[tuple[str, int, bool]] = [("", 0, False)]
    open_ = Counter()  # names in the stack, so that a closing tag without its opening one costs nothing
    endless = set()  # elements whose end tag does not occur any more

    def close() -> None:
        nonlocal parts, linked
        text = " ".join("".join(parts).split())
        if text:
            out.append((text, linked, stack[-1][1], int(stack[-1][2])))
        parts, linked = [], 0

    def add(raw: str) -> None:
        nonlocal linked
        text = html.unescape(raw) if "&" in raw else raw
        parts.append(text)
        if link:
            linked += len(text.split())

    def leave(name: str) -> None:
        while True:
            last = stack.pop()[0]
            open_[last] -= 1
            if last == name:
                return

    while True:
        m = TAG.search(page, at)
        add(page[at : m.start() if m else len(page)])
        if m is None:
            break
        at = m.end()
        closing, name, attributes = m.group(1, 2, 3) if m.group(2) else m.group(4, 5, 6)
        if name is None:
            continue
        name = name.lower()
        if name in RAW:
            if not closing and not attributes.endswith("/"):
                end = None if name in endless else re.compile(rf"</{name}\b[^>]*>", re.I).search(page, at)
                if end:
                    at = end.end()
                elif name in TEXT_ONLY:
                    at = len(page)
                else:
                    endless.add(name)
            parts.append(" ")
        elif name == "br":
            parts.append(" ")
        elif name == "a":
            link = int(not closing)
        elif name in BLOCK or name in CONTAINER:
            close()
            link = 0
            if name in CONTAINER:
                if closing:
                    if open_[name]:
                        leave(name)
                elif not attributes.endswith("/"):
                    for left in CLOSES.get(name, ()):
                        while open_[left]:
                            leave(left)
                    kinds, inside = stack[-1][1:]
                    stack.append((name, kinds | surroundings(name, attributes, inside), inside or name in ("article", "main")))
                    open_[name] += 1
    close()
    return out


def main_text(page: str, tree: tuple | int | None = None) -> str:
    blocks = blocks_of(page)
    if not blocks:
        return ""
    words = np.array([t.count(" ") + 1 for t, *_ in blocks], float)
    kinds = np.array([b[2] for b in blocks])
    rows = np.column_stack([words, np.array([b[1] for b in blocks]) / words, np.array([b[3] for b in blocks]), *[kinds >> k & 1 for k in range(len(KINDS))]])
    return " ".join(b[0] for b, keep in zip(blocks, classify(trained_tree() if tree is None else tree, with_neighbours(rows)), strict=True) if keep)


def extract_main_text(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) for each page row: its main blocks in page order, joined by one space.

    Null pages are empty; a page without main text gives "". Whole pages of any length, broken markup,
    repeated rows and null ids pass through; other columns are ignored; an empty table gives an empty result.
    """

    tree = trained_tree()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(p, tree) if p else "" for p in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")
