"""Main text of web pages: flat text blocks and a decision tree.

A page is cut into flat blocks at every tag that is not inline. A block has its word
count and link density, those of the blocks before and after it, whether it is in an
article or in a menu, header or the like by its tags, and whether what holds it is
named like one. A decision tree grown on a small labelled table says which blocks are
main text. The table is made by rule from a seed: pages marked up by tags, by names
only, and by neither, so that on a third of them only words, link density and the
neighbours' tell.
"""

from __future__ import annotations

import functools
import html
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# fixed values of HTML
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Their content is no text; that of RAW reaches to the end of the page if they are not closed, that of others then counts.
RAW = frozenset("script style title textarea iframe".split())
SKIPPED = RAW | frozenset("noscript template svg math object select option datalist button canvas audio video".split())
ATTRS = r"""(?:[^>"']++|"[^"]*+"|'[^']*+')*+"""
TAG = re.compile(rf"<!--.*?(?:-->|$)|<(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>{ATTRS})>|</?[a-zA-Z][^>]*(?:>|$)|<[!?/][^>]*(?:>|$)", re.DOTALL)
CLOSING = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*>", re.IGNORECASE) for name in SKIPPED}
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
HINT = re.compile(r"""(?:^|\s)(class|id|role|itemprop|hidden|aria-hidden|style)\b(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.IGNORECASE)
WORDS = re.compile(r"[a-z]+")
CHROME_TAGS = frozenset("nav header footer aside form menu dialog fieldset".split())
CHROME_WORDS = frozenset(
    "ad ads adv advert adverts advertisement banner breadcrumb breadcrumbs comment comments complementary contentinfo cookie cookies copyright disqus footer form gdpr header login masthead menu modal nav navbar navigation newsletter notice popup promo promoted related replies reply search share sharing sidebar signup social sponsor sponsored subscribe teaser toolbar widget".split()
)
MAIN_TAGS = frozenset(("article", "main"))
MAIN_WORDS = frozenset("article articlebody content entry main post story".split())
#: What a name may add to a word above without meaning something else: ``comment-list``, but not ``notice-period``.
PARTS = frozenset("area bar block body box btn button container content group inner item items link links list outer panel row section slot text top unit wrap wrapper".split())
NAMES = ("words", "link_density", "words_before", "density_before", "words_after", "density_after", "in_main", "in_chrome", "named", "heading", "page_has_main")


@dataclass
class Block:
    text: str
    words: int
    density: float
    main: bool
    chrome: bool
    named: bool
    heading: bool


def landmark(name: str, attrs: str, in_main: bool) -> str:
    """'hidden', 'main', 'chrome', 'soft' (chrome by its names only), 'title' (a header in the main text,
    of which the headings count) or '' for an opening tag."""
    said = {m[1].lower(): (m[2] or "").strip("\"'").lower() for m in HINT.finditer(attrs)} if attrs else {}
    if "hidden" in said or said.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", said.get("style", "")):
        return "hidden"
    names = [WORDS.findall(w) for k in ("class", "id", "role", "itemprop") for w in said.get(k, "").split()]
    words = {w for n in names for w in n}
    if name == "header" and in_main:
        return "title"
    if name in CHROME_TAGS:
        return "chrome"
    if name not in ("body", "html", "main") and any(n[-1] in CHROME_WORDS or n[0] in CHROME_WORDS and all(w in PARTS or w in CHROME_WORDS for w in n) for n in names if n):
        return "soft"
    return "main" if name in MAIN_TAGS or words & MAIN_WORDS and name not in ("body", "html") else ""


def inside(around: str, name: str, own: str) -> str:
    """What a tag is within what is around it: nothing inside a menu is main text, but an
    article or main starts main text again inside what is chrome by its names only. Nothing
    inside what is hidden is seen."""
    if around == "hidden" or own == "hidden":
        return "hidden"
    if around == "title":
        return "main" if name in HEADINGS else own if own in ("chrome", "soft") else "title"
    if around == "chrome" or own == "chrome":
        return "chrome"
    if around == "soft":
        return "main" if name in MAIN_TAGS and own == "main" else "soft"
    return own or around


def blocks(page: str) -> list[Block]:
    """The flat text blocks of a page in order; empty ones are left out."""
    out: list[Block] = []
    open_tags: list[tuple[str, str]] = []  # not inline: name, landmark (its own or that around it)
    parts: list[str] = []
    linked: list[str] = []
    in_link = -1  # the number of open tags around the link that is open
    endless: set[str] = set()  # skipped elements that nothing closes any more

    def end() -> None:
        text = " ".join(html.unescape("".join(parts)).split())
        kind = open_tags[-1][1] if open_tags else ""
        if text and kind != "hidden":
            words, links = len(text.split()), len(html.unescape(" ".join(linked)).split())
            heading = any(t[0] in HEADINGS for t in open_tags[-2:])
            out.append(Block(text, words, min(1.0, links / words), kind == "main", kind in ("chrome", "title"), kind == "soft", heading))
        parts.clear()
        linked.clear()

    def add(text: str) -> None:
        parts.append(text)
        if in_link >= 0:
            linked.append(text)

    at = 0
    while m := TAG.search(page, at):
        if m.start() > at:
            add(page[at : m.start()])
        at = m.end()
        name = (m["name"] or "").lower()
        if not name:
            continue
        if name in SKIPPED and not m["close"] and not (name in ("svg", "math") and m["attrs"].endswith("/")) and name not in endless:
            close = CLOSING[name].search(page, at)
            if close or name in RAW:
                at = close.end() if close else len(page)
                continue
            endless.add(name)
        if name in INLINE:
            if name == "a":
                in_link = -1 if m["close"] or not re.search(r"(?i)(?:^|\s)href\b", m["attrs"]) else len(open_tags)
            continue
        if name == "br":
            add(" ")
            continue
        end()
        if name == "head" and not m["close"]:
            continue
        if m["close"]:
            for k in range(len(open_tags) - 1, -1, -1):
                if open_tags[k][0] == name:
                    del open_tags[k:]
                    break
        elif name not in VOID and not m["attrs"].endswith("/"):
            if name in ("p", *HEADINGS, "li") and open_tags and open_tags[-1][0] in ("p", name):
                open_tags.pop()  # these end themselves
            around = open_tags[-1][1] if open_tags else ""
            open_tags.append((name, inside(around, name, landmark(name, m["attrs"], around == "main"))))
        if len(open_tags) < in_link:  # what holds the link has ended
            in_link = -1
    if at < len(page):
        add(page[at:])
    end()
    return out


def table(found: list[Block]) -> np.ndarray:
    """A row of ``NAMES`` for each block."""
    n = len(found)
    rows = np.zeros((n, len(NAMES)))
    if not n:
        return rows
    rows[:, 0] = [b.words for b in found]
    rows[:, 1] = [b.density for b in found]
    rows[1:, 2:4] = rows[:-1, :2]
    rows[:-1, 4:6] = rows[1:, :2]
    rows[:, 6] = [b.main for b in found]
    rows[:, 7] = [b.chrome for b in found]
    rows[:, 8] = [b.named for b in found]
    rows[:, 9] = [b.heading for b in found]
    rows[:, 10] = any(b.main for b in found)
    return rows


#: Chrome elements, and names of elements that are the same.
NAMED = (("nav", "menu"), ("aside", "sidebar"), ("aside", "notice"), ("form", "newsletter"), ("footer", "footer"), ("aside", "advert"), ("aside", "comments"))


def invented_page(rng: np.random.Generator, style: int) -> tuple[str, list[tuple[str, bool]]]:
    """A page and its blocks with their labels. ``style``: 0 tags, 1 names, 2 neither."""
    told: list[tuple[str, bool]] = []

    def words(low: int, high: int) -> str:
        n = int(rng.integers(low, high + 1))
        return " ".join("".join(rng.choice(list("aeinorstul"), int(rng.integers(2, 9)))) for _ in range(n)) + str(rng.choice(["", ".", "!"]))

    def block(tag: str, low: int, high: int, main: bool, link: float = 0.0) -> str:
        text = words(low, high)
        told.append((text, main))
        if link == 1.0:
            return f"<{tag}><a href='/x'>{text}</a></{tag}>"
        if link:
            head, _, tail = text.partition(" ")
            return f"<{tag}><a href='/x'>{head}</a> {tail}</{tag}>"
        return f"<{tag}>{text}</{tag}>"

    def some(*parts) -> list:
        return [p for p in parts if rng.random() < 0.7]

    def hold(tag: str, name: str, inner: str) -> str:
        return f"<{tag}>{inner}</{tag}>" if style == 0 else f"<div class='{name}'>{inner}</div>" if style == 1 else f"<div>{inner}</div>"

    def menu() -> str:
        return "<ul>" + "".join(block("li", 1, 3, False, 1.0) for _ in range(int(rng.integers(3, 8)))) + "</ul>"

    def cards() -> str:
        """Other stories, each a link as a whole."""
        return "<div>" + "".join(block("p", 6, 30, False, 1.0) for _ in range(int(rng.integers(2, 5)))) + "</div>"

    def within() -> str:
        """Chrome inside the article: by tags, by names, or as cards."""
        tag, name = NAMED[int(rng.integers(len(NAMED)))]
        return cards() if style == 2 or rng.random() < 0.3 else hold(tag, name, "".join(block("p", 3, long, False) for _ in range(int(rng.integers(1, 3)))))

    def article() -> str:
        out = [block("h1", 2, 12, True) if rng.random() < 0.6 else block("p", 15, 70, True)]
        for _ in range(int(rng.integers(3, 9))):
            kind = rng.random()
            if kind < 0.07:
                out.append(within())
            elif kind < 0.15:
                out.append(block("p", 1, 6, True))
            elif kind < 0.25:
                out.append(block("h2", 1, 6, True))
            elif kind < 0.35:
                out.append("<ul>" + "".join(block("li", 2, 14, True, 0.3 if rng.random() < 0.3 else 0.0) for _ in range(3)) + "</ul>")
            else:
                out.append(block("p", 9, 90, True, 0.2 if rng.random() < 0.3 else 0.0))
        return "".join([*out, block("p", 15, 80, True)])

    # without tags and names nothing tells long chrome from text
    long = int(rng.choice([9, 20, 45, 90])) if style < 2 else 9
    page = "".join(make() for make in some(
        lambda: hold("header", "page-header", block("h1" if style < 2 else "p", 1, 4, False) + block("p", 2, max(6, long), False)), lambda: hold("nav", "menu", menu()), lambda: hold("nav", "menu", block("p", 2, long, False)) if style < 2 else "", lambda: hold("form", "search", block("p", 2, long, False)),
        lambda: f"<div{' class=ad' if style < 2 else ''}>" + block("p", 3, long, False) + "</div>" if rng.random() < 0.5 else f"<div{' class=ad' if style < 2 else ''}>" + block("span", 3, long, False) + "</div>",
        lambda: hold("aside", "notice", block("p", 4, long, False) + block("div", 1, 2, False))))
    inner = article()
    page += f"<article>{inner}</article>" if style == 0 and rng.random() < 0.7 else f"<main>{inner}</main>" if style == 0 else f"<div class='{rng.choice(['content', 'post', 'entry', 'story'])}'>{inner}</div>" if style == 1 and rng.random() < 0.7 else f"<div>{inner}</div>"
    page += "".join(make() for make in some(
        lambda: hold("aside", "comments", "".join(block("p", 1, 2, False, 1.0) + block("p", 2, 3 * long, False) for _ in range(2))) if style < 2 else "", cards, lambda: hold("aside", "sidebar", block("h3", 1, 3, False) + menu() + (block("p", 5, long, False) if style < 2 else "")),
        lambda: hold("form", "newsletter", block("p", 2, 9, False) + block("div", 1, 2, False)), lambda: hold("footer", "site-footer", block("p", 3, max(12, long) if style < 2 else 7, False, 0.3) + block("p", 1, 3, False, 1.0))))
    return f"<html><body>{page}</body></html>", told


TABLE_SEED, TABLE_PAGES = 17, 240


def labelled_table(seed: int = TABLE_SEED, pages: int = TABLE_PAGES) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of the blocks of pages made by rule."""
    rng = np.random.default_rng(seed)
    xs, ys = [], []
    for k in range(pages):
        page, told = invented_page(rng, k % 3)
        found = blocks(page)
        assert [b.text for b in found] == [t for t, _ in told]
        xs.append(table(found))
        ys += [label for _, label in told]
    return np.vstack(xs), np.array(ys)


def grow(x: np.ndarray, y: np.ndarray, least: int = 1, depth: int = 8):
    """A tree as nested tuples (column, threshold, low branch, high branch); a leaf is a bool.

    Splits by Gini impurity; equal gains go to the first column and lowest threshold.
    """
    share = y.mean()
    if depth == 0 or share in (0.0, 1.0) or len(y) < 2 * least:
        return bool(share >= 0.5)
    best = (2 * share * (1 - share) - 1e-9, None, None)
    for c in range(x.shape[1]):
        values = np.unique(x[:, c])
        for t in (values[1:] + values[:-1]) / 2:
            low = x[:, c] <= t
            a, b = y[low], y[~low]
            if min(len(a), len(b)) >= least:
                impurity = (len(a) * 2 * a.mean() * (1 - a.mean()) + len(b) * 2 * b.mean() * (1 - b.mean())) / len(y)
                if impurity < best[0] - 1e-12:
                    best = (impurity, c, t)
    if best[1] is None:
        return bool(share >= 0.5)
    low = x[:, best[1]] <= best[2]
    return best[1], float(best[2]), grow(x[low], y[low], least, depth - 1), grow(x[~low], y[~low], least, depth - 1)


@functools.cache
def default_tree():
    return grow(*labelled_table(), least=3)


def decide(tree, row) -> bool:
    while not isinstance(tree, bool):
        tree = tree[3] if row[tree[0]] > tree[1] else tree[2]
    return tree


def main_text(page: str | None, tree=None) -> str:
    found = blocks(page or "")
    tree = default_tree() if tree is None else tree
    return " ".join(b.text for b, row in zip(found, table(found).tolist()) if decide(tree, row))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", tree=None) -> DataFrame:
    """-> id, url, text (main text, empty if none), n_chars (code points).

    Null and empty pages give the empty text; long ones are read whole. Every row gives a
    row, an empty table none; other columns are ignored. No shuffle: each page is handled where it is read.
    """
    tree = default_tree() if tree is None else tree

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = [main_text(p, tree) for p in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [id_col, url_col, "text", "n_chars"])

    given = pages.select(F.col(id_col).cast("long").alias(id_col), F.col(url_col).cast("string").alias(url_col), F.col(html_col).cast("string").alias("_html"))
    return given.mapInArrow(run, f"`{id_col}` long, `{url_col}` string, text string, n_chars long")
