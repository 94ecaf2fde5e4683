"""Main text of web pages: flat text blocks classified by a decision tree.

A page is read as a flat list of text blocks. A block's features are its words and link density, those of the blocks
before and after it, and whether an enclosing element stands for page furniture or for the article. The tree is trained
on the small labelled table below; nothing of a page is cut by size.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citefold.llm.batches import slices

# Fixed values of the HTML language: elements whose content is no text, that end a text block, or that are void.
RAW = ("script", "style", "title", "textarea", "noscript", "template", "iframe", "svg", "math", "object", "canvas",
       "audio", "video", "select", "xmp", "noembed", "noframes")
BLOCKS = set("""address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption
figure footer form frameset h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol optgroup option p pre section
summary table tbody td tfoot th thead tr ul button""".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
ENDS_P = BLOCKS - {"body", "html", "head", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "option", "button", "legend"}
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
            "th": {"td", "th"}, "option": {"option"}}
# Elements, roles and words of class and id names that stand for page furniture, or for the article.
FURNITURE = set("nav header footer aside form menu dialog button fieldset dir label input".split())
FURNITURE_ROLES = set("navigation banner contentinfo complementary search alert alertdialog dialog menu menubar form".split())
FURNITURE_NAMES = set("""ad ads adv advert adverts advertisement advertising adbox adslot adsense banner banners breadcrumb breadcrumbs
comment comments commentlist disqus reply replies respond responses cookie cookies consent gdpr notice notices notification alert
sidebar side sidenav rail menu menus nav navbar navigation topbar toolbar footer foot colophon copyright masthead header
share sharing social related recommended recommendations promo promotion promoted sponsor sponsored newsletter subscribe
subscription signup login register popup modal overlay widget widgets pagination pager tags skip feedback form search
disclaimer legal""".split())
STATES = set("has with without no is tag category cat topic".split())  # "has-sidebar", "tag-search": no furniture itself
ARTICLE = {"article", "main"}
ARTICLE_NAMES = set("article post entry story content body text main".split())

TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>"
    r"|<[!?/][^>]*>|<[!?/a-zA-Z][^>]*\Z", re.S)
ATTRIBUTE = re.compile(r"(?<![\w-])(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?", re.I)
NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


@dataclass
class Block:
    text: str
    words: int
    linked: int
    furniture: bool
    article: bool
    heading: bool


def _kind(tag: str, attributes: str, inside_article: bool) -> tuple[bool, bool, str, str]:
    """(stands for furniture, for the article, "whole" or "part" of a name says furniture or "", what it lifts).

    A name says furniture as a whole token ("sidebar") or, weaker, as the first or last part of a longer one. A main
    element lifts both kinds off itself and all that encloses it; an article the weaker one, if it is not named after
    furniture itself, as comments and teasers are.
    """
    furniture = tag in FURNITURE and not (tag == "header" and inside_article)
    article = tag in ARTICLE
    main = tag == "main"
    whole = first = last = named = False
    if attributes and "=" in attributes or "hidden" in attributes:
        for name, value in ATTRIBUTE.findall(attributes):
            name, value = name.lower(), value.strip("\"'")
            if name == "role":
                furniture |= value.lower() in FURNITURE_ROLES
                article |= value.lower() in ARTICLE
                main |= value.lower() == "main"
            elif name == "hidden" or name == "aria-hidden" and value.lower() == "true":
                furniture = True
            elif name == "style":
                furniture |= "display:none" in value.replace(" ", "").lower()
            elif name in ("class", "id") and tag not in ("body", "html"):
                for token in value.split():
                    parts = [p.lower() for p in NAME.findall(token)]
                    if not parts:
                        continue
                    own = ARTICLE_NAMES.intersection(parts)
                    good = {"header", "body", "text"} if own else set()
                    ends = [p in FURNITURE_NAMES and p not in good for p in (parts[0], parts[-1])]
                    if len(parts) == 1:
                        whole |= ends[0]
                        named |= bool(own)
                    elif parts[0] not in STATES:
                        first |= ends[0]
                        last |= ends[1]
                    article |= bool(own) and not any(ends) and parts[-1] in ARTICLE_NAMES
    if main:
        return furniture, article, "", "whole"
    if tag == "article" and not first and (named or not whole):
        return furniture, article, "", "part"
    return furniture, article, "whole" if whole else "part" if first or last else "", ""


def blocks_of(page: str) -> list[Block]:
    """Text blocks of a page in order; elements left open end where their parents do, or with the page."""
    out: list[Block] = []
    # (tag, furniture, article, furniture whatever names say, marks), each of it or of what encloses it; a mark is the
    # kind of a name that says furniture, emptied when an article or main element inside lifts it
    stack: list[tuple[str, bool, bool, bool, tuple[list[str], ...]]] = []
    marked: list[tuple[Block, tuple[list[str], ...]]] = []
    parts: list[str] = []
    linked = 0
    links = 0

    def flush() -> None:
        nonlocal linked
        if parts:
            words = "".join(parts).split()
            if words:
                inside = stack[-1] if stack else ("", False, False, False, ())
                heading = any(len(s[0]) == 2 and s[0][0] == "h" and s[0][1].isdigit() for s in stack)
                out.append(Block(" ".join(words), len(words), linked, inside[3], inside[2], heading))
                marked.append((out[-1], inside[4]))
            parts.clear()
        linked = 0

    def text(piece: str) -> None:
        nonlocal linked
        if piece:
            piece = html.unescape(piece) if "&" in piece else piece
            parts.append(piece)
            if links:
                linked += len(piece.split())

    def close(tag: str) -> None:
        nonlocal links
        for depth in range(len(stack) - 1, -1, -1):
            if stack[depth][0] == tag:
                gone = stack[depth:]
                if any(g[0] in BLOCKS for g in gone) or gone[0][1] and not (depth and stack[depth - 1][1]):
                    flush()
                del stack[depth:]
                links -= sum(g[0] == "a" for g in gone)
                return

    at, size = 0, len(page)
    while at < size:
        found = TAG.search(page, at)
        if not found:
            text(page[at:])
            break
        text(page[at:found.start()])
        at = found.end()
        tag = (found[2] or found[5] or "").lower()
        if not tag:
            continue
        ending, attributes = found[1] or found[4], found[3] or found[6] or ""
        if ending:
            if tag == "br":
                parts.append(" ")
            elif tag == "p" and not any(s[0] == "p" for s in stack):
                flush()
            else:
                close(tag)
            continue
        if tag in RAW:
            if not attributes.endswith("/"):
                end = re.compile(rf"</{re.escape(tag)}\s*[^>]*>", re.I).search(page, at)
                at = end.end() if end else size
            parts.append(" ")
            continue
        if tag in ENDS_P and stack and any(s[0] == "p" for s in stack):
            close("p")
        if tag in SIBLINGS and stack:
            for depth in range(len(stack) - 1, -1, -1):
                if stack[depth][0] in SIBLINGS[tag]:
                    close(stack[depth][0])
                    break
                if stack[depth][0] in ("ul", "ol", "dl", "table", "select", "menu"):
                    break
        if tag == "a" and links:
            close("a")
        upper = stack[-1] if stack else ("", False, False, False, ())
        fixed, article, name, lifts = _kind(tag, attributes, upper[2])
        furniture = fixed or bool(name)
        if tag in BLOCKS or furniture and not upper[1]:
            flush()
        if lifts and not upper[3] and (lifts == "whole" or all(m[0] != "whole" for m in upper[4])):
            for mark in upper[4]:
                mark[0] = ""
        if tag == "br":
            parts.append(" ")
        if tag not in VOID:
            stack.append((tag, upper[1] or furniture, upper[2] or article, upper[3] or fixed,
                          (*upper[4], [name]) if name else upper[4]))
            links += tag == "a"
    flush()
    for block, marks in marked:
        block.furniture |= any(m[0] for m in marks)
    return out


FEATURES = ("furniture", "article", "heading", "words", "links", "words_before", "links_before", "words_after", "links_after")
# The small labelled table: features in the order above, then 1 for main text and 0 for anything else. Rows describe
# typical blocks: menus, footers, adverts, notices, forms, comments, link lists; titles, long and short paragraphs.
LABELLED = (
    (1, 0, 0, 1, 1.0, 0, 0.0, 1, 1.0, 0), (1, 0, 0, 2, 1.0, 1, 1.0, 1, 1.0, 0), (1, 0, 0, 9, 0.0, 1, 1.0, 12, 0.0, 0),
    (1, 0, 0, 14, 0.1, 80, 0.0, 0, 0.0, 0), (1, 0, 1, 3, 0.0, 60, 0.0, 4, 1.0, 0), (1, 0, 0, 45, 0.0, 8, 0.2, 60, 0.0, 0),
    (1, 0, 0, 120, 0.0, 40, 0.0, 6, 1.0, 0), (1, 1, 0, 30, 0.0, 90, 0.0, 25, 0.0, 0), (1, 1, 1, 2, 0.0, 70, 0.0, 20, 0.0, 0),
    (1, 1, 0, 4, 1.0, 55, 0.0, 3, 1.0, 0), (1, 1, 0, 75, 0.0, 15, 0.0, 0, 0.0, 0), (1, 1, 0, 8, 0.0, 30, 0.0, 100, 0.0, 0),
    (1, 0, 0, 20, 0.0, 0, 0.0, 10, 0.0, 0), (1, 0, 0, 5, 0.0, 0, 0.0, 90, 0.0, 0), (1, 1, 0, 150, 0.0, 80, 0.0, 80, 0.0, 0),
    (0, 0, 0, 1, 1.0, 0, 0.0, 2, 1.0, 0), (0, 0, 0, 2, 1.0, 3, 1.0, 2, 1.0, 0), (0, 0, 0, 6, 0.9, 50, 0.0, 5, 1.0, 0),
    (0, 0, 0, 4, 0.0, 2, 1.0, 1, 1.0, 0), (0, 0, 0, 3, 0.0, 0, 0.0, 2, 1.0, 0), (0, 0, 0, 12, 0.8, 8, 0.9, 0, 0.0, 0),
    (0, 0, 0, 2, 0.0, 4, 0.9, 0, 0.0, 0), (0, 0, 0, 5, 0.0, 2, 1.0, 3, 1.0, 0), (0, 0, 0, 3, 0.0, 1, 1.0, 4, 0.8, 0),
    (0, 0, 1, 7, 0.0, 1, 1.0, 60, 0.0, 1), (0, 0, 1, 9, 0.0, 0, 0.0, 70, 0.0, 1), (0, 0, 1, 4, 0.0, 90, 0.0, 85, 0.0, 1),
    (0, 0, 0, 60, 0.0, 8, 0.0, 75, 0.0, 1), (0, 0, 0, 95, 0.1, 60, 0.0, 40, 0.0, 1), (0, 0, 0, 35, 0.0, 90, 0.0, 12, 0.1, 1),
    (0, 0, 0, 25, 0.2, 70, 0.0, 50, 0.0, 1), (0, 0, 0, 15, 0.0, 40, 0.0, 66, 0.0, 1), (0, 0, 0, 9, 0.0, 55, 0.0, 38, 0.0, 1),
    (0, 0, 0, 5, 0.0, 45, 0.0, 52, 0.0, 1), (0, 0, 0, 18, 0.0, 2, 1.0, 44, 0.0, 1), (0, 0, 0, 22, 0.0, 30, 0.0, 0, 0.0, 1),
    (0, 1, 1, 6, 0.0, 9, 0.0, 50, 0.0, 1), (0, 1, 1, 10, 0.0, 1, 1.0, 3, 0.0, 1), (0, 1, 1, 3, 0.0, 80, 0.0, 75, 0.0, 1),
    (0, 1, 0, 1, 0.0, 60, 0.0, 10, 0.0, 1), (0, 1, 0, 4, 0.0, 10, 0.0, 12, 0.0, 1), (0, 1, 0, 8, 0.0, 9, 0.0, 0, 0.0, 1),
    (0, 1, 0, 55, 0.0, 10, 0.0, 80, 0.0, 1), (0, 1, 0, 130, 0.1, 70, 0.0, 12, 0.0, 1), (0, 1, 0, 40, 0.3, 65, 0.0, 33, 0.0, 1),
    (0, 1, 0, 6, 0.5, 42, 0.0, 51, 0.0, 1), (0, 1, 0, 3, 1.0, 70, 0.0, 60, 0.0, 1), (0, 1, 0, 12, 0.0, 1, 1.0, 14, 0.0, 1),
    (0, 1, 0, 2, 0.0, 1, 1.0, 1, 0.0, 1), (0, 1, 0, 3, 0.0, 4, 0.0, 2, 1.0, 1), (0, 1, 0, 2, 1.0, 2, 1.0, 2, 1.0, 1),
    (0, 1, 0, 2, 0.0, 0, 0.0, 0, 0.0, 1), (0, 1, 0, 7, 1.0, 30, 0.0, 6, 0.0, 1), (0, 1, 0, 3, 0.0, 2, 1.0, 1, 1.0, 1),
)


@dataclass
class Tree:
    """A node (feature <= bound goes left) or a leaf."""

    label: int
    feature: int = -1
    bound: float = 0.0
    left: "Tree | None" = None
    right: "Tree | None" = None

    def judge(self, row: tuple) -> int:
        node = self
        while node.feature >= 0:
            node = node.left if row[node.feature] <= node.bound else node.right
        return node.label


def train(rows=LABELLED, depth: int = 6) -> Tree:
    """Binary splits of least Gini impurity; ties go to the first feature and bound."""
    ones = sum(r[-1] for r in rows)
    leaf = Tree(int(2 * ones >= len(rows)))
    if depth == 0 or ones in (0, len(rows)):
        return leaf
    best = None
    for f in range(len(FEATURES)):
        values = sorted({r[f] for r in rows})
        for low, high in zip(values, values[1:]):
            bound = (low + high) / 2
            sides = [[r[-1] for r in rows if (r[f] <= bound) == s] for s in (True, False)]
            impurity = sum(2 * sum(s) * (len(s) - sum(s)) / len(s) for s in sides)
            if best is None or impurity < best[0] - 1e-12:
                best = impurity, f, bound
    if best is None:
        return leaf
    _, f, bound = best
    return Tree(leaf.label, f, bound, train([r for r in rows if r[f] <= bound], depth - 1),
                train([r for r in rows if r[f] > bound], depth - 1))


def features(blocks: list[Block]) -> list[tuple]:
    sizes = [(0, 0.0), *((b.words, b.linked / b.words) for b in blocks), (0, 0.0)]
    return [(int(b.furniture), int(b.article), int(b.heading), *sizes[i + 1], *sizes[i], *sizes[i + 2])
            for i, b in enumerate(blocks)]


def main_text(page: str | None, tree: Tree) -> str:
    blocks = blocks_of(page or "")
    return "\n\n".join(b.text for b, row in zip(blocks, features(blocks)) if tree.judge(row))


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every row of ``pages`` (page_id, url, html).

    Null, empty and text-free pages give an empty text. Broken markup is read as far as it goes: an unfinished tag at
    the end is no text, elements left open end with their parents. Rows may repeat; other columns are ignored; an empty
    table gives no rows.
    """
    source = pages.select("page_id", "url", F.col("html").cast("string").alias("html"))
    kinds = dict(source.dtypes)
    tree = train()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "html"):
            texts = [main_text(p, tree) for p in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()),
                 pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return source.mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
