"""Main text of web pages by tag-path ratios.

A page is read as text blocks, each with its root-to-leaf tag path. For each path the page's text length and
punctuation are added up and set against the number of its blocks. Both ratios are smoothed over the paths in page
order, a neighbour counting the more the longer the part of the path that is common, and fused by multiplication with
each other and with a prior of the path; the blocks of paths above a threshold are content. The smallest element around most of the content (weighted by text) is
the article; what stands between the content nodes in it, such as headings and short lists, belongs to it as well.
Content outside it is kept if it is in no article or main element, with the headings right before it.

The prior (which can be switched off) is nought for paths in subtrees whose tag, class, id or role names a menu, header,
footer, sidebar, notice, advert, form or comment by a whole word, else one; but classes and ids of an article or main element, or
of one that holds most of the page's text, don't count. Scripts, styles and what is hidden are never text.

Time and memory grow in proportion to a page, also for deeply nested, cut off or hostile ones; pages are read whole.
Null and empty html, and pages without text, give the empty text. Each page is worked on by itself, so repeated pages
give equal rows, and nothing is shuffled; an empty table gives no rows. Other columns, whatever their names, are not
read.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

SCHEMA = "page_id long, url string, text string, n_chars long"

# fixed values of the markup language
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title noscript template iframe svg xmp noembed noframes annotation annotation-xml".split())
BLOCKS = set("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption".split())
ENDS_P = BLOCKS - {"body", "html", "caption", "tbody", "td", "tfoot", "th", "thead", "tr"}
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
ITEMS = set(CLOSES) | {x for own in CLOSES.values() for x in own}
BARRIER = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "option": {"select"}}

#: where the search for an open p ends
ENDS_SEARCH = set("td th li div article section body".split())

#: what is never main text, by tag
APART = set("nav footer aside form button select option input label fieldset dialog menu head".split())
#: by a whole word of class, id or role
WORDS = set("""ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion promoted
nav navbar navigation menu menubar breadcrumb breadcrumbs crumbs pager pagination toolbar topbar header masthead
footer colophon copyright sidebar side aside rail widget related recommended recommendations
notice notices cookie cookies consent gdpr popup modal overlay alert newsletter subscribe subscription signup login paywall
comment comments reply replies respond disqus discussion form search share sharing social skip hidden banner contentinfo complementary
commentlist commentform cookiebar cookiebanner leftsidebar rightsidebar breadcrumblist""".split())
IN_ARTICLE_HEADINGS = {"header", "masthead"}
#: names that say what an element has, not what it is
HAS = re.compile(r"(?<![\w-])(?:has|with|without|no)[-_][\w-]*", re.I)
HUMP = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")
INLINE = set("p b i em strong span a h1 h2 h3 h4 h5 h6 blockquote li td tr".split())
HEADINGS = set("h1 h2 h3 h4 h5 h6".split())

NAME = re.compile(r"/?[a-zA-Z][^\s/>]*")
REST = re.compile(r"(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>")
ATTRIBUTE = re.compile(r"([^\s=\"'/>]++)(?:\s*+=\s*+(\"[^\"]*+\"|'[^']*+'|[^\s\"'>]++))?")
PUNCTUATION = re.compile(r"[.,;:!?…。，、；：！？]")


@dataclass(slots=True)
class Node:
    tag: str
    parent: Node | None
    path: int  # the number of its tag path on this page
    depth: int
    hidden: bool  # it or something around it is never shown
    apart: bool  # it or something around it is no main text by its name
    named: bool  # apart by its own class or id, unless it holds most of the page
    under_named: bool  # it or something around it is named
    inside: bool  # in an article or main element
    paragraph: Node | None  # the open p that a new block ends
    items: dict  # the open list items, rows, cells that a new one ends
    text: int = 0  # characters of text in it


@dataclass(slots=True)
class Block:
    node: Node
    text: str
    apart: bool = False  # the prior of its path is nought


def is_apart(tag: str, attributes: str, inside: bool, prior: bool) -> tuple[bool, bool, bool]:
    """Whether an element is hidden, is set apart for sure, and whether the class or id of a block sets it apart."""
    apart, named = prior and (tag in APART or tag == "header" and not inside), False
    for name, value in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'")
        if name == "hidden" or (name == "aria-hidden" and value.lower() == "true") or (name == "style" and re.search(r"display\s*:\s*none", value, re.I)):
            return True, apart, False
        if prior and name in ("class", "id", "role") and tag not in ("html", "body", "article", "main"):
            value = HAS.sub(" ", value)
            found = set(re.split(r"[^a-z0-9]+", value.lower() + " " + HUMP.sub(" ", value).lower())) & WORDS
            if inside and tag not in ("ul", "ol"):
                found -= IN_ARTICLE_HEADINGS
            apart = apart or bool(found) and (name == "role" or tag not in BLOCKS)
            named = named or bool(found)
    return False, apart, named and not apart


def tokens(page: str) -> Iterator[tuple[str, str, str]]:
    """(kind, tag, attributes or text) in order; kinds: text, open, close. One pass; a tag that is cut off ends the page."""
    i, n, quotes = 0, len(page), True
    last = page.rfind(">")
    while i < n:
        at = page.find("<", i)
        if at < 0:
            at = n
        if at > i:
            yield "text", "", page[i:at]
        if at == n:
            return
        if page.startswith("<!--", at):
            end = page.find("-->", at + 4)
            i = n if end < 0 else end + 3
            continue
        if page.startswith("<![CDATA[", at):
            end = page.find("]]>", at)
            i = n if end < 0 else end + 3
            continue
        name = NAME.match(page, at + 1)
        if name is None and page[at + 1 : at + 2] not in ("!", "?", "/"):
            yield "text", "", "<"
            i = at + 1
            continue
        if last < at:
            return
        begin = name.end() if name else at + 1
        whole = REST.match(page, begin) if quotes and name else None
        quotes = quotes and (whole is not None or name is None)  # quotes that don't match end tags nowhere from here on
        i = whole.end() if whole else page.find(">", begin) + 1
        if name is None:
            continue
        tag = name[0].lower()
        if tag[0] == "/":
            yield "close", tag[1:], ""
            continue
        yield "open", tag, page[begin : i - 1]
        if tag in RAW and page[i - 2] != "/":
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I).search(page, i)
            close = page.find(">", end.end()) if end else -1
            i = n if close < 0 else close + 1


def blocks_of(page: str, prior: bool = True) -> tuple[list[Block], list[Node], list[tuple[int, ...]]]:
    """The text blocks of a page in order, marked if apart; its elements, each after its parent; (parent, depth) of its paths."""
    root = Node("", None, 0, 0, False, False, False, False, False, None, {})
    at = home = root
    nodes, out, pending, open_tags = [root], [], [], {}
    paths: dict[tuple[int, str], int] = {}
    shape = [(0, 0)]

    def flush():
        nonlocal pending
        text = " ".join(entities.unescape("".join(pending)).split()) if pending else ""
        if text and not home.hidden:
            out.append(Block(home, text, home.apart))
        pending = []

    def leave(node: Node) -> None:
        """Closes the open elements down to this one."""
        nonlocal at
        while at is not node:
            open_tags[at.tag] -= 1
            at = at.parent

    for kind, tag, more in tokens(page):
        if kind == "text" or tag == "br" or tag in RAW:
            piece = more if kind == "text" else " " if kind == "open" else ""
            if piece and not at.hidden:
                if not pending:
                    home = at
                pending.append(piece)
            continue
        if kind == "close":
            if open_tags.get(tag):
                n = at
                while n.tag != tag:
                    n = n.parent
                if tag in BLOCKS or n.hidden or n.apart or at.under_named:
                    flush()
                leave(n.parent)
            continue
        if tag in BLOCKS:
            flush()
        if tag in ENDS_P and at.paragraph:
            leave(at.paragraph.parent)
        if tag in CLOSES:
            ends = [n for t in CLOSES[tag] if (n := at.items.get(t))]
            if ends:
                leave(min(ends, key=lambda n: n.depth).parent)
        if tag in VOID or (tag in ("html", "body") and open_tags.get(tag)):
            continue
        hidden, apart, named = is_apart(tag, more, at.inside, prior)
        if apart and not at.apart:
            flush()
        items = at.items
        if any(tag in b for b in BARRIER.values()) or tag in ITEMS:
            items = {t: n for t, n in items.items() if tag not in BARRIER[t]}
        key = (at.path, tag)
        if key not in paths:
            paths[key] = len(shape)
            shape.append((at.path, at.depth + 1))
        node = Node(tag, at, paths[key], at.depth + 1, at.hidden or hidden, at.apart or apart, named, at.under_named or named, at.inside or tag in ("article", "main"), None, items)
        node.paragraph = node if tag == "p" else None if tag in ENDS_SEARCH else at.paragraph
        if tag in ITEMS:
            node.items = items | {tag: node}
        nodes.append(node)
        open_tags[tag] = open_tags.get(tag, 0) + 1
        at = node
    flush()
    mark_named(out, nodes)
    return out, nodes, shape


def add_up(blocks: list[Block], nodes: list[Node]) -> None:
    """How much text of these blocks each element holds."""
    for n in nodes:
        n.text = 0
    for b in blocks:
        b.node.text += len(b.text)
    for n in reversed(nodes[1:]):
        n.parent.text += n.text


def mark_named(blocks: list[Block], nodes: list[Node]) -> None:
    """Marks what a class or id sets apart; one that holds most of the text doesn't, if no article or main is elsewhere."""
    shown = [b for b in blocks if not b.apart]
    named = [b for b in shown if b.node.under_named]
    if any(b.node.inside for b in shown if not b.node.under_named):
        for b in named:
            b.apart = True
    elif named:
        add_up(shown, nodes)
        gone = {id(nodes[0]): False}
        for n in nodes[1:]:
            gone[id(n)] = gone[id(n.parent)] or n.named and 2 * n.text <= nodes[0].text
        for b in named:
            b.apart = gone[id(b.node)]


def common_depth(a: int, b: int, shape: list[tuple[int, ...]]) -> int:
    """How many elements two paths have in common from the root on."""
    while a != b:
        if shape[a][1] >= shape[b][1]:
            a = shape[a][0]
        else:
            b = shape[b][0]
    return shape[a][1]


def smoothed(x: list[float], own: list[int], shape: list[tuple[int, ...]]) -> list[float]:
    """Values of paths, smoothed over the two before and after in page order, weighted by distance and common path."""
    out = []
    for i, a in enumerate(own):
        total = weight = 0.0
        for j in range(max(0, i - 2), min(len(x), i + 3)):
            w = math.exp(-((i - j) ** 2) / 2) * ((1 + common_depth(a, own[j], shape)) / (1 + max(shape[a][1], shape[own[j]][1]))) ** 4
            total, weight = total + w * x[j], weight + w
        out.append(total / weight)
    return out


def path_of(b: Block) -> tuple[int, bool]:
    """The path that a block counts for. The same tags inside and outside of what is set apart are two paths."""
    return b.node.path, b.apart


def content_paths(blocks: list[Block], shape: list[tuple[int, ...]]) -> set[tuple[int, bool]]:
    """The tag paths whose smoothed ratios of text and punctuation, fused with the prior, reach the threshold.

    The prior is 1, or 0 for what is set apart. Paths are smoothed over neighbours of the same prior.
    """
    length: dict[tuple[int, bool], int] = {}
    marks: dict[tuple[int, bool], int] = {}
    count: dict[tuple[int, bool], int] = {}
    for b in blocks:
        p = path_of(b)
        length[p] = length.get(p, 0) + len(b.text)
        marks[p] = marks.get(p, 0) + len(PUNCTUATION.findall(b.text))
        count[p] = count.get(p, 0) + 1
    fused: dict[tuple[int, bool], float] = {}
    for prior in (1.0, 0.0):
        own = [p for p in count if p[1] is not bool(prior)]  # in page order
        paths = [p for p, _ in own]
        text = smoothed([length[p] / count[p] for p in own], paths, shape)
        stops = smoothed([marks[p] / count[p] for p in own], paths, shape)
        fused |= {p: prior * t * (1 + m) for p, t, m in zip(own, text, stops, strict=True)}
    # how far scores lie apart is told by paths that can be content
    each = [(f, count[p]) for p, f in fused.items() if not p[1]]
    if not each:
        return set()
    n = sum(c for _, c in each)
    mean = sum(f * c for f, c in each) / n
    spread = math.sqrt(sum(c * (f - mean) ** 2 for f, c in each) / n)
    threshold = min(spread, 0.5 * max(f for f, _ in each))
    return {p for p, f in fused.items() if f >= threshold and f > 0}


def main_text(page: str, prior: bool = True) -> str:
    """The main text of one page."""
    blocks, nodes, shape = blocks_of(page, prior)
    paths = content_paths(blocks, shape)
    chosen = [b for b in blocks if path_of(b) in paths]
    if not chosen:
        return ""
    add_up(chosen, nodes)
    around = max(chosen, key=lambda b: len(b.text)).node
    while around.parent is not None and around.text < 0.8 * nodes[0].text:
        around = around.parent
    while around.tag in INLINE and around.parent is not None and around.parent.tag not in ("", "html", "body"):
        around = around.parent
    top = around
    while top is not None and top.tag != "article":
        top = top.parent
    article = top or around
    within = {id(nodes[0]): article is nodes[0]}
    for n in nodes[1:]:
        within[id(n)] = within[id(n.parent)] or n is article
    picked = {id(b) for b in chosen}
    # what stands among the content joins it, unless its path is set apart and so below every threshold
    kept = [within[id(b.node)] and (not b.apart or id(b) in picked) for b in blocks]
    if not article.inside:
        kept = [k or id(b) in picked for k, b in zip(kept, blocks, strict=True)]
        headed = {id(nodes[0]): False}
        for n in nodes[1:]:
            headed[id(n)] = headed[id(n.parent)] or n.tag in HEADINGS
        after = False
        for i in range(len(blocks) - 1, -1, -1):  # headings right before what is kept
            if not blocks[i].apart:
                after = kept[i] = kept[i] or after and headed[id(blocks[i].node)]
    return "\n".join(b.text for b, k in zip(blocks, kept, strict=True) if k)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for each row of (page_id, url, html)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, len(batch), 500):
                part = batch.slice(i, 500)
                texts = [main_text(h) if h else "" for h in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(run, SCHEMA)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
