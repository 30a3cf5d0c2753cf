"""Main text against a plain version: the library's parser, paths as strings, loops; hostile and odd pages."""

import math
import re
import time
from html.parser import HTMLParser

import pyarrow.parquet as pq
import pytest

from quarryloom.llm import op10_main_text as pages


class Tree(HTMLParser):
    """Blocks as (elements around it, text); a p ends at the next block."""

    def __init__(self):
        super().__init__()
        self.open, self.blocks, self.text, self.home, self.n, self.skip = [], [], "", None, 0, None

    def end_block(self):
        text = " ".join(self.text.split())
        if text and not any(t in ("nav", "footer") or "ad" in c for t, c, _ in self.home):
            self.blocks.append((self.home, text))
        self.text = ""

    def handle_starttag(self, tag, attrs):
        if tag == "br":
            self.text += " "
        elif tag in ("script", "style", "title"):
            self.skip = tag
        elif tag != "meta":
            if tag in pages.BLOCKS:
                self.end_block()
                for i in range(len(self.open) - 1, -1, -1):
                    if self.open[i][0] in ("li", "div", "article", "body"):
                        break
                    if self.open[i][0] == "p":
                        self.open = self.open[:i]
                        break
            self.n += 1
            self.open = [*self.open, (tag, dict(attrs).get("class", "").split(), self.n)]

    def handle_endtag(self, tag):
        if tag == self.skip:
            self.skip = None
        elif any(t == tag for t, _, _ in self.open):
            if tag in pages.BLOCKS:
                self.end_block()
            while self.open[-1][0] != tag:
                self.open = self.open[:-1]
            self.open = self.open[:-1]

    def handle_data(self, data):
        if not self.skip:
            if not self.text:
                self.home = self.open
            self.text += data


def plain_main_text(page: str) -> str:
    tree = Tree()
    tree.feed(page)
    tree.close()
    tree.end_block()
    blocks = tree.blocks
    if not blocks:
        return ""
    of = lambda b: tuple(t for t, _, _ in b[0])
    paths = list(dict.fromkeys(of(b) for b in blocks))
    ratio = lambda p, f: sum(f(b[1]) for b in blocks if of(b) == p) / sum(of(b) == p for b in blocks)
    fused = {}
    for i, p in enumerate(paths):
        sums = [0.0, 0.0, 0.0]
        for j, q in enumerate(paths):
            if abs(i - j) <= 2:
                common = next((k for k, (x, y) in enumerate(zip(p, q, strict=False)) if x != y), min(len(p), len(q)))
                w = math.exp(-((i - j) ** 2) / 2) * ((1 + common) / (1 + max(len(p), len(q)))) ** 4
                sums = [sums[0] + w, sums[1] + w * ratio(q, len), sums[2] + w * ratio(q, lambda t: len(re.findall(r"[.,;:!?]", t)))]
        fused[p] = sums[1] / sums[0] * (1 + sums[2] / sums[0])
    values = [fused[of(b)] for b in blocks]
    mean = sum(values) / len(values)
    spread = math.sqrt(sum((v - mean) ** 2 for v in values) / len(values))
    chosen = [b for b, v in zip(blocks, values, strict=True) if v >= min(spread, 0.5 * max(values))]
    total = sum(len(b[1]) for b in chosen)
    longest = max(chosen, key=lambda b: len(b[1]))[0]
    held = lambda e: sum(len(b[1]) for b in chosen if e in b[0])
    k = max((i for i, e in enumerate(longest) if held(e) >= 0.8 * total), default=-1)
    while k > 0 and longest[k][0] in pages.INLINE and longest[k - 1][0] not in ("html", "body"):
        k -= 1
    article = max((i for i in range(k + 1) if longest[i][0] == "article"), default=k)
    assert article >= 0 and any(t in ("article", "main") for t, _, _ in longest[: article + 1])
    return "\n".join(b[1] for b in blocks if longest[article] in b[0])


def test_main_text_against_a_plain_tree():
    html = pq.read_table("/root/testdata/sf0.01/pages.parquet").column("html").to_pylist()
    assert len(html) == 250
    for page in html:
        assert pages.main_text(page) == plain_main_text(page)


def test_paths_alone_find_the_article():
    """Without the prior of word lists the text is found by the ratios of its paths."""
    html = pq.read_table("/root/testdata/sf0.01/pages.parquet").column("html").to_pylist()
    same = sum(pages.main_text(p, prior=False) == pages.main_text(p) for p in html)
    assert same >= 0.9 * len(html)
    links = "".join(f"<li><a href='/{i}'>Entry {i}</a></li>" for i in range(30))
    body = "".join(f"<p>Paragraph {i} has clauses, stops; and, at some length, a point to make.</p>" for i in range(6))
    page = f"<body><div><ul>{links}</ul></div><div><h2>Title</h2>{body}<h2>Part</h2>{body}</div><div><ul>{links}</ul></div></body>"
    text = pages.main_text(page, prior=False)
    assert "Entry" not in text and text.split("\n")[0] == "Title" and text.count("Paragraph") == 12 and "Part" in text


@pytest.mark.parametrize("page", ["<div>" * 60_000 + "x", "<a" * 60_000 + ">", "<div>a, b" * 30_000, "<b>" * 60_000 + "</i>" * 60_000, '<a "' * 60_000, "<a '>'" * 60_000 + '"', "<ul><li>" * 30_000, "<p class=ad><div class=ad>t" * 20_000])
def test_hostile_pages_take_linear_time(page):
    began = time.process_time()
    pages.main_text(page)
    assert time.process_time() - began < 20


def test_attributes_and_cut_off_pages():
    assert pages.main_text("<p title='hidden class=ad'>Shown, all the same.</p>") == "Shown, all the same."
    assert pages.main_text("<p hidden>Not shown.</p><p>Shown.</p>") == "Shown."
    assert pages.main_text("<p>a < b and c</p><p>text<!-- cut") == "a < b and c\ntext"
    assert pages.main_text("<p>one</p><scr") == "one" and pages.main_text("<table><tr><td>a<td>b<tr><td>c</table>") == "a\nb\nc"


def test_extra_columns_and_repeats(spark):
    rows = [(1, "u", "<p>x, y</p>", 5), (1, "u", "<p>x, y</p>", 6), (None, None, None, None)]
    got = pages.extract(spark.createDataFrame(rows, "page_id long, url string, html string, `text.n` int")).collect()
    assert sorted((r.page_id or 0, r.text, r.n_chars) for r in got) == [(0, "", 0), (1, "x, y", 4), (1, "x, y", 4)]


def test_the_ratios_of_paths_choose(monkeypatch):
    prose = "".join(f"<p>Number {i} of some sentences, with commas; and more, and an end. Then one more of them, here.</p>" for i in range(6))
    links = "".join(f"<li><a href='/{i}'>entry {i}</a></li>" for i in range(12))
    page = f"<html><body><div><ul>{links}</ul></div><div>{prose}</div><div class='footer'><p>All rights, and so on, are kept. See there.</p></div></body></html>"
    got = pages.main_text(page)
    assert "entry" not in got and "rights" not in got and got.count("\n") == 5
    assert "entry" not in pages.main_text(page, prior=False)
    monkeypatch.setattr(pages, "content_paths", lambda blocks, shape: {pages.path_of(b) for b in blocks})
    everything = pages.main_text(page)
    assert "entry 3" in everything and "rights" in everything
