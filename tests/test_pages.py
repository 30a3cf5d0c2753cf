"""Parser pass, regions, columns, sizes, rules: hand-computed expectations on small pages."""

import pytest
from pyspark.sql import functions as F

from quarryloom.functions import numbers, text, urls
from quarryloom.operators import columns, corpus, dom, rules, selectors, templates
from quarryloom.sources import pages as sources

SENTENCE = "The reading rooms stay open late in winter, and the loan desk moves to the ground floor. "
STORY = f"""<html><body><ul id="mainmenu"><li><a href="/">Start</a></li><li><a href="/loans/">Loans</a></li><li><a href="/rooms/">Rooms</a></li></ul>
<div class="wrap"><h1 class="headline">Longer hours</h1><p><span class="posted">2019/11/23</span> <span class="unit">古籍馆</span></p>
<div class="story"><p>{SENTENCE * 4}</p><p>{SENTENCE * 3}</p></div></div><div id="copyright">Library of a small town, opening hours, address and more words <a href="/imprint">imprint</a></div></body></html>"""
SHELVES = """<html><body><div class="shelf"><ol class="titles">%s</ol></div><p class="pager">共 <i>63</i> 项 <a href="p2.html">2</a> <a href="p9.html">9</a> <a href="p2.html">next</a></p></body></html>""" % "".join(f"<li><a href='/t/{i * 7}.html'>Title {i}</a></li>" for i in range(7))
SHEETS = """<html><body><p>Forms</p><div class="sheets"><a href="/x/loan.xlsx">Loan</a><a href="/x/room.PDF">Room</a><a href="/x/old.doc?v=2">Old</a><a href="/help">Help</a></div></body></html>"""


@pytest.fixture(scope="module")
def regions(spark):
    """Regions of a page; all pages below are parsed in one job."""
    known: dict[str, dict] = {}

    def of(*pages):
        if new := [p for p in dict.fromkeys(pages) if p not in known]:
            known.update({p: {} for p in new})
            for r in dom.segment_pages(spark.createDataFrame([(i, "u", p) for i, p in enumerate(new)], "k int, url string, html string"), ["k"]).collect():
                known[new[r.k]][r.type] = (r.selector, r.confidence, r.note)
        return [known[p] for p in pages]

    return of


def test_regions_of_a_story(regions):
    r = regions(STORY)[0]
    assert r["article_body"] == ("div.story", 1.0, None)
    assert r["navigation"][0] == "ul#mainmenu" and r["footer"][0] == "div#copyright" and r["footer"][1] < r["navigation"][1]
    assert r["article_meta"][0] == "span.posted" and set(r) == {"article_body", "navigation", "footer", "article_meta"}


def test_regions_of_lists_files_and_odd_pages(regions):
    nested = "<section><div class='deep'>" + "".join(f"<p><a href='/{i}'>{i}</a></p>" for i in range(9)) + "</div></section>"
    few = "<div>" + "<p><a href='/x'>t</a></p>" * 4 + "<p>no link</p></div>"
    shelves, sheets, deep, little, *odd, crumb = regions(SHELVES, SHEETS, nested, few, "", "\n\t", "5 < 6 and no tag", "<p id='crumb'><a href='/'>up</a></p>")
    assert shelves["article_list"] == ("ol.titles", round(0.5 + 0.5 * 7 / 12, 2), None) and shelves["pagination"] == ("p.pager", round(0.7 + 0.3 * 2 / 3, 2), None)
    assert sheets["attachment"] == ("div.sheets", round(0.6 + 0.4 * 3 / 4, 2), None)
    assert deep["article_list"][0] == "div.deep" and "article_list" not in little
    assert odd == [{}, {}, {}] and crumb["article_body"] == ("body", 0.0, dom.NO_BODY)


def test_a_short_article_is_the_body(spark, regions):
    short = "<body><div class='ad'>Not this one</div><article><h1>Closed.</h1><p><b>Closed.<br></article></body>"
    nothing, menu = "<body><div>Not this one</div><article> </article></body>", "<body><main class='menu'>Up</main></body>"
    assert [r["article_body"] for r in regions(short, nothing, menu)] == [("article", 1.0, None), ("body", 0.0, dom.NO_BODY), ("body", 0.0, dom.NO_BODY)]
    own = columns.classify_pages(dom.segment_pages(spark.createDataFrame([("u", short), ("v", nothing)], "url string, html string"), ["url"])).collect()
    assert {r.url: (r.type, r.confidence) for r in own} == {"u": ("single", 1.0), "v": ("unknown", 0.0)}


def selectors_of(spark, *pages):
    elements = dom.explode_elements(spark.createDataFrame([(k, "u", p) for k, p in enumerate(pages)], "k int, url string, html string"), ["k"])
    found = {(r.k, r.pos): r.selector for r in selectors.element_selectors(elements, ["k"]).collect()}
    return [[found[k, i] for i in range(len(dom.parse(p).tag))] for k, p in enumerate(pages)]


def test_every_element_has_a_selector_whose_first_match_it_is(spark):
    tiles = "<section class='tile wide'>1</section><section class='tile'><em id='e9'>2</em></section><q>3</q><q>4</q><q>5</q>"
    wider = "<main><i class='a b c'>x</i><i class='b a'>y</i><i class='b d'>z</i><i class='a b'>w</i></main>"
    names = "<div id='1a'><u id='x y'></u></div><div id='ok-1'></div><div class='p.q r'></div><div class='twin twin'></div>"
    twice = "<ul><li class='on'><b>x</b></li><li class='on'><b>x</b><b>y</b></li></ul>"
    got = selectors_of(spark, tiles, wider, names, twice)
    assert got[0] == ["section.tile.wide", "section:nth-of-type(2)", "em#e9", "q", "q:nth-of-type(2)", "q:nth-of-type(3)"]
    assert got[1] == ["main", "i.a.b.c", "main > i:nth-of-type(2)", "i.b.d", "main > i:nth-of-type(4)"]  # the first has both classes too
    assert got[2] == ["div", "u", "div#ok-1", "div.r", "div.twin.twin"]
    assert got[3] == ["ul", "li.on", "b", "ul > li:nth-of-type(2)", "ul > li:nth-of-type(2) > b:nth-of-type(1)", "ul > li:nth-of-type(2) > b:nth-of-type(2)"]
    for page, own in ((tiles, got[0]), (twice, got[3])):
        assert [dom.parse(page).first(s) for s in own] == list(range(len(own)))


def test_pages_without_a_key_keep_their_selectors(spark):
    rows = spark.createDataFrame([(None, "u", "<p>a</p><p>b</p>")], "k int, url string, html string")
    assert sorted(r.selector for r in selectors.element_selectors(dom.explode_elements(rows, ["k"]), ["k"]).collect()) == ["p", "p:nth-of-type(2)"]
    assert [r.selector for r in dom.segment_pages(rows.withColumn("html", F.lit(f"<div class='s'>{SENTENCE}</div>")), ["k"]).collect()] == ["div.s"]
    assert selectors.element_selectors(dom.explode_elements(rows.limit(0), ["k"]), ["k"]).collect() == []


def test_element_rows_give_density(spark):
    rows = [(1, "u", "<main><div id='d'>aaaa bbbb</div><div class='x y'>c</div><div class='y'>d</div></main>"), (2, "u", "<div class='sidebar'>only noise in here</div>"), (3, "u", None)]
    elements = dom.explode_elements(spark.createDataFrame(rows, "k int, url string, html string"), ["k"])
    assert [(r.k, r.tag, r.text_len) for r in dom.densest(elements, ["k"], 5).collect()] == [(1, "div", 9)]


def test_fingerprint_ignores_noise_and_small_pages():
    assert dom.parse("<section class='tile wide'>1</section><section class='tile'><em id='e9'>2</em></section><q>3</q>").fingerprint() == ["em", "q", "section.tile"]
    assert dom.parse("<aside class='sidebar'><dl><dt>k<dd>v</dl></aside><p>one</p>").fingerprint() == []
    assert dom.parse("<main class='page two'><h2>t</h2><figure>f</figure></main>").fingerprint() == ["figure", "h2", "main.page"]


def test_candidates(spark):
    twice, deep = "<b class='tag'>a word</b><b class='tag'>档案馆</b>", "<div class='o'><div class='i'><p><a href='/a.pdf'>x</a></p><p class='f'><a href='/b.pdf?v=1'>y</a><a href='/c.pdf'>z</a></p></div></div><a href='/d.doc'>w</a>"
    pages = [STORY, SHEETS, twice, deep]
    hits = dom.selector_hits(spark.createDataFrame([(k, "u", p) for k, p in enumerate(pages)], "k int, url string, html string"), ["k"]).collect()
    own = [{(r.field, r.selector) for r in hits if r.k == k} for k in range(len(pages))]
    assert {("body", "div.story"), ("title", "h1.headline"), ("date", "span.posted"), ("department", "span.unit")} <= own[0]
    assert {s for f, s in own[1] if f == "attachment"} == {'div.sheets a[href$=".xlsx"]'}  # of ends in capitals or with a query none is selected
    assert ("department", "b.tag") not in own[2]
    assert {s for f, s in own[3] if f == "attachment"} == {'a[href$=".pdf"]', 'p.f a[href$=".pdf"]', 'a[href$=".doc"]'}
    assert len(hits) == len(set(hits))


@pytest.mark.parametrize("value, shown", [(3, "约 3"), (58, "约 50"), (99, "约 90"), (100, "约 100"), (273, "约 250"), (999, "约 950"), (4821, "约 4800")])
def test_approximate(spark, value, shown):
    assert spark.range(1).select(numbers.approximate(F.lit(value))).first()[0] == shown


def test_urls(spark):
    cases = [("https://lib.town/2019/t7/b-04.html?p=2", "/#/#/#", "https://lib.town"), ("http://lib.town:81/rooms/plan.html#top", "/rooms/plan.html", "http://lib.town:81"), ("mail:x", "", None), ("https://lib.town", "", "https://lib.town")]
    got = spark.createDataFrame([(c[0],) for c in cases], "u string").select(urls.url_shape(F.col("u")), urls.origin_of(F.col("u"))).collect()
    assert [tuple(r) for r in got][:2] == [c[1:] for c in cases][:2] and got[2][1] is None and tuple(got[3]) == cases[3][1:]
    assert [urls.resolve("https://lib.town/a/b.html", h) for h in ("c.html#n", "/d", "../e", "#n", "javascript:f()", "tel:1", "", None)] == ["https://lib.town/a/c.html", "https://lib.town/d", "https://lib.town/e", None, None, None, None, None]
    pages = spark.createDataFrame([("p9.html",), ("/rooms/plan.html",), ("/t/x3_12.html",)], "h string").select(urls.page_number(F.col("h"))).collect()
    assert [r[0] for r in pages] == [9, None, 12]


def test_text_functions(spark):
    row = spark.createDataFrame([("am 1998-7 - 4 erschienen", "音像部", "siehe 图管〔2017〕208号, AB-77 und x-1")], "d string, p string, n string")
    assert tuple(row.select(text.find_date(F.col("d")), text.is_department(F.col("p")), text.extract_doc_numbers(F.col("n"))).first()) == ("1998-7 - 4", True, ["图管〔2017〕208号", "AB-77"])
    assert spark.range(1).select(text.text_norm(F.lit("\u3000x \t y\u3000"))).first()[0] == "x y"


@pytest.mark.parametrize("html, entries, items, pages, method", [
    ("总共 5127 篇", 7, 5127, None, columns.BY_ITEMS), ("共 63 项", 0, 63, None, columns.BY_ITEMS), ("总数 9", 7, 9, None, columns.BY_ITEMS),
    ("3 / 14", 7, 98, 14, columns.BY_PAGES), ("older entries", 7, 63, 9, columns.BY_LINKS), ("", 7, None, None, columns.BY_NOTHING), ("3 / 14", 0, None, None, columns.BY_NOTHING),
])
def test_sizes(spark, html, entries, items, pages, method):
    row = spark.createDataFrame([(html, ["p2.html", "p9.html"], entries)], "paging_text string, hrefs array<string>, entries int")
    r = columns.estimate_sizes(row).first()
    assert (r["items"], r["pages"], r["method"]) == (items, pages, method)


def test_paging_text_keeps_pieces_apart():
    assert dom.parse("<nav class='pagination'>总数 63<b>7</b><b>8</b></nav>").paging_text() == "总数 63 7 8"
    assert dom.parse(SHELVES).paging_text() == "共 63 项 2 9 next"


def test_column_tree(spark):
    home = """<ul class="menu"><li><a href="/index.html">Start</a></li><li><a href="/loans/">Loans</a><ul><li><a href="/loans/fees.html">Fees</a></li><li><a href="https://else.where/z">Else</a></li></ul></li><li><a href="/rooms/"><img src="r.png"></a></li></ul>"""
    homes = spark.createDataFrame([("a", "https://lib.town/index.html", home), ("b", "https://b.town/", "<p><a href='/y/41'>one</a><a href='/y/42'>two</a><a href='/about'>about</a></p>")], "site string, url string, html string")
    links = dom.extract_links(homes, ["site", "url"]).withColumnRenamed("url", "base_url")
    got = {(r.site, r.url): (r.name, r.depth, r.parent_url, r.needs_manual_name, r.source) for r in columns.discover_columns(homes, links).collect()}
    assert got[("a", "https://lib.town/loans/fees.html")] == ("Fees", 1, "https://lib.town/loans/", False, "navigation")
    assert got[("a", "https://lib.town/rooms/")] == (columns.NAME_UNKNOWN, 0, None, True, "navigation") and len([k for k in got if k[0] == "a"]) == 3
    assert {k[1] for k in got if k[0] == "b"} == {"https://b.town/y/41", "https://b.town/about"} and got[("b", "https://b.town/about")][4] == "clustering"


def test_clustering_modes(spark):
    rows = [("s", 1, "/p", ["a", "b", "c"], "x"), ("s", 2, "/p", ["a", "b", "c", "d"], "y"), ("s", 3, "/p", ["q", "r", "s"], "x"), ("s", 4, "/q", ["a", "b", "c"], "x"), ("s", 5, "/p", [], "x"), ("s", 6, "/p", [], "x"), ("s", 7, "/p", ["a", "b", "c"], "z")]
    pages = spark.createDataFrame([(*r, f"u{r[1]}") for r in rows], "site string, seq long, shape string, fingerprint array<string>, column string, url string")
    for exact in (False, True):
        got = sorted((r.url_shape, r.page_count, r.columns, r.sample_urls) for r in templates.cluster_templates(pages, exact=exact).collect())
        assert [(g[0], g[1]) for g in got if g[1] > 1] == [("/p", 3)] and ["x", "y", "z"] in [g[2] for g in got]
        assert sum(g[1] for g in got) == 7 and ["u1", "u2", "u7"] in [g[3] for g in got]
    assert templates.cluster_templates(pages, threshold=0.01).where("url_shape = '/p'").count() >= 3
    assert templates.cluster_templates(pages.limit(0)).count() == 0


def test_rules_and_drafts(spark):
    pages = spark.createDataFrame([(4, f"u{i}", STORY) for i in range(3)] + [(4, "u9", SHEETS)], "template_id int, url string, html string")
    ranked = rules.infer_selectors(dom.selector_hits(pages, ["template_id", "url"]), pages)
    best = {r.field: (r.selector, r.hits, r.samples) for r in ranked.where("rank = 1").collect()}
    assert best["body"] == ("div.story", 3, 4) and best["attachment"][1:] == (1, 4)
    fields = rules.draft_fields(ranked, pages.select("template_id").distinct())
    sites = spark.createDataFrame([(4, "town's library", ["https://lib.town"], "desk", 4)], "template_id int, name string, entry_urls array<string>, contact string, samples int")
    r = rules.build_drafts(fields, sites).first()
    assert "name: 'town''s library'" in r.yaml_text and "  body: 'div.story'  # 75% of the pages" in r.yaml_text and r.low_confidence_fields == ["attachment"]
    assert {f.field for f in rules.missing_fields(ranked.where("field = 'date'"), pages.select("template_id").distinct()).collect()} == {"title", "body", "department", "attachment"}
    own = spark.createDataFrame([(4, {"title": "h1.headline", "body": "div.none", "attachment": "a"})], "template_id int, rules map<string,string>")
    got = {x.url: x for x in dom.extract_fields(pages, own, ["url"]).collect()}
    assert got["u1"].title == "Longer hours" and got["u1"].body is None and "body" in got["u1"].unknown


def test_markdown_and_chunks(spark):
    html = "<html><body><nav>menu</nav><h1>T</h1><p>one <b>two</b></p><table><tr><th>a</th><th>b</th></tr><tr><td>1</td><td>2</td></tr></table><table><tr><td colspan=2>m</td></tr></table><ul><li>x</li></ul><div class='footer'>f</div></body></html>"
    md, tables, merged, flat = corpus.markdown_of(dom.parse(html))
    assert md == "# T\n\none two\n\n| a | b |\n| --- | --- |\n| 1 | 2 |\n\n<table><tr><td colspan=\"2\">m</td></tr></table>\n\n- x" and (tables, merged, flat) == (2, 1, False)
    assert corpus.markdown_of(dom.parse("<div>" * 3000 + "deep"))[0] == "deep"
    assert corpus.markdown_of(dom.parse("<p>a</p>"))[3] and corpus.markdown_of(None) == ("", 0, 0, True)
    para = "。".join(f"这是第{i}句话内容" for i in range(40)) + "。"
    chunks = corpus.chunks_of(f"# A\n\nshort\n\n## B\n\n{para}", 100, 20, 10)
    assert chunks[0] == (["A"], "short") and all(p == ["A", "B"] for p, _ in chunks[1:]) and max(len(t) for _, t in chunks) <= 110
    assert all(f"第{i}句" in "".join(t for _, t in chunks) for i in range(40)) and chunks[1][1][-5:] in chunks[2][1] + chunks[1][1]
    rows = "\n".join(f"| {i} | {'x' * 20} |" for i in range(10))
    pieces = corpus.chunks_of(f"| h | k |\n| --- | --- |\n{rows}", 100, 20, 10)
    assert len(pieces) > 1 and all(t.startswith("| h | k |\n| --- | --- |\n") for _, t in pieces)
    with pytest.raises(ValueError):
        corpus.chunk_documents(spark.createDataFrame([(1, "x")], "k int, markdown string"), "k", 10, 10)


def test_sitemaps_by_an_xml_parser(spark):
    head = '<?xml version="1.0" encoding="UTF-8"?>'
    ns = 'xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"'
    rows = [
        ("a", "b", f"{head}<urlset {ns}><!-- <url><loc>no</loc></url> --><url><loc> https://lib.town/?x=1&amp;y=&#50; </loc></url><url><loc><![CDATA[https://lib.town/a&b]]></loc></url><url><loc/></url></urlset>"),
        ("i", "b", f"<sitemapindex {ns}><sitemap><loc>https://lib.town/s.xml</loc></sitemap></sitemapindex>"), ("bad", "b", "<urlset><url>"), ("other", "b", "<html/>"), ("none", "b", None),
    ]
    got = [(r.site, r.pos, r.target, r.is_index) for r in sources.read_sitemaps(spark.createDataFrame(rows, "site string, base_url string, xml string")).collect()]
    assert sorted(got) == [("a", 0, "https://lib.town/?x=1&y=2", False), ("a", 1, "https://lib.town/a&b", False), ("i", 0, "https://lib.town/s.xml", True)]


def test_folders_and_kinds_of_files(spark, tmp_path):
    (tmp_path / "deep").mkdir()
    for name, content in {"a.pdf": b"%PDF-1.4 x", "deep/b.html": b"<!DOCTYPE html><p>x", "deep/c.txt": b"plain", "skip.tmp": b"x"}.items():
        (tmp_path / name).write_bytes(content)
    files = sources.read_folder(spark, str(tmp_path), include=[r"\.(pdf|html|txt|tmp)$"], exclude=[r"\.tmp$"])
    (tmp_path / "odd [1]*.pdf").write_bytes(b"%PDF-1.4")
    assert [r.path for r in sources.read_folder(spark, str(tmp_path), include=["odd"]).collect()] == ["odd [1]*.pdf"]
    assert sources.read_folder(spark, str(tmp_path), include=["nothing"]).collect() == []
    (tmp_path / "skip.tmp").chmod(0)  # what the rules leave out is never opened
    files = sources.read_folder(spark, str(tmp_path), include=[r"\.(pdf|html|txt|tmp)$"], exclude=[r"\.tmp$", "odd"])
    assert "skip.tmp" not in "".join(files.inputFiles())
    kinds = spark.createDataFrame([(b"PK\x03\x04..word/x", ), (b"PK\x03\x04\x07xl/", ), (b"PK\x03\x04w\x06\xf7&B", ), (b"a\0b", )], "content binary")
    assert [r[0] for r in kinds.select(sources.sniff_type(F.col("content"))).collect()] == ["docx", "xlsx", "text", "unsupported"]
    got = {r.path: (r.bytes, r.kind) for r in files.select("path", "bytes", sources.sniff_type(F.col("content")).alias("kind")).collect()}
    assert got == {"a.pdf": (10, "pdf"), "deep/b.html": (19, "html"), "deep/c.txt": (5, "text")}


def test_chunks_carry_their_documents_columns(spark):
    docs = spark.createDataFrame([("d1", "# A\n\ntext one", "web", ["f.pdf"]), ("d2", "text two", "file", None)], "doc_id string, markdown string, source string, attachments array<string>")
    got = corpus.with_metadata(corpus.chunk_documents(docs, "doc_id"), docs, "doc_id").collect()
    assert {(r.doc_id, r.source, tuple(r.attachments or [])) for r in got} == {("d1", "web", ("f.pdf",)), ("d2", "file", ())}


def test_named_characters_need_their_semicolon(spark):
    html = "<html><body><h1>Fish &amp; chips &ampx; &copy 5 &#169; &lt;b&gt; &notit; R&D &amp</h1><a href='/p?a=1&copy=2&amp;b=3'>x</a><script>a &amp b</script><article><p>%s&amp</p></article></body></html>" % SENTENCE
    page = dom.parse(html)
    assert page.text(page.first("h1")) == "Fish & chips &ampx; &copy 5 © <b> &notit; R&D &amp"
    assert page.attrs[page.anchors[0]]["href"] == "/p?a=1&copy=2&b=3" and page.text(page.first("script")) == "a &amp b"
    assert [html[page.mark_from[i] : page.mark_to[i]][:3] for i in range(3)] == ["<ht", "<bo", "<h1"] and html[: page.mark_to[2]].endswith("</h1>")
    own = dom.densest(dom.explode_elements(spark.createDataFrame([(1, "u", html)], "k int, url string, html string"), ["k"]), ["k"]).first()
    assert own.text_len == len((SENTENCE + "&amp").strip())
    assert corpus.to_markdown(spark.createDataFrame([(1, html)], "k int, html string"), ["k"]).first().markdown.endswith("&amp")
