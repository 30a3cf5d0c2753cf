"""Queries over pages: URLs, links, templates, columns, robots, crawl versions."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import numbers, text, urls
from ..operators import columns, crawl, dom, links, robots, rules, templates
from ..operators.selectors import element_selectors
from ..sources import pages as sources
from ..session import shared_folder
from .catalog import query, table

ORIGIN = "regexp_extract(url, '^(https?://[^/?#]+)', 1)"
PATH = "regexp_extract({0}, '^https?://[^/?#]*([^?#]*)', 1)"
SHAPE = "array_to_string(list_transform(string_split(" + PATH + ", '/'), lambda s: case when regexp_matches(s, '[0-9]') then '#' else s end), '/')"
#: all anchors of the test pages: their hrefs are paths
LINKS = f"""
links as (
  select page_id, url, href, pos - 1 as pos, {ORIGIN} || regexp_replace(href, '#.*$', '') as target
  from (select page_id, url, regexp_extract_all(html, '<a href="([^"]*)"', 1) as h from pages), lateral (select unnest(h) as href, generate_subscripts(h, 1) as pos)
)"""
TARGET_SHAPE = SHAPE.format("target")
URL_SHAPE = SHAPE.format("url")
FIRST = f"""
firsts as (
  select * from links where target <> url and (starts_with(target, {ORIGIN} || '/') or target = {ORIGIN})
  qualify row_number() over (partition by url, target order by page_id, pos) = 1
)"""


def page_links(spark, sf):
    return dom.extract_links(table(spark, sf, "pages"), ["page_id", "url"])


def site_pages(spark, sf):
    p = table(spark, sf, "pages")
    return p.select("page_id", "url", "html", urls.host_of(F.col("url")).alias("site"), urls.url_shape(F.col("url")).alias("shape"), F.col("page_id").alias("seq"), F.element_at(F.split(urls.path_of(F.col("url")), "/"), 2).alias("column"))


SITE_PAGES = f"site_pages as (select page_id, url, html, regexp_extract(url, '^https?://([^/?#]*)', 1) as site, {URL_SHAPE} as shape, string_split({PATH.format('url')}, '/')[2] as col from pages)"

# --- URLs and text ---


@query("url_origin", f"select page_id, nullif({ORIGIN}, '') as origin from pages")
def _(spark, sf):
    return table(spark, sf, "pages").select("page_id", urls.origin_of(F.col("url")).alias("origin"))


@query("url_shape", f"select page_id, {URL_SHAPE} as shape from pages")
def _(spark, sf):
    return table(spark, sf, "pages").select("page_id", urls.url_shape(F.col("url")).alias("shape"))


@query("url_home", f"select page_id, {PATH.format('url')} in ('', '/') or (string_split({PATH.format('base')}, '/')[-1] <> '' and string_split({PATH.format('url')}, '/')[-1] = string_split({PATH.format('base')}, '/')[-1]) as home from (select page_id, url, min(url) over (partition by {ORIGIN}) as base from pages)")
def _(spark, sf):
    p = table(spark, sf, "pages").select("page_id", "url", urls.origin_of(F.col("url")).alias("origin"))
    first = p.groupBy("origin").agg(F.min("url").alias("base"))
    return p.join(first.withColumnRenamed("origin", "o"), F.expr("origin <=> o")).select("page_id", urls.is_homepage_like(F.col("url"), F.col("base")).alias("home"))


@query("url_pageno", "select page_id, try_cast(nullif(regexp_extract(split_part(string_split(url, '/')[-1], '.', 1), '([0-9]+)[^0-9]*$', 1), '') as bigint) as page_no from pages")
def _(spark, sf):
    return table(spark, sf, "pages").select("page_id", urls.page_number(F.col("url")).alias("page_no"))


@query("url_resolve", f"with {LINKS} select page_id, href, target, count(*) as n from links group by all")
def _(spark, sf):
    own = page_links(spark, sf).select("page_id", "url", "href")
    return own.select("page_id", "href", urls.resolve_link(F.col("url"), F.col("href")).alias("target")).groupBy("page_id", "href", "target").agg(F.count("*").alias("n"))


@query("txt_norm", "select doc_id, sha256(trim(regexp_replace(text, '\\s+', ' ', 'g'))) as norm, length(regexp_replace(text, '\\s+', '', 'g')) as squeezed from documents")
def _(spark, sf):
    d = table(spark, sf, "documents")
    return d.select("doc_id", F.sha2(text.text_norm(F.col("text")), 256).alias("norm"), F.length(text.text_squeeze(F.col("text"))).cast("long").alias("squeezed"))


@query("txt_date", "select o_orderkey, nullif(regexp_extract(o_orderpriority || ' ' || strftime(o_orderdate, '%Y / %m / %d') || ' x', '((?:19|20)[0-9]{2}\\s*[-/年]\\s*[0-9]{1,2}\\s*[-/月]\\s*[0-9]{1,2})', 1), '') as found from orders")
def _(spark, sf):
    line = F.concat(F.col("o_orderpriority"), F.lit(" "), F.date_format("o_orderdate", "yyyy / MM / dd"), F.lit(" x"))
    return table(spark, sf, "orders").select("o_orderkey", text.find_date(line).alias("found"))


@query("txt_dept", "select s_suppkey, regexp_matches(s_name || ['处', '中心', 'x', '办公室'][(s_suppkey % 4 + 1)::int], '(?:处|院|系|部|办公室|中心|科|馆|所)$') as dept from supplier")
def _(spark, sf):
    ends = F.element_at(F.array(*[F.lit(x) for x in ("处", "中心", "x", "办公室")]), (F.col("s_suppkey") % 4 + 1).cast("int"))
    return table(spark, sf, "supplier").select("s_suppkey", text.is_department(F.concat("s_name", ends)).alias("dept"))


@query("txt_attach", "select page_id, regexp_matches(lower(split_part(url, '?', 1)), '\\.(html|pdf)$') as attachment from pages")
def _(spark, sf):
    return table(spark, sf, "pages").select("page_id", urls.is_attachment(F.col("url"), ["html", "PDF"]).alias("attachment"))


@query("txt_docnum", "select o_orderkey, array_to_string(regexp_extract_all('见 闽教学〔' || year(o_orderdate) || '〕' || o_orderkey || '号 与 FORM-' || (o_orderkey % 900 + 100), '([一-鿿]{1,8}[〔\\[（(][0-9]{4}[〕\\]）)][0-9]+号|[A-Z]{2,}-?[0-9]{2,})', 1), ',') as numbers from orders")
def _(spark, sf):
    line = F.concat(F.lit("见 闽教学〔"), F.year("o_orderdate").cast("string"), F.lit("〕"), F.col("o_orderkey").cast("string"), F.lit("号 与 FORM-"), (F.col("o_orderkey") % 900 + 100).cast("string"))
    return table(spark, sf, "orders").select("o_orderkey", F.array_join(text.extract_doc_numbers(line), ",").alias("numbers"))


@query("num_approx", "select doc_id, '约 ' || (n_chars // s * s)::bigint as shown from (select doc_id, n_chars, case when n_chars < 10 then 1 when n_chars < 100 then 10 when n_chars < 1000 then 50 else 100 end as s from documents)")
def _(spark, sf):
    return table(spark, sf, "documents").select("doc_id", numbers.approximate(F.col("n_chars")).alias("shown"))


@query("num_size_text", "select p_partkey, case when p_partkey % 5 = 0 then '规模未知' else '约 ' || (p_size // case when p_size < 10 then 1 else 10 end * case when p_size < 10 then 1 else 10 end) || '条' || case when p_partkey % 2 = 1 then '、约 7页' else '' end || '（据页数文本）' end as shown from part")
def _(spark, sf):
    k = F.col("p_partkey")
    return table(spark, sf, "part").select("p_partkey", numbers.size_display(F.when(k % 5 != 0, F.col("p_size")), F.when(k % 2 == 1, 7), F.lit(columns.BY_PAGES)).alias("shown"))


@query("dom_noise", "select page_id, regexp_matches(lower(regexp_extract(url, '^https?://([^/?#]*)', 1) || ' ' || coalesce(url, '')), 'nav|menu|header|footer|sidebar|side|breadcrumb|copyright|banner|topbar|crumb') as noisy from pages")
def _(spark, sf):
    return table(spark, sf, "pages").select("page_id", text.is_noise(urls.host_of(F.col("url")), F.col("url")).alias("noisy"))


# --- one parser pass ---


@query("html_elements", "select page_id, tag, count(*) as n from (select page_id, unnest(regexp_extract_all(html, '<([a-z][a-z0-9]*)[ >]', 1)) as tag from pages) group by all")
def _(spark, sf):
    return dom.explode_elements(table(spark, sf, "pages"), ["page_id"]).groupBy("page_id", "tag").agg(F.count("*").alias("n"))


@query("html_links", f"with {LINKS} select page_id, pos, href, target, false as noisy from links")
def _(spark, sf):
    return page_links(spark, sf).select("page_id", F.col("pos").cast("long"), "href", "target", "noisy")


@query("html_regions")
def _(spark, sf):
    return dom.segment_pages(table(spark, sf, "pages"), ["page_id", "url"])


@query("html_regions_lists", "select page_id, 'ul' as selector, round(0.5 + 0.5 * n / (n + 5), 2) as confidence, array_to_string(names, '')[:90] as snippet from (select page_id, names, len(names) as n from (select page_id, regexp_extract_all(html, '<li><a href=\"[^\"]*\">([^<]*)</a></li>', 1) as names from pages)) where n >= 5")
def _(spark, sf):
    """Of the regions the lists of links, which the test pages show in their navigation."""
    own = dom.segment_pages(table(spark, sf, "pages"), ["page_id"]).where("type = 'article_list'")
    return own.select("page_id", "selector", "confidence", "snippet")


#: the text of an element of the test pages: no tags, white space as one space
FLAT = "trim(regexp_replace(replace(replace(regexp_replace({0}, '<[^>]*>', '', 'g'), '&quot;', '\"'), '&amp;', '&'), '\\s+', ' ', 'g'))"
INSIDE = "regexp_extract(html, '(<article>.*</article>)', 1, 's')"


@query("html_density", f"with e as (select page_id, 'article' as tag, {INSIDE} as m from pages union all select page_id, 'div', regexp_extract(html, '(<div class=\"ad\">.*?</div>)', 1, 's') from pages), d as (select page_id, tag, length({FLAT.format('m')}) as text_len, length({FLAT.format('m')})::double ^ 2 / length(m) as density from e) select page_id, tag, text_len, round(density, 6) as density from d where text_len >= 50 qualify row_number() over (partition by page_id order by density desc) = 1")
def _(spark, sf):
    own = dom.densest(dom.explode_elements(table(spark, sf, "pages"), ["page_id"]), ["page_id"])
    return own.select("page_id", "tag", F.col("text_len").cast("long").alias("text_len"), F.round("density", 6).alias("density"))


#: elements of the test pages; what stands in what is known by tag, paragraphs end where the next begins
ELEMENTS = """
elements as (
  select page_id, tag, pos - 1 as pos, coalesce(max(case when tag = 'html' then pos end) over w - 1, 0) as html, max(case when tag = 'head' then pos end) over w - 1 as head, max(case when tag = 'body' then pos end) over w - 1 as body,
    max(case when tag = 'nav' then pos end) over w - 1 as nav, max(case when tag = 'ul' then pos end) over w - 1 as ul, max(case when tag = 'li' then pos end) over w - 1 as li, max(case when tag = 'article' then pos end) over w - 1 as article, max(case when tag = 'p' then pos end) over w - 1 as p, max(case when tag = 'b' then pos end) over w - 1 as b
  from (select page_id, unnest(tags) as tag, unnest(range(1, len(tags) + 1)) as pos from (select page_id, regexp_extract_all(html, '<([a-z][a-z0-9]*)[ >]', 1) as tags from pages))
  window w as (partition by page_id order by pos)
),
placed as (
  select page_id, pos, tag, case when tag in ('head', 'body') then html when tag in ('meta', 'title', 'style', 'script') then head when tag in ('nav', 'div', 'article', 'footer') then body when tag = 'ul' then nav when tag = 'li' then ul when tag = 'a' then li when tag in ('h1', 'p') then article when tag = 'b' then p when tag = 'br' then b end as parent
  from elements
),
parts as (
  select *, tag || case when count(*) over s > 1 then ':nth-of-type(' || row_number() over (s order by pos) || ')' else '' end as part, row_number() over (partition by page_id, tag order by pos) as nth
  from placed window s as (partition by page_id, parent, tag)
),
paths as (
  select page_id, pos, part as path from parts where parent is null
  union all
  select c.page_id, c.pos, p.path || ' > ' || c.part from paths p join parts c on c.page_id = p.page_id and c.parent = p.pos
)"""


@query("html_selector", f"with recursive {ELEMENTS} select page_id, pos, case when tag = 'div' and nth = 1 then 'div.ad' when nth = 1 then tag else path end as selector from parts join paths using (page_id, pos)")
def _(spark, sf):
    own = element_selectors(dom.explode_elements(table(spark, sf, "pages"), ["page_id"]), ["page_id"])
    return own.select("page_id", F.col("pos").cast("long").alias("pos"), "selector")


@query("html_selector_classes", f"with recursive {ELEMENTS}, own as (select *, case tag when 'p' then 'c' || nth % 3 when 'li' then 'item' when 'b' then 'lead' end as c, case tag when 'p' then 't' || nth % 5 when 'li' then 'k' || nth % 4 end as d from parts) select page_id, pos, case when tag = 'div' and nth = 1 then 'div.ad' when tag in ('p', 'li') and row_number() over (partition by page_id, tag, c, d order by pos) = 1 then tag || '.' || c || '.' || d when tag = 'b' and nth = 1 then 'b.lead' when nth = 1 then tag else path end as selector from own join paths using (page_id, pos)")
def _(spark, sf):
    """Selectors of pages whose paragraphs and entries have two classes each, of which others have one."""
    k, n = "row_number() over (partition by page_id, tag order by pos)", dom.explode_elements(table(spark, sf, "pages"), ["page_id"])
    n = n.withColumn("nth", F.expr(k))
    two = F.when(F.col("tag") == "p", F.array(F.concat(F.lit("c"), (F.col("nth") % 3).cast("string")), F.concat(F.lit("t"), (F.col("nth") % 5).cast("string")))).when(F.col("tag") == "li", F.array(F.lit("item"), F.concat(F.lit("k"), (F.col("nth") % 4).cast("string")))).when(F.col("tag") == "b", F.array(F.lit("lead"))).otherwise(F.col("classes"))
    return element_selectors(n.withColumn("classes", two).drop("nth"), ["page_id"]).select("page_id", F.col("pos").cast("long").alias("pos"), "selector")


@query("dom_noise_elements", f"with recursive {ELEMENTS} select page_id, pos, tag in ('nav', 'ul', 'li', 'a') or tag = 'footer' and page_id % 2 = 0 as noise from placed")
def _(spark, sf):
    """Noise is inherited: of pages whose navigation has a telling class, and every second one's footer a telling id."""
    html = F.replace("html", F.lit("<nav>"), F.lit("<nav class='Main-MENU'>"))
    html = F.when(F.col("page_id") % 2 == 0, F.replace(html, F.lit("<footer>"), F.lit("<footer id='CopyRight-line'>"))).otherwise(html)
    own = dom.explode_elements(table(spark, sf, "pages").withColumn("html", html), ["page_id"])
    return own.select("page_id", F.col("pos").cast("long").alias("pos"), "noise")


def paged(spark, sf):
    """The pages with a pager behind their article that tells a number of entries and links to further pages."""
    n = F.length("url")
    pager = F.concat(F.lit("</article><div class='pager'>共 <b>"), (F.col("page_id") * n % 977).cast("string"), F.lit("</b> 条<a href='list2.htm'>2</a> <a href='list"), (n % 40 + 3).cast("string"), F.lit(".htm'>end</a></div>"))
    return table(spark, sf, "pages").withColumn("html", F.replace("html", F.lit("</article>"), pager))


PAGED = "paged as (select page_id, page_id * length(url) % 977 as items, length(url) % 40 + 3 as last from pages)"


@query("html_snippet", f"with {PAGED} select page_id, 'div.pager' as selector, '共 ' || items || ' 条2 end' as snippet, length(html) + length('<div class=''pager''>共 <b></b> 条<a href=''list2.htm''>2</a> <a href=''list.htm''>end</a></div>') + length(items::varchar) + length(last::varchar) as page_chars from paged join pages using (page_id)")
def _(spark, sf):
    own = dom.segment_pages(paged(spark, sf), ["page_id"]).where("type = 'pagination'")
    return own.select("page_id", "selector", "snippet", F.col("page_chars").cast("long").alias("page_chars"))


@query("html_paging_text", f"with {PAGED} select page_id, '共 ' || items || ' 条 2 end' as paging_text from paged")
def _(spark, sf):
    return dom.page_structure(paged(spark, sf), ["page_id"]).select("page_id", "paging_text")


@query("agg_size_pages", f"with {PAGED} select page_id, items, null::bigint as pages, '条数文本' as method from paged")
def _(spark, sf):
    """The size of each list, from the pagination text and the links of its page."""
    p = paged(spark, sf)
    hrefs = dom.extract_links(p, ["page_id"]).groupBy("page_id").agg(F.collect_list("href").alias("hrefs"))
    own = dom.page_structure(p, ["page_id"]).select("page_id", "paging_text").join(hrefs, "page_id", "left").withColumn("entries", F.lit(10))
    return columns.estimate_sizes(own).select("page_id", "items", F.col("pages").cast("long").alias("pages"), "method")


@query("agg_page_type_pages", "select page_id, 'single' as type, true as has_pagination from pages")
def _(spark, sf):
    """The type of each page from the regions that the parser pass finds on it."""
    regions = dom.segment_pages(paged(spark, sf), ["page_id"]).where("type <> 'article_list'").withColumnRenamed("page_id", "url")
    return columns.classify_pages(regions).select(F.col("url").alias("page_id"), "type", "has_pagination")


@query("html_candidates", f"with e as (select page_id, 'title' as field, 'h1' as selector, regexp_extract(html, '(<h1>.*?</h1>)', 1, 's') as m from pages union all select page_id, 'body', 'div.ad', regexp_extract(html, '(<div class=\"ad\">.*?</div>)', 1, 's') from pages) select page_id, field, selector from e where case field when 'title' then length({FLAT.format('m')}) between 1 and 120 else length({FLAT.format('m')}) >= 50 end")
def _(spark, sf):
    return dom.selector_hits(table(spark, sf, "pages"), ["page_id"])


@query("html_extract", "select page_id, trim(regexp_extract(replace(html, '&amp;', '&'), '<h1>(.*?)</h1>', 1)) as title, null::varchar as date from pages")
def _(spark, sf):
    p = site_pages(spark, sf).withColumn("template_id", F.lit("t"))
    own = p.select("template_id").limit(1).select("template_id", F.create_map(F.lit("title"), F.lit("h1"), F.lit("body"), F.lit("article")).alias("rules"))
    return dom.extract_fields(p, own, ["page_id"]).select("page_id", "title", "date")


DRESS = "replace(html, '</h1>', '</h1><span class=''when''>发布：2024-' || lpad((page_id % 12 + 1)::varchar, 2, '0') || '-07</span> <em class=''unit''>第' || page_id || '教务处</em> <a href=''/f/' || page_id || '.PDF?v=2''>x</a><a href=''/f/b.docx''>y</a><a href=''/f/b.docx''>again</a>')"


@query("html_extract_fields", f"with d as (select page_id, {ORIGIN} as origin, {DRESS} as html from pages) select page_id, trim(regexp_replace(replace(replace(regexp_extract(html, '<h1>(.*?)</h1>', 1), '&quot;', '\"'), '&amp;', '&'), '\\s+', ' ', 'g')) as title, '发布：2024-' || lpad((page_id % 12 + 1)::varchar, 2, '0') || '-07' as date, '第' || page_id || '教务处' as department, sha256({FLAT.format(INSIDE)}) as body, origin || '/f/' || page_id || '.PDF?v=2,' || origin || '/f/b.docx' as attachments, 'none' as unknown from d union all select page_id, null, null, null, null, '', 'body,title,date,department' from d where page_id % 5 = 0")
def _(spark, sf):
    """All five fields by a template's rules; a fifth of the pages is of a template whose rules hit nothing as well."""
    when = F.concat(F.lit("</h1><span class='when'>发布：2024-"), F.lpad((F.col("page_id") % 12 + 1).cast("string"), 2, "0"), F.lit("-07</span> <em class='unit'>第"), F.col("page_id").cast("string"), F.lit("教务处</em> <a href='/f/"), F.col("page_id").cast("string"), F.lit(".PDF?v=2'>x</a><a href='/f/b.docx'>y</a><a href='/f/b.docx'>again</a>"))
    p = table(spark, sf, "pages").withColumn("html", F.replace("html", F.lit("</h1>"), when))
    p = p.withColumn("template_id", F.lit("all")).unionByName(p.where("page_id % 5 = 0").withColumn("template_id", F.lit("none")))
    rule = F.when(F.col("template_id") == "all", F.create_map(*[F.lit(x) for pair in {"title": "h1", "date": "span.when", "department": "em.unit", "body": "article", "attachment": "a"}.items() for x in pair])).otherwise(F.create_map(F.lit("title"), F.lit("h1.none"), F.lit("body"), F.lit("section")))
    own = dom.extract_fields(p, p.select("template_id").distinct().withColumn("rules", rule), ["page_id"])
    unknown = F.when(F.size("unknown") == 0, "none").otherwise(F.array_join("unknown", ","))
    return own.select("page_id", "title", "date", "department", F.sha2("body", 256).alias("body"), F.array_join("attachments", ",").alias("attachments"), unknown.alias("unknown"))


@query("html_nav", f"with {LINKS}, a as (select page_id, url, unnest(regexp_extract_all(html, '<li><a href=\"[^\"]*\">([^<]*)</a></li>', 1)) as name, unnest(regexp_extract_all(html, '<li><a href=\"([^\"]*)\">[^<]*</a></li>', 1)) as href from pages) select page_id, {ORIGIN} || href as target, name, 0 as depth, count(*) as n from a group by all")
def _(spark, sf):
    # the test pages' navigation has neither class nor id, so it gets one
    marked = table(spark, sf, "pages").withColumn("html", F.replace("html", F.lit("<nav>"), F.lit("<nav class='nav'>")))
    return dom.navigation_links(marked, ["page_id", "url"]).groupBy("page_id", "target", "name", F.col("depth").cast("int").alias("depth")).agg(F.count("*").alias("n"))


# --- links ---


@query("flt_links", f"with {LINKS}, {FIRST} select url, target from firsts where not regexp_matches(target, '/the$')")
def _(spark, sf):
    return links.filter_links(page_links(spark, sf), deny=["/the$"]).select("url", "target")


@query("flt_content", f"with {LINKS}, noisy as (select *, regexp_matches(href, '^/[a-m]') as noisy from links) select page_id, url, href, pos from noisy qualify not noisy or bool_and(noisy) over (partition by url)")
def _(spark, sf):
    own = page_links(spark, sf).withColumn("noisy", F.col("href").rlike("^/[a-m]"))
    return links.content_links(own).select("page_id", "url", "href", F.col("pos").cast("long"))


@query("win_rank_shape", f"with {LINKS}, shaped as (select page_id, pos, target, {TARGET_SHAPE} as shape from links), sized as (select *, count(*) over (partition by page_id, shape) as n, min(pos) over (partition by page_id, shape) as first_pos from shaped) select page_id, pos, row_number() over (partition by page_id order by n desc, first_pos, pos) as rank from sized")
def _(spark, sf):
    own = page_links(spark, sf).withColumn("url", F.col("page_id"))
    return links.rank_links(own).select("page_id", F.col("pos").cast("long"), F.col("rank").cast("long"))


@query("win_sample", f"with {LINKS}, once as (select {ORIGIN} as site, target, page_id, pos from links qualify row_number() over (partition by {ORIGIN}, target order by page_id, pos) = 1) select site, target, row_number() over (partition by site order by page_id, pos) as sample_no from once qualify sample_no <= 20")
def _(spark, sf):
    own = page_links(spark, sf).select(urls.origin_of(F.col("url")).alias("site"), F.col("page_id").alias("entry_seq"), F.col("pos").alias("rank"), "target")
    return links.sample_pages(own).select("site", "target", F.col("sample_no").cast("long"))


@query("win_quota", f"with {SITE_PAGES}, have as (select site, shape, count(*) as n from site_pages where page_id % 5 = 0 group by all) select page_id from site_pages left join have using (site, shape) where page_id % 5 <> 0 qualify row_number() over (partition by site, shape order by page_id) + coalesce(n, 0) <= 3")
def _(spark, sf):
    p = site_pages(spark, sf).drop("html")
    have = p.where("page_id % 5 = 0").groupBy("site", "shape").agg(F.count("*").alias("samples"))
    return links.plan_samples(p.where("page_id % 5 <> 0"), have).select("page_id")


@query("win_budget", f"with {SITE_PAGES}, cols as (select site, col, min(page_id) as seq, count(*) as cost from site_pages group by all) select site, col as \"column\", (sum(cost) over (partition by site order by seq))::bigint as spent, sum(cost) over (partition by site order by seq) <= 4 as probed from cols")
def _(spark, sf):
    cols = site_pages(spark, sf).groupBy("site", "column").agg(F.min("seq").alias("seq"), F.count("*").alias("cost"))
    return links.apply_budget(cols, 4).select("site", "column", "spent", "probed")


@query("flt_columns", f"with {LINKS} select page_id, target from links where {PATH.format('target')} not in ('', '/') and not (string_split({PATH.format('url')}, '/')[-1] <> '' and string_split({PATH.format('target')}, '/')[-1] = string_split({PATH.format('url')}, '/')[-1]) group by all")
def _(spark, sf):
    own = page_links(spark, sf).select(F.col("page_id").alias("site"), F.col("url").alias("base_url"), "pos", "target")
    return links.column_candidates(own).select(F.col("site").alias("page_id"), "target")


FRONTIER = f"with {LINKS}, {SITE_PAGES}, fetched as (select url as target from pages union all select target from links where page_id % 3 = 0), good as (select target from links where not regexp_matches(target, '/[A-Z]')) select distinct {ORIGIN} as site, target from links where target not in (select target from fetched) and target in (select target from good)"


@query("crawl_frontier", FRONTIER)
def _(spark, sf):
    own = page_links(spark, sf).withColumn("site", urls.origin_of(F.col("url")))
    fetched = table(spark, sf, "pages").select(F.col("url").alias("target")).union(own.where("page_id % 3 = 0").select("target"))
    return links.next_frontier(own, fetched, own.where(~F.col("target").rlike("/[A-Z]"))).select("site", "target")


@query("crawl_frontier_waves", FRONTIER)
def _(spark, sf):
    """The same against a table of seen URLs in buckets, to which two waves have been added."""
    seen = f"seen_{uuid.uuid4().hex}"
    own = page_links(spark, sf).withColumn("site", urls.origin_of(F.col("url")))
    where, buckets = f"{shared_folder(spark).rstrip('/')}/{seen}", max(16, int(spark.conf.get("spark.sql.shuffle.partitions")))
    links.remember(table(spark, sf, "pages").select(F.col("url").alias("target")), seen, buckets, where)
    links.remember(own.where("page_id % 3 = 0").join(spark.table(seen), "target", "left_anti"), seen, buckets)
    return links.next_frontier(own, spark.table(seen), own.where(~F.col("target").rlike("/[A-Z]"))).select("site", "target")


@query("crawl_frontier_paging", f"with {PAGED}, l as (select {ORIGIN} as site, {ORIGIN} || left({PATH.format('url')}, length({PATH.format('url')}) - length(string_split({PATH.format('url')}, '/')[-1])) || 'list' || p || '.htm' as target, p from pages join paged using (page_id), lateral (select unnest([2, last]) as p)) select distinct site, target from l where p <= 20 and target not in (select url from pages)")
def _(spark, sf):
    """Further pages of lists, up to the twentieth of a list."""
    p = paged(spark, sf)
    own = dom.extract_links(p, ["page_id", "url"]).withColumns({"site": urls.origin_of(F.col("url")), "paging": F.col("href").rlike("^list[0-9]+[.]htm$")})
    return links.next_frontier(own.where("paging"), p.select(F.col("url").alias("target")), own, max_pages=20).select("site", "target")


@query("flt_scope", f"with {SITE_PAGES} select page_id from site_pages where col in ('en', 'fr') and length(site) % 2 = 0 and shape not like '%.html'")
def _(spark, sf):
    p = site_pages(spark, sf).withColumn("template_id", F.col("shape")).drop("html")
    cols = p.where("column in ('en', 'fr') and length(site) % 2 = 0").select("site", "column").distinct()
    tpls = p.where("shape not like '%.html'").select("site", "template_id").distinct()
    return links.in_scope(p, cols, tpls).select("page_id")


@query("set_scope", f"with {SITE_PAGES} select site, shape from site_pages where col = 'en' intersect select site, shape from site_pages where page_id % 2 = 0")
def _(spark, sf):
    p = site_pages(spark, sf)
    return p.where("column = 'en'").select("site", "shape").intersect(p.where("page_id % 2 = 0").select("site", "shape"))


# --- templates ---

FP = "list_sort(list_distinct(list_transform(regexp_extract_all(html, '<([a-z][a-z0-9]*)[ >]', 1), lambda t: case when t = 'div' then 'div.ad' else t end)))"
PRINTS = f"prints as (select page_id, url, site, shape, col, {FP} as fp from site_pages)"


@query("agg_fingerprint", f"with {SITE_PAGES}, {PRINTS} select page_id, array_to_string(fp, ' ') as fingerprint from prints")
def _(spark, sf):
    own = templates.fingerprints(dom.explode_elements(table(spark, sf, "pages"), ["page_id"]), ["page_id"])
    return own.select("page_id", F.array_join("fingerprint", " ").alias("fingerprint"))


def printed(spark, sf):
    p = site_pages(spark, sf)
    return dom.page_structure(p, [c for c in p.columns if c != "html"])


TEMPLATE_ID = "substr(sha256(shape || chr(0) || array_to_string(fp, chr(0))), 1, 12)"


@query("agg_template_id", f"with {SITE_PAGES}, {PRINTS} select page_id, {TEMPLATE_ID} as template_id from prints")
def _(spark, sf):
    return printed(spark, sf).select("page_id", templates.template_id(F.col("shape"), F.col("fingerprint")).alias("template_id"))


TEMPLATES = f"with {SITE_PAGES}, {PRINTS} select site, {TEMPLATE_ID} as template_id, shape as url_shape, count(*) as page_count, arg_min(url, page_id) as first_url, list_sort(list_distinct(list(col)))[1] as least_column from prints group by site, shape, fp"


def templates_of(own):
    return own.select("site", "template_id", "url_shape", "page_count", F.element_at("sample_urls", 1).alias("first_url"), F.array_min("columns").alias("least_column"))


@query("agg_templates", TEMPLATES)
def _(spark, sf):
    return templates_of(templates.cluster_templates(printed(spark, sf)))


@query("agg_templates_exact", TEMPLATES)
def _(spark, sf):
    return templates_of(templates.cluster_templates(printed(spark, sf), exact=True))


@query("agg_template_rec", f"with {SITE_PAGES}, {PRINTS}, t as (select site, shape, {TEMPLATE_ID} as template_id, col, min(page_id) as p, count(*) as n from prints group by all) select site, template_id, sum(n)::bigint as page_count, string_agg(col, ',' order by p) as columns from t group by site, shape, template_id")
def _(spark, sf):
    return templates.cluster_templates(printed(spark, sf)).select("site", "template_id", "page_count", F.array_join("columns", ",").alias("columns"))


@query("tpl_attach", f"with {SITE_PAGES}, {PRINTS} select site, {TEMPLATE_ID} as template_id, col as \"column\", count(*) as pages from prints group by all")
def _(spark, sf):
    return templates.template_columns(templates.assign_templates(printed(spark, sf)))


USER_PRINTS = "prints as (select user_id, (user_id % 20)::varchar as site, list_sort(list_distinct(list(event_type || (event_id % 7)))) as fp from events group by all)"


@query("tpl_similar", f"with {USER_PRINTS}, few as (select site, fp, count(*) as pages from prints group by all), pairs as (select a.site, array_to_string(a.fp, chr(1)) as a, array_to_string(b.fp, chr(1)) as b, len(list_intersect(a.fp, b.fp)) / len(list_distinct(list_concat(a.fp, b.fp))) as similarity from few a join few b on a.site = b.site and array_to_string(a.fp, chr(1)) < array_to_string(b.fp, chr(1))) select site, sha256(a) as a, sha256(b) as b, round(similarity, 6) as similarity from pairs where similarity >= 0.7")
def _(spark, sf):
    e = table(spark, sf, "events")
    token = F.concat("event_type", (F.col("event_id") % 7).cast("string"))
    fps = e.groupBy("user_id").agg(F.array_sort(F.collect_set(token)).alias("fingerprint")).select((F.col("user_id") % 20).cast("string").alias("site"), F.lit("/").alias("shape"), "fingerprint")
    own = templates.similar_fingerprints(fps, name=lambda c: F.sha2(F.array_join(c, "\1"), 256))
    return own.select("site", "a", "b", F.round("similarity", 6).alias("similarity"))


@query("set_fp_ops", f"with {USER_PRINTS}, p as (select a.user_id, a.fp as x, b.fp as y from prints a join prints b on b.user_id = a.user_id + 1) select user_id, round(len(list_intersect(x, y)) / len(list_distinct(list_concat(x, y))), 6) as jaccard, len(list_intersect(x, y))::bigint as common from p")
def _(spark, sf):
    token = F.concat("event_type", (F.col("event_id") % 7).cast("string"))
    a = table(spark, sf, "events").groupBy("user_id").agg(F.collect_set(token).alias("x"))
    b = a.select((F.col("user_id") - 1).alias("user_id"), F.col("x").alias("y"))
    return a.join(b, "user_id").select("user_id", F.round(templates.jaccard(F.col("x"), F.col("y")), 6).alias("jaccard"), F.size(F.array_intersect("x", "y")).cast("long").alias("common"))


# --- columns, types, sizes ---


@query("agg_columns_shape", f"with {LINKS} select page_id, arg_min(target, pos) as url, '未知' as name from links where {PATH.format('target')} not in ('', '/') and not (string_split({PATH.format('url')}, '/')[-1] <> '' and string_split({PATH.format('target')}, '/')[-1] = string_split({PATH.format('url')}, '/')[-1]) group by page_id, {TARGET_SHAPE}")
def _(spark, sf):
    p = table(spark, sf, "pages").withColumn("site", F.col("page_id"))
    own = page_links(spark, sf).select(F.col("page_id").alias("site"), F.col("url").alias("base_url"), "pos", "target")
    return columns.discover_columns(p, own).select(F.col("site").alias("page_id"), "url", "name")


@query("agg_sitemap_cols", f"with {SITE_PAGES} select site, count(distinct shape) as columns from site_pages where {PATH.format('url')} not in ('', '/') group by site")
def _(spark, sf):
    return columns.columns_from_sitemap(sitemap_rows(spark, sf)).groupBy("site").agg(F.count("*").alias("columns"))


#: a sitemap file holds so many addresses at most
SITEMAP_URLS = 50_000


def sitemap_rows(spark, sf):
    """The pages of each site written as sitemap files (pages of 50,000 neighbouring ids each) and read back; positions go on from file to file."""
    p = site_pages(spark, sf).withColumn("file", F.floor(F.col("page_id") / SITEMAP_URLS))
    loc = F.concat(F.lit("<url><loc> "), F.replace("url", F.lit("&"), F.lit("&amp;")), F.lit("</loc></url>"))
    xml = F.concat(F.lit('<?xml version="1.0"?><urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">'), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_id", loc.alias("l")))), lambda x: x["l"]), "\n"), F.lit("</urlset>"))
    first = Window.partitionBy("site").orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    files = p.groupBy("site", "file").agg(xml.alias("xml"), F.concat(F.min(urls.origin_of(F.col("url"))), F.lit("/")).alias("base_url"), F.count("*").alias("n"))
    had = p.groupBy("site", "file").agg(F.count("*").alias("n")).withColumn("had", F.coalesce(F.sum("n").over(first), F.lit(0))).select(F.struct("site", "file").alias("site"), "had")
    own = sources.read_sitemaps(files.select(F.struct("site", "file").alias("site"), "xml", "base_url"))
    return own.join(had, "site").withColumn("pos", F.col("pos") + F.col("had")).withColumn("site", F.col("site.site")).drop("had")


@query("src_sitemap", f"with {SITE_PAGES} select site, url as target, row_number() over (partition by site order by page_id) - 1 as pos, false as is_index from site_pages")
def _(spark, sf):
    return sitemap_rows(spark, sf).select("site", "target", F.col("pos").cast("long"), "is_index")


@query("col_parents", "with n as (select n_regionkey as site, n_name as url, lag(n_name) over (order by n_nationkey) as parent from nation) select site, url, case when parent in (select url from n m where m.site = n.site) and parent <> url then parent end as parent_url from n")
def _(spark, sf):
    n = table(spark, sf, "nation")
    up = n.select((F.col("n_nationkey") + 1).alias("n_nationkey"), F.col("n_name").alias("parent_url"))
    return columns.resolve_parents(n.join(up, "n_nationkey", "left").select(F.col("n_regionkey").alias("site"), F.col("n_name").alias("url"), "parent_url"))


REGION_OF = "case (user_id + event_id % 2) % 4 when 0 then 'article_list' when 1 then 'article_body' when 2 then 'pagination' else 'footer' end"


@query("agg_page_type", f"with r as (select user_id % 300 as url, {REGION_OF} as type, (event_id % 10) / 10.0 as confidence from events), o as (select url, max(confidence) filter (type = 'article_list') as l, max(confidence) filter (type = 'article_body') as b, count(*) filter (type = 'pagination') > 0 as p from r group by url) select url, case when l is not null then 'list' when b > 0 then 'single' else 'unknown' end as type, round(case when l is not null then least(0.6 + case when p then 0.3 else 0 end + 0.1 * l, 1) when b > 0 then 0.5 + 0.5 * b else 0 end, 1)::double as confidence, p as has_pagination from o")
def _(spark, sf):
    e = table(spark, sf, "events")
    regions = e.select((F.col("user_id") % 300).alias("url"), F.expr(REGION_OF).alias("type"), ((F.col("event_id") % 10) / 10.0).alias("confidence"))
    return columns.classify_pages(regions).select("url", "type", F.round("confidence", 1).alias("confidence"), "has_pagination")


@query("agg_size", """
with d as (select doc_id, n_chars, ['总共 ' || n_chars || ' 记录 页码 1/' || (n_chars % 90 + 1), '1 / ' || (n_chars % 90 + 1) || ' 页', '共 ' || (n_chars % 90 + 1) || ' 页', '', '下一页'][(doc_id % 5 + 1)::int] as t from documents)
select doc_id, case doc_id % 5 when 0 then n_chars when 1 then (n_chars % 90 + 1) * 10 when 2 then n_chars % 90 + 1 when 4 then case when n_chars % 50 > 1 then n_chars % 50 * 10 end end as items,
  case doc_id % 5 when 0 then n_chars % 90 + 1 when 1 then n_chars % 90 + 1 when 2 then n_chars % 90 + 1 when 4 then case when n_chars % 50 > 1 then n_chars % 50 end end as pages,
  case doc_id % 5 when 0 then '条数文本' when 1 then '页数文本' when 2 then '条数文本' when 4 then case when n_chars % 50 > 1 then '分页链接' else '未知' end else '未知' end as method from d
""")
def _(spark, sf):
    d, n = table(spark, sf, "documents"), F.col("n_chars").cast("string")
    m = (F.col("n_chars") % 90 + 1).cast("string")
    paging = F.element_at(F.array(F.concat(F.lit("总共 "), n, F.lit(" 记录 页码 1/"), m), F.concat(F.lit("1 / "), m, F.lit(" 页")), F.concat(F.lit("共 "), m, F.lit(" 页")), F.lit(""), F.lit("下一页")), (F.col("doc_id") % 5 + 1).cast("int"))
    own = d.select("doc_id", paging.alias("paging_text"), F.array(F.lit("/a/list.htm"), F.concat(F.lit("/a/list"), (F.col("n_chars") % 50).cast("string"), F.lit(".htm"))).alias("hrefs"), F.lit(10).alias("entries"))
    return columns.estimate_sizes(own).select("doc_id", "items", "pages", "method")


@query("agg_last_page", "with seen as (select user_id as col, event_id % 12 + 1 as page, max(case when value > 20 then 1 else 0 end) as ok from events group by all), gap as (select col, min(page) as gap from seen where ok = 0 group by col), last as (select s.col, max(page) as last from seen s left join gap using (col) where ok = 1 and (gap is null or page < gap) group by s.col) select distinct seen.col as \"column\", coalesce(last, 0) as last_page, coalesce(gap <> coalesce(last, 0) + 1, true) as lower_bound from seen left join gap using (col) left join last using (col)")
def _(spark, sf):
    e = table(spark, sf, "events")
    return columns.last_pages(e.select(F.col("user_id").alias("column"), (F.col("event_id") % 12 + 1).alias("page"), (F.col("value") > 20).alias("exists")))


@query("col_confidence", "with r as (select user_id % 40 as template_id, max((event_id % 4 = 1 and user_id % 3 > 0)::int) as b, max((event_id % 4 = 2 and event_id % 10 >= 5 and user_id % 7 > 2)::int) as m, max((event_id % 97 = 3)::int) as a from events group by all), c as (select t % 9 as col, max(b) + max(m) + max(a) as n from (select distinct user_id % 60 as t from events) left join r on template_id = t group by t % 9) select col as \"column\", coalesce(n, 0)::int as recognised, case when n = 3 then 'high' when n > 0 then 'medium' else 'low' end as confidence from c")
def _(spark, sf):
    e = table(spark, sf, "events")
    kinds = F.explode(F.filter(F.array(F.when(F.expr("event_id % 4 = 1 and user_id % 3 > 0"), F.struct(F.lit("article_body").alias("type"), F.lit(0.9).alias("c"))), F.when(F.expr("event_id % 4 = 2 and user_id % 7 > 2"), F.struct(F.lit("article_meta").alias("type"), ((F.col("event_id") % 10) / 10).alias("c"))), F.when(F.col("event_id") % 97 == 3, F.struct(F.lit("attachment").alias("type"), F.lit(0.5).alias("c")))), lambda x: x.isNotNull()))
    regions = e.select((F.col("user_id") % 40).alias("template_id"), kinds.alias("k")).select("template_id", "k.type", F.col("k.c").alias("confidence"))
    bridge = e.select((F.col("user_id") % 60).alias("template_id")).distinct().select(F.lit(0).alias("site"), (F.col("template_id") % 9).alias("column"), "template_id")
    return columns.field_confidence(regions, bridge).select("column", "recognised", "confidence")


# --- robots ---

AGENT = "QuarryBot/1.0 (+mailto:ops@example.org)"


def robots_texts(spark, sf):
    hosts = table(spark, sf, "pages").select(urls.origin_of(F.col("url")).alias("origin")).distinct()
    n = F.length("origin")
    text_ = F.concat(F.lit("# rules\nUser-agent: other\nUser-Agent: quarry\nDisallow: /en/\nAllow: /en/*.html$\nDisallow: /*?page=2\nCrawl-delay: "), (n % 4).cast("string"), F.lit("\nDisallow:\n\nUser-agent: *\nDisallow: /\nCrawl-delay: soon\n"))
    return hosts.select("origin", text_.alias("text"))


HOSTS = f"hosts as (select distinct {ORIGIN} as origin from pages)"


@query("robots_parse", f"with {HOSTS}, r(agent, allow, path) as (values ('other', null, null), ('quarry', null, null), ('other', false, '/en/'), ('quarry', false, '/en/'), ('other', true, '/en/*.html$'), ('quarry', true, '/en/*.html$'), ('other', false, '/*?page=2'), ('quarry', false, '/*?page=2'), ('other', null, null), ('quarry', null, null), ('*', null, null), ('*', false, '/')) select origin, agent, allow::varchar as allow, path, count(*) as n from hosts, r group by all")
def _(spark, sf):
    return robots.parse_robots(robots_texts(spark, sf)).groupBy("origin", "agent", F.col("allow").cast("string").alias("allow"), "path").agg(F.count("*").alias("n"))


ROBOTS = f"""
asked as (select distinct url, {ORIGIN} as origin, coalesce(nullif({PATH.format('url')}, ''), '/') || case when regexp_extract(url, '^[^?#]*\\?([^#]*)', 1) <> '' then '?' || regexp_extract(url, '^[^?#]*\\?([^#]*)', 1) else '' end as p from pages),
hit as (select url, origin, case when regexp_matches(p, '^/en/.*\\.html$') then null when regexp_matches(p, '^/.*\\?page=2') then '/*?page=2' when regexp_matches(p, '^/en/') then '/en/' end as rule from asked)"""


@query("robots_check", f"with {ROBOTS} select page_id, rule is null as allowed, 'Disallow: ' || rule as rule, case when rule is not null then 'robots' end as reason from pages join hit using (url)")
def _(spark, sf):
    rows = robots.parse_robots(robots_texts(spark, sf))
    return robots.check_robots(table(spark, sf, "pages").select("page_id", "url"), rows, AGENT).select("page_id", "allowed", "rule", "reason")


@query("robots_fail_closed", f"with {ROBOTS} select page_id, case when length(origin) % 5 = 0 then false when length(origin) % 5 = 1 then true else rule is null end as allowed, origin || '/robots.txt' as robots_url, case when length(origin) % 5 = 0 then '无法获取 robots.txt，按禁止处理' when length(origin) % 5 > 1 and rule is not null then 'robots' end as reason from pages join hit using (url)")
def _(spark, sf):
    texts = robots_texts(spark, sf)
    n = F.length("origin") % 5
    status = texts.select("origin", F.when(n == 0, 503).when(n == 1, 404).otherwise(200).alias("status"))
    return robots.check_robots(table(spark, sf, "pages").select("page_id", "url"), robots.parse_robots(texts), AGENT, status).select("page_id", "allowed", "robots_url", "reason")


@query("robots_delay", f"with {HOSTS} select origin, (length(origin) % 4)::double as crawl_delay from hosts")
def _(spark, sf):
    return robots.crawl_delays(robots.parse_robots(robots_texts(spark, sf)), AGENT)


REQUESTS = "requests as (select user_id as origin, epoch_us(ts) / 1e6 as t, event_id as seq from events)"


def requests(spark, sf):
    e = table(spark, sf, "events")
    return e.select(F.col("user_id").alias("origin"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("at"), F.col("event_id").alias("seq"), "event_type", "value")


@query("win_throttle", f"with {REQUESTS}, n as (select *, (row_number() over (partition by origin order by t, seq) - 1) * 36000.0::double as i from requests) select seq, round(i + max(t - i) over (partition by origin order by t, seq rows unbounded preceding) - t, 3) as delay from n")
def _(spark, sf):
    return robots.schedule_requests(requests(spark, sf), 36000.0).select("seq", F.round("delay", 3).alias("delay"))


@query("win_rate_audit", f"with {REQUESTS}, g as (select origin, seq, t - lag(t) over (partition by origin order by t, seq) as gap from requests) select origin, seq, round(gap, 3) as gap from g where gap < 3600")
def _(spark, sf):
    return robots.rate_violations(requests(spark, sf), 3600.0).select("origin", "seq", F.round("gap", 3).alias("gap"))


@query("win_concurrency", f"with {REQUESTS}, e as (select origin, t as moment, 1 as step from requests union all select origin, t + 7200, -1 from requests), s as (select origin, moment, sum(step) as step from e group by all), r as (select origin, moment, sum(step) over (partition by origin order by moment) as running from s) select origin, round(moment, 3) as moment, running::bigint as running from r where running > 2")
def _(spark, sf):
    log = requests(spark, sf).withColumn("until", F.col("at") + 7200)
    return robots.concurrency(log, 2).select("origin", F.round("moment", 3).alias("moment"), "running")


@query("agg_fetch_outcome", "with a as (select user_id as url, event_id as attempt, case event_type when 'error' then 503 else case when event_id % 9 = 0 then 404 else 200 end end as status from events), l as (select url, count(*) as attempts, arg_max(status, attempt) as last_status from a group by url) select url, attempts, last_status, case when last_status < 400 then 'ok' when last_status >= 500 and attempts > 3 then 'gave_up' else 'failed' end as outcome from l")
def _(spark, sf):
    e = table(spark, sf, "events")
    status = F.when(F.col("event_type") == "error", 503).when(F.col("event_id") % 9 == 0, 404).otherwise(200)
    return robots.fetch_outcomes(e.select(F.col("user_id").alias("url"), F.col("event_id").alias("attempt"), status.alias("status")))


# --- versions of a crawl ---

HASHES = "old as (select page_id, sha256(html) as h from pages where page_id % 10 <> 1), new as (select page_id, sha256(html || case when page_id % 7 = 0 then '!' else '' end) as h from pages where page_id % 10 <> 2), diff as (select coalesce(old.page_id, new.page_id) as page_id, case when old.h is null then 'new' when new.h is null then 'removed' when old.h <> new.h then 'changed' else 'unchanged' end as status from old full join new on old.page_id = new.page_id)"


def snapshots(spark, sf):
    p = table(spark, sf, "pages")
    old = p.where("page_id % 10 <> 1").select("page_id", F.sha2("html", 256).alias("content_hash"))
    new = p.where("page_id % 10 <> 2").select("page_id", F.sha2(F.concat("html", F.when(F.col("page_id") % 7 == 0, "!").otherwise("")), 256).alias("content_hash"))
    return old, new


@query("crawl_diff", f"with {HASHES} select page_id, status, status in ('new', 'changed') as reprocess from diff")
def _(spark, sf):
    return crawl.diff_snapshots(*snapshots(spark, sf), ["page_id"])


@query("agg_crawl_summary", f"with {HASHES} select status, count(*) as n from diff group by status union all select 'failed', count(*) from (select user_id from events group by user_id having arg_max(event_type, event_id) = 'error') union all select 'skipped', count(*) from pages where regexp_matches(url, '[0-9]$')")
def _(spark, sf):
    e = table(spark, sf, "events")
    failed = robots.fetch_outcomes(e.select(F.col("user_id").alias("url"), F.col("event_id").alias("attempt"), F.when(F.col("event_type") == "error", 503).otherwise(200).alias("status"))).where("outcome <> 'ok'")
    skipped = table(spark, sf, "pages").where(F.col("url").rlike("[0-9]$"))
    return crawl.crawl_summary(crawl.diff_snapshots(*snapshots(spark, sf), ["page_id"]), failed, skipped)


@query("set_removed", f"with {HASHES} select page_id from old where page_id not in (select page_id from new)")
def _(spark, sf):
    return crawl.removed_sources(*snapshots(spark, sf), ["page_id"])


@query("kb_delete", "select doc_id from documents where source not in ('src1', 'src2')")
def _(spark, sf):
    d = table(spark, sf, "documents")
    return crawl.delete_sources(d, d.where("source in ('src1', 'src2')").select("source").distinct(), ["source"]).select("doc_id")


@query("struct_diff", f"""
with {SITE_PAGES}, cols as (select site, col as url, count(*) as items from site_pages group by all),
a as (select * from cols where length(site || url) % 5 <> 0), b as (select site, url, items + case when length(url || site) % 3 = 0 then 1 else 0 end as items from cols where length(site || url) % 5 <> 1),
d as (select coalesce(a.site, b.site) as site, case when a.items is null then '+' when b.items is null then '-' when a.items <> b.items then '~' end as mark, coalesce(a.url, b.url) as what from a full join b on a.site = b.site and a.url = b.url),
t as (select distinct site, shape from site_pages where length(shape) % 2 = 0),
every as (select site, mark, what from d where mark is not null union all select site, '!', shape from t),
sites as (select site from a union select site from b)
select site, mark, what from every union all select site, '=', 'no change' from sites where site not in (select site from every)
""")
def _(spark, sf):
    p = site_pages(spark, sf).drop("html")
    cols = p.groupBy("site", F.col("column").alias("url")).agg(F.count("*").alias("items"))
    key = F.length(F.concat("site", "url"))
    old = cols.where(key % 5 != 0)
    new = cols.where(key % 5 != 1).withColumn("items", F.col("items") + F.when(key % 3 == 0, 1).otherwise(0))
    shapes = p.select("site", "shape").distinct()
    tpl = lambda odd: shapes.select("site", "shape", F.concat("shape", F.lit(odd)).alias("template_id"), F.array(F.lit("a"), F.lit(odd)).alias("fingerprint"))
    t_old = tpl("x")
    t_new = tpl("x").where(F.length("shape") % 2 != 0).union(tpl("y").where(F.length("shape") % 2 == 0))
    return crawl.diff_structures(old, new, t_old, t_new).select("site", "mark", "what")


@query("att_link", f"with {LINKS} select page_id, target as attachment_url, case when length(target) % 4 = 0 then 'too_large' when length(target) % 3 > 0 then 'downloaded' else 'failed' end as status, count(*) as n from links group by all")
def _(spark, sf):
    own = page_links(spark, sf)
    downloads = own.select(F.col("target").alias("attachment_url")).distinct().select("attachment_url", F.when(F.length("attachment_url") % 4 == 0, 10**9).otherwise(10**6).alias("bytes"), (F.length("attachment_url") % 3 > 0).alias("ok"))
    pages = own.groupBy("page_id").agg(F.collect_list(F.struct(F.col("anchor").alias("name"), F.col("target").alias("url"))).alias("attachments")).withColumnRenamed("page_id", "url")
    return crawl.link_attachments(pages, downloads).groupBy(F.col("url").alias("page_id"), "attachment_url", "status").agg(F.count("*").alias("n"))


# --- extraction rules ---

HITS = "hits as (select user_id % 8 as template_id, ['body', 'title', 'date'][(event_id % (1 + user_id % 8 % 3) + 1)::int] as field, 'div.c' || (event_id % 17) as selector, user_id as url from events), pages_ as (select user_id % 8 as template_id, count(distinct user_id) as samples from events group by all), rate as (select template_id, field, selector, count(distinct url) as hits, any_value(samples) as samples from hits join pages_ using (template_id) group by all), ranked as (select *, row_number() over (partition by template_id, field order by hits desc, length(selector) desc, selector) as rank from rate)"


def hits_and_pages(spark, sf):
    e = table(spark, sf, "events")
    field = F.element_at(F.array(*[F.lit(x) for x in ("body", "title", "date")]), F.expr("int(event_id % (1 + user_id % 8 % 3) + 1)"))
    hits = e.select((F.col("user_id") % 8).alias("template_id"), field.alias("field"), F.concat(F.lit("div.c"), (F.col("event_id") % 17).cast("string")).alias("selector"), F.col("user_id").alias("url"))
    return hits, e.select((F.col("user_id") % 8).alias("template_id"), F.col("user_id").alias("url"))


@query("agg_selector_rate", f"with {HITS} select template_id, field, selector, hits, samples, round(hits / samples, 6) as hit_rate from rate")
def _(spark, sf):
    return rules.infer_selectors(*hits_and_pages(spark, sf)).select("template_id", "field", "selector", "hits", "samples", F.round("hit_rate", 6).alias("hit_rate"))


@query("win_selector_top", f"with {HITS} select template_id, field, selector, rank from ranked where rank <= 5")
def _(spark, sf):
    return rules.infer_selectors(*hits_and_pages(spark, sf)).where("rank <= 5").select("template_id", "field", "selector", F.col("rank").cast("long"))


@query("field_missing", f"with {HITS}, f(field) as (values ('body'), ('title'), ('date'), ('department'), ('attachment')) select template_id, field from pages_, f where (template_id, field) not in (select (template_id, field) from rate)")
def _(spark, sf):
    hits, pages = hits_and_pages(spark, sf)
    return rules.missing_fields(hits, pages.select("template_id").distinct()).select("template_id", "field")


def drafts(spark, sf):
    hits, pages = hits_and_pages(spark, sf)
    known = pages.groupBy("template_id").agg(F.countDistinct("url").alias("samples"))
    fields = rules.draft_fields(rules.infer_selectors(hits, pages), known)
    sites = known.select("template_id", F.concat(F.lit("site "), F.col("template_id").cast("string")).alias("name"), F.array(F.lit("http://a.example/it's")).alias("entry_urls"), F.lit("ops").alias("contact"), "samples")
    return fields, sites


@query("win_draft", f"with {HITS}, f(field) as (values ('body'), ('title'), ('date'), ('department'), ('attachment')), b as (select template_id, field, selector, hits / samples as r from ranked where rank = 1) select template_id, field, coalesce(selector, case when field in ('body', 'title') then 'TODO:需人工指定' end) as selector, selector is null as needs_manual, coalesce(r < 0.6, false) as low_confidence from (select template_id, field from pages_, f) left join b using (template_id, field)")
def _(spark, sf):
    return drafts(spark, sf)[0].select("template_id", "field", "selector", "needs_manual", "low_confidence")


@query("win_draft_yaml")
def _(spark, sf):
    return rules.build_drafts(*drafts(spark, sf))
