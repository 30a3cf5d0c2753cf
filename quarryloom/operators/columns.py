"""Columns of a site: from its navigation, from link shapes, from its sitemap; page types and sizes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import size_display
from ..functions.urls import page_number, url_shape
from .dom import NAME_UNKNOWN, navigation_links
from .links import column_candidates

LEAST_NAVIGATION = 3
NO_TYPE = "页面既无条目列表，也未能识别出正文区"
# fixed values: how a size was found, and what says it
BY_ITEMS, BY_PAGES, BY_LINKS, BY_PROBE, BY_NOTHING = "条数文本", "页数文本", "分页链接", "试探", "未知"
ITEMS_RE = r"(?:总共|共有|共|总数)\s*[：:]?\s*([0-9]+)\s*(?:条|篇|项|记录|个)?"
RATIO_RE = r"[0-9]+\s*/\s*([0-9]+)\s*页?"
PAGES_RE = r"共\s*([0-9]+)\s*页"

TREE = ["site", "seq", "name", "url", "depth", "parent_url", "needs_manual_name", "source"]


def resolve_parents(columns: DataFrame) -> DataFrame:
    """A parent that is no column of the site, or the column itself, becomes null."""
    known = columns.select("site", F.col("url").alias("parent_url"), F.lit(True).alias("_known")).distinct()
    keep = F.col("_known") & (F.col("parent_url") != F.col("url"))
    return columns.join(known, ["site", "parent_url"], "left").withColumn("parent_url", F.when(keep, F.col("parent_url"))).select(columns.columns)


def columns_by_shape(links: DataFrame, source: str) -> DataFrame:
    """One column per URL shape of (site, pos, target): the first link, its name unknown."""
    first = links.groupBy("site", url_shape(F.col("target")).alias("shape")).agg(F.min(F.struct("pos", "target")).alias("f"))
    return first.select("site", F.col("f.pos").alias("seq"), F.lit(NAME_UNKNOWN).alias("name"), F.col("f.target").alias("url"), F.lit(0).alias("depth"), F.lit(None).cast("string").alias("parent_url"), F.lit(True).alias("needs_manual_name"), F.lit(source).alias("source"))


def discover_columns(homes: DataFrame, links: DataFrame) -> DataFrame:
    """The column tree of each home page (site, url, html): its navigation if that gives three columns at least, else
    one column per shape of its links (site, base_url, pos, target)."""
    nav = navigation_links(homes.withColumn("base_url", F.col("url")), ["site", "base_url"])
    nav = column_candidates(nav).select("site", F.col("pos").alias("seq"), "name", F.col("target").alias("url"), "depth", "parent_url", "needs_manual_name", F.lit("navigation").alias("source"))
    nav = resolve_parents(nav)
    enough = nav.groupBy("site").count().where(F.col("count") >= LEAST_NAVIGATION).select("site")
    rest = columns_by_shape(column_candidates(links), "clustering").join(enough, "site", "left_anti")
    return nav.join(enough, "site", "left_semi").select(TREE).unionByName(rest.select(TREE))


def columns_from_sitemap(locations: DataFrame) -> DataFrame:
    """The same from sitemap locations (site, base_url, pos, target)."""
    return columns_by_shape(column_candidates(locations), "sitemap")


def classify_pages(regions: DataFrame) -> DataFrame:
    """Regions (url, type, confidence) → (url, type, confidence, has_pagination, reason)."""
    of = lambda kind: F.max(F.when(F.col("type") == kind, F.col("confidence")))
    own = regions.groupBy("url").agg(of("article_list").alias("l"), of("article_body").alias("b"), of("pagination").isNotNull().alias("has_pagination"))
    is_list, single = F.col("l").isNotNull(), F.col("b") > 0
    paging = F.when(F.col("has_pagination"), 0.3).otherwise(0.0)
    return own.select(
        "url",
        F.when(is_list, "list").when(single, "single").otherwise("unknown").alias("type"),
        F.when(is_list, F.least(F.round(F.lit(0.6) + paging + 0.1 * F.col("l"), 2), F.lit(1.0))).when(single, F.round(0.5 + 0.5 * F.col("b"), 2)).otherwise(F.lit(0.0)).alias("confidence"),
        "has_pagination",
        F.when(~(is_list | F.coalesce(single, F.lit(False))), NO_TYPE).alias("reason"),
    )


def _number(text: Column, pattern: str) -> Column:
    found = F.regexp_extract(text, pattern, 1)
    return F.when(found != "", found.cast("long"))


def estimate_sizes(pages: DataFrame) -> DataFrame:
    """Adds items, pages, method, display to (paging_text, hrefs array, entries): the first source that speaks counts.

    Item-count text; page ratio or page-count text times entries; the largest page number in a link times entries, if
    there is pagination text; else unknown (null, never 0).
    """
    text, entries = F.coalesce("paging_text", F.lit("")), F.coalesce("entries", F.lit(0))
    items, stated = _number(text, ITEMS_RE), F.coalesce(_number(text, RATIO_RE), _number(text, PAGES_RE))
    linked = F.array_max(F.transform("hrefs", page_number))
    by_pages = (stated > 0) & (entries > 0)
    by_links = (text != "") & (linked > 1) & (entries > 0)
    method = F.when(items.isNotNull(), BY_ITEMS).when(by_pages, BY_PAGES).when(by_links, BY_LINKS).otherwise(BY_NOTHING)
    out = pages.withColumns({
        "items": F.when(items.isNotNull(), items).when(by_pages, stated * entries).when(by_links, linked * entries),
        "pages": F.when(items.isNotNull() | by_pages, stated).when(by_links, linked),
        "method": method,
    })
    return out.withColumn("display", size_display(F.col("items"), F.col("pages"), F.col("method")))


def last_pages(log: DataFrame) -> DataFrame:
    """(column, page, exists) observations → last existing page before the first gap, and whether it is a lower bound.

    Pages count from 1; the end is known if the next page was seen not to exist.
    """
    seen = log.groupBy("column", "page").agg(F.max(F.col("exists").cast("int")).alias("exists"))
    gap = seen.where("exists = 0").groupBy("column").agg(F.min("page").alias("gap"))
    upto = seen.join(gap, "column", "left").where("exists = 1 and (gap is null or page < gap)")
    last = upto.groupBy("column").agg(F.max("page").alias("last"))
    out = seen.select("column").distinct().join(last, "column", "left").join(gap, "column", "left")
    return out.select("column", F.coalesce("last", F.lit(0)).alias("last_page"), F.coalesce(F.col("gap") != F.coalesce("last", F.lit(0)) + 1, F.lit(True)).alias("lower_bound"))


def field_confidence(regions: DataFrame, bridge: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Per column high / medium / low: all, some or none of body, meta and attachment recognised in its templates.

    regions (template_id, type, confidence); bridge (site, column, template_id).
    """
    fields = ["article_body", "article_meta", "attachment"]
    ok = lambda kind: F.max(((F.col("type") == kind) & (F.col("confidence") >= threshold)).cast("int"))
    own = bridge.join(regions, "template_id", "left").groupBy("site", "column").agg(*[F.coalesce(ok(k), F.lit(0)).alias(k) for k in fields])
    n = F.col("article_body") + F.col("article_meta") + F.col("attachment")
    return own.withColumn("recognised", n).withColumn("confidence", F.when(n == 3, "high").when(n > 0, "medium").otherwise("low"))
