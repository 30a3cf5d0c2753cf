"""Versions of a crawl or a structure: what is new, changed, gone; attachments; summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .templates import jaccard


def diff_snapshots(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, status, reprocess) by content_hash: new, changed, unchanged or removed. Only hashes are compared."""
    a, b = (x.select(*keys, F.col("content_hash").alias(n)) for x, n in ((old, "_old"), (new, "_new")))
    status = F.when(F.col("_old").isNull(), "new").when(F.col("_new").isNull(), "removed").when(F.col("_old") != F.col("_new"), "changed").otherwise("unchanged")
    return a.join(b, keys, "full_outer").select(*keys, status.alias("status")).withColumn("reprocess", F.col("status").isin("new", "changed"))


def crawl_summary(diff: DataFrame, failed: DataFrame | None = None, skipped: DataFrame | None = None, attachments: DataFrame | None = None) -> DataFrame:
    """(status, n) of a run: pages by what became of them, those that failed or were skipped, attachments by status."""
    out = diff.groupBy("status").agg(F.count("*").alias("n"))
    for name, rows in (("failed", failed), ("skipped", skipped)):
        if rows is not None:
            out = out.unionByName(rows.agg(F.count("*").alias("n")).select(F.lit(name).alias("status"), "n"))
    if attachments is not None:
        out = out.unionByName(attachments.where("status is not null").groupBy(F.concat(F.lit("attachment "), "status").alias("status")).agg(F.count("*").alias("n")))
    return out


def removed_sources(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Sources of the last import that aren't there now: listed, not deleted."""
    return old.select(keys).distinct().join(new.select(keys), keys, "left_anti")


def delete_sources(kb: DataFrame, sources: DataFrame, keys: list[str]) -> DataFrame:
    return kb.join(sources.select(keys), keys, "left_anti")


def diff_structures(old_columns: DataFrame, new_columns: DataFrame, old_templates: DataFrame, new_templates: DataFrame, threshold: float = 0.7) -> DataFrame:
    """(site, mark, what, before, after): ``+`` new, ``-`` gone, ``~`` another size, ``!`` another template.

    columns (site, url, items); templates (site, shape, template_id, fingerprint). A template has changed if its
    shape has no id in common and its fingerprints are less similar than the threshold. No change is one ``=`` row.
    """
    a, b = (c.select("site", "url", F.col("items").alias(n), F.lit(True).alias(f"_{n}")) for c, n in ((old_columns, "before"), (new_columns, "after")))
    mark = F.when(F.col("_before").isNull(), "+").when(F.col("_after").isNull(), "-").when(~F.col("before").eqNullSafe(F.col("after")), "~")
    columns = a.join(b, ["site", "url"], "full_outer").select("site", mark.alias("mark"), F.col("url").alias("what"), F.col("before").cast("string").alias("before"), F.col("after").cast("string").alias("after")).where("mark is not null")
    old, new = (t.groupBy("site", "shape").agg(F.array_sort(F.collect_set("template_id")).alias(f"{n}_ids"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("fingerprint")))).alias(f"{n}_fp")) for t, n in ((old_templates, "old"), (new_templates, "new")))
    changed = old.join(new, ["site", "shape"]).where(~F.arrays_overlap("old_ids", "new_ids") & (jaccard(F.col("old_fp"), F.col("new_fp")) < threshold))
    out = columns.unionByName(changed.select("site", F.lit("!").alias("mark"), F.col("shape").alias("what"), F.array_join("old_ids", ",").alias("before"), F.array_join("new_ids", ",").alias("after")))
    sites = old_columns.select("site").union(new_columns.select("site")).distinct()
    same = sites.join(out.select("site"), "site", "left_anti").select("site", F.lit("=").alias("mark"), F.lit("no change").alias("what"), F.lit(None).cast("string").alias("before"), F.lit(None).cast("string").alias("after"))
    return out.unionByName(same)


def link_attachments(pages: DataFrame, downloads: DataFrame, max_bytes: int = 50 * 1024 * 1024) -> DataFrame:
    """Pages (url, attachments array<struct<name,url>>) with each attachment's type and status; no page is lost.

    downloads (attachment_url, bytes, ok): downloaded, too_large or failed (also if it was never tried).
    """
    each = pages.select("url", F.explode_outer("attachments").alias("a")).select("url", F.col("a.name").alias("name"), F.col("a.url").alias("attachment_url"))
    status = F.when(F.col("attachment_url").isNull(), None).when(F.col("bytes") > max_bytes, "too_large").when(F.coalesce("ok", F.lit(False)), "downloaded").otherwise("failed")
    kind = F.lower(F.regexp_extract(F.substring_index("attachment_url", "?", 1), r"\.([A-Za-z0-9]+)$", 1))
    return each.join(downloads, "attachment_url", "left").select("url", "name", kind.alias("type"), "attachment_url", status.alias("status"))
