"""Links of pages: filters, ranking by URL shape, samples, quotas and budgets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.urls import host_of, is_homepage_like, origin_of, page_number, url_shape


def filter_links(links: DataFrame, allow: Sequence[str] = (), deny: Sequence[str] = ()) -> DataFrame:
    """Links (url, pos, target, noisy) to the page's own origin, not to itself; of equal targets the first."""
    origin = origin_of(F.col("url"))
    keep = F.col("target").isNotNull() & (F.col("target") != F.col("url")) & (F.col("target").startswith(F.concat(origin, F.lit("/"))) | (F.col("target") == origin))
    if allow:
        keep &= F.greatest(*[F.col("target").rlike(p) for p in allow], F.lit(False))
    for p in deny:
        keep &= ~F.col("target").rlike(p)
    first = F.row_number().over(Window.partitionBy("url", "target").orderBy("pos"))
    return links.where(keep).withColumn("_n", first).where("_n = 1").drop("_n")


def content_links(links: DataFrame) -> DataFrame:
    """Links outside structural noise; all of a page's links if it has none such."""
    some = F.max(~F.col("noisy")).over(Window.partitionBy("url"))
    return links.withColumn("_some", some).where("not noisy or not _some").drop("_some")


def rank_links(links: DataFrame) -> DataFrame:
    """Adds ``rank``: links of a page's largest shape group first, then of the group seen first, then by place."""
    shaped = links.withColumn("shape", url_shape(F.col("target")))
    group = Window.partitionBy("url", "shape")
    order = Window.partitionBy("url").orderBy(F.desc("_size"), "_first", "pos")
    return shaped.withColumns({"_size": F.count("*").over(group), "_first": F.min("pos").over(group)}).withColumn("rank", F.row_number().over(order)).drop("_size", "_first")


def sample_pages(links: DataFrame, most: int = 20) -> DataFrame:
    """At most ``most`` targets of a site over its entries' ranked links; no target twice.

    Expects (site, entry_seq, rank, target).
    """
    first = Window.partitionBy("site", "target").orderBy("entry_seq", "rank")
    order = Window.partitionBy("site").orderBy("entry_seq", "rank")
    once = links.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")
    return once.withColumn("sample_no", F.row_number().over(order)).where(F.col("sample_no") <= most)


def plan_samples(candidates: DataFrame, collected: DataFrame, per_template: int = 3) -> DataFrame:
    """Candidates (site, shape, seq, ...) while their shape has fewer than ``per_template`` samples.

    ``collected`` (site, shape, samples) are the samples that all templates of a shape have already.
    """
    have = collected.groupBy("site", "shape").agg(F.sum("samples").alias("_have"))
    turn = F.row_number().over(Window.partitionBy("site", "shape").orderBy("seq"))
    return candidates.join(have, ["site", "shape"], "left").withColumn("_turn", turn).where(F.col("_turn") + F.coalesce("_have", F.lit(0)) <= per_template).drop("_turn", "_have")


def apply_budget(columns: DataFrame, budget: int = 60) -> DataFrame:
    """Adds ``spent`` and ``probed``: columns (site, seq, cost) in order until a site's request budget is spent."""
    spent = F.sum("cost").over(Window.partitionBy("site").orderBy("seq"))
    return columns.withColumn("spent", spent).withColumn("probed", F.col("spent") <= budget)


def column_candidates(links: DataFrame) -> DataFrame:
    """Links (site, base_url, pos, target) to the base's host that are not its home page; first of equal targets."""
    keep = (host_of(F.col("target")) == host_of(F.col("base_url"))) & ~is_homepage_like(F.col("target"), F.col("base_url"))
    first = F.row_number().over(Window.partitionBy("site", "base_url", "target").orderBy("pos"))
    return links.where(keep).withColumn("_n", first).where("_n = 1").drop("_n")


def next_frontier(links: DataFrame, fetched: DataFrame, allowed: DataFrame, scope: DataFrame | None = None, max_pages: int | None = None) -> DataFrame:
    """Targets found and not fetched yet that robots allow and the scope's shapes hold, each once.

    With ``max_pages`` the pages of a list beyond that number stay out: links say in ``paging`` whether they lead to one.
    """
    if max_pages is not None:
        links = links.where(~F.coalesce("paging", F.lit(False)) | (F.coalesce(page_number(F.col("target")), F.lit(1)) <= max_pages))
    new = links.select("site", "target").where("target is not null").distinct().join(fetched.select("target"), "target", "left_anti").join(allowed.select("target"), "target", "left_semi")
    new = new.withColumn("shape", url_shape(F.col("target")))
    return new if scope is None else new.join(scope.select("site", "shape").distinct(), ["site", "shape"], "left_semi")


def remember(targets: DataFrame, seen: str, buckets: int, path: str | None = None) -> None:
    """Adds URLs to the table ``seen``, which is kept in buckets of ``target`` (new ones only, if the caller's frontier is).

    A frontier against ``spark.table(seen)`` deals its links to these buckets; the seen side, which holds all that was
    ever fetched, is read bucket by bucket and never shuffled, as long as there are no fewer ``buckets`` than
    spark.sql.shuffle.partitions (else Spark prefers to deal both sides anew). A wave appends a file a bucket at most for each of its
    tasks, so it comes dealt by the same key.
    """
    writer = targets.select("target").where("target is not null").distinct().repartition(buckets, "target").write.mode("append").format("parquet").bucketBy(buckets, "target").sortBy("target")
    (writer.option("path", path) if path else writer).saveAsTable(seen)


def in_scope(pages: DataFrame, columns: DataFrame, templates: DataFrame, version: str | None = None, current: str | None = None) -> DataFrame:
    """Pages of selected columns and selected templates. A selection of another structure version must be confirmed."""
    if version != current:
        raise ValueError(f"selected on structure {version}, current is {current}: confirm the selection")
    if columns.isEmpty() or templates.isEmpty():
        raise ValueError("nothing is selected")
    return pages.join(columns, ["site", "column"], "left_semi").join(templates, ["site", "template_id"], "left_semi")
