"""Page templates: fingerprints, stable ids, clustering inside (site, URL shape), the bridge to columns."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .similarity import similar_sets

THRESHOLD = 0.7
#: pages whose runs of equal fingerprints one task numbers at most
RUN_SPAN = 1_000_000
LEAST_TOKENS = 3


def fingerprints(elements: DataFrame, keys: list[str]) -> DataFrame:
    """Elements (keys, tag, classes, noise) → sorted set of ``tag`` or ``tag.firstclass``; under three tokens none."""
    token = F.when(F.size("classes") > 0, F.concat_ws(".", "tag", F.element_at("classes", 1))).otherwise(F.col("tag"))
    tokens = elements.groupBy(*keys).agg(F.array_sort(F.collect_set(F.when(~F.col("noise"), token))).alias("t"))
    return tokens.select(*keys, F.when(F.size("t") >= LEAST_TOKENS, F.col("t")).otherwise(F.array().cast("array<string>")).alias("fingerprint"))


def template_id(shape: Column, fingerprint: Column) -> Column:
    """Twelve hex digits of a digest of the shape and the sorted tokens, each after a zero byte."""
    return F.substring(F.sha2(F.concat_ws("\0", shape, F.array_sort(fingerprint)), 256), 1, 12)


def jaccard(a: Column, b: Column) -> Column:
    """0 for two empty sets."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(F.lit(0.0))


def fp_intersect(a: Column, b: Column) -> Column:
    """The common tokens; the first set if there are none."""
    both = F.array_intersect(a, b)
    return F.when(F.size(both) > 0, both).otherwise(a)


def similar_fingerprints(fps: DataFrame, threshold: float = THRESHOLD, name: Callable[[Column], Column] | None = None) -> DataFrame:
    """Pairs of distinct fingerprints of one (site, shape) that are similar: (site, shape, a, b, similarity).

    Few fingerprints stand in a shape however many pages it has: equal ones are one before any pair is made
    (``similarity.similar_sets``). With ``name`` a and b are that of the fingerprints.
    """
    return similar_sets(fps, ["site", "shape"], "fingerprint", threshold, name)


class Clusters:
    """Greedy clusters of token sets: a set joins the first cluster whose common tokens are similar enough.

    Tokens have an order, rarest first. A cluster is listed under the first few of its common tokens, a set looks
    only under its own first few (two similar sets share one of these); a cluster that shrinks is listed anew. Common
    tokens are rows of bits, so that all clusters found, or simply all where that is no more work, are compared at once.
    """

    def __init__(self, threshold: float, sets: list[list[str]]):
        often: dict[str, int] = {}
        for s in sets:
            for t in s:
                often[t] = often.get(t, 0) + 1
        self.rank = {t: i for i, t in enumerate(sorted(often, key=lambda t: (often[t], t)))}
        self.names = list(self.rank)
        self.threshold = threshold
        self.bits = np.zeros((64, -(-len(often) // 64) or 1), np.uint64)
        self.sizes = np.zeros(64, np.int64)
        self.n = 0
        self.listed: dict[int, list[int]] = {}

    def put(self, at: int, bits: np.ndarray, tokens: list[int]) -> None:
        self.bits[at], self.sizes[at] = bits, len(tokens)
        for t in self.first_few(tokens):
            self.listed.setdefault(t, []).append(at)

    def first_few(self, tokens: list[int]) -> list[int]:
        return tokens[: len(tokens) - math.ceil(len(tokens) * self.threshold - 1e-9) + 1]

    def tokens_of(self, bits: np.ndarray) -> list[int]:
        return np.flatnonzero(np.unpackbits(bits.view(np.uint8), bitorder="little")).tolist()

    def common(self) -> list[list[str]]:
        return [sorted(self.names[t] for t in self.tokens_of(b)) for b in self.bits[: self.n]]

    def add(self, tokens: list[str]) -> int:
        """The number of the cluster that a set joins or opens."""
        own = sorted({self.rank[t] for t in tokens})
        bits = np.packbits(np.bincount(own, minlength=64 * self.bits.shape[1]).astype(bool), bitorder="little").view(np.uint64)
        lists = [self.listed.get(t, []) for t in self.first_few(own)]
        # looking at all is less work than putting long lists together
        some = np.arange(self.n) if 16 * sum(map(len, lists)) > self.n * self.bits.shape[1] else np.unique(np.concatenate([np.zeros(0, np.int64), *map(np.array, lists)]).astype(np.int64))
        both = np.bitwise_count(self.bits[some] & bits).sum(1, dtype=np.int64)
        near = np.flatnonzero((both > 0) & (both / (self.sizes[some] + len(own) - both) >= self.threshold))
        if len(near):
            at = int(some[near[0]])
            if both[near[0]] < self.sizes[at]:
                now = self.bits[at] & bits
                self.put(at, now, self.tokens_of(now))
            return at
        if self.n == len(self.bits):
            self.bits, self.sizes = np.concatenate([self.bits, np.zeros_like(self.bits)]), np.concatenate([self.sizes, np.zeros_like(self.sizes)])
        self.n += 1
        self.put(self.n - 1, bits, own)
        return self.n - 1


def _keyed(pages: DataFrame, exact: bool) -> DataFrame:
    """Adds ``_key``, the layout that a page is clustered by.

    Clusters are greedy in order of ``seq`` within (site, shape): a page joins the first whose common tokens are
    similar enough, which then become the intersection. By default only distinct fingerprints (at their first ``seq``)
    are clustered and pages joined back, so a shape with a billion pages is as small as its handful of layouts. With
    ``exact`` each run of neighbouring pages with one fingerprint is clustered, which gives what page by page would: a
    run's first page leaves its cluster more similar to the others of the run. Runs end at every RUN_SPAN of ``seq``,
    so that no task numbers more. The two differ only where a cluster's common tokens shrink below the threshold for a
    fingerprint that it holds. Pages without tokens are templates of their own.
    """
    key = F.concat_ws("\1", "fingerprint")
    if exact:
        span = F.floor(F.col("seq") / RUN_SPAN)
        order = Window.partitionBy("site", "shape", span).orderBy("seq")
        changed = F.coalesce(F.lag("fingerprint").over(order) != F.col("fingerprint"), F.lit(True)).cast("int")
        pages = pages.withColumn("_changed", changed).withColumn("_run", F.sum("_changed").over(order)).drop("_changed")
        key = F.concat_ws("/", span.cast("string"), F.col("_run").cast("string"))
    return pages.withColumn("_key", F.when(F.size("fingerprint") > 0, key).otherwise(F.concat(F.lit("\2"), F.col("seq").cast("string")))).drop("_run")


def _placed(keyed: DataFrame, threshold: float, by: list[str]) -> DataFrame:
    """(site, shape, key, *by, pages, at, cluster, common, template_id): pages are counted by layout before they are clustered."""
    counts = keyed.groupBy("site", "shape", F.col("_key").alias("key"), *by).agg(F.count("*").alias("pages"), F.min("seq").alias("at"), F.first("fingerprint").alias("fingerprint"))

    def cluster(frame: pd.DataFrame) -> pd.DataFrame:
        layouts = frame.sort_values("at").drop_duplicates("key")
        sets = [list(f) for f in layouts.fingerprint]
        clusters = Clusters(threshold, sets)
        own = dict(zip(layouts.key, [clusters.add(s) for s in sets], strict=True))
        common = clusters.common()
        frame = frame.assign(cluster=frame.key.map(own))
        return frame.assign(common=[common[i] for i in frame.cluster])[names]

    kinds = dict(counts.dtypes)
    names = ["site", "shape", "key", *by, "pages", "at", "cluster", "common"]
    empty, full = counts.where(F.size("fingerprint") == 0), counts.where(F.size("fingerprint") > 0)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in names[:-2]) + ", cluster long, common array<string>"
    alone = empty.withColumns({"cluster": (-1 - F.col("at")).cast("long"), "common": F.col("fingerprint")}).select(names)
    return full.groupBy("site", "shape").applyInPandas(cluster, schema).unionByName(alone).withColumn("template_id", template_id(F.col("shape"), F.col("common")))


def assign_templates(pages: DataFrame, threshold: float = THRESHOLD, exact: bool = False) -> DataFrame:
    """Adds the cluster's common tokens as ``common``, ``cluster`` and ``template_id`` to (site, shape, seq, fingerprint, ...)."""
    keyed = _keyed(pages, exact)
    placed = _placed(keyed, threshold, []).select("site", "shape", F.col("key").alias("_key"), "cluster", "common", "template_id")
    return keyed.join(placed, ["site", "shape", "_key"]).drop("_key")


def cluster_templates(pages: DataFrame, threshold: float = THRESHOLD, exact: bool = False, samples: int = 20) -> DataFrame:
    """Templates of (site, url, seq, shape, fingerprint, column): common tokens, first sample URLs, columns, pages.

    Columns are in order of first page. The list of sample URLs holds the first ``samples``; each task keeps the first
    of a layout before any page is shuffled, so no task ranks all pages of a template.
    """
    keyed, key = _keyed(pages, exact), ["site", "shape", "cluster", "template_id", "common"]
    placed = _placed(keyed, threshold, ["column"])
    seen = F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("at", "column"))), lambda x: x["column"]))
    counted = placed.groupBy(*key).agg(F.sum("pages").alias("page_count"), seen.alias("columns"))
    turn = F.row_number().over(Window.partitionBy("site", "shape", "_key").orderBy("seq"))
    few = keyed.select("site", "shape", "_key", "seq", "url").withColumn("_turn", turn).where(F.col("_turn") <= samples)
    layouts = placed.select("site", "shape", F.col("key").alias("_key"), "cluster", "template_id").distinct()
    first = F.slice(F.array_sort(F.collect_list(F.struct("seq", "url"))), 1, samples)
    urls = few.join(layouts, ["site", "shape", "_key"]).groupBy("site", "shape", "cluster", "template_id").agg(F.transform(first, lambda x: x["url"]).alias("sample_urls"))
    return counted.join(urls, ["site", "shape", "cluster", "template_id"]).select("site", "template_id", F.col("shape").alias("url_shape"), F.col("common").alias("fingerprint"), "sample_urls", "columns", "page_count")


def template_columns(pages: DataFrame) -> DataFrame:
    """The bridge: which columns each template covers and with how many pages, of (site, template_id, column)."""
    return pages.groupBy("site", "template_id", "column").agg(F.count("*").alias("pages"))
