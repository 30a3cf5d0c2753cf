"""Selectors of elements, as expressions over element rows (``dom.explode_elements``).

A selector is good for an element if the element is its first match. What a selector by id, one class or tag matches
first is the least place of the rows that carry the same string; what joined classes match first is the least place among the
page's sets of classes that hold them all. An element without a good one has its path: its own part and those of its
ancestors. Rows of a page are dealt together once, by the page's keys; nothing is broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpoint_ready

#: names that a selector may hold unescaped
PLAIN = r"^-?[A-Za-z_\x{80}-\x{10FFFF}][\w\x{80}-\x{10FFFF}-]*$"
TITLE_TAGS = ["h1", "h2", "h3"]


def _plain(c: Column) -> Column:
    return c.rlike(PLAIN)


def _texts(*cs: Column) -> Column:
    return F.array(*cs) if cs else F.array().cast("array<string>")


def simple_ways(tag: Column | None = None) -> Column:
    """Selectors by id, by each class and, where ``tag`` holds, by tag alone; from exact to loose."""
    by_class = F.transform(F.filter("classes", _plain), lambda c: F.concat("tag", F.lit("."), c))
    name = F.trim("element_id")
    by_id = F.when(F.coalesce(_plain(name), F.lit(False)), _texts(F.concat("tag", F.lit("#"), name))).otherwise(_texts())
    by_tag = _texts(F.col("tag")) if tag is None else F.when(tag, _texts(F.col("tag"))).otherwise(_texts())
    return F.concat(by_id, by_class, by_tag)


def joined_firsts(elements: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, tag, all classes as a sorted set, the first element that has them all) of elements with classes.

    Sets of a page meet through the class of theirs that the fewest sets hold.
    """
    sets = elements.where(F.size("classes") > 0).groupBy(*keys, "tag", F.array_sort(F.array_distinct("classes")).alias("all_of")).agg(F.min("pos").alias("first"))
    each = sets.select(*keys, "tag", "all_of", "first", F.explode("all_of").alias("one"))
    each = each.withColumn("holders", F.count("*").over(Window.partitionBy(*keys, "tag", "one")))
    rare = each.groupBy(*keys, "tag", "all_of").agg(F.min_by("one", F.struct("holders", "one")).alias("one"))
    more = each.select(*(F.col(k).alias(f"_{k}") for k in keys), F.col("tag").alias("_tag"), F.col("one").alias("_one"), F.col("all_of").alias("wider"), "first")
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    met = rare.join(more, [*same, F.col("tag") == F.col("_tag"), F.col("one") == F.col("_one")])
    return met.where(F.size(F.array_except("all_of", "wider")) == 0).groupBy(*keys, "tag", "all_of").agg(F.min("first").alias("first"))


def element_selectors(elements: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, pos, selector): one selector for every element, whose first match it is."""
    checkpoint_ready(elements.sparkSession)
    page = elements.select(*keys, "pos", "parent", "tag", "element_id", "classes", "above").checkpoint()  # pages are parsed once
    page = page.repartition(*keys)
    simple = page.select(*keys, "pos", F.posexplode(simple_ways()).alias("turn", "selector"))
    firsts = simple.withColumn("first", F.min("pos").over(Window.partitionBy(*keys, "selector"))).where("pos = first")
    # the id comes before joined classes, these before single ones
    own = firsts.select(*keys, "pos", F.when(F.col("selector").contains("#"), -2).otherwise(F.col("turn")).alias("turn"), "selector")
    joined = joined_firsts(page, keys).withColumn("plain", F.forall("all_of", _plain)).where("plain")
    several = page.where(F.size("classes") > 1).select(*keys, "pos", "tag", "classes", F.array_sort(F.array_distinct("classes")).alias("all_of"))
    other = joined.select(*(F.col(k).alias(f"_{k}") for k in keys), F.col("tag").alias("_tag"), F.col("all_of").alias("_all_of"), "first")
    on = [*(F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys), F.col("tag") == F.col("_tag"), F.col("all_of") == F.col("_all_of"), F.col("pos") == F.col("first")]
    both = several.join(other, on).select(*keys, "pos", F.lit(-1).alias("turn"), F.concat("tag", F.lit("."), F.array_join("classes", ".")).alias("selector"))
    # the path: parts of the element and its ancestors, each with its place among siblings of its tag
    siblings = Window.partitionBy(*keys, "parent", "tag")
    nth = F.row_number().over(siblings.orderBy("pos"))
    part = F.when(F.count("*").over(siblings) > 1, F.concat("tag", F.lit(":nth-of-type("), nth.cast("string"), F.lit(")"))).otherwise(F.col("tag"))
    chosen = own.unionByName(both).groupBy(*keys, "pos").agg(F.min_by("selector", "turn").alias("selector"))
    laid = page.select(*keys, "pos", "above", part.alias("part"))
    there = chosen.select(*(F.col(k).alias(f"_{k}") for k in keys), F.col("pos").alias("_pos"))
    rest = laid.join(there, [*(F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys), F.col("pos") == F.col("_pos")], "left_anti")
    steps = rest.select(*keys, "pos", F.posexplode(F.concat(F.array("pos"), "above")).alias("up", "at"))
    parts = laid.select(*(F.col(k).alias(f"_{k}") for k in keys), F.col("pos").alias("_pos"), "part")
    found = steps.join(parts, [*(F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys), F.col("at") == F.col("_pos")])
    order = F.array_sort(F.collect_list(F.struct((-F.col("up")).alias("up"), "part")))
    paths = found.groupBy(*keys, "pos").agg(F.array_join(F.transform(order, lambda x: x["part"]), " > ").alias("selector"))
    return chosen.unionByName(paths)


def field_selectors(elements: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, field, selector) of element rows with ``fields`` (the fields that an element gives) and, for links, ``ends``
    (endings of the address as written) and ``end`` (the ending by which it is an attachment, or null).

    A selector counts for what its first match gives. Attachments are looked for by ending inside what their parent's
    selectors match.
    """
    checkpoint_ready(elements.sparkSession)
    page = elements.select(*keys, "pos", "parent", "tag", "element_id", "classes", "above", "fields", "ends", "end").checkpoint()
    page = page.repartition(*keys)
    ways = page.select(*keys, "pos", "fields", F.explode(simple_ways(F.col("tag").isin(*TITLE_TAGS))).alias("selector"))
    first = ways.groupBy(*keys, "selector").agg(F.min_by("fields", "pos").alias("fields"))
    plain = first.select(*keys, F.explode("fields").alias("field"), "selector")
    # links by ending: inside each selector of their ancestors, and anywhere
    links = page.where((F.size("ends") > 0) | F.col("end").isNotNull()).select(*keys, "pos", "parent", "above", "ends", "end")
    scopes = ways.select(*(F.col(k).alias(f"_{k}") for k in keys), F.col("pos").alias("_pos"), F.col("selector").alias("scope"))
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    inside = links.select("*", F.explode("above").alias("at")).join(scopes, [*same, F.col("at") == F.col("_pos")]).select(*keys, "pos", "ends", "end", "scope", (F.col("at") == F.col("parent")).alias("own"))
    ended = inside.select(*keys, "pos", "end", "scope", F.explode("ends").alias("as_written"))
    bare = links.select(*keys, "pos", "end", F.lit("").alias("scope"), F.explode("ends").alias("as_written"))
    gives = ended.unionByName(bare).groupBy(*keys, "scope", "as_written").agg(F.min_by(F.col("end").isNotNull(), "pos").alias("gives")).where("gives")
    asked = inside.where("own").select(*keys, "scope", F.col("end").alias("as_written"))
    parents = inside.where("own").select(*(F.col(k).alias(f"_{k}") for k in keys), F.col("pos").alias("_pos")).distinct()
    alone = links.join(parents, [*same, F.col("pos") == F.col("_pos")], "left_anti").select(*keys, F.lit("").alias("scope"), F.col("end").alias("as_written"))
    asked = asked.unionByName(alone).where("as_written is not null").distinct()
    other = gives.select(*(F.col(k).alias(f"_{k}") for k in keys), F.col("scope").alias("_scope"), F.col("as_written").alias("_as_written"))
    found = asked.join(other, [*same, F.col("scope") == F.col("_scope"), F.col("as_written") == F.col("_as_written")], "left_semi")
    selector = F.concat(F.when(F.col("scope") == "", "").otherwise(F.concat("scope", F.lit(" "))), F.lit('a[href$="'), "as_written", F.lit('"]'))
    return plain.unionByName(found.select(*keys, F.lit("attachment").alias("field"), selector.alias("selector")))
