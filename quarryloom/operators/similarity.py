"""Similar sets: a join by prefixes or blocks of all pairs, and near-equal texts by banded minima of shingles."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import checkpoint_ready, ship


def prefix_length(size: Column, threshold: float) -> Column:
    """How many of a set's rarest tokens suffice to meet every set that is similar enough."""
    return (size - F.ceil(size * F.lit(threshold) - F.lit(1e-9)) + 1).cast("int")


def least_overlap(a: Column, b: Column, threshold: float) -> Column:
    """Common tokens of two sets of such sizes with that Jaccard similarity, at least."""
    return F.ceil((a + b) * F.lit(threshold / (1 + threshold)) - F.lit(1e-9))


#: sets of a block at most, and tokens of a block's sets; columns of a slice in which common tokens are counted
BLOCK, TOKENS, SLICE = 512, 500_000, 4096
#: a pair of a prefix join is joined, shuffled and made one with others: so many pairs of a block are less work
JOINED = 16


def similar_sets(sets: DataFrame, group: list[str], tokens: str, threshold: float, name: Callable[[Column], Column] | None = None) -> DataFrame:
    """(group, a, b, similarity): pairs of distinct non-empty sets (group, tokens) of a group with Jaccard ``threshold`` or more.

    Of two sets a is the one whose tokens, joined, come first. With ``name`` a and b are that of the sets, made once a set
    where many pairs are found. ``tokens`` are sorted sets. Groups and sets that are null take no part.

    Two ways, by what a group has. Tokens of a set are put in rising order of how many sets of the group hold them. Similar
    sets share one of the first few tokens (``prefix_length``), their sizes are near each other, and behind the place of
    the shared token enough tokens must be left on either side; only pairs that pass all of this are compared. Hot tokens
    stand last, so they join no sets but those that have little else. Where sets are made of so few tokens that such a join
    would meet more pairs than there are, all pairs of the group are compared by blocks: common tokens of two blocks are a
    product of their bits.
    """
    checkpoint_ready(sets.sparkSession)
    name = name or (lambda c: c)
    rows = distinct_sets(sets, group, tokens)
    met = prefixes(rows, group, threshold).groupBy(*group, "token").agg(F.count("*").alias("n")).groupBy(*group).agg(F.sum(F.col("n").cast("double") * F.col("n")).alias("met"))
    sizes = rows.groupBy(*group).agg(F.count("*").alias("n"), F.sum(F.size("set")).alias("tokens"))
    way = sizes.join(met, group).withColumn("dense", F.col("n").cast("double") * F.col("n") <= JOINED * F.col("met"))
    way = way.withColumn("blocks", F.ceil(F.greatest(F.col("n") / BLOCK, F.col("tokens") / TOKENS)).cast("int")).select(*group, "dense", "blocks").checkpoint()
    few = rows.join(way.where("not dense").select(group), group, "left_semi")
    common = F.size(F.array_intersect("a", "b"))
    found = candidates(few, group, "set", threshold).withColumn("similarity", common / (F.size("a") + F.size("b") - common)).where(F.col("similarity") >= threshold)
    swapped = F.concat_ws("\1", "a") > F.concat_ws("\1", "b")
    found = found.select(*group, *(name(F.when(swapped, F.col(y)).otherwise(F.col(x))).alias(x) for x, y in ("ab", "ba")), "similarity")
    return found.unionByName(similar_in_blocks(rows.join(way.where("dense").drop("dense"), group), group, threshold, name))


def distinct_sets(sets: DataFrame, group: list[str], tokens: str) -> DataFrame:
    return sets.where(F.size(tokens) > 0).select(*group, F.col(tokens).alias("set")).distinct()


def prefixes(rows: DataFrame, group: list[str], threshold: float) -> DataFrame:
    """(group, set, size, place, token): the rarest tokens of each set, as many as it takes to meet every similar one."""
    each = rows.select(*group, "set", F.explode("set").alias("token"))
    often = each.groupBy(*group, "token").agg(F.count("*").alias("sets"))
    rare = F.array_sort(F.collect_list(F.struct("sets", "token")))
    ordered = each.join(often, [*group, "token"]).groupBy(*group, "set").agg(F.transform(rare, lambda x: x["token"]).alias("by_rarity"))
    size = F.size("set")
    return ordered.select(*group, "set", size.alias("size"), F.posexplode(F.slice("by_rarity", F.lit(1), prefix_length(size, threshold))).alias("place", "token"))


def candidates(sets: DataFrame, group: list[str], tokens: str, threshold: float) -> DataFrame:
    """The pairs (group, a, b) that ``similar_sets`` compares where it joins prefixes."""
    ahead = prefixes(distinct_sets(sets, group, tokens), group, threshold)
    a, b = (ahead.select(*group, "token", F.col("set").alias(x), F.col("size").alias(f"{x}_size"), F.col("place").alias(f"{x}_place")) for x in "ab")
    near = (F.col("a_size") <= F.col("b_size")) & (F.col("a_size") >= F.ceil(F.col("b_size") * threshold - F.lit(1e-9)))
    # of two sets of one size the lesser comes first
    once = (F.col("a_size") < F.col("b_size")) | (F.col("a") < F.col("b"))
    left = F.least(F.col("a_size") - F.col("a_place"), F.col("b_size") - F.col("b_place"))
    met = a.join(b, [*group, "token"]).where(near & once)
    # the first shared token tells how much can be common at most; later ones only tell less
    met = met.groupBy(*group, "a", "b").agg(F.min(F.struct("a_place", "a_size", "b_size", left.alias("left"))).alias("m"))
    return met.where(F.col("m.left") >= least_overlap(F.col("m.a_size"), F.col("m.b_size"), threshold)).drop("m")


def bits_of(lists: pa.ListArray, codes: np.ndarray, first: int) -> np.ndarray:
    """A row a set, a column a token with a code from ``first`` on, SLICE at most: 1 where the set holds it."""
    out = np.zeros((len(lists), SLICE), np.float32)
    owner = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
    here = (codes >= first) & (codes < first + SLICE)
    out[owner[here], codes[here] - first] = 1
    return out


def common_tokens(a: pa.ListArray, b: pa.ListArray) -> np.ndarray:
    """How many tokens each set of one block has in common with each of another."""
    x, y = pc.unique(a.flatten()), pc.unique(b.flatten())
    both = x.filter(pc.is_in(x, value_set=y))
    codes = [pc.fill_null(pc.index_in(z.flatten(), value_set=both), -1).to_numpy(zero_copy_only=False) for z in (a, b)]
    out = np.zeros((len(a), len(b)), np.float32)
    for first in range(0, len(both), SLICE):
        width = min(SLICE, len(both) - first)
        out += bits_of(a, codes[0], first)[:, :width] @ bits_of(b, codes[1], first)[:, :width].T
    return out


def similar_in_blocks(rows: DataFrame, group: list[str], threshold: float, name: Callable[[Column], Column]) -> DataFrame:
    """The pairs of (group, set, blocks), all of a group compared: its sets are dealt in ``blocks``, a task holds two."""
    own = rows.withColumns({"name": name(F.col("set")), "joined": F.concat_ws("\1", "set"), "own": F.pmod(F.xxhash64("set"), "blocks").cast("int")})
    what = [F.col(c).alias(c) for c in (*group, "set", "name", "joined")]  # columns of its own for either side
    left = own.select(*what, F.col("own").alias("i"), F.explode(F.sequence("own", F.col("blocks") - 1)).alias("j"))
    right = own.select(*what, F.explode(F.sequence(F.lit(0), "own")).alias("i"), F.col("own").alias("j"))
    kinds = dict(own.dtypes)
    schema = ", ".join([*(f"`{g}` {kinds[g]}" for g in group), f"a {kinds['name']}, b {kinds['name']}, similarity double"])

    def run(key: tuple, x: pa.Table, y: pa.Table) -> pa.Table:
        whole = key[-1].as_py() == key[-2].as_py()
        x, y = (t.select(["set", "name", "joined"]).combine_chunks() for t in (x, x if whole else y))
        a, b = (t.column("set").combine_chunks() if len(t) else pa.array([], t.schema.field("set").type) for t in (x, y))
        both = common_tokens(a, b).astype(float)
        found = both / (np.diff(a.offsets.to_numpy())[:, None] + np.diff(b.offsets.to_numpy()) - both)
        every = pa.concat_tables([x, y])
        order = np.empty(len(every), np.int64)
        order[pc.sort_indices(every.column("joined")).to_numpy()] = np.arange(len(every))
        row, col = np.nonzero(np.triu(found >= threshold, 1) if whole else found >= threshold)
        swapped = order[row] > order[len(x) + col]
        first, second = np.where(swapped, len(x) + col, row), np.where(swapped, row, len(x) + col)
        names = every.column("name").combine_chunks()
        out = [pa.array([k.as_py()] * len(row), k.type) for k in key[:-2]]
        return pa.table([*out, names.take(pa.array(first)), names.take(pa.array(second)), pa.array(found[row, col])], names=[*group, "a", "b", "similarity"])

    return left.groupBy(*group, "i", "j").cogroup(right.groupBy(*group, "i", "j")).applyInArrow(run, schema)


# --- texts -----------------------------------------------------------------------------------------------------

#: characters of a shingle, and bands x rows of minima: a pair of similarity 0.8 shares a band with a chance of 1 - (1 - 0.8 ** ROWS) ** BANDS > 0.9999
SHINGLE, BANDS, ROWS = 9, 20, 4


def squeezed(text: Column) -> Column:
    """Lower case, without white space: what near-equal texts are compared by."""
    return F.lower(F.regexp_replace(text, r"(?U)\s+", ""))


def mixed(h: np.ndarray) -> np.ndarray:
    """64 bits spread over 64 bits (the end of splitmix64)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def letters(body: str) -> np.ndarray:
    return np.frombuffer(body.encode("utf-32-le"), np.uint32)


def band_values(body: str, bands: int, rows: int) -> np.ndarray:
    """A number for each band of a text's signature, with the band in it; a text of less than a shingle has none."""
    c = letters(body).astype(np.uint64)
    n = len(c) - SHINGLE + 1
    if n < 1:
        return np.zeros(0, np.int64)
    h = np.zeros(n, np.uint64)
    for i in range(SHINGLE):
        h = h * np.uint64(0x9E3779B97F4A7C15) + c[i : i + n]
    h, each = mixed(h), mixed(np.arange(1, bands * rows + 1, dtype=np.uint64))
    least = np.full(bands * rows, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, n, 512):
        np.minimum(least, ((h[i : i + 512, None] ^ each) * (each | np.uint64(1))).min(0), out=least)
    value = np.arange(bands, dtype=np.uint64)
    for column in least.reshape(bands, rows).T:
        value = mixed(value * np.uint64(0x9E3779B97F4A7C15) + column)
    return value.view(np.int64)


def shingles(*bodies: str) -> list[np.ndarray]:
    """The distinct shingles of each of some texts, as sorted numbers that are equal where the shingles are."""
    parts = [letters(b) for b in bodies]
    known, codes = np.unique(np.concatenate(parts), return_inverse=True)
    bits = max(1, int(len(known) - 1).bit_length())
    held = max(1, 64 // bits)  # letters in a word of 64 bits: with few different ones a shingle is one word, else several
    out, words = [], []
    for at, part in zip(np.cumsum([0, *map(len, parts)]), parts, strict=False):
        c = codes[at : at + len(part)].astype(np.uint64)
        n = max(0, len(c) - SHINGLE + 1)
        own = []
        for first in range(0, SHINGLE, held):
            w = np.zeros(n, np.uint64)
            for i in range(first, min(first + held, SHINGLE)):
                w = (w << np.uint64(bits)) | c[i : i + n]
            own.append(w)
        words.append(own)
    if len(words[0]) == 1:
        return [np.unique(w[0]) for w in words]
    every = np.unique(np.concatenate([np.stack(w, 1) for w in words]), axis=0, return_inverse=True)[1].ravel()
    for at, w in zip(np.cumsum([0, *(len(w[0]) for w in words)]), words, strict=False):
        out.append(np.unique(every[at : at + len(w[0])]))
    return out


def near_equal(a: str, b: str, threshold: float) -> bool:
    x, y = shingles(a, b)
    if not len(x) or not len(y) or max(len(x), len(y)) * threshold > min(len(x), len(y)):
        return False
    common = len(np.intersect1d(x, y, assume_unique=True))
    return common >= (len(x) + len(y) - common) * threshold


def near_duplicates(docs: DataFrame, key: str, text: str, threshold: float = 0.8, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(key, class, similar): each document whose text is near-equal to another text, its class's least key, and whether it
    stands for its text.

    Near-equal are texts whose shingles have a Jaccard similarity of ``threshold`` or more; a class is what such pairs
    connect. Texts equal but for case and white space are one text (of its least key), so a thousand copies are one row
    before any pair is made. A signature is ``bands`` x ``rows`` minima over the hashes of a text's shingles, each
    hashed once more with another number, made in one pass over the text. Texts that agree on a band meet in a bucket: every text
    meets the bucket's least one, and only texts that are not near-equal to that meet all others, so a bucket of near
    copies makes as many pairs as it has texts. Texts that meet are compared by their true shingles. A bucket of texts
    that don't resemble its least one makes pairs of these texts with the whole bucket.

    Null and empty texts have no shingles and are in no class; null keys take no part. A text shorter than a shingle
    resembles no other text.
    """
    ship(docs.sparkSession)
    own = docs.select(F.col(key).alias("key"), squeezed(F.col(text)).alias("body")).where("body <> '' and key is not null").withColumn("print", F.sha2("body", 256))
    texts = own.groupBy("print").agg(F.min("key").alias("key"), F.first("body").alias("body")).checkpoint()
    kind = dict(texts.dtypes)["key"]

    def values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [band_values(b, bands, rows) for b in batch.column("body").to_pylist()]
            at = np.repeat(np.arange(len(found)), [len(v) for v in found])
            yield pa.RecordBatch.from_arrays([batch.column("key").take(pa.array(at)), pa.array(np.concatenate([np.zeros(0, np.int64), *found]))], ["key", "value"])

    buckets = texts.select("key", "body").mapInArrow(values, f"key {kind}, value long").checkpoint()
    least = buckets.groupBy("value").agg(F.min("key").alias("hub"), F.count("*").alias("n")).where("n > 1").drop("n")
    met = buckets.join(least, "value").where("key <> hub").checkpoint()
    first = compared(met.select(F.col("hub").alias("a"), F.col("key").alias("b")).distinct(), texts, threshold).checkpoint()
    apart = met.join(first.select(F.col("a").alias("hub"), F.col("b").alias("key")), ["hub", "key"], "left_anti").select("value", F.col("key").alias("other"))
    more = apart.join(met.drop("hub"), "value").where("key <> other").select(F.least("key", "other").alias("a"), F.greatest("key", "other").alias("b")).distinct()
    links = first.unionByName(compared(more, texts, threshold)).checkpoint()
    classes = connected(links)
    found = texts.select("print", F.col("key").alias("stands")).join(classes.withColumnRenamed("key", "stands"), "stands")
    return own.select("key", "print").join(found, "print").select("key", "class", (F.col("key") == F.col("stands")).alias("stands"))


def compared(pairs: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, b) of keys whose texts are near-equal. The texts (key, body) of a pair are looked up by either key."""
    a, b = (texts.select(F.col("key").alias(x), F.col("body").alias(f"{x}_body")) for x in "ab")
    both = pairs.join(a, "a").join(b, "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [near_equal(x.as_py(), y.as_py(), threshold) for x, y in zip(batch.column("a_body"), batch.column("b_body"), strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    kind = dict(pairs.dtypes)["a"]
    return both.select("a", "b", "a_body", "b_body").mapInArrow(run, f"a {kind}, b {kind}")


def connected(links: DataFrame) -> DataFrame:
    """(key, class) of links (a, b): the least key that a key is connected to.

    In turn every key is linked to the least of its greater neighbours' and own neighbourhood, and every key's lesser
    neighbours to the least of them, until nothing changes; each turn is a few aggregations, whatever the length of chains.
    """
    edges = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct().checkpoint()
    while True:
        # greater neighbours go to the least of the neighbourhood
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        # lesser neighbours, and the key, go to the least of these
        lesser = large.distinct()
        least = lesser.groupBy("a").agg(F.min("b").alias("m"))
        own = least.select("a", F.col("m").alias("b"))
        small = lesser.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = own.unionByName(small).distinct().checkpoint()
        if now.exceptAll(edges).isEmpty() and edges.exceptAll(now).isEmpty():
            break
        edges = now
    roots = edges.select(F.col("b").alias("key")).distinct()
    return edges.select(F.col("a").alias("key"), F.col("b").alias("class")).unionByName(roots.select("key", F.col("key").alias("class"))).distinct()
