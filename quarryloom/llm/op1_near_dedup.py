"""Near-duplicate classes by Order MinHash, verified by banded alignment.

Documents with equal word sequences are one node. A node's k-mers are its sequences of three words, labelled by how
often they stood before in the text. (With every fifth word changed two texts have a similarity of 0.8 and no five-word
k-mer in common, so candidates come from shorter ones and many orders.) For each of ``sketches`` orders the two least
labelled k-mers are kept in text order; two documents agree in a sketch if both agree in the same order, which is
sensitive to edits and not only to shared content. A candidate pair is a link if an alignment of the words, banded to
what the threshold allows, matches 0.8 of them: 2 * matched / (words of both). Classes are the connected components of
the links.

No bucket is expanded into all its pairs:

1. each member of a bucket is aligned with the bucket's least document, its hub, and components are formed;
2. a bucket that still holds several classes is *open*. All pairs of different classes in it are compared: up to
   ``together`` members by a join, whose pairs a bound from word counts must allow;
3. the members of a larger open bucket of a sketch are dealt out to blocks of some ``BLOCK`` rows or ``BLOCK_WORDS``
   words. For every two blocks a group gets their members with their texts, compares the pairs by the same bound, aligns
   what it allows and returns the links. A pair counts only in the first sketch in which it agrees, and not once the
   links of its group have joined its classes. A node's text is fetched once, with the list of its buckets, and copied
   from there to the groups; a bucket of one block needs no more copies than it has members.

So every pair that agrees in a sketch is compared, whatever the size of the bucket, or is already of one class.

Texts of up to SHORT words share too few k-mers. They, and what can be similar to them, are bucketed by pairs of words
instead, without loss from thresholds above 2/3 on: of n words that match in n * t / (2 - t) at least, all but so many,
plus two, are taken in the order of their hashes, and two similar texts have two of those in common. Large open buckets
are split by a third such word, a fourth and a fifth, again without loss: pairs that need no more common words than
those of the bucket (one text has at most 5/4 of them) are looked at before each split. What is open after the last
split is compared whole, whatever its size.

Words are maximal runs of bytes other than 0x20 and 0x09-0x0D; whole texts of any length count. Null text counts as
empty; texts without words are one class. A row with a null doc_id gets the class of its text if another row has that
text, else a null class. Rows with the same doc_id and other texts count each by its text. Ties of hashes go to the
earlier k-mer. Repeated rows are one node; an empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import math
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import as_string_array, buffer_of, checkpoint_ready, mix, release, slices, span_hashes, spread, table, take_spans, text_slices, word_hashes, word_spans

SHINGLE, SIMILARITY, SKETCHES, BUCKETS, SHORT = 3, 0.8, 48, 128, 15
#: members of an open bucket whose pairs are joined; members, and words, of the blocks of larger ones; splits by words
TOGETHER, BLOCK, BLOCK_WORDS, SPLITS = 32, 1024, 1_000_000, 3
PLACE_BITS = 24
TOP = np.uint64(0xFFFFFFFFFFFFFFFF)


def occurrences(key: np.ndarray) -> np.ndarray:
    """How often each value stood before."""
    order = np.argsort(key, kind="stable")
    s = key[order]
    new = np.ones(len(s), bool)
    new[1:] = s[1:] != s[:-1]
    at = np.flatnonzero(new)
    out = np.empty(len(s), np.int64)
    out[order] = np.arange(len(s)) - np.repeat(at, np.diff(np.append(at, len(s))))
    return out


def order_sketches(h: np.ndarray, first: np.ndarray, k: int, sketches: int) -> np.ndarray:
    """(texts, sketches): the two least labelled k-mers of each order, in text order. Rows of empty texts are 0."""
    texts, n = len(first) - 1, np.diff(first)
    out = np.zeros((texts, sketches), np.uint64)
    some = np.flatnonzero(n)
    if not len(some):
        return out
    counts = np.maximum(n[some] - k + 1, 1)
    begin = np.cumsum(counts) - counts
    owner = np.repeat(np.arange(len(some)), counts)
    place = np.arange(len(owner)) - begin[owner]
    s = first[some][owner] + place
    kmer = span_hashes(h, s, np.minimum(s + k, first[some + 1][owner]))
    with np.errstate(over="ignore"):
        times = occurrences(kmer ^ mix(owner.astype(np.uint64) + np.uint64(1)))
        labelled = mix(kmer + times.astype(np.uint64) * np.uint64(0xA0761D6478BD642F))
        low = np.uint64((1 << PLACE_BITS) - 1)
        tag = place.astype(np.uint64) & low
        tagged = counts.max() <= 1 << PLACE_BITS  # else there is one text here, longer than a slice
        for i in range(sketches):
            v = labelled * np.uint64(0xE7037ED1A0B428DB + 2 * i * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF | 1)
            v ^= v >> np.uint64(31)
            v *= np.uint64(0x8EBC6AF09C88C6E3)
            v = (v & ~low) | tag if tagged else v & ~low
            a = np.minimum.reduceat(v, begin) & low if tagged else v.argmin(keepdims=True)
            at = begin + a.astype(np.int64)
            v[at] = TOP
            b = np.minimum.reduceat(v, begin) & low if tagged else v.argmin(keepdims=True)
            b = np.where(counts > 1, b, a)
            x, y = kmer[begin + np.minimum(a, b).astype(np.int64)], kmer[begin + np.maximum(a, b).astype(np.int64)]
            out[some, i] = mix(mix(x) * np.uint64(3) + y + np.uint64(i + 1) * np.uint64(0xD6E8FEB86659FD93))
    return out


def fewest(n: np.ndarray, threshold: float) -> np.ndarray:
    """Words that a text of n words has in common with any similar one, at least."""
    return np.ceil(n * threshold / (2 - threshold) - 1e-9).astype(np.int64)


def first_words(h: np.ndarray, first: np.ndarray, threshold: float, more: int) -> pa.ListArray:
    """Of texts that are short, or similar to short ones: hashes of their labelled words in order, all but those that
    must be common to similar texts, plus ``more``. Other texts have none."""
    n = np.diff(first)
    widest = int(SHORT * (2 - threshold) / threshold + 1e-9)
    some = np.flatnonzero((n > 1) & (n <= widest))
    m = n[some]
    has = np.arange(widest) < m[:, None]
    own = h[(first[some][:, None] + np.arange(widest))[has]]
    x = np.full(has.shape, TOP)
    with np.errstate(over="ignore"):
        times = occurrences(own ^ mix(np.repeat(some, m).astype(np.uint64) + np.uint64(1)))
        x[has] = mix(own + times.astype(np.uint64) * np.uint64(0xA0761D6478BD642F))
    x.sort(axis=1)
    taken = np.minimum(m - fewest(m, threshold) + more, m)
    return lists_of(x[np.arange(widest) < taken[:, None]], taken, some, len(n))


def lists_of(values: np.ndarray, sizes: np.ndarray, rows: np.ndarray, n: int) -> pa.ListArray:
    """Lists of some of n rows; the others are empty."""
    every = np.zeros(n, np.int64)
    every[rows] = sizes
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(every)]).astype(np.int32)), pa.array(values.view(np.int64)))


def word_counts(counts: np.ndarray) -> pa.Array:
    """Counts as 16-bit lists; null for a text with more words in a bucket than that holds."""
    fits = counts.max(1, initial=0) < 1 << 15
    ends = np.concatenate([[0], np.cumsum(np.where(fits, counts.shape[1], 0))]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(counts[fits].ravel().astype(np.int16)), mask=pa.array(~fits))


def text_keys(raw: np.ndarray, s: np.ndarray, e: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of a cryptographic digest of each text's words."""
    data, bounds = take_spans(np.append(raw, np.uint8(0)), s, e + 1)
    data[bounds[1:] - 1] = 32
    data, at = memoryview(data), bounds[first]
    digests = b"".join(hashlib.blake2b(data[a:b], digest_size=16).digest() for a, b in zip(at[:-1], at[1:], strict=True))
    both = np.frombuffer(digests, np.int64).reshape(-1, 2)
    return both[:, 0], both[:, 1]


NODE = "one long, two long, n_words int, counts array<short>, sketches array<long>, words array<long>"


def sketch(docs: DataFrame, k: int = SHINGLE, sketches: int = SKETCHES, threshold: float = SIMILARITY) -> DataFrame:
    """One row for each document: 128 bits of its words, their number, bucketed counts, sketches or first words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, raw, off in text_slices(batch):
                s, e, first = word_spans(raw, off)
                h = word_hashes(raw, s, e)
                n = np.diff(first)
                counts = np.bincount(spread(first) * BUCKETS + (h >> np.uint64(57)).astype(np.int64), minlength=len(n) * BUCKETS)
                one, two = text_keys(raw, s, e, first)
                long = np.flatnonzero(n > SHORT)
                own = order_sketches(h, first, k, sketches)[long]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("version"), pa.array(one), pa.array(two), pa.array(n, pa.int32()), word_counts(counts.reshape(-1, BUCKETS)),
                     lists_of(own.ravel(), np.full(len(long), sketches), long, len(n)), first_words(h, first, threshold, 2 + SPLITS)],
                    names=["doc_id", "version", *(x.split()[0] for x in NODE.split(", "))],
                )

    return docs.mapInArrow(run, f"doc_id long, version long, {NODE}")


def matched(a: list, b: list, need: int) -> int | None:
    """How many words of two sequences an alignment matches at most; None if fewer than ``need``.

    Bit-parallel over the cells of a band: one that matches so many leaves at most len(a) - need words of a and
    len(b) - need of b, so it stays that near to the diagonal.
    """
    i = 0
    while i < len(a) and i < len(b) and a[i] == b[i]:
        i += 1
    j = 0
    while j < len(a) - i and j < len(b) - i and a[len(a) - 1 - j] == b[len(b) - 1 - j]:
        j += 1
    a, b, need = a[i : len(a) - j], b[i : len(b) - j], max(need - i - j, 0)
    n, m = len(a), len(b)
    if min(n, m) < need:
        return None
    left, right = m - need, n - need
    at: dict = defaultdict(int)
    for p, w in enumerate(a):
        at[w] |= 1 << p
    width = left + right + 1
    band = (1 << width) - 1
    low, found, zeros = 0, 0, (1 << n) - 1  # bit p of zeros is 0 where a match ends
    for q, w in enumerate(b):
        mask = at.get(w)
        start = q - left
        if start - low >= 1024:  # what lies left of the band is final
            step = start - low
            found += step - (zeros & ((1 << step) - 1)).bit_count()
            zeros >>= step
            low = start
        if mask is None:
            continue
        mask = (mask >> low) & (band << (start - low) if start >= low else band >> (low - start))
        if mask:
            u = zeros & mask
            zeros = ((zeros + u) | (zeros - u)) & ((1 << (n - low)) - 1)
    found += n - low - zeros.bit_count()
    return found + i + j if found >= need else None


def needed(total: int, similarity: float) -> int:
    """Matched words that texts of ``total`` words together need."""
    return math.ceil(similarity * total / 2 - 1e-9)


def similar(a: str, b: str, threshold: float) -> bool:
    x, y = a.encode().split(), b.encode().split()
    return matched(x, y, needed(len(x) + len(y), threshold)) is not None


def bound(a: str, b: str) -> str:
    """SQL: at most so many words match, by the words in each bucket and by the shorter text."""
    return f"least(aggregate(zip_with({a}.counts, {b}.counts, (x, y) -> int(least(x, y))), 0, (t, x) -> t + x), {a}.n_words, {b}.n_words)"


def aligned(pairs: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """(a, b, matched) of pairs (a, b, a_row, b_row): words that align, null if fewer than ``least`` of them.

    A row is (doc_id, version), which names one text of ``texts``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, len(batch), 64):
                part = batch.slice(i, 64)
                sides = ((x.encode().split(), y.encode().split()) for x, y in zip(part.column("left").to_pylist(), part.column("right").to_pylist(), strict=True))
                found = pa.array([matched(x, y, needed(len(x) + len(y), least)) for x, y in sides], pa.int32())
                yield pa.RecordBatch.from_arrays([part.column("a"), part.column("b"), found], names=["a", "b", "matched"])

    side = lambda x, name: texts.select(F.col("doc_id").alias(f"{x}_doc"), F.col("version").alias(f"{x}_version"), F.col("text").alias(name))
    pairs = pairs.select("a", "b", *[F.col(f"{x}_row.{c}").alias(f"{x}_{short}") for x in "ab" for c, short in (("doc_id", "doc"), ("version", "version"))])
    both = pairs.join(side("b", "right"), ["b_doc", "b_version"]).join(side("a", "left"), ["a_doc", "a_version"])
    return both.select("a", "b", "left", "right").mapInArrow(run, "a long, b long, matched int")


def components(links: DataFrame) -> DataFrame:
    """(node, class): the least node that each node is linked to, by whatever way.

    Each round a node takes the least class of its neighbours, every third round the class of its class as well, so
    long chains shorten by half. Lineage is cut each round.
    """
    both = links.select(F.col("a").alias("node"), F.col("b").alias("other")).union(links.select("b", "a")).distinct().checkpoint()
    at = both.groupBy("node").agg(F.min("other").alias("class")).select("node", F.least("class", "node").alias("class"), F.lit(None).cast("long").alias("old")).checkpoint()
    turn = 0
    while True:
        turn += 1
        told = at.where("old is null or class <> old")  # only what has changed is told again
        heard = both.join(told.select(F.col("node").alias("other"), "class"), "other").select("node", "class", F.lit(None).cast("long").alias("old"))
        if turn % 3 == 0:
            far = at.select("node", F.col("class").alias("mid")).join(at.select(F.col("node").alias("mid"), "class"), "mid").select("node", "class", F.lit(None).cast("long").alias("old"))
            heard = heard.union(far)
        step = heard.union(at.select("node", "class", F.col("class").alias("old"))).groupBy("node").agg(F.min("class").alias("class"), F.min("old").alias("old")).checkpoint()
        at = step
        if step.where("class <> old").isEmpty():
            return at.select("node", "class")


def memberships(nodes: DataFrame, threshold: float) -> DataFrame:
    """(key, node, last): the buckets of each node, by a sketch (negative last) or by a pair of its first words."""
    by_sketch = nodes.select("node", F.posexplode("sketches")).select(F.col("col").alias("key"), "node", (-1 - F.col("pos")).alias("last"))
    pairs = f"inline(flatten(transform(sequence(0, {first_of(2, threshold)} - 2), i -> transform(sequence(i + 1, {first_of(2, threshold)} - 1), j -> struct(xxhash64(words[i], words[j]) as key, j as last)))))"
    by_words = nodes.where(f"{first_of(2, threshold)} >= 2").selectExpr("node", pairs).select("key", "node", "last")
    return by_sketch.union(by_words)


def first_of(common: int, threshold: float) -> str:
    """SQL: how many of the first words two similar texts need to share ``common`` of them."""
    return f"least(size(words), n_words - int(ceil(n_words * double('{threshold}') / (2 - double('{threshold}')) - 1e-9)) + {common})"


def open_buckets(rows: DataFrame) -> DataFrame:
    """The rows of buckets with several classes, with their number ``n`` of members."""
    mixed = rows.groupBy("key").agg(F.min("class").alias("x"), F.max("class").alias("y"), F.count("*").alias("n")).where("x <> y").select("key", "n")
    return rows.join(mixed, "key")


def split(rows: DataFrame, turn: int, threshold: float) -> DataFrame:
    """The rows of word buckets with the keys of the ``turn``-th split: by one word more."""
    end = first_of(turn + 3, threshold)
    by_words = rows.where(f"last + 1 < {end}").select("*", F.expr(f"inline(transform(sequence(last + 1, {end} - 1), i -> struct(xxhash64(key, words[i]) as next, i as at)))"))
    return by_words.select(F.col("next").alias("key"), "node", "class", F.col("at").alias("last"), "n_words", "words")


def across(left: DataFrame, right: DataFrame, nodes: DataFrame, threshold: float, where: str) -> DataFrame:
    """(a, b) that share a key, are of different classes and may be similar by length and by the bound of word counts."""
    fact = lambda rows, x, y: rows.select("key", "node", "class").join(nodes.select("node", F.struct("n_words", "counts").alias(y)), "node").withColumnsRenamed({"node": x, "class": f"{x}_class"})
    pairs = fact(left, "x", "p").join(fact(right, "y", "q"), "key").where(f"x_class <> y_class and ({where})")
    enough = f"double('{threshold}') * (p.n_words + q.n_words) - 1e-9"
    pairs = pairs.where(f"2 * least(p.n_words, q.n_words) >= {enough}").where(f"2 * {bound('p', 'q')} >= {enough}")
    return pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


def block_links(own: pa.Table, threshold: float) -> list[tuple[int, int]]:
    """Links between members of different classes in one bucket: of two blocks, or within one.

    Rows of one class are alike here: once a link has joined two classes, their other pairs are passed over.
    """
    own = own.sort_by("node")  # the same links whatever the order of rows
    node, label, n, side = (own.column(c).to_numpy() for c in ("node", "class", "n_words", "side"))
    _, label = np.unique(label, return_inverse=True)
    raw, off = buffer_of(as_string_array(own.column("text")))
    words = lambda i: raw[off[i] : off[i + 1]].tobytes().split()  # noqa: E731  the words of all texts at once would take ten times their bytes
    counts = np.zeros((len(own), BUCKETS), np.int32)
    for i, j in slices(off):
        part = raw[off[i] : off[j]]
        s, e, first = word_spans(part, off[i : j + 1] - off[i])
        bucket = spread(first) * BUCKETS + (word_hashes(part, s, e) >> np.uint64(57)).astype(np.int64)
        counts[i:j] = np.bincount(bucket, minlength=(j - i) * BUCKETS).reshape(-1, BUCKETS)
    counts = counts.astype(np.int16) if counts.max(initial=0) < 1 << 15 else counts
    before = own.column("before").combine_chunks().flatten().to_numpy().reshape(len(own), -1)
    two = side.min() < side.max()
    out = []
    for x in np.flatnonzero(side == side.min()):
        y = np.flatnonzero(side > side[x]) if two else np.arange(x + 1, len(own))
        least = threshold * (n[x] + n[y]) - 1e-9
        y = y[(label[y] != label[x]) & (2 * np.minimum(n[x], n[y]) >= least)]
        y = y[~(before[y] == before[x]).any(1)]
        y = y[2 * np.minimum(counts[x], counts[y]).sum(1, dtype=np.int64) >= threshold * (n[x] + n[y]) - 1e-9]
        own_words = words(x) if len(y) else []
        for i in y:
            if label[i] != label[x] and matched(own_words, words(i), needed(int(n[x]) + int(n[i]), threshold)) is not None:
                out.append((min(node[x], node[i]), max(node[x], node[i])))
                label[label == label[i]] = label[x]
    return out


def within_blocks(large: DataFrame, nodes: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """(a, b): links between classes in buckets of sketches, found by every two blocks of a bucket."""
    # by node, with the list of its buckets (one of each sketch at most): joins with nodes and texts make a row a node
    own = large.groupBy("node").agg(F.min("class").alias("class"), F.collect_list(F.struct("key", "last")).alias("buckets"))
    own = own.join(nodes.select("node", "doc_id", "version", "n_words", "sketches"), "node").checkpoint()
    # as a table of its own, so that Spark can split a large bucket in the join with its size
    sizes = own.select("n_words", F.explode("buckets.key").alias("key")).groupBy("key").agg(F.greatest(F.count("*") / BLOCK, F.sum(F.col("n_words").cast("long")) / BLOCK_WORDS).alias("x"))
    sizes = sizes.select("key", F.ceil("x").cast("int").alias("parts")).checkpoint()
    placed = own.select("node", F.inline("buckets")).join(sizes, "key").groupBy("node").agg(F.collect_list(F.struct("key", "last", "parts")).alias("buckets"))
    own = own.drop("buckets").join(placed, "node").join(texts.select("doc_id", "version", "text"), ["doc_id", "version"])
    rows = own.select("node", "class", "n_words", "sketches", "text", F.inline("buckets")).withColumn("side", F.expr("int(pmod(xxhash64(node, key), parts))"))
    rows = rows.withColumn("before", F.expr("slice(sketches, 1, -1 - last)")).withColumn("other", F.expr("explode(sequence(0, parts - 1))"))
    rows = rows.select("key", F.least("side", "other").alias("low"), F.greatest("side", "other").alias("high"), "node", "class", "n_words", "side", "before", "text")

    def run(own: pa.Table) -> pa.Table:
        links = block_links(own, threshold)
        return pa.table({c: pa.array([p[i] for p in links], pa.int64()) for i, c in enumerate("ab")})

    return rows.groupBy("key", "low", "high").applyInArrow(run, "a long, b long").distinct()


def second_look(member: DataFrame, nodes: DataFrame, classes: DataFrame, texts: DataFrame, threshold: float, together: int) -> tuple[DataFrame, DataFrame]:
    """Pairs (a, b) of different classes in open buckets that may be links, and links found by blocks in large ones.

    Each part is a job of its own: the driver keeps figures of every task of a job's stages until the job ends.
    """
    placed = member.join(classes, "node", "left").select("key", "node", F.coalesce("class", "node").alias("class"), "last")
    rows = open_buckets(placed).checkpoint()
    release(texts.sparkSession)
    small, pairs = rows.where(F.col("n") <= together).select("key", "node", "class"), []
    links = within_blocks(rows.where("last < 0").where(F.col("n") > together), nodes, texts, threshold).checkpoint()
    release(texts.sparkSession)
    rows = rows.where("last >= 0")
    for turn in range(SPLITS):
        large = rows.where(F.col("n") > together)
        if large.isEmpty():
            break
        large = large.join(nodes.select("node", "n_words", "words"), "node").drop("n") if turn == 0 else large.drop("n")
        # pairs that need no more common words than the turn + 2 that they have in the bucket
        most = int(2 * (turn + 2) / threshold + 1e-9)
        pairs.append(across(large.where(F.col("n_words") <= most // 2), large.where(F.col("n_words") < most), nodes, threshold, f"p.n_words + q.n_words <= {most}").checkpoint())
        rows = open_buckets(split(large, turn, threshold)).checkpoint()
        kept = rows if turn == SPLITS - 1 else rows.where(F.col("n") <= together)
        small = small.union(kept.select(F.xxhash64("key", F.lit(turn)).alias("key"), "node", "class"))
    small = small.checkpoint()
    found = across(small, small, nodes, threshold, "x < y").checkpoint()
    for more in pairs:
        found = found.union(more)
    return found.distinct(), links


def near_classes(docs: DataFrame, threshold: float = SIMILARITY, k: int = SHINGLE, sketches: int = SKETCHES, together: int = TOGETHER) -> DataFrame:
    """doc_id, class_id (the least doc_id of the class), n_words for each row of (doc_id, text), with its version (xxhash64 of
    the text) and its class's number ``group`` (null if all rows of the class lack an id)."""
    checkpoint_ready(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("version"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = sketch(docs, k, sketches, threshold).checkpoint()
    unique = rows.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").isEmpty()
    if not unique:
        docs = docs.dropDuplicates(["doc_id", "version"])  # repeated rows would multiply the pairs that fetch them
    first = rows.where("doc_id is not null").groupBy("one", "two").agg(F.min(F.struct("doc_id", "version")).alias("f")).select("one", "two", "f.doc_id", "f.version")
    # a node is known by its least doc_id; of ids that stand for several texts, by a number above all others
    if unique:
        first = first.selectExpr("one", "two", "doc_id as node", "doc_id as node_doc", "version as node_version", "false as shared").checkpoint()
    else:
        several = first.groupBy("doc_id").agg(F.count("*").alias("texts")).where("texts > 1")
        number = "if(texts is null, doc_id, bigint('4611686018427387904') + (xxhash64(doc_id, one, two) & bigint('4611686018427387903')))"
        first = first.join(several, "doc_id", "left").selectExpr("one", "two", f"{number} as node", "doc_id as node_doc", "version as node_version", "texts is not null as shared").checkpoint()
    nodes = rows.join(first, ["one", "two"]).where("doc_id = node_doc and version = node_version and n_words > 0")
    nodes = nodes.select("node", "doc_id", "version", "n_words", "counts", "sketches", "words")
    nodes = (nodes if unique else nodes.dropDuplicates(["node"])).checkpoint()
    member = memberships(nodes, threshold)
    buckets = member.groupBy("key").agg(F.min("node").alias("least"), F.count("*").alias("n")).where("n > 1").select("key", "least")
    member = member.join(buckets, "key").checkpoint()
    facts = lambda x: nodes.select(F.col("node").alias(x), F.struct("n_words", "counts").alias(f"{x}_facts"), F.struct("doc_id", "version").alias(f"{x}_row"))

    def linked(pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) whose texts align."""
        both = pairs.join(facts("a"), "a").join(facts("b"), "b")
        both = both.where(f"2 * {bound('a_facts', 'b_facts')} >= double('{threshold}') * (a_facts.n_words + b_facts.n_words) - 1e-9")
        return aligned(both.select("a", "b", "a_row", "b_row"), docs, threshold).where("matched is not null").select("a", "b").checkpoint()

    links = linked(member.where("node <> least").select(F.col("least").alias("a"), F.col("node").alias("b")).distinct())
    release(docs.sparkSession)
    classes = components(links)
    pairs, more = second_look(member.select("key", "node", "last"), nodes, classes, docs, threshold, together)
    more = linked(pairs).union(more)
    release(docs.sparkSession)
    if not more.isEmpty():
        classes = components(links.union(more))
    release(docs.sparkSession)
    ids = rows.join(first, ["one", "two"], "left").join(classes, "node", "left").withColumn("group", F.coalesce("class", "node")).withColumn("class", F.col("group"))
    if not unique and not first.where("shared").isEmpty():
        least = ids.where("group is not null").groupBy("group").agg(F.min("doc_id").alias("least"))
        ids = ids.join(least, "group", "left").withColumn("class", F.col("least"))
    return ids.select("doc_id", F.col("class").alias("class_id"), F.col("n_words").cast("long"), "version", "group")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_classes(table(spark, sf_dir, "documents")).drop("version", "group")
