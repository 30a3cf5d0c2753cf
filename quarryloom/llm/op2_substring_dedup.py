"""Removal of repeated passages by super-k-mer partitioning.

A window is ``window`` consecutive words of one document; its minimiser is the least hash of the ``m``-word sequences
in it. Consecutive windows with the same minimiser form a super-k-mer. Equal windows have equal minimisers, so:

1. every super-k-mer's minimiser and document are added up (two-phase aggregation, no text in the shuffle); only those
   whose minimiser stands in two documents at least can hold a repeated window, and only those go on;
2. they travel, each packed as one string, to their minimiser's bucket, where windows are sorted by 128 bits of hashes,
   neighbours with equal hashes are compared word by word, and each run of equal windows gives the least document it
   starts in;
3. a minimiser with more than ``hot`` super-k-mers isn't one task's work: its strings are dealt out by document. Equal
   strings (by SHA-256) are one: it is kept for its least document, and goes whole from all others. The windows of the
   different strings are aggregated by their own 128 bits (pre-aggregated before the shuffle) and joined back. Both joins
   are in up to ``PARTS`` parts, so that what is held by very many documents isn't one task's work either;
4. the ranges of words to remove are gathered for each document and taken out of its text.

Documents are shuffled once (both joins read the same exchange). A word is a maximal run of bytes other than 0x20 and
0x09-0x0D. Null text has no words; a document with fewer words than a window stays as it is; kept words are joined by
one space; a text of any length is worked on whole; an empty table gives no rows. A null doc_id is neither smaller nor
larger than another: such a row stays whole and removes nothing. Rows with the same doc_id don't remove each other's
words. Extra columns, whatever their names, are carried along if asked for.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import as_string_array, buffer_of, span_hashes, span_keys, spread, table, text_slices, two_hashes, word_hashes, word_spans

WINDOW, MINIMISER, HOT, PARTS = 50, 10, 1000, 16
#: words of packed strings that a bucket task sorts at once (whole buckets; a bucket has at most ``hot`` strings)
AT_ONCE = 400_000


def super_kmers(h: np.ndarray, first: np.ndarray, window: int, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first window, number of windows, minimiser) of the super-k-mers of texts, windows by place among all words."""
    none = np.zeros(0, np.int64)
    if len(h) < window:
        return none, none, none.astype(np.uint64)
    i = np.arange(len(h) - m + 1)
    low = span_hashes(h, i, i + m)
    width, size = window - m + 1, 1
    while size * 2 <= width:
        low = np.minimum(low[:-size], low[size:])
        size *= 2
    if size < width:
        low = np.minimum(low[: len(low) - (width - size)], low[width - size :])
    doc = spread(first)[: len(low)]
    valid = np.arange(len(low)) + window <= first[1:][doc]
    new = valid.copy()
    new[1:] &= ~(valid[:-1] & (low[1:] == low[:-1]) & (doc[1:] == doc[:-1]))
    at = np.flatnonzero(new)
    upto = np.concatenate([[0], np.cumsum(valid)])
    return at, np.diff(np.append(upto[at], upto[-1])), low[at]


def skeleton(docs: DataFrame, window: int, m: int) -> DataFrame:
    """(minimiser, doc_id, version, start, windows) for each super-k-mer of (doc_id, version, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, raw, off in text_slices(batch):
                s, e, first = word_spans(raw, off)
                at, n, low = super_kmers(word_hashes(raw, s, e), first, window, m)
                doc = np.searchsorted(first, at, "right") - 1
                of = pa.array(doc)
                yield pa.RecordBatch.from_arrays([pa.array(low.view(np.int64)), part.column("doc_id").take(of), part.column("version").take(of), pa.array((at - first[doc]).astype(np.int32)), pa.array(n.astype(np.int32))], names=["minimiser", "doc_id", "version", "start", "windows"])

    return docs.where("doc_id is not null").select("doc_id", "version", "text").mapInArrow(run, "minimiser long, doc_id long, version long, start int, windows int")


def packed(docs: DataFrame, wanted: DataFrame, window: int) -> DataFrame:
    """The wanted super-k-mers with their words as one string."""
    of_doc = wanted.groupBy("doc_id", "version").agg(F.collect_list(F.struct("start", "windows", "minimiser", "parts")).alias("kmers"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in range(0, len(batch), 64):
                part = batch.slice(b, 64)
                rows = []
                for doc_id, version, text, kmers in zip(*(part.column(c).to_pylist() for c in range(4)), strict=True):
                    if not kmers:
                        continue
                    words = text.encode().split()
                    rows += [(k["minimiser"], k["parts"], doc_id, version, k["start"], b" ".join(words[k["start"] : k["start"] + k["windows"] + window - 1])) for k in kmers]
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.string()]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["minimiser", "parts", "doc_id", "version", "start", "packed"])

    # a left join, so that the exchange of documents is the one that remove_repeats() reads again
    both = docs.join(of_doc, ["doc_id", "version"], "left").select("doc_id", "version", "text", "kmers")
    strings = both.mapInArrow(run, "minimiser long, parts int, doc_id long, version long, start int, packed string")
    # buckets meet; strings of hot minimisers are dealt out. Both readers choose their rows after this exchange
    return strings.repartition(F.when(F.col("parts") > 0, F.xxhash64("packed", "doc_id")).otherwise(F.col("minimiser")))


def windows_of(raw: np.ndarray, off: np.ndarray, window: int) -> tuple[np.ndarray, ...]:
    """(string, place in it, two 64-bit hashes) of every window of packed strings, its first word, the keys of words."""
    s, e, first = word_spans(raw, off)
    keys = span_keys(raw, s, e)
    n = np.maximum(np.diff(first) - window + 1, 0)
    row = np.repeat(np.arange(len(n)), n)
    place = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    i = first[row] + place
    a, b = (span_hashes(h, i, i + window) for h in two_hashes(*keys))
    return row, place, a, b, i, keys


def runs(a: np.ndarray, b: np.ndarray, at: np.ndarray, keys: tuple[np.ndarray, np.ndarray], window: int) -> np.ndarray:
    """Where another window begins among windows sorted by hashes; words of neighbours with equal hashes are compared."""
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    same = np.flatnonzero(~new)
    for k in range(window):
        x, y = at[same] + k, at[same - 1] + k
        if any((key[x] != key[y]).any() for key in keys):
            raise ArithmeticError("two windows with the same 128 bits of hashes")
    return new


def bucket_ranges(minimiser: np.ndarray, doc: np.ndarray, version: np.ndarray, start: np.ndarray, raw: np.ndarray, off: np.ndarray, window: int):
    """Ranges of words (doc, version, from, to) that repeat a window of a smaller document, for whole buckets."""
    row, place, a, b, at, keys = windows_of(raw, off, window)
    order = np.lexsort((doc[row], b, a))
    row, place, a, b, at = row[order], place[order], a[order], b[order], at[order]
    new = runs(a, b, at, keys, window)
    least = doc[row[new]][np.cumsum(new) - 1] if len(row) else row
    hit = np.flatnonzero(doc[row] > least)
    if not len(hit):
        none = np.zeros(0, np.int64)
        return none, none, none, none
    row, place = row[hit], place[hit]
    order = np.lexsort((place, row))
    row, place = row[order], place[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (place[1:] != place[:-1] + 1)
    at = np.flatnonzero(new)
    last = np.append(at[1:], len(row)) - 1
    of = row[at]
    return doc[of], version[of], start[of] + place[at], start[of] + place[last] + window


def ranges_by_bucket(strings: DataFrame, window: int) -> DataFrame:
    """(doc_id, version, from, to) out of buckets: rows are dealt and sorted by minimiser, buckets stay whole."""
    names = ["doc_id", "version", "from", "to"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0

        def work(t: pa.Table) -> pa.RecordBatch:
            raw, off = buffer_of(as_string_array(t.column("packed")))
            out = bucket_ranges(*(t.column(c).to_numpy() for c in ("minimiser", "doc_id", "version", "start")), raw, off, window)
            return pa.RecordBatch.from_arrays([pa.array(c.astype(k)) for c, k in zip(out, (np.int64, np.int64, np.int32, np.int32), strict=True)], names=names)

        for batch in batches:
            batch = batch.filter(pc.equal(batch.column("parts"), 0))
            for i in range(0, len(batch), 2000):
                part = batch.slice(i, 2000)
                held.append(part)
                size += len(part)
                if size * window >= AT_ONCE:
                    t = pa.Table.from_batches(held)
                    key = t.column("minimiser").to_numpy()
                    cut = int(np.flatnonzero(key == key[-1])[0])  # the last bucket may go on
                    if cut:
                        yield work(t.slice(0, cut))
                        held, size = t.slice(cut).combine_chunks().to_batches(), len(t) - cut
        if held:
            yield work(pa.Table.from_batches(held))

    return strings.sortWithinPartitions("minimiser").mapInArrow(run, "doc_id long, version long, from int, to int")


def ranges_by_window(strings: DataFrame, window: int) -> DataFrame:
    """The same for hot minimisers: each window by its own hashes."""
    fields = "a long, b long, part int, parts int, doc_id long, version long, from int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for own, raw, off in text_slices(batch.filter(pc.greater(batch.column("parts"), 0)), "packed"):
                row, place, a, b, _, _ = windows_of(raw, off, window)
                parts = own.column("parts").to_numpy()
                part = own.column("doc_id").to_numpy() % np.maximum(parts, 1)
                columns = [a.view(np.int64), b.view(np.int64), part[row].astype(np.int32), parts[row], own.column("doc_id").to_numpy()[row], own.column("version").to_numpy()[row], (own.column("start").to_numpy()[row] + place).astype(np.int32)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=[f.split()[0] for f in fields.split(", ")])

    each = strings.mapInArrow(run, fields)
    # a window has one minimiser, so all its rows have the same number of parts
    least = each.groupBy("a", "b").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"), F.max("parts").alias("parts")).where("least < most")
    least = least.select("a", "b", "least", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    return each.join(least, ["a", "b", "part"]).where("doc_id > least").select("doc_id", "version", "from", (F.col("from") + window).cast("int").alias("to"))


def equal_strings(strings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of hot minimisers: the ranges of strings that a smaller document holds as well, and all other strings."""
    own = strings.where("parts > 0").withColumn("digest", F.unhex(F.sha2("packed", 256))).withColumn("part", F.expr("int(pmod(doc_id, parts))"))
    # equal strings have one minimiser, so one number of parts
    copies = own.groupBy("digest").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"), F.max("parts").alias("parts")).where("least < most")
    copies = copies.select("digest", "least", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    both = own.join(copies, ["digest", "part"], "left")
    words = F.length("packed") - F.length(F.replace("packed", F.lit(" "), F.lit(""))) + 1
    ranges = both.where("doc_id > least").select("doc_id", "version", F.col("start").alias("from"), (F.col("start") + words).cast("int").alias("to"))
    return ranges, both.where("least is null or doc_id = least").select(*strings.columns)


def remove_repeats(docs: DataFrame, window: int = WINDOW, m: int = MINIMISER, hot: int = HOT, carry: list[str] | None = None) -> DataFrame:
    """doc_id, n_words, n_removed, kept (text) for each row of (doc_id, text); ``carry`` adds a struct ``carried``."""
    quoted = lambda c: "`" + c.replace("`", "``") + "`"
    extra = [F.struct(*[F.col(quoted(c)).alias(c) for c in carry]).alias("carried")] if carry else []
    docs = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("version"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), *extra)
    marks = skeleton(docs, window, m)
    shared = marks.groupBy("minimiser").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"), F.count("*").alias("n")).where("least < most")
    wanted = marks.join(shared, "minimiser").select("doc_id", "version", "start", "windows", "minimiser", F.when(F.col("n") > hot, F.least(F.lit(PARTS), F.ceil(F.col("n") / max(hot, 1)))).otherwise(0).cast("int").alias("parts"))
    strings = packed(docs, wanted, window)
    whole, others = equal_strings(strings)
    ranges = ranges_by_bucket(strings, window).unionByName(ranges_by_window(others, window)).unionByName(whole)
    of_doc = ranges.groupBy("doc_id", "version").agg(F.collect_set(F.struct("from", "to")).alias("ranges"))
    fields = T.StructType().add("doc_id", "long").add("n_words", "long").add("n_removed", "long").add("kept", "string")
    if carry:
        fields.add("carried", docs.schema["carried"].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in range(0, len(batch), 256):
                part = batch.slice(b, 256)
                n_words, n_removed, kept = [], [], []
                for text, ranges in zip(part.column("text").to_pylist(), part.column("ranges").to_pylist(), strict=True):
                    words = text.encode().split()
                    n_words.append(len(words))
                    if ranges:
                        keep, at = [], 0
                        for r in sorted((r["from"], r["to"]) for r in ranges):
                            keep += words[at : r[0]] if r[0] > at else []
                            at = max(at, r[1])
                        words = keep + words[at:]
                    n_removed.append(n_words[-1] - len(words))
                    kept.append(b" ".join(words).decode())
                columns = [part.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string())]
                names = ["doc_id", "n_words", "n_removed", "kept"]
                if carry:
                    columns, names = [*columns, part.column("carried")], [*names, "carried"]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.join(of_doc, ["doc_id", "version"], "left").mapInArrow(run, fields)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


#: the same by windows as lists of words
ORACLE_SQL = """
with words as (
  select doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as w from documents
), starts as (
  select doc_id, unnest(range(1, cast(len(w) - 48 as bigint))) as p, w from words where len(w) >= 50
), windows as (
  select doc_id, p, md5(array_to_string(list_slice(w, p, p + 49), ' ')) as h from starts
), least as (
  select h, min(doc_id) as first_doc from windows group by h having count(distinct doc_id) > 1
), hits as (
  select distinct doc_id, p + k as word from windows join least using (h), range(50) r(k) where doc_id > first_doc
), gone as (
  select doc_id, list(word) as removed, count(*) as n from hits group by doc_id
)
select doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(n, 0) as bigint) as n_removed,
  sha256(array_to_string(case when removed is null then w else list_filter(w, lambda x, i: not list_contains(removed, i)) end, ' ')) as kept_sha256
from words left join gone using (doc_id)
"""
