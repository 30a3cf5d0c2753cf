"""Language identification, words first, then shorter and shorter character n-grams.

The classifier is fitted on a bounded sample: of a language with more than ``sample`` training rows each row takes part
with the probability sample / rows, by a hash of the row. Spark counts all words of the sampled texts by language, and
from them all n-grams (two-phase aggregations); every word and n-gram is in the model, with log frequencies for every
language. A known word scores by its log frequencies; an unseen one by the longest n-grams of which the model knows any
(5 characters down to 1, with word ends marked), as the mean of those known.

A word is a run of letters in lower case. Null text, or a text without a letter, gives ``und`` with score 0. Equal
texts give equal results. Ties go to the language that is first in order. Rows without a language don't train. Without
any training rows every text is ``und``; an empty table gives no rows. A text of any length is read whole, in one
slice. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import LETTER, Cut, cut
from .common import as_string_array, broadcast_value, buffer_of, checkpoint_ready, crc32_of_id, distinct_spans, key_hashes, rows_where, span_keys, table, take_spans, text_slices

#: training rows of a language, on average; characters of the longest n-grams
SAMPLE, LONGEST = 1_000, 5
#: words that a score rests on at most: long texts are no surer than that
EVIDENCE = 20
EDGE = 32  # stands at both ends of a word
SCHEMA = "doc_id long, lang_pred string, score double"


def letters(raw: np.ndarray, off: np.ndarray) -> Cut:
    c = cut(raw, off, spaced=False)
    keep = c.kinds == LETTER
    return Cut(c.raw, c.starts[keep], c.ends[keep], np.concatenate([[0], np.cumsum(keep)])[c.first], c.kinds[keep])


def language_words(docs: DataFrame) -> DataFrame:
    """(word, lang, n) of all rows that have a language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, raw, off in text_slices(batch, limit=2_000_000):
                c = letters(raw, off)
                if not len(c.starts):
                    continue
                langs = part.column("lang").dictionary_encode()
                of_word = np.repeat(langs.indices.to_numpy(), np.diff(c.first))
                low, high = span_keys(c.raw, c.starts, c.ends)
                example, codes = distinct_spans(low, high, key_hashes(low, high))
                k = len(langs.dictionary)
                pairs, n = np.unique(codes * k + of_word, return_counts=True)
                at = example[pairs // k]
                data, ends = take_spans(c.raw, c.starts[at], c.ends[at])
                words = pa.Array.from_buffers(pa.string(), len(at), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(data.tobytes())])
                yield pa.RecordBatch.from_arrays([words, langs.dictionary.take(pa.array(pairs % k)), pa.array(n, pa.int64())], names=["word", "lang", "n"])

    return docs.where("lang is not null").select("text", "lang").mapInArrow(run, "word string, lang string, n long").groupBy("word", "lang").agg(F.sum("n").alias("n"))


def gram_counts(words: DataFrame, longest: int) -> DataFrame:
    """(size, gram, lang, n) of the n-grams of (word, lang, n), word ends marked by a space."""
    # dealt out before it grows some fortyfold
    marked = words.repartition(words.sparkSession.sparkContext.defaultParallelism, "word").selectExpr("concat(' ', word, ' ') as m", "lang", "n")
    grams = f"inline(flatten(transform(sequence(1, {longest}), s -> transform(sequence(1, greatest(length(m) - s + 1, 1)), i -> struct(s as size, substring(m, i, s) as gram)))))"
    # a word shorter than s gives itself at most once more; those have another length than s and go
    return marked.selectExpr(grams, "lang", "n").where("gram <> ' ' and length(gram) = size").groupBy("size", "gram", "lang").agg(F.sum("n").alias("n"))


class Frequencies:
    """Log frequencies in each language, found by hash and compared by whole keys."""

    def __init__(self, strings: pa.Array, langs: np.ndarray, n: np.ndarray, smooth: float, k: int):
        coded = as_string_array(strings).dictionary_encode()
        raw, off = buffer_of(as_string_array(coded.dictionary))
        counts = np.zeros((len(coded.dictionary), k))
        np.add.at(counts, (coded.indices.to_numpy(), langs), n)
        low, high = span_keys(raw, off[:-1], off[1:])
        hashes = key_hashes(low, high)
        order = np.argsort(hashes)
        self.hashes, self.low, self.high = hashes[order], low[order], high[order]
        self.log = np.log((counts + smooth) / (counts.sum(0) + smooth * (len(counts) + 1)))[order].astype(np.float32)

    def find(self, raw: np.ndarray, s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(self.hashes):
            return np.zeros(len(s), bool), np.zeros(len(s), np.int64)
        low, high = span_keys(raw, s, e)
        at = np.minimum(np.searchsorted(self.hashes, key_hashes(low, high)), len(self.hashes) - 1)
        return (self.low[at] == low) & (self.high[at] == high), at


class Model:
    """words: a table (word, lang, n); grams: (size, gram, lang, n); languages in order."""

    def __init__(self, words: pa.Table, grams: pa.Table, languages: list[str], longest: int = LONGEST):
        self.languages, self.longest = languages, longest
        k, names = len(languages), pa.array(languages, pa.string())
        of = lambda t: pa.compute.index_in(t.column("lang"), names).to_numpy()
        self.words = Frequencies(words.column("word"), of(words), words.column("n").to_numpy(), 0.5, k)
        self.grams = [None]
        for size in range(1, longest + 1):
            own = grams.filter(pa.compute.equal(grams.column("size"), size))
            self.grams.append(Frequencies(own.column("gram"), of(own), own.column("n").to_numpy(), 0.5, k))

    def word_scores(self, raw: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
        """Log frequencies of distinct words, known or backed off."""
        out = np.zeros((len(s), len(self.languages)))
        hit, at = self.words.find(raw, s, e)
        out[hit] = self.words.log[at[hit]]
        left = np.flatnonzero(~hit)
        if not len(left):
            return out
        # the unseen words end to end, each with its two edges
        data, ends = take_spans(raw, s[left], e[left])
        n = len(left)
        marked = np.full(len(data) + 2 * n, EDGE, np.uint8)
        owner = np.repeat(np.arange(n), np.diff(ends))
        marked[np.arange(len(data)) + 2 * owner + 1] = data
        bounds = ends + 2 * np.arange(n + 1)
        lead = np.flatnonzero((marked & 0xC0) != 0x80)
        of = np.searchsorted(bounds, lead, "right") - 1
        stop = np.append(lead, len(marked))
        open_ = np.ones(n, bool)
        for size in range(self.longest, 0, -1):
            i = np.flatnonzero(open_[of[: len(of) - size + 1]] & (of[: len(of) - size + 1] == of[size - 1 :])) if len(of) >= size else np.zeros(0, np.int64)
            if not len(i):
                continue
            f = self.grams[size]
            hit, at = f.find(marked, lead[i], stop[i + size])
            i, at = of[i[hit]], at[hit]
            known = np.bincount(i, minlength=n)
            for lang in range(len(self.languages)):
                total = np.bincount(i, f.log[at, lang], minlength=n)
                out[left[known > 0], lang] = (total / np.maximum(known, 1))[known > 0]
            open_ &= known == 0
        return out

    def predict(self, raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number of the language or -1, score) of each text."""
        c = letters(raw, off)
        texts = len(off) - 1
        n = np.diff(c.first)
        if not len(c.starts) or not self.languages:
            return np.full(texts, -1), np.zeros(texts)
        low, high = span_keys(c.raw, c.starts, c.ends)
        example, codes = distinct_spans(low, high, key_hashes(low, high))
        scores = self.word_scores(c.raw, c.starts[example], c.ends[example])
        owner = np.repeat(np.arange(texts), n)
        total = np.stack([np.bincount(owner, scores[codes, i], minlength=texts) for i in range(len(self.languages))], 1)
        total *= (np.minimum(n, EVIDENCE) / np.maximum(n, 1))[:, None]
        total -= total.max(1, keepdims=True)
        p = np.exp(total)
        p /= p.sum(1, keepdims=True)
        best = p.argmax(1)
        return np.where(n > 0, best, -1), np.where(n > 0, p[np.arange(texts), best], 0.0)


def sampled(training: DataFrame, sample: int) -> DataFrame:
    """The rows that fit the model: ``sample`` of each language on average, all of a language that has fewer."""
    n = {r.lang: r["count"] for r in training.where("lang is not null").groupBy("lang").count().collect()}
    share = F.lit(1.0)
    for lang, rows in n.items():
        if rows > sample:
            share = F.when(F.col("lang") == lang, sample / rows).otherwise(share)
    return training.where((F.shiftrightunsigned(F.xxhash64(*training.columns), 11) * F.lit(2.0**-53)) < share)


def fit(training: DataFrame, sample: int = SAMPLE, longest: int = LONGEST) -> Model:
    """The model of rows (text, lang, ...). What reaches the driver comes from ``sample`` rows of each language."""
    checkpoint_ready(training.sparkSession)
    words = language_words(sampled(training, sample)).checkpoint()
    known = words.toArrow()
    return Model(known, gram_counts(words, longest).toArrow(), sorted(pa.compute.unique(known.column("lang")).to_pylist()), longest)


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score for each row."""
    shared = broadcast_value(docs.sparkSession, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = pa.array([*shared.value.languages, "und"])
        for batch in batches:
            for part, raw, off in text_slices(batch, limit=1_000_000):
                best, score = shared.value.predict(raw, off)
                yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), names.take(pa.array(np.where(best < 0, len(names) - 1, best))), pa.array(score)], names=["doc_id", "lang_pred", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)


def keep(docs: DataFrame, model: Model, min_score: float) -> DataFrame:
    """The rows, with all their columns, that have a language with that score at least."""
    shared = broadcast_value(docs.sparkSession, model)

    def sure(raw: np.ndarray, off: np.ndarray) -> np.ndarray:
        best, score = shared.value.predict(raw, off)
        return (best >= 0) & (score >= min_score)

    return rows_where(docs, sure, limit=1_000_000)


def training_rows(docs: DataFrame) -> DataFrame:
    return docs.where(f"{crc32_of_id('doc_id')} % 3 <> 1 and lang is not null").select("text", "lang", "doc_id")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = identify(docs, fit(training_rows(docs)))
    return out.select("doc_id", F.expr(f"{crc32_of_id('doc_id')} % 3 = 1").alias("held_out"), "lang_pred", "score")
