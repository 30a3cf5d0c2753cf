"""Quality scores: random Fourier features over document statistics, ridge by partition-summed normal equations,
isotonic calibration.

The cosine features approximate a Gaussian kernel over standardised statistics of a text. Each partition of the
training rows adds up its part of the normal equations; Spark sums the parts; the driver solves one system whose size
is the number of features. Calibration pools adjacent violators over binned scores: those of each half of the training
rows by the weights of the other half.

Some ``sample`` labelled rows train (by hash of their id; the bound of what is broadcast); every row is scored over its
whole text, however long. Null and empty texts have the statistics of an empty text and get a score
too; an empty table gives no rows. Equal texts get equal scores. Without any usable label every score is 0.5. A
document labelled more than once counts once, with its highest label. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import broadcast_value, checkpoint_ready, crc32_of_id, mix, rows_where, span_hashes, table, text_slices, word_hashes, word_spans

SAMPLE, FEATURES, WIDTH, RIDGE, BINS, SEED = 20_000, 256, 4.0, 1.0, 1000, 7
THRESHOLD = 0.3
NAMES = [f"s{i}" for i in range(21)]
#: tasks that add up normal equations
SUMMANDS = 16

UPPER, LOWER, DIGIT, STOP, QUOTE, SYMBOL, NEWLINE, GAP, HIGH, TAIL = range(10)


def byte_kinds() -> np.ndarray:
    t = np.full(256, SYMBOL, np.uint8)
    t[0x41:0x5B], t[0x61:0x7B], t[0x30:0x3A] = UPPER, LOWER, DIGIT
    t[[ord(c) for c in ".,;:?"]] = STOP
    t[[ord(c) for c in "'\"()-"]] = QUOTE
    t[10], t[[9, 11, 12, 13, 32]] = NEWLINE, GAP
    t[0x80:0xC0], t[0xC0:] = TAIL, HIGH
    return t


KINDS = byte_kinds()


def statistics(raw: np.ndarray, off: np.ndarray) -> np.ndarray:
    """One row of statistics for each text."""
    texts = len(off) - 1
    kind = KINDS[raw]
    owner = np.repeat(np.arange(texts), np.diff(off))
    by = np.bincount(owner * 10 + kind, minlength=texts * 10).reshape(texts, 10).astype(float)
    size = np.maximum(np.diff(off).astype(float), 1)
    chars = np.maximum(size - by[:, TAIL], 1)
    s, e, first = word_spans(raw, off)
    n = np.diff(first)
    words = np.maximum(n.astype(float), 1)
    doc = np.repeat(np.arange(texts), n)
    per = lambda v: np.bincount(doc, v, minlength=texts)
    length = (e - s).astype(float)
    before = lambda flag: np.concatenate([[0], np.cumsum(flag)])
    symbol, upper, digit = (before(kind == k) for k in (SYMBOL, UPPER, DIGIT))
    odd, caps, nums = (x[e] - x[s] for x in (symbol, upper, digit))
    h = word_hashes(raw, s, e)
    distinct_words = pair_counts(doc, h, texts)
    again = np.zeros(len(h), bool)
    again[1:] = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
    # three words in a row, and lines, that stand more than once in a text
    three = span_windows(h, 3)
    inside = np.arange(len(h)) + 3 <= first[1:][doc] if len(h) else np.zeros(0, bool)
    three_n = np.bincount(doc[inside], minlength=texts)
    three_distinct = pair_counts(doc[inside], three[inside[: len(three)].nonzero()[0]] if len(h) else three, texts)
    ends_line = np.flatnonzero(raw == 10)
    lines = np.unique(np.concatenate([ends_line + 1, off[:-1]]))
    lines = lines[lines < len(raw)]
    stop = np.append(lines[1:], len(raw))
    line_doc = np.searchsorted(off, lines, "right") - 1
    stop = np.where((stop > 0) & (stop <= len(raw)) & (raw[np.maximum(stop - 1, 0)] == 10) & (stop - 1 >= lines), stop - 1, stop) if len(lines) else stop
    line_n = np.maximum(np.bincount(line_doc, minlength=texts), 1)
    line_distinct = pair_counts(line_doc, word_hashes(raw, lines, stop), texts) if len(lines) else np.ones(texts)
    mean = per(length) / words
    return np.stack([
        np.log1p(n), np.log1p(size), mean, np.sqrt(np.maximum(per(length**2) / words - mean**2, 0)),
        by[:, UPPER] / chars, by[:, DIGIT] / chars, by[:, STOP] / chars, by[:, QUOTE] / chars, by[:, SYMBOL] / chars, by[:, NEWLINE] / chars, by[:, HIGH] / chars,
        per(odd > 0) / words, per((odd > 0) & (odd == e - s)) / words, per(caps > 1) / words, per(nums > 0) / words, per(length == 1) / words,
        distinct_words / words, np.where(three_n > 0, three_distinct / np.maximum(three_n, 1), 1.0), np.minimum(line_distinct / line_n, 1.0), np.log1p(words / line_n), per(again) / words,
    ], 1)


def span_windows(h: np.ndarray, k: int) -> np.ndarray:
    """A hash of h[i:i+k] for each i that has one."""
    if len(h) < k:
        return np.zeros(0, np.uint64)
    i = np.arange(len(h) - k + 1)
    return span_hashes(h, i, i + k)


def pair_counts(doc: np.ndarray, h: np.ndarray, texts: int) -> np.ndarray:
    """How many distinct values each text has."""
    if not len(doc):
        return np.zeros(texts)
    with np.errstate(over="ignore"):
        coded = pa.array(h ^ mix(doc.astype(np.uint64) + np.uint64(1))).dictionary_encode()
    example = np.empty(len(coded.dictionary), np.int64)
    example[coded.indices.to_numpy()] = np.arange(len(doc))
    return np.bincount(doc[example], minlength=texts).astype(float)


class Kernel:
    """The cosine features of standardised statistics."""

    def __init__(self, mean: np.ndarray, std: np.ndarray, features: int = FEATURES, width: float = WIDTH, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.mean, self.std = mean, np.where(std > 1e-9, std, 1.0)
        self.w = rng.normal(0, 1 / width, (len(mean), features))
        self.b = rng.uniform(0, 2 * np.pi, features)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.std, -6, 6)
        return np.hstack([np.cos(z @ self.w + self.b) * np.sqrt(2 / len(self.b)), np.ones((len(x), 1))])


def isotonic(score: np.ndarray, label_sum: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators over bins in order of score: (score, probability) knots, both never falling.

    No probability is nearer to 0 or 1 than half a row of all would bring it.
    """
    blocks: list[list[float]] = []  # weight, sum of labels, sum of scores
    for s, y, w in zip(score, label_sum, n, strict=True):
        blocks.append([w, y, s * w])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][0] >= blocks[-1][1] * blocks[-2][0]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last, strict=True)]
    w, y, s = np.array(blocks).T
    least = 0.5 / (w.sum() + 1)
    return s / w, np.clip(y / w, least, 1 - least)


class Model:
    def __init__(self, kernel: Kernel | None, weights: np.ndarray | None, knots: tuple[np.ndarray, np.ndarray] | None = None):
        self.kernel, self.weights, self.knots = kernel, weights, knots

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.kernel(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.kernel is None:
            return np.full(len(x), 0.5)
        return np.clip(np.interp(self.raw(x), *self.knots), 0, 1)


def labelled(docs: DataFrame, labels: DataFrame, sample: int) -> DataFrame:
    """(doc_id, text, label) of the training rows. The ids that travel to all tasks are ``sample`` on average, chosen by hash."""
    own = labels.where("doc_id is not null and quality is not null")
    rows = own.count()
    own = own.where((F.shiftrightunsigned(F.xxhash64("doc_id"), 11) * F.lit(2.0**-53)) < (sample / rows if rows > sample else 1.0))
    chosen = own.groupBy("doc_id").agg(F.max("quality").cast("double").alias("label"))
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "label")


def measured(training: DataFrame) -> DataFrame:
    """The statistics s0, s1, ... and the label of each row (text, label, ...), with the half that it belongs to (by a hash of
    the whole row, so that copies of a text with other ids are in both)."""

    def run(batches):
        for batch in batches:
            for part, raw, off in text_slices(batch):
                x = statistics(raw, off)
                half = part.column("half").to_numpy()
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in x.T] + [part.column("label").cast(pa.float64()), pa.array(half)], names=[*NAMES, "label", "half"])

    halves = training.select("text", "label", F.pmod(F.xxhash64(*training.columns), F.lit(2)).cast("int").alias("half"))
    return halves.mapInArrow(run, ", ".join(f"{n} double" for n in [*NAMES, "label"]) + ", half int")


def solve(gram: np.ndarray, ridge: float) -> np.ndarray:
    """Weights of the features from sums of products of (features, constant, label)."""
    penalty = np.eye(len(gram) - 1) * ridge
    penalty[-1, -1] = 1e-6
    return np.linalg.solve(gram[:-1, :-1] + penalty, gram[:-1, -1])


def fit(training: DataFrame, ridge: float = RIDGE) -> Model:
    """A model of rows (text, label, ...). Texts are measured once; each half is calibrated on the ridge of the other, or, if
    one half has rows of one label only, on the ridge of all."""
    spark = training.sparkSession
    checkpoint_ready(spark)
    rows = measured(training).checkpoint()
    m = rows.agg(*[F.avg(n).alias(f"m{n}") for n in NAMES], *[F.stddev_pop(n).alias(f"d{n}") for n in NAMES], F.count("*").alias("n"), F.avg("label").alias("label")).first()
    if not m.n or m.label in (0.0, 1.0):
        return Model(None, None)
    kernel = broadcast_value(spark, Kernel(np.array([m[f"m{n}"] for n in NAMES]), np.array([m[f"d{n}"] for n in NAMES])))
    matrix = lambda batch: np.stack([c.to_numpy() for c in batch.columns[:-1]], 1)
    d = FEATURES + 2

    def normal(batches):
        total = np.zeros((2, d, d))
        for batch in batches:
            x, half = matrix(batch), batch.column("half").to_numpy()
            phi = np.hstack([kernel.value(x[:, :-1]), x[:, -1:]])
            for i in range(2):
                total[i] += phi[half == i].T @ phi[half == i]
        if total.any():
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.ravel())], names=["cell", "part"])

    cells = rows.coalesce(SUMMANDS).mapInArrow(normal, "cell long, part double").groupBy("cell").agg(F.sum("part").alias("part")).toPandas()
    gram = np.zeros(2 * d * d)
    gram[cells.cell.to_numpy()] = cells.part.to_numpy()
    gram = gram.reshape(2, d, d)
    mixed = all(0 < g[-2, -1] < g[-2, -2] for g in gram)  # sum of labels, rows
    others = broadcast_value(spark, [Model(kernel.value, solve(gram[1 - i] if mixed else gram.sum(0), ridge)) for i in range(2)])

    def scored(batches):
        for batch in batches:
            x, half = matrix(batch), batch.column("half").to_numpy()
            r = np.where(half == 0, others.value[0].raw(x[:, :-1]), others.value[1].raw(x[:, :-1]))
            yield pa.RecordBatch.from_arrays([pa.array(np.round(np.clip(r, -1, 2) * BINS).astype(np.int64)), pa.array(x[:, -1])], names=["bin", "label"])

    bins = rows.mapInArrow(scored, "bin long, label double").groupBy("bin").agg(F.sum("label").alias("y"), F.count("*").alias("n")).orderBy("bin").toPandas()
    return Model(kernel.value, solve(gram.sum(0), ridge), isotonic(bins.bin.to_numpy() / BINS, bins.y.to_numpy(), bins.n.to_numpy()))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score for each row."""
    shared = broadcast_value(docs.sparkSession, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, raw, off in text_slices(batch):
                yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), pa.array(shared.value.score(statistics(raw, off)))], names=["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")


def keep(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows, with all their columns, whose text scores the threshold at least."""
    shared = broadcast_value(docs.sparkSession, model)
    return rows_where(docs, lambda raw, off: shared.value.score(statistics(raw, off)) >= threshold)


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Trains on labels outside the held-out fifth of the ids."""
    return fit(labelled(docs, labels.where(f"{crc32_of_id('doc_id')} % 5 <> 0"), sample))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = score(docs, train(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", F.expr(f"{crc32_of_id('doc_id')} % 5 = 0").alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))
