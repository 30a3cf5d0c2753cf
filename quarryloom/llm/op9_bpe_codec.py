"""BPE encoding and decoding with a minimal acyclic lexicon of frequent words.

Spark counts the pre-tokens of all documents; those above the least count that leaves ``lexicon_size`` of them (the
bound of what reaches the driver and is broadcast; a histogram of counts finds it) are compiled on the driver into the
least acyclic automaton: suffixes are shared, and the numbers along a word's path sum to its place in a list of id
outputs. Workers memory-map that block. Distinct words of a slice walk it in lockstep; words that it doesn't hold are
merged exactly. The result doesn't depend on the lexicon.

Null text counts as empty: no ids, decoded to the empty text; an empty table gives no rows. A text of any length is
one slice. Repeated rows get equal values; other columns are not read. Texts that hold the string of a special token
go through the library, which finds those before anything else.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .automaton import Automaton, minimal
from .bpe import VectorBPE, WordIds, cut, encode_slice
from .common import broadcast_value, buffer_of, checkpoint_ready, distinct_spans, key_hashes, span_keys, table, take_spans, text_slices

LEXICON_SIZE = 30_000
SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def word_counts(docs: DataFrame, spaced: bool) -> DataFrame:
    """(word, n): how often each pre-token stands in all documents; each task adds up before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, raw, off in text_slices(batch, limit=2_000_000):
                c = cut(raw, off, spaced)
                if not len(c.starts):
                    continue
                low, high = span_keys(c.raw, c.starts, c.ends)
                example, codes = distinct_spans(low, high, key_hashes(low, high))
                data, ends = take_spans(c.raw, c.starts[example], c.ends[example])
                words = pa.Array.from_buffers(pa.binary(), len(example), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(data.tobytes())])
                yield pa.RecordBatch.from_arrays([words, pa.array(np.bincount(codes), pa.int64())], names=["word", "n"])

    return docs.select("text").mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def frequent(counts: DataFrame, size: int) -> DataFrame:
    """The rows of (word, n) above the least grade of n, in quarters of an octave, that leaves ``size`` rows at most."""
    grade = F.floor(4 * F.log2("n"))
    rows, least = 0, None
    for r in counts.groupBy(grade.alias("grade")).count().orderBy(F.desc("grade")).collect():  # some two hundred at most
        rows += r["count"]
        if rows > size:
            break
        least = r.grade
    return counts.where(F.lit(False) if least is None else grade >= least)


def lexicon(docs: DataFrame, model: VectorBPE, size: int) -> tuple[bytes, np.ndarray, np.ndarray]:
    """(automaton block, ids end to end, first id of each word and the end) of the most frequent words."""
    checkpoint_ready(docs.sparkSession)
    top = frequent(word_counts(docs, model.spaced).checkpoint(), size).select("word").collect()
    words = sorted(bytes(r.word) for r in top)
    ends = np.cumsum([len(w) for w in words]).astype(np.int64)
    ids, n = model.merge(np.frombuffer(b"".join(words), np.uint8), np.concatenate([[0], ends])[:-1].astype(np.int64), ends)
    return minimal(words).pack() if words else b"", ids, np.concatenate([[0], np.cumsum(n)]).astype(np.int64)


def encode_decode(docs: DataFrame, tokenizer_path: str, lexicon_size: int = LEXICON_SIZE, outputs: bool = False) -> DataFrame:
    """Digests of ids and decoded text; ``outputs`` adds ids (array<int>) and decoded (string) themselves."""
    model = VectorBPE.compile(tokenizer_path)
    shared = broadcast_value(docs.sparkSession, (model, *lexicon(docs, model, lexicon_size)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, block, lex_ids, lex_at = shared.value
        if "codec" not in model._memory:
            automaton = Automaton.map(block) if block else None

            def resolve(raw, starts, ends):
                ok, number = automaton.walk(raw, starts, ends) if automaton else (np.zeros(len(starts), bool), np.zeros(len(starts), np.int64))
                rest = np.flatnonzero(~ok)
                own, n = model.merge(raw, starts[rest], ends[rest]) if len(rest) else (np.zeros(0, np.int32), np.zeros(0, np.int64))
                counts, source = np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64)
                counts[ok], source[ok] = lex_at[number[ok] + 1] - lex_at[number[ok]], lex_at[number[ok]]
                counts[rest], source[rest] = n, len(lex_ids) + np.cumsum(n) - n
                end = np.cumsum(counts)
                return np.concatenate([lex_ids, own])[np.repeat(source - (end - counts), counts) + np.arange(end[-1])], counts

            model._memory["codec"] = WordIds(resolve), pa.array([str(i) for i in range(len(model.tokens))]), pa.array(model.tokens)
        words, decimal, shown = model._memory["codec"]
        for batch in batches:
            for part, raw, off in text_slices(batch):
                ids, first = encode_slice(model, raw, off, words)
                index, at = pa.array(ids), pa.array(first, pa.int32())
                n = np.diff(first)
                columns = [part.column("doc_id").cast(pa.int64()), pa.array(n, pa.int64())]
                joined = [pc.binary_join(pa.ListArray.from_arrays(at, names.take(index)), " ") for names in (decimal, shown)]
                columns += [digests(j) for j in joined]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if outputs:
                    columns, names = [*columns, pa.ListArray.from_arrays(at, index), joined[1]], [*names, "ids", "decoded"]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA + (", ids array<int>, decoded string" if outputs else ""))


def digests(texts: pa.Array) -> pa.Array:
    raw, off = buffer_of(texts)
    data = memoryview(raw.tobytes())
    return pa.array([hashlib.sha256(data[a:b]).hexdigest() for a, b in zip(off[:-1], off[1:], strict=True)], pa.string())


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
