"""Shared pieces of the operators: table access, Arrow batch slicing, word spans and rolling hashes.

All kernels work on the UTF-8 buffer of an Arrow string column, for many documents at once, in slices of a
bounded number of bytes, so that memory stays flat whatever the size of a batch; one document longer than a
slice is a slice by itself (whole texts, never prefixes).
"""

from __future__ import annotations

import gc
import hashlib
import re
import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..session import ship

#: bytes of text that a kernel looks at in one go
SLICE_BYTES = 600_000
U64 = np.uint64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_ready(spark: SparkSession) -> None:
    """checkpoint() writes to the folder that the cluster names; a session on one machine gets one of its own."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = sc.getConf().get("spark.checkpoint.dir")
        if not folder and not re.match(r"local\b(?!-cluster)", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-"))


def release(spark: SparkSession) -> None:
    """Frees the disk of shuffles and checkpoints that nothing refers to any more.

    Spark deletes their files once the driver has collected its garbage, which it may put off for half an hour; between
    the phases of a long operator they would add up.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def broadcast_value(spark: SparkSession, value):
    """A broadcast of something whose size does not grow with the data (a vocabulary, a fitted model)."""
    return ship(spark).sparkContext.broadcast(value)


def as_string_array(column) -> pa.Array:
    """One contiguous plain string array; null becomes the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not (pa.types.is_string(column.type) or pa.types.is_large_string(column.type)):
        column = column.cast(pa.string())
    return column.fill_null("") if column.null_count else column


def buffer_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets): the UTF-8 of all texts end to end and len + 1 offsets into it, from 0."""
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, off - off[0]


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes (one row at least)."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


def text_slices(batch: pa.RecordBatch, text: str = "text", limit: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of a batch with the bytes and offsets of their texts."""
    raw, off = buffer_of(as_string_array(batch.column(text)))
    for i, j in slices(off, limit):
        yield batch.slice(i, j - i), raw[off[i] : off[j]], off[i : j + 1] - off[i]


def rows_where(docs: DataFrame, keep: Callable[[np.ndarray, np.ndarray], np.ndarray], limit: int = SLICE_BYTES) -> DataFrame:
    """The rows, with all their columns, for which keep(bytes, offsets of the texts) holds. Names may be any, also with dots."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, raw, off in text_slices(batch, limit=limit):
                yield part.filter(pa.array(keep(raw, off)))

    plain = docs.toDF(*["text" if c == "text" else f"column_{i}" for i, c in enumerate(docs.columns)])
    return plain.mapInArrow(run, plain.schema).toDF(*docs.columns)


# --- rolling polynomial hashes, modulo 2**64 -------------------------------------------------------------

_ODD = U64(0x9E3779B97F4A7C15)
#: the low n bytes of eight
_MASKS = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (two multiply-xorshift rounds)."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> U64(30))
        x = x * U64(0xBF58476D1CE4E5B9)
        x ^= x >> U64(27)
        x *= U64(0x94D049BB133111EB)
        x ^= x >> U64(31)
    return x


#: a random-looking 64-bit value for each byte
BYTE_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * _ODD)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """B**i and B**-i for i < n (an odd base has an inverse modulo 2**64)."""
    have = _POWERS.get(0)
    if have is None or len(have[0]) < n:
        size = max(n, 2 * SLICE_BYTES + 16)
        base, inverse = int(0xD1342543DE82EF95), pow(0xD1342543DE82EF95, -1, 1 << 64)
        out = []
        for b in (base, inverse):
            p = np.empty(size, np.uint64)
            p[0] = 1
            filled = 1
            with np.errstate(over="ignore"):
                while filled < size:
                    step = min(filled, size - filled)
                    p[filled : filled + step] = p[:step] * U64(pow(b, filled, 1 << 64))
                    filled += step
            out.append(p)
        have = (out[0], out[1])
        if size <= 4 * SLICE_BYTES:
            _POWERS[0] = have
    return have[0], have[1]


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of values[s:e] for each span; equal sequences, equal hashes, wherever they stand."""
    up, down = powers(len(values) + 1)
    with np.errstate(over="ignore"):
        total = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * up[: len(values)], out=total[1:])
        h = (total[ends] - total[starts]) * down[starts]
        return mix(h + (ends - starts).astype(np.uint64) * _ODD)


# --- words: maximal runs of bytes other than 0x20 and 0x09-0x0D --------------------------------------------

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def word_spans(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first): byte spans of the words, and for each text the number of its first word (len + 1)."""
    solid = ~_SPACE[raw]
    begin, end = solid.copy(), solid.copy()
    begin[1:] &= ~solid[:-1]
    end[:-1] &= ~solid[1:]
    cut = off[1:-1]
    cut = cut[(cut > 0) & (cut < len(raw))]
    begin[cut] = solid[cut]
    end[cut - 1] = solid[cut - 1]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
    return starts, ends, np.searchsorted(starts, off)


def span_keys(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit halves of a key of each byte span: equal spans, equal keys, and the other way round.

    Spans of up to 15 bytes are their own key, with their length; longer ones have 120 bits of a cryptographic digest.
    """
    n = ends - starts
    padded = np.concatenate([raw, np.zeros(16, np.uint8)])
    eight = np.ndarray(len(raw) + 9, "<u8", padded, strides=(1,))
    low, high = eight[starts] & _MASKS[np.minimum(n, 8)], eight[np.minimum(starts + 8, len(raw))] & _MASKS[np.clip(n - 8, 0, 7)]
    high |= np.minimum(n, 16).astype(np.uint64) << U64(56)
    for i in np.flatnonzero(n > 15):
        d = hashlib.blake2b(raw[starts[i] : ends[i]], digest_size=15).digest()
        low[i], high[i] = int.from_bytes(d[:8], "little"), int.from_bytes(d[8:], "little") | 16 << 56
    return low, high


def key_hashes(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """A 64-bit hash of keys."""
    with np.errstate(over="ignore"):
        return mix(low ^ mix(high + _ODD))


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return key_hashes(*span_keys(raw, starts, ends))


def two_hashes(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of keys that don't meet together: what maps to the same pair has, for all that is known, the same key."""
    with np.errstate(over="ignore"):
        return key_hashes(low, high), mix(high ^ mix(low * U64(0xA0761D6478BD642F) + _ODD))


def distinct_spans(low: np.ndarray, high: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the place of one of each distinct key, the number of each item's key). Spans whose hashes meet stay two."""
    coded = pa.array(hashes).dictionary_encode()
    codes = coded.indices.to_numpy()
    example = np.empty(len(coded.dictionary), np.int64)
    example[codes] = np.arange(len(codes))
    of = example[codes]
    if (low[of] != low).any() or (high[of] != high).any():
        both = np.empty(len(low), [("low", np.uint64), ("high", np.uint64)])
        both["low"], both["high"] = low, high
        _, example, codes = np.unique(both, return_index=True, return_inverse=True)
    return example, codes


def take_spans(raw: np.ndarray, s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of spans end to end and their bounds (len + 1)."""
    n = e - s
    ends = np.cumsum(n)
    return raw[np.repeat(s - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)], np.concatenate([[0], ends]).astype(np.int64)


def spread(first: np.ndarray) -> np.ndarray:
    """For each item the number of the group that it is in, from group starts (len + 1)."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def crc32_of_id(column: str) -> str:
    """SQL: crc32 of an integer id written as text (null ids count as the empty text)."""
    return f"crc32(cast(coalesce(cast({column} as string), '') as binary))"
