"""Packing of token sequences by the sum-of-squares rule.

A document longer than a window fills whole windows; its rest goes to the fill level h whose choice leaves the least
sum over levels of (number of partly filled windows at that level) squared. The level array is all the state that a
choice reads. Each partition of the input packs its own documents, so nothing is shuffled; when its rows end, its
partly filled windows are evened out by cutting the pieces of the emptiest to fill the fullest, and one partly filled
window at most is left in a partition. Sequence ids hold the partition's number, so a task that runs again makes the
same rows.

Null text counts as empty: such a document is the one end id. Repeated documents are packed each by itself; other
columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from .bpe import VectorBPE, encode_slice
from .common import broadcast_value, table, text_slices

WINDOW, END_ID = 2048, 1
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"

Piece = tuple  # doc_id, start, ids, doc_tokens


class Packer:
    """Windows being filled. ``add`` returns the windows (lists of pieces) that became full."""

    def __init__(self, window: int):
        self.window = window
        self.level = np.zeros(window + 1, np.int64)  # partly filled windows at each level
        self.open: list[list[list[Piece]]] = [[] for _ in range(window + 1)]

    def add(self, doc_id, ids: np.ndarray) -> list[list[Piece]]:
        n, c = len(ids), self.window
        whole = n - n % c
        full = [[(doc_id, i, ids[i : i + c], n)] for i in range(0, whole, c)]
        r = n - whole
        if r:
            piece = (doc_id, whole, ids[whole:], n)
            h = self.choose(r)
            w = self.open[h].pop() if h else []
            w.append(piece)
            self.level[h] -= h > 0
            if h + r == c:
                full.append(w)
            else:
                self.level[h + r] += 1
                self.open[h + r].append(w)
        return full

    def choose(self, r: int) -> int:
        """The level that a piece of r ids goes to; 0 for a new window."""
        have, c = self.level, self.window
        best, least = 0, 2 * have[r] + 1
        if r < c:
            cost = np.where(have[1 : c - r + 1] > 0, 2 * (have[r + 1 : c + 1] - have[1 : c - r + 1]) + 2, 1 << 40)
            cost[-1] -= 1  # a window that becomes full is no more counted
            h = len(cost) - 1 - int(cost[::-1].argmin())
            if cost[h] <= least:
                best = h + 1
        return best

    def close(self) -> Iterator[list[Piece]]:
        """The windows left, evened out: all but one at most are full."""
        left = [w for at in range(self.window - 1, 0, -1) for w in self.open[at]]
        fill = [at for at in range(self.window - 1, 0, -1) for _ in self.open[at]]
        i, j = 0, len(left) - 1
        while i <= j:
            while i < j and fill[i] < self.window:
                doc_id, start, ids, n = left[j].pop()
                room = self.window - fill[i]
                if len(ids) > room:
                    left[j].append((doc_id, start, ids[: len(ids) - room], n))
                    start, ids = start + len(ids) - room, ids[len(ids) - room :]
                left[i].append((doc_id, start, ids, n))
                fill[i] += len(ids)
                fill[j] -= len(ids)
                if not fill[j]:
                    j -= 1
            yield left[i]
            i += 1


def pack_rows(windows: list[list[Piece]], first: int) -> pa.RecordBatch:
    rows = []
    for k, w in enumerate(windows):
        at = 0
        for doc_id, start, ids, n in w:
            rows.append((doc_id, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), n, first + k, at))
            at += len(ids)
    cols = list(zip(*rows, strict=True)) if rows else [()] * 7
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=[x.split()[0] for x in SCHEMA.split(", ")])


def pack(docs: DataFrame, tokenizer_path: str, window: int = WINDOW, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """One row for each piece of a document in a window; ``with_ids`` adds the ids themselves (array<int>)."""
    model = broadcast_value(docs.sparkSession, VectorBPE.compile(tokenizer_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, base, made = Packer(window), TaskContext.get().partitionId() << 33, 0

        def out(windows):
            nonlocal made
            b = pack_rows(windows, base + made)
            made += len(windows)
            if with_ids:
                ids = pa.array([p[2] for w in windows for p in w], pa.list_(pa.int32()))
                b = pa.RecordBatch.from_arrays([*b.columns, ids], names=[*b.schema.names, "ids"])
            return b

        for batch in batches:
            for part, raw, off in text_slices(batch):
                ids, first = encode_slice(model.value, raw, off)
                full = []
                for k, doc_id in enumerate(part.column("doc_id").to_pylist()):
                    own = np.empty(first[k + 1] - first[k] + 1, np.int32)
                    own[:-1] = ids[first[k] : first[k + 1]]
                    own[-1] = end_id
                    full += packer.add(doc_id, own)
                yield out(full)
        yield out(list(packer.close()))

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA + (", ids array<int>" if with_ids else ""))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
