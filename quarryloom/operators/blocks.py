"""Searches of many vectors in many: blocks of vectors are written once and every pair of blocks is read, not shuffled.

A block is some thousand vectors with their ids, as bytes in one row. A task holds a block of queries and reads the
blocks of vectors one after the other (Spark's cartesian product of two RDDs keeps neither side); it keeps the k best of
each query so far, so the rows that leave it are the result. What is on disk follows the tables, not the pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpoint_ready, ship

#: vectors of a block at most, numbers in it at most, queries that are scored at once
BLOCK, NUMBERS, SLICE = 4096, 1 << 20, 256
#: scores are ranked by nine places
PLACES, HALF = 9, 1e-9


def packed(ids: pa.Array, v: np.ndarray, cell: np.ndarray | None = None) -> bytes:
    """A block as bytes, in order of cell and id; half as many where single precision holds the very numbers."""
    cell = np.zeros(len(ids), np.int32) if cell is None else cell
    order = pc.sort_indices(pa.table({"cell": cell, "id": ids}), sort_keys=[("cell", "ascending"), ("id", "ascending")])
    v = v[order.to_numpy()]
    small = v.astype(np.float32)
    flat = small if (small == v).all() else v
    held = pa.FixedSizeListArray.from_arrays(pa.array(flat.ravel()), v.shape[1])
    return encoded(pa.table({"id": ids.take(order), "v": held, "cell": cell[order.to_numpy()]}))


def unpacked(block: bytes) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    t = decoded(block).combine_chunks()
    v = t.column("v").combine_chunks()
    return t.column("id").combine_chunks(), v.flatten().to_numpy().reshape(len(v), -1).astype(float), t.column("cell").to_numpy()


def directions(v: np.ndarray, norm: np.ndarray) -> np.ndarray:
    return (v / np.where(norm > 0, norm, 1)[:, None]).astype(np.float32)


def encoded(t: pa.Table, compression: str | None = None) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, t.schema, options=pa.ipc.IpcWriteOptions(compression=compression)) as out:
        out.write_table(t)
    return sink.getvalue().to_pybytes()


def decoded(block: bytes) -> pa.Table:
    with pa.ipc.open_stream(block) as own:
        return own.read_all()


def dealt(df: DataFrame, key: str, block: int, rows: int) -> DataFrame:
    """(name, block): the rows (key, v), or (key, v, cell) with the cells of a partition together, in packed blocks."""
    n = max(1, -(-rows // block))
    celled = "cell" in df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(parts: list) -> pa.RecordBatch:
            nonlocal made
            made += 1
            t = pa.Table.from_batches(parts).combine_chunks()
            v = t.column("v").combine_chunks()
            numbers = v.flatten().to_numpy(zero_copy_only=False).reshape(len(v), -1)
            cell = t.column("cell").to_numpy() if celled else None
            name = f"{TaskContext.get().partitionId()}/{made}"
            return pa.RecordBatch.from_pydict({"name": [name], "block": [packed(t.column(key).combine_chunks(), numbers, cell)]})

        made, parts, held = 0, [], 0
        for batch in batches:
            while len(batch):
                parts.append(batch.slice(0, block - held))
                batch = batch.slice(block - held)
                held += len(parts[-1])
                if held == block:
                    yield out(parts)
                    parts, held = [], 0
        if held:
            yield out(parts)

    own = df if celled else df.select(key, F.col("v").cast("array<double>").alias("v")).coalesce(n)
    return own.mapInArrow(run, "name string, block binary").repartition(n)


class Best:
    """The k best of each query of a block, of the vectors seen so far."""

    def __init__(self, block: bytes, k: int, near: Callable[[np.ndarray], np.ndarray] | None):
        self.ids, self.v, _ = unpacked(block)
        self.k, self.norm = k, np.linalg.norm(self.v, axis=1)
        self.unit = directions(self.v, self.norm)
        # what a sum of so many products of single precision may be off by, and the places that are ranked by
        self.margin = 2e-7 * (self.v.shape[1] + 8) + HALF
        self.last = np.where(self.norm > 0, -np.inf, np.inf)  # the k-th score; a query without a direction takes nothing
        self.cells = near(self.v) if near else None
        self.held: pa.Table | None = None
        self.new: list[pa.Table] = []

    def add(self, block: tuple[pa.Array, np.ndarray, np.ndarray]) -> None:
        ids, v, cell = block
        norm = np.linalg.norm(v, axis=1)
        unit = directions(v, norm)
        if self.cells is None:
            self._add(ids, v, norm, unit, np.arange(len(self.v)))
            return
        edges = np.flatnonzero(np.diff(cell, prepend=-1, append=-1))
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            self._add(ids.slice(a, b - a), v[a:b], norm[a:b], unit[a:b], np.flatnonzero(self.cells[:, cell[a]]))

    def _add(self, ids: pa.Array, v: np.ndarray, norm: np.ndarray, unit: np.ndarray, asked: np.ndarray) -> None:
        best = min(self.k, len(v))
        for i in range(0, len(asked), SLICE):
            own = asked[i : i + SLICE]
            least = self.last[own]
            # single precision tells who is far below the k best; all others are scored in double precision
            near = self.unit[own] @ unit.T >= (least - self.margin).astype(np.float32)[:, None]
            if np.count_nonzero(near) <= 4 * self.k * len(own):
                row, col = np.divmod(np.flatnonzero(near), len(v))
                if not len(row):
                    continue
                score = np.einsum("ij,ij->i", self.v[own[row]], v[col]) / np.where(self.norm[own] > 0, self.norm[own], 1)[row] / np.where(norm > 0, norm, 1)[col]
                score = np.where(norm[col] > 0, np.round(score, PLACES), -np.inf)
                keep = (score >= least[row]) & (score > -np.inf)
                row, col, score = row[keep], col[keep], score[keep]
            else:
                score = np.round((self.v[own] @ v.T) / np.where(self.norm[own] > 0, self.norm[own], 1)[:, None] / np.where(norm > 0, norm, 1), PLACES)
                score[:, norm == 0] = -np.inf
                last = np.partition(score, len(v) - best, axis=1)[:, len(v) - best, None]
                tied = score == last  # of equal scores the least ids, as many as there is room for
                room = best - (score > last).sum(1, keepdims=True)
                row, col = np.nonzero(((score > last) | (tied & (np.cumsum(tied, axis=1) <= room))) & (score >= least[:, None]) & (score > -np.inf))
                score = score[row, col]
            self.new.append(pa.table({"row": own[row].astype(np.int32), "chunk_id": ids.take(pa.array(col)), "score": score + 0.0}))
        if sum(map(len, self.new)) >= len(self.v) * self.k:
            self._merge()

    def _merge(self) -> None:
        t = pa.concat_tables([*([self.held] if self.held is not None else []), *self.new])
        t = t.take(pc.sort_indices(t, sort_keys=[("row", "ascending"), ("score", "descending"), ("chunk_id", "ascending")]))
        row = t.column("row").to_numpy()
        place = np.arange(len(row)) - np.searchsorted(row, row)
        self.held, self.new = t.filter(pa.array(place < self.k)), []
        row, score = self.held.column("row").to_numpy(), self.held.column("score").to_numpy()
        full = place[place < self.k] == self.k - 1
        self.last[row[full]] = score[full]

    def result(self) -> Iterator[bytes]:
        """Its rows (query_id, chunk_id, score, rank) in order, packed, some ten thousand at a time."""
        if self.new:
            self._merge()
        if self.held is None:
            return
        row = self.held.column("row").to_numpy()
        rank = np.arange(len(row)) - np.searchsorted(row, row) + 1
        t = pa.table({"query_id": self.ids.take(pa.array(row)), "chunk_id": self.held.column("chunk_id"), "score": self.held.column("score"), "rank": rank.astype(np.int32)})
        for i in range(0, len(t), 50_000):
            yield encoded(t.slice(i, 50_000).combine_chunks(), "zstd")


def search_blocks(queries: DataFrame, asked: int, vectors: DataFrame, held: int, k: int, dim: int, block: int = BLOCK, near: Callable[[np.ndarray], np.ndarray] | None = None) -> DataFrame:
    """(query_id, chunk_id, score, rank): the k best of (query_id, v) against (chunk_id, v), with the numbers of their rows.

    ``near`` tells which cells each vector of a block of queries is compared with; vectors then have a ``cell``. The search
    is done at once, and its result checkpointed: it may be read more than once. Few queries are dealt to as many tasks as
    run at once, each with some of the vectors; only then the best of these tasks are ranked once more.
    """
    spark = ship(queries.sparkSession)
    checkpoint_ready(spark)
    block = min(block, max(64, NUMBERS // max(dim, 1)))
    tasks = spark.sparkContext.defaultParallelism
    left, right = dealt(queries, "query_id", block, asked), dealt(vectors, "chunk_id", block, held)
    parts = min(-(-held // block) or 1, -(-2 * tasks * block // max(asked, 1)))

    def run(pairs: Iterator[tuple]) -> Iterator[tuple]:
        best: dict[str, Best] = {}
        name, own = None, None
        for x, y in pairs:
            if x.name not in best:
                best[x.name] = Best(bytes(x.block), k, near)
            if y.name != name:
                name, own = y.name, unpacked(bytes(y.block))
            best[x.name].add(own)
        for b in best.values():
            for rows in b.result():
                yield (rows,)

    found = left.rdd.cartesian(right.rdd.coalesce(max(1, parts))).mapPartitions(run)
    kept = spark.createDataFrame(found, "block binary", verifySchema=False).checkpoint()
    kinds = dict(queries.dtypes)["query_id"], dict(vectors.dtypes)["chunk_id"]
    schema = f"query_id {kinds[0]}, chunk_id {kinds[1]}, score double, rank int"

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for one in batch.column("block"):
                yield from decoded(one.as_py()).to_batches()

    out = kept.mapInArrow(rows, schema)
    if parts <= 1:
        return out
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id"))
    return out.withColumn("rank", rank).where(F.col("rank") <= k)
