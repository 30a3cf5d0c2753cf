"""Nearest neighbours by additive quantisation.

A vector is approximated by a sum of full-dimensional codewords, one from each codebook; the codebooks are fitted to
the residuals of a bounded sample, and encoding keeps a beam of the best partial sums. Each code is stored with a
norm: the ratio of the vector's length to its approximation's. A query's inner products with all codewords are looked
up and added, times that ratio.

Every row is encoded and every row is scored for every query, in tiles of about BLOCK candidates and TILE queries, so a
task holds one tile whatever the table's size. Only codes and norms (some 50 bytes a row) are dealt to the tiles; vectors
aren't. Of all tiles the best estimates of a query go on (rows are dealt by hash, so a tile among many gives four times
its share and 20 more); they meet the original vectors in blocks of PART rows, each with the queries that have
candidates there, and are ranked by exact inner products in double precision.

How many estimates go on is measured on the table: PROBES queries, chosen by hash, are searched exactly in all rows, and
the places of what they find in the order of their estimates are counted over all rows. So many go on that the share
RECALL of these has a place among them, ``rerank`` at least. Where vectors have no structure that grows with the table;
tiles hold fewer queries to the same degree, and the queries of a part are dealt to more tasks, so that a task holds
what it held before.

Vectors that are null, zero, of another length than the commonest, or that hold null or non-finite components take no
part; nor do null ids. Ties go to the smaller id, also among equal vectors. Repeated query ids count once (the least
vector); repeated candidate rows are candidates each. Fewer than k candidates give them all; an empty table no rows.
Other columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import broadcast_value, checkpoint_ready, table

SAMPLE, BOOKS, WORDS, BEAM, ROUNDS, SEED = 8192, 32, 128, 4, 4, 11
BLOCK, PART, TILE, RERANK = 65_536, 8192, 1024, 400
K, RECALL, PROBES = 20, 0.95, 64
ESTIMATE, FOUND = "query_id long, vec_id long, estimate float", "query_id long, vec_id long, score double"


def usable(vectors: DataFrame, dim: int | None = None) -> DataFrame:
    """(vec_id, v): the rows that take part, as doubles."""
    x = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("v")).where(
        "vec_id is not null and v is not null and exists(v, x -> x <> 0) and not exists(v, x -> x is null or isnan(x) or abs(x) = double('infinity'))"
    )
    return x if dim is None else x.where(F.size("v") == dim)


class Quantizer:
    def __init__(self, books: np.ndarray):
        self.books = books  # (books, words, dimensions)

    @classmethod
    def fit(cls, x: np.ndarray, books: int = BOOKS, words: int = WORDS, rounds: int = ROUNDS, seed: int = SEED) -> Quantizer:
        """Residual codebooks by k-means, each to what the ones before leave."""
        rng, rest, out = np.random.default_rng(seed), x.copy(), []
        words = min(words, len(x))
        for _ in range(books):
            c = rest[rng.choice(len(rest), words, replace=False)].copy()
            for _ in range(rounds):
                near = (rest @ c.T - (c**2).sum(1) / 2).argmax(1)
                n = np.bincount(near, minlength=words)
                order = np.argsort(near, kind="stable")
                some = np.flatnonzero(n)
                c[some] = np.add.reduceat(rest[order], (np.cumsum(n) - n)[some]) / n[some][:, None]
            near = (rest @ c.T - (c**2).sum(1) / 2).argmax(1)
            rest = rest - c[near]
            out.append(c)
        return cls(np.array(out))

    def encode(self, x: np.ndarray, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
        """(codes, stored norms) by beam search: the partial sums that leave the least residuals are kept."""
        n, (m, words, d) = len(x), self.books.shape
        rest = x[:, None, :]  # (rows, beam, dimensions)
        codes = np.zeros((n, 1, 0), np.uint8)
        for c in self.books:
            width = rest.shape[1]
            loss = (rest**2).sum(2)[:, :, None] - 2 * (rest.reshape(-1, d) @ c.T).reshape(n, width, words) + (c**2).sum(1)
            loss = loss.reshape(n, -1)
            keep = min(beam, loss.shape[1])
            best = np.argpartition(loss, keep - 1, 1)[:, :keep] if keep < loss.shape[1] else np.tile(np.arange(keep), (n, 1))
            row, (b, w) = np.arange(n)[:, None], np.divmod(best, words)
            rest = rest[row, b] - c[w]
            codes = np.concatenate([codes[row, b], w[:, :, None].astype(np.uint8)], 2)
        best = (rest**2).sum(2).argmin(1)
        row = np.arange(n)
        near = x - rest[row, best]
        size = np.sqrt((near**2).sum(1))
        norms = np.where(size > 0, np.sqrt((x**2).sum(1)) / np.where(size > 0, size, 1), 1)
        return codes[row, best], norms.astype(np.float32)

    def estimate(self, q: np.ndarray, codes: np.ndarray, norms: np.ndarray) -> np.ndarray:
        """Approximate inner products (queries, rows): looked up, added, times the stored norm."""
        total = np.zeros((len(q), len(codes)), np.float32)
        for i, c in enumerate(self.books):
            total += np.take((q @ c.T).astype(np.float32), codes[:, i], axis=1)
        return total * norms


def matrix(column) -> np.ndarray:
    """Lists of equal length as rows."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy().reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def best_of(scores: np.ndarray, r: int) -> np.ndarray:
    """Columns of the r highest of each row; of equals the first columns."""
    n = scores.shape[1]
    if r >= n:
        return np.tile(np.arange(n), (len(scores), 1))
    edge = np.partition(scores, n - r, axis=1)[:, n - r][:, None]
    above, equal = scores > edge, scores == edge
    take = above | (equal & (np.cumsum(equal, 1) <= r - above.sum(1)[:, None]))
    return np.nonzero(take)[1].reshape(len(scores), r)


def estimate_tile(model: Quantizer, queries: pa.Table, rows: pa.Table, most: int) -> pa.Table:
    """The rows of a tile with the best estimates for each of its queries."""
    rows = rows.sort_by("vec_id")
    qid, q = queries.column("vec_id").to_numpy(), matrix(queries.column("v"))
    vid, norms = rows.column("vec_id").to_numpy(), rows.column("norm").to_numpy()
    codes = np.frombuffer(b"".join(rows.column("codes").to_pylist()), np.uint8).reshape(len(vid), -1)
    out = []
    for i in range(0, len(qid), 64):
        ids = qid[i : i + 64]
        near = model.estimate(q[i : i + 64], codes, norms)
        near[ids[:, None] == vid] = -np.inf
        best = best_of(near, most)
        value = near[np.arange(len(ids))[:, None], best]
        ok = value > -np.inf
        out.append((np.broadcast_to(ids[:, None], best.shape)[ok], vid[best][ok], value[ok]))
    return pa.table([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], names=["query_id", "vec_id", "estimate"])


def rank_part(wanted: pa.Table, rows: pa.Table, k: int) -> pa.Table:
    """The k best rows of a part for each query with candidates in it, by exact inner products."""
    rows = rows.sort_by("vec_id")
    vid, v = rows.column("vec_id").to_numpy(), matrix(rows.column("v"))
    q, lists = matrix(wanted.column("v")), wanted.column("candidates").combine_chunks()
    bounds, ids = lists.offsets.to_numpy(), lists.flatten().to_numpy()
    out = []
    for i, query_id in enumerate(wanted.column("query_id").to_pylist()):
        own = np.sort(ids[bounds[i] - bounds[0] : bounds[i + 1] - bounds[0]])
        a, b = np.searchsorted(vid, own), np.searchsorted(vid, own, "right")
        at = np.repeat(a - np.concatenate([[0], np.cumsum(b - a)[:-1]]), b - a) + np.arange((b - a).sum())
        score = (v[at] * q[i]).sum(1)  # the same for equal vectors, wherever they stand
        top = np.argsort(-score, kind="stable")[:k]
        out.append((np.full(len(top), query_id), vid[at[top]], score[top]))
    return pa.table([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], names=["query_id", "vec_id", "score"])


def fit(vectors: DataFrame, rows: int, sample: int = SAMPLE) -> Quantizer:
    """Codebooks of some ``sample`` of the ``rows`` vectors, chosen by hash: the bound of what reaches the driver."""
    chosen = vectors.where((F.shiftrightunsigned(F.xxhash64("vec_id"), 11) * F.lit(2.0**-53)) < min(1.0, sample / rows)).orderBy(F.xxhash64("vec_id"), "vec_id")
    x = matrix(chosen.select("v").toArrow().column("v"))
    return Quantizer.fit(x if len(x) else matrix(vectors.limit(1).toArrow().column("v")))


def exact_places(coded: DataFrame, x: DataFrame, asked: DataFrame, model, k: int, probes: int) -> list[int]:
    """For the k nearest of some queries, in rising order: how many rows have a better estimate, and k for equal ones.

    To the driver come the probes, their k nearest with codes, and a count for each of these.
    """
    spark = x.sparkSession
    some = asked.orderBy(F.xxhash64("vec_id"), "vec_id").limit(probes).toArrow()
    if not len(some):
        return []
    probe = broadcast_value(spark, (some.column("vec_id").to_numpy(), matrix(some.column("v"))))

    def nearest_of(batches):
        ids, q = probe.value
        best = None
        for batch in batches:
            if len(batch):
                score, vid = q @ matrix(batch.column("v")).T, np.broadcast_to(batch.column("vec_id").to_numpy(), (len(q), len(batch)))
                score = np.where(ids[:, None] == vid, -np.inf, score)
                score, vid = (score, vid) if best is None else (np.hstack([best[0], score]), np.hstack([best[1], vid]))
                order = np.lexsort((vid, -score), axis=1)[:, :k]
                best = np.take_along_axis(score, order, 1), np.take_along_axis(vid, order, 1)
        if best is not None:
            at, rank = np.nonzero(best[0] > -np.inf)
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(best[1][at, rank]), pa.array(best[0][at, rank])], names=["probe", "vec_id", "score"])

    rank = F.row_number().over(Window.partitionBy("probe").orderBy(F.desc("score"), "vec_id"))
    truth = x.mapInArrow(nearest_of, "probe int, vec_id long, score double").withColumn("rank", rank).where(F.col("rank") <= k).select("probe", "vec_id").distinct()
    found = truth.join(coded.groupBy("vec_id").agg(F.min(F.struct("codes", "norm")).alias("c")), "vec_id").select("probe", "c.*").orderBy("probe").toArrow()
    if not len(found):
        return []
    codes = np.frombuffer(b"".join(found.column("codes").to_pylist()), np.uint8).reshape(len(found), -1)
    own = found.column("probe").to_numpy()
    value = model.value.estimate(probe.value[1], codes, found.column("norm").to_numpy())[own, np.arange(len(found))]
    edges = broadcast_value(spark, (own, value))

    def better(batches):
        (ids, q), (own, value) = probe.value, edges.value
        total = np.zeros(len(own), np.int64)
        for batch in batches:
            for i in range(0, len(batch), 1024):
                part = batch.slice(i, 1024)
                estimate = model.value.estimate(q, np.frombuffer(b"".join(part.column("codes").to_pylist()), np.uint8).reshape(len(part), -1), part.column("norm").to_numpy())
                estimate[ids[:, None] == part.column("vec_id").to_numpy()] = -np.inf
                total += (estimate[own] > value[:, None]).sum(1)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(own), dtype=np.int32)), pa.array(total)], names=["edge", "n"])

    counts = coded.mapInArrow(better, "edge int, n long").groupBy("edge").agg(F.sum("n").alias("n"))
    return sorted(r.n + k for r in counts.collect())


def none_of(schema: str) -> pa.Table:
    kinds = {"long": pa.int64(), "float": pa.float32(), "double": pa.float64()}
    fields = [f.split() for f in schema.split(", ")]
    return pa.table([pa.array([], kinds[k]) for _, k in fields], names=[n for n, _ in fields])


def nearest(vectors: DataFrame, is_query, k: int = K, sample: int = SAMPLE, rerank: int = RERANK, block: int = BLOCK, recall: float = RECALL, probes: int = PROBES) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest of each row for which ``is_query`` (a column of vec_id) holds.

    ``rerank`` estimates go to the exact ranking at least, more if a recall of ``recall`` takes more (0: just these).
    """
    spark = vectors.sparkSession
    checkpoint_ready(spark)
    sizes = usable(vectors).groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if sizes is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    x, rows = usable(vectors, sizes.d), sizes["count"]
    asked = x.where(is_query).groupBy("vec_id").agg(F.min("v").alias("v"))
    n_blocks = math.ceil(rows / block)
    model = broadcast_value(spark, fit(x, rows, sample))

    def encode(batches):
        for batch in batches:
            for i in range(0, len(batch), 1024):
                part = batch.slice(i, 1024)
                codes, norms = model.value.encode(matrix(part.column("v")))
                yield pa.RecordBatch.from_arrays([part.column("vec_id"), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(norms)], names=["vec_id", "codes", "norm"])

    coded = x.mapInArrow(encode, "vec_id long, codes binary, norm float").checkpoint()
    if recall and rerank < rows:
        places = exact_places(coded, x, asked, model, k, probes)
        rerank = max(rerank, places[math.ceil(recall * len(places)) - 1]) if places else rerank
    more = max(1.0, rerank / RERANK)
    n_parts, n_slices, n_tiles = math.ceil(rows / PART), math.ceil(more), max(1, math.ceil(asked.count() * more / TILE))
    of_tile = min(rerank, 4 * math.ceil(rerank / n_blocks) + 20)

    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    dealt = lambda n, of="vec_id": F.pmod(F.xxhash64(of), F.lit(n)).cast("int")
    coded = coded.withColumn("block", dealt(n_blocks)).withColumn("tile", every(n_tiles))
    queries = asked.withColumn("tile", dealt(n_tiles)).withColumn("block", every(n_blocks))

    def search(queries: pa.Table, rows: pa.Table) -> pa.Table:
        return estimate_tile(model.value, queries, rows, of_tile) if len(queries) and len(rows) else none_of(ESTIMATE)

    near = queries.groupBy("block", "tile").cogroup(coded.groupBy("block", "tile")).applyInArrow(search, ESTIMATE)
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("estimate"), "vec_id"))
    near = near.withColumn("place", place).where(F.col("place") <= rerank)
    wanted = near.groupBy("query_id", dealt(n_parts).alias("part"), dealt(n_slices, "query_id").alias("slice")).agg(F.collect_set("vec_id").alias("candidates"))
    wanted = wanted.join(asked.withColumnRenamed("vec_id", "query_id"), "query_id").select("part", "slice", "query_id", "v", "candidates")

    def exact(wanted: pa.Table, rows: pa.Table) -> pa.Table:
        return rank_part(wanted, rows, k) if len(wanted) and len(rows) else none_of(FOUND)

    rows_of = x.withColumn("part", dealt(n_parts)).withColumn("slice", every(n_slices))
    found = wanted.groupBy("part", "slice").cogroup(rows_of.groupBy("part", "slice")).applyInArrow(exact, FOUND)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)
