"""Nearest vectors by cells: less than all pairs, with a recall that is measured on the table itself.

Vectors are dealt to the cells of a k-means model (fitted to a bounded sample) by direction; a query is compared, exactly,
with the vectors of the cells nearest to it. How many cells that is follows from a measurement: some queries are searched
in all rows first, and as many cells are taken as hold the wanted share of what they find.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpoint_ready, ship
from .blocks import search_blocks
from .retrieval import TOP_K, one_dimension, vector_search
from .small import if_small

#: sampled vectors a model is fitted to, sampled vectors a cell at least, queries that are searched in all rows
SAMPLE, OF_CELL, PROBES = 20_000, 16, 64
RECALL, PART = 0.95, 4096


def with_direction(df: DataFrame, key: str) -> DataFrame:
    """(key, v): the rows whose vector has a direction."""
    return df.select(key, F.col("v").cast("array<double>").alias("v")).where("v is not null and exists(v, x -> x <> 0)")


def fit_cells(vectors: DataFrame, rows: int, cells: int | None = None, sample: int = SAMPLE) -> np.ndarray:
    """Directions of the centres: about the square root of the number of rows, as far as the sample bears them."""
    share = (F.shiftrightunsigned(F.xxhash64("chunk_id"), 11) * F.lit(2.0**-53)) < min(1.0, sample / rows)
    chosen = vectors.where(share).repartition(8, "chunk_id").sortWithinPartitions("chunk_id").select(array_to_vector("v").alias("features"))
    k = min(cells or math.isqrt(rows), sample // OF_CELL)
    if k < 2:
        return np.zeros((1, 1))
    model = KMeans(k=k, maxIter=8, seed=7, distanceMeasure="cosine", initMode="random").fit(chosen)
    centres = np.array(model.clusterCenters())
    return centres / np.maximum(np.linalg.norm(centres, axis=1), 1e-300)[:, None]


def nearest(v: np.ndarray, centres: np.ndarray, n: int) -> np.ndarray:
    """The n nearest cells of each vector, the nearest first."""
    near = v @ centres.T if len(centres) > 1 else np.zeros((len(v), 1))
    return np.argsort(-near, axis=1, kind="stable")[:, :n]


def in_cells(df: DataFrame, key: str, centres: np.ndarray, n: int) -> DataFrame:
    """(key, v, cell, place): the n nearest cells of each row, the nearest with place 0."""
    model = ship(df.sparkSession).sparkContext.broadcast(centres)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            c = model.value
            if not len(frame):
                continue
            yield frame.assign(cells=nearest(np.array(frame.v.tolist()), c, n).tolist())

    kind = dict(df.dtypes)[key]
    own = df.mapInPandas(run, f"{key} {kind}, v array<double>, cells array<int>")
    return own.select(key, "v", F.posexplode("cells").alias("place", "cell"))


def cells_for(queries: DataFrame, held: DataFrame, centres: np.ndarray, k: int, recall: float, probes: int) -> int:
    """How many cells a query needs so that the share ``recall`` of the k nearest, over all rows, is in them."""
    some = queries.orderBy(F.xxhash64("query_id"), "query_id").limit(probes).checkpoint()
    truth = vector_search(some, held.select("chunk_id", "v"), k).select("query_id", "chunk_id")
    found = held.select("chunk_id", "v").join(if_small(truth.select("chunk_id").distinct()), "chunk_id", "left_semi")
    at = truth.join(in_cells(found, "chunk_id", centres, 1).select("chunk_id", "cell"), "chunk_id")
    order = in_cells(some, "query_id", centres, len(centres)).select("query_id", "cell", "place")
    counts = {r.place: r["count"] for r in at.join(order, ["query_id", "cell"]).groupBy("place").count().collect()}  # a row a cell at most
    total = np.cumsum([counts.get(i, 0) for i in range(len(centres))])
    return 1 + int(np.searchsorted(total, recall * total[-1] - 1e-9)) if total[-1] else 1


def cell_search(queries: DataFrame, vectors: DataFrame, k: int = TOP_K, recall: float = RECALL, cells: int | None = None, sample: int = SAMPLE, probes: int = PROBES, part: int = PART) -> DataFrame:
    """(query_id, chunk_id, score, rank) as vector_search() gives them, from the cells that a query needs.

    Scores are exact; what is missing of the k nearest is 1 - ``recall`` on average, by measurement. The rows of a cell
    stand together in blocks of ``part`` vectors at most, so that a cell with a third of all rows is many blocks. Every
    block of queries reads every block (``blocks.search_blocks``) but scores those cells only that its queries need, so
    neither vectors nor queries are copied to cells. On vectors without structure nearly all cells are needed, and the work
    is that of all pairs again. Null vectors and those without a direction take no part; empty tables give no rows.
    """
    spark = queries.sparkSession
    checkpoint_ready(spark)
    asked, held = with_direction(queries, "query_id"), with_direction(vectors, "chunk_id")
    dim, rows = one_dimension(asked, held), held.count()
    centres = fit_cells(held, max(rows, 1), cells, sample)
    n = cells_for(asked, held, centres, k, recall, probes) if len(centres) > 1 else 1
    model = ship(spark).sparkContext.broadcast(centres)

    def near(v: np.ndarray) -> np.ndarray:
        out = np.zeros((len(v), len(model.value)), bool)
        np.put_along_axis(out, nearest(v, model.value, n), True, axis=1)
        return out

    # cells stand together, large ones in several partitions, small ones with others
    own = in_cells(held, "chunk_id", centres, 1).drop("place").hint("rebalance", "cell").sortWithinPartitions("cell", "chunk_id")
    return search_blocks(asked, asked.count(), own, rows, k, dim, part, near)
