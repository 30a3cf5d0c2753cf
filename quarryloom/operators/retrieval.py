"""Retrieval as batch jobs: a table of queries against tables of postings and vectors."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import extract_doc_numbers
from ..session import checkpoint_ready, ship
from .blocks import BLOCK, search_blocks
from .small import BROADCAST_ROWS, if_small

K1, B = 1.5, 0.75
#: scores of queries and chunks that a task holds at once
CELLS = 2_000_000
TOP_K, CANDIDATE_K, THRESHOLD, WEIGHT = 5, 20, 0.3, 0.5
WORD = r"([\p{L}\p{Nd}]+)"
CJK = r"[㐀-䶿一-鿿]"
#: a letter or digit of a word; a document number isn't looked for inside one
IN_WORD = r"[\p{L}\p{Nd}&&[^㐀-䶿一-鿿]]"


def words(c: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.regexp_extract_all(F.lower(c), F.lit(WORD), F.lit(1))


def tokenize(c: Column) -> Column:
    """Words, pairs of neighbouring CJK characters, and document numbers whole besides their pieces. What looks like a
    number inside a longer word (a key in hex digits, say) isn't one: the word is whole already."""
    plain = F.filter(F.regexp_extract_all(F.lower(c), F.lit(r"((?:(?![㐀-䶿一-鿿])[\p{L}\p{Nd}])+)"), F.lit(1)), lambda w: w != "")
    runs = F.regexp_extract_all(c, F.lit(f"({CJK}+)"), F.lit(1))
    pairs = F.flatten(F.transform(runs, lambda r: F.when(F.length(r) < 2, F.array(r)).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(F.length(r) - 1, F.lit(1))), lambda i: F.substring(r, i, F.lit(2))))))
    return F.concat(plain, pairs, F.transform(extract_doc_numbers(c, alone=IN_WORD), F.lower))


def term_counts(chunks: DataFrame, tokens: Callable[[Column], Column] = words, wanted: DataFrame | None = None) -> DataFrame:
    """(kb_id, chunk_id, chunk_len, term, tf, whole) of (kb_id, chunk_id, text): texts are tokenised once.

    A chunk's empty term (whole = 1) carries its length to the statistics, out of the same exchange. With ``wanted``
    (term, and kb_id if it asks by kb) all other terms go before any shuffle.
    """
    own = chunks.select("kb_id", "chunk_id", tokens(F.coalesce("text", F.lit(""))).alias("t"))
    each = own.select("kb_id", "chunk_id", F.size("t").alias("chunk_len"), F.explode(F.concat(F.array(F.lit("")), "t")).alias("term"))
    if wanted is not None:
        keys = [c for c in ("kb_id", "term") if c in wanted.columns]
        named = wanted.select(*(F.col(c).alias(f"_{c}") for c in keys), F.lit(True).alias("_asked")).distinct()
        met = each.join(if_small(named), [each[c] == named[f"_{c}"] for c in keys], "left")
        each = met.where("_asked or term = ''").drop("_asked", *(f"_{c}" for c in keys))
    whole = F.max(F.when(F.col("term") == "", 1).otherwise(0)).alias("whole")
    return each.groupBy("kb_id", "chunk_id", "chunk_len", "term").agg(F.count("*").alias("tf"), whole)


def from_counts(tf: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(postings (kb_id, chunk_id, term, tf, chunk_len, df), stats (kb_id, chunks, avg_len))."""
    # filters and counts are on sums, so that Spark keeps them above the exchange, which all three then read
    stats = tf.where("whole = 1").groupBy("kb_id").agg(F.count_if(F.col("tf") > 0).alias("chunks"), F.avg("chunk_len").alias("avg_len"))
    df = tf.where("whole = 0").groupBy("kb_id", "term").agg(F.count_if(F.col("tf") > 0).alias("df"))
    return tf.where("whole = 0").drop("whole").join(df, ["kb_id", "term"]), stats


def build_bm25(chunks: DataFrame, tokens: Callable[[Column], Column] = words) -> tuple[DataFrame, DataFrame]:
    """All postings and statistics of (kb_id, chunk_id, text)."""
    return from_counts(term_counts(chunks, tokens))


def terms_of(queries: DataFrame, tokens: Callable[[Column], Column] = words) -> DataFrame:
    """The distinct terms of (query_id, text), with kb_id if the queries have one."""
    own = [c for c in ("query_id", "kb_id") if c in queries.columns]
    return queries.select(*own, F.explode(F.array_distinct(tokens(F.coalesce("text", F.lit(""))))).alias("term"))


def idf() -> Column:
    return F.log(1 + (F.col("chunks") - F.col("df") + 0.5) / (F.col("df") + 0.5))


def weight() -> Column:
    return F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("chunk_len") / F.col("avg_len")))


def bm25_search(terms: DataFrame, postings: DataFrame, stats: DataFrame) -> DataFrame:
    """(query_id, kb_id, chunk_id, score) of every chunk that holds a term of (query_id, term).

    Each distinct term counts once a query. Terms with a kb_id are asked of that one, others of all. Postings meet the
    terms by (kb_id, term) or term; a frequent term is split by AQE.
    """
    keys = [c for c in ("kb_id", "term") if c in terms.columns]
    hit = postings.join(if_small(terms), keys).join(if_small(stats), "kb_id")
    return hit.groupBy("query_id", "kb_id", "chunk_id").agg(F.sum(idf() * weight()).alias("score"))


def search_bm25(queries: DataFrame, chunks: DataFrame, tokens: Callable[[Column], Column] = words) -> DataFrame:
    """The same from (query_id, text), with kb_id or for all kbs, and (kb_id, chunk_id, text).

    The terms that are asked and the counts of these terms are written (checkpointed) once each: the texts are read and
    tokenised in one pass, and no posting is made that nobody asks for.
    """
    checkpoint_ready(queries.sparkSession)
    terms = terms_of(queries, tokens).checkpoint()
    tf = term_counts(chunks, tokens, terms.drop("query_id")).checkpoint()
    return bm25_search(terms, *from_counts(tf))


def top_bm25(queries: DataFrame, chunks: DataFrame, k: int = TOP_K, tokens: Callable[[Column], Column] = words, places: int = 9) -> DataFrame:
    """(query_id, kb_id, chunk_id, score, rank): the k best chunks of every kb for (query_id, text), ranked by ``places``.

    The scores are those of ``search_bm25``. A common word of many queries is in most chunks, so chunks times queries times
    shared words are summed: not as rows, but in tasks that hold a chunk's asked terms with their weights and all the
    queries' terms; each batch of chunks gives its k best. Queries with more terms than are broadcast, and queries that
    ask one kb each, go the way of rows.
    """
    terms = terms_of(queries, tokens)
    few = terms.select("query_id", "term").limit(BROADCAST_ROWS + 1).toArrow() if "kb_id" not in queries.columns else None
    if few is None or len(few) > BROADCAST_ROWS:
        return top_k(search_bm25(queries, chunks, tokens), k, per=("query_id", "kb_id"), places=places)
    checkpoint_ready(queries.sparkSession)
    ship(queries.sparkSession)
    tf = term_counts(chunks, tokens, terms.drop("query_id")).checkpoint()
    postings, stats = from_counts(tf)
    weighed = postings.join(if_small(stats), "kb_id").select("kb_id", "chunk_id", F.struct("term", (idf() * weight()).alias("weight")).alias("p"))
    held = weighed.groupBy("kb_id", "chunk_id").agg(F.collect_list("p").alias("p"))
    asked, of = few.column("query_id").combine_chunks().dictionary_encode(), few.column("term").combine_chunks().dictionary_encode()
    ids, known = asked.dictionary, of.dictionary
    by_term = np.argsort(of.indices.to_numpy(), kind="stable")
    query, at = asked.indices.to_numpy()[by_term], np.searchsorted(of.indices.to_numpy()[by_term], np.arange(len(known) + 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = max(1, CELLS // max(len(ids), 1))
        for batch in batches:
            for first in range(0, len(batch), size):
                part = pa.Table.from_batches([batch.slice(first, size)])
                part = part.take(pc.sort_indices(part.select(["kb_id", "chunk_id"]), sort_keys=[("kb_id", "ascending"), ("chunk_id", "ascending")], null_placement="at_start")).combine_chunks()
                hits = part.column("p").combine_chunks()
                term = pc.index_in(hits.flatten().field("term"), value_set=known).to_numpy()
                n = at[term + 1] - at[term]  # the queries of each term
                chunk = np.repeat(np.repeat(np.arange(len(part)), pc.list_value_length(hits).to_numpy()), n)
                own = query[np.repeat(at[term] - np.cumsum(n) + n, n) + np.arange(n.sum())]
                score = np.bincount(own * len(part) + chunk, np.repeat(hits.flatten().field("weight").to_numpy(), n), len(ids) * len(part)).reshape(len(ids), len(part))
                kb = part.column("kb_id").combine_chunks().dictionary_encode().indices.to_numpy()
                edges = np.flatnonzero(np.diff(kb, prepend=-1, append=-1))
                for a, b in zip(edges[:-1], edges[1:], strict=True):
                    row, col = k_best(np.where(score[:, a:b] > 0, np.round(score[:, a:b], places), -np.inf), k)
                    where = pa.array(a + col)
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(row)), part.column("kb_id").combine_chunks().take(where), part.column("chunk_id").combine_chunks().take(where), pa.array(score[row, a + col])], names=["query_id", "kb_id", "chunk_id", "score"])

    kinds = dict(terms.dtypes)["query_id"], dict(held.dtypes)["kb_id"], dict(held.dtypes)["chunk_id"]
    best = held.mapInArrow(run, f"query_id {kinds[0]}, kb_id {kinds[1]}, chunk_id {kinds[2]}, score double")
    return top_k(best, k, per=("query_id", "kb_id"), places=places)


def k_best(score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, columns) of the k best of each row that are finite; of equal ones the first, as many as there is room for."""
    best = min(k, score.shape[1])
    last = np.partition(score, score.shape[1] - best, axis=1)[:, score.shape[1] - best, None]
    tied = score == last
    room = best - (score > last).sum(1, keepdims=True)
    return np.nonzero(((score > last) | (tied & (np.cumsum(tied, axis=1) <= room))) & np.isfinite(score))


def one_dimension(queries: DataFrame, vectors: DataFrame) -> int:
    """The dimension that all vectors have, 0 without any."""
    sizes = [r.n for r in vectors.select(F.size("v").alias("n")).union(queries.select(F.size("v"))).distinct().limit(2).collect()]
    if len(sizes) > 1:
        raise ValueError(f"one collection has vectors of dimensions {sorted(sizes)}")
    return sizes[0] if sizes else 0


def best_pairs(asked: pd.DataFrame, held: pd.DataFrame, k: int) -> pd.DataFrame:
    """The k best (chunk_id, v) of one block for each (query_id, v) of another, by cosine to nine places."""
    out = [pd.DataFrame({"query_id": asked.query_id[:0], "chunk_id": held.chunk_id[:0], "score": np.zeros(0)})]
    if len(asked) and len(held):
        held = held.sort_values("chunk_id")
        v, chunk = np.array(held.v.tolist(), float), held.chunk_id.to_numpy()
        vn = np.linalg.norm(v, axis=1)
        for i in range(0, len(asked), 256):
            ids, q = asked.query_id.to_numpy()[i : i + 256], np.array(asked.v.iloc[i : i + 256].tolist(), float)
            qn = np.linalg.norm(q, axis=1)
            score = np.round((q @ v.T) / np.where(qn > 0, qn, 1)[:, None] / np.where(vn > 0, vn, 1), 9)
            score[:, vn == 0] = -np.inf
            score[qn == 0] = -np.inf
            row, col = k_best(score, k)  # of equal scores the least chunks
            out.append(pd.DataFrame({"query_id": ids[row], "chunk_id": chunk[col], "score": score[row, col]}))
    return pd.concat(out, ignore_index=True)


def vector_search(queries: DataFrame, vectors: DataFrame, k: int = TOP_K, block: int = BLOCK, within: str | None = None) -> DataFrame:
    """(query_id, chunk_id, score): cosine similarity to nine places, the k best of (query_id, v) against (chunk_id, v).

    ``within`` names a column of both: a query is then scored against the vectors of its own value only, say its kb.

    Both sides are dealt in blocks of about ``block``; a task holds one block of each. Without ``within`` every pair of
    blocks is read where it is scored (``blocks.search_blocks``), so nothing but the blocks and the result is written;
    with it the blocks of a value are shuffled to their pairs, each of which keeps its own k best. Scores are rounded
    before they are ranked, so that equal vectors tie. Vectors must have one dimension; zero vectors have no direction
    and take no part.
    """
    dim = one_dimension(queries, vectors)
    if within is None:
        return search_blocks(queries, queries.count(), vectors, vectors.count(), k, dim, block)
    n_asked, n_held = (max(1, -(-x.count() // block)) for x in (queries, vectors))
    kind = dict(queries.dtypes)["query_id"], dict(vectors.dtypes)["chunk_id"]

    def dealt(df: DataFrame, key: str, own: str, n: int, other: str, others: int) -> DataFrame:
        every = F.explode(F.sequence(F.lit(0), F.lit(others - 1))).alias(other)
        return df.select(F.col(within).alias(within), key, F.col("v").cast("array<double>").alias("v"), F.pmod(F.xxhash64(key), F.lit(n)).cast("int").alias(own), every)

    def run(asked: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        return best_pairs(asked, held, k)

    left = dealt(queries, "query_id", "asked", n_asked, "held", n_held).groupBy(within, "asked", "held")
    right = dealt(vectors, "chunk_id", "held", n_held, "asked", n_asked).groupBy(within, "asked", "held")
    return top_k(left.cogroup(right).applyInPandas(run, f"query_id {kind[0]}, chunk_id {kind[1]}, score double"), k)


def top_k(scored: DataFrame, k: int = TOP_K, threshold: float | None = None, per: tuple[str, ...] = ("query_id",), places: int | None = None) -> DataFrame:
    """Adds ``rank``: per query the k best by score, ties by chunk, none below the threshold.

    With ``places`` scores that are equal to so many places tie; the scores themselves stay as they are.
    """
    score = F.col("score") if places is None else F.round("score", places)
    rank = F.row_number().over(Window.partitionBy(*per).orderBy(score.desc(), "chunk_id"))
    own = scored if threshold is None else scored.where(F.col("score") >= threshold)
    return own.withColumn("rank", rank).where(F.col("rank") <= k)


def fuse(vector: DataFrame, keyword: DataFrame, k: int = TOP_K, candidate_k: int = CANDIDATE_K, threshold: float = THRESHOLD, weight: float = WEIGHT) -> DataFrame:
    """The candidates of both lists (query_id, chunk_id, score), fused, sorted, cut at threshold and k.

    weight * cosine in [0, 1] + (1 - weight) * BM25 / the query's best BM25.
    """
    if k > candidate_k:
        raise ValueError("top_k must not exceed candidate_k")
    best = F.max("score").over(Window.partitionBy("query_id"))
    a = top_k(vector, candidate_k).select("query_id", "chunk_id", F.greatest(F.least("score", F.lit(1.0)), F.lit(0.0)).alias("a"))
    b = top_k(keyword, candidate_k).withColumn("b", F.col("score") / best).select("query_id", "chunk_id", "b")
    score = weight * F.coalesce("a", F.lit(0.0)) + (1 - weight) * F.coalesce("b", F.lit(0.0))
    return top_k(a.join(b, ["query_id", "chunk_id"], "full_outer").select("query_id", "chunk_id", score.alias("score")), k, threshold)


def retrieve(mode: str, vector: DataFrame | None, keyword: DataFrame | None, k: int = TOP_K, candidate_k: int = CANDIDATE_K, threshold: float = THRESHOLD) -> DataFrame:
    """vector, keyword or hybrid. Scores of keyword mode are shares of the query's best."""
    if mode == "vector":
        return top_k(vector, k, threshold)
    if mode == "keyword":
        best = F.max("score").over(Window.partitionBy("query_id"))
        return top_k(keyword.withColumn("score", F.col("score") / best), k, threshold)
    if mode == "hybrid":
        return fuse(vector, keyword, k, candidate_k, threshold)
    raise ValueError(f"unknown mode {mode!r}: vector, keyword, hybrid")


def rerank(hits: DataFrame, scores: DataFrame, k: int = TOP_K) -> DataFrame:
    """Hits in the order of a reranker's scores, cut to k; a missing score is an error."""
    own = hits.drop("score", "rank").join(scores.select("query_id", "chunk_id", F.col("score").alias("_s")), ["query_id", "chunk_id"], "left")
    checked = F.when(F.col("_s").isNotNull(), F.col("_s")).otherwise(F.raise_error(F.concat(F.lit("no rerank score for "), F.col("query_id").cast("string"), F.lit("/"), F.col("chunk_id").cast("string"))).cast("double"))
    return top_k(own.withColumn("score", checked).drop("_s"), k)


def reachability(questions: DataFrame, hits: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(question_id, outcome, best_score, best_chunk, nearest): hit, low_score or no_candidate; without questions one
    row with outcome not_run."""
    # the three best are chosen before anything is gathered
    first = F.array_sort(F.collect_list(F.struct("rank", "chunk_id", "score")))
    own = top_k(hits.select("query_id", "chunk_id", "score"), 3).groupBy("query_id").agg(first.alias("first"))
    own = own.select("query_id", F.col("first")[0]["score"].alias("best_score"), F.col("first")[0]["chunk_id"].alias("best_chunk"), F.transform("first", lambda x: x["chunk_id"]).alias("nearest"))
    outcome = F.when(F.col("best_score").isNull(), "no_candidate").when(F.col("best_score") < threshold, "low_score").otherwise("hit")
    out = questions.select(F.col("query_id")).join(own, "query_id", "left").select(F.col("query_id").alias("question_id"), outcome.alias("outcome"), "best_score", "best_chunk", F.coalesce("nearest", F.array().cast(f"array<{dict(hits.dtypes)['chunk_id']}>")).alias("nearest"))
    spark = questions.sparkSession
    none = spark.range(1).join(questions.limit(1).select(F.lit(1).alias("_x")), F.lit(True), "left_anti").select(F.lit(None).cast(dict(out.dtypes)["question_id"]).alias("question_id"), F.lit("not_run").alias("outcome"), F.lit(None).cast("double").alias("best_score"), F.lit(None).cast(dict(out.dtypes)["best_chunk"]).alias("best_chunk"), F.array().cast(dict(out.dtypes)["nearest"]).alias("nearest"))
    return out.unionByName(none)


# --- plug-ins ---


def embed_texts(df: DataFrame, embed: Callable[[list[str]], list[list[float]]], batch_size: int = 64, text: str = "text") -> DataFrame:
    """Adds ``v``: vectors of the caller's model, in order. Blank text, a wrong number of vectors, an empty vector or
    another dimension is an error; an empty batch isn't sent."""
    schema = T.StructType([*df.schema.fields, T.StructField("v", T.ArrayType(T.FloatType()))])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        dim = None
        for frame in frames:
            for i in range(0, len(frame), batch_size):
                part = frame.iloc[i : i + batch_size].copy()
                texts = part[text].tolist()
                if any(t is None or not t.strip() for t in texts):
                    raise ValueError("a blank text can't be embedded")
                vectors = embed(texts)
                if len(vectors) != len(texts):
                    raise ValueError(f"{len(texts)} texts gave {len(vectors)} vectors")
                for v in vectors:
                    dim = len(v) if dim is None else dim
                    if not v or len(v) != dim:
                        raise ValueError("vectors are empty or differ in dimension")
                part["v"] = [list(map(float, v)) for v in vectors]
                yield part

    return df.mapInPandas(run, schema)


def ingest(index: DataFrame, documents: DataFrame) -> DataFrame:
    """An index (kb_id, source, ...) after documents of the same columns came in: those of a source replace its old ones."""
    return index.join(documents.select("kb_id", "source").distinct(), ["kb_id", "source"], "left_anti").unionByName(documents.select(index.columns))


def delete(index: DataFrame, sources: DataFrame) -> DataFrame:
    """An index without the rows of (kb_id, source)."""
    return index.join(sources.select("kb_id", "source").distinct(), ["kb_id", "source"], "left_anti")


@dataclass(frozen=True)
class Kernel:
    """What callers use of a knowledge base, whatever stands behind it: functions of DataFrames. Calling it retrieves."""

    retrieve: Callable[..., DataFrame]
    ingest: Callable[[DataFrame, DataFrame], DataFrame] = ingest
    delete: Callable[[DataFrame, DataFrame], DataFrame] = delete

    def __call__(self, **inputs) -> DataFrame:
        return self.retrieve(**inputs)


KERNELS: dict[str, Kernel] = {}


def register_kernel(name: str, kernel: Kernel | Callable[..., DataFrame]) -> None:
    KERNELS[name] = kernel if isinstance(kernel, Kernel) else Kernel(kernel)


def get_kernel(name: str) -> Kernel:
    """A kernel by name; an unknown name fails at once."""
    if name == "graph":
        raise NotImplementedError("the graph kernel is not enabled")
    if name not in KERNELS:
        raise KeyError(f"no kernel {name!r}; there are {', '.join(sorted(KERNELS))}")
    return KERNELS[name]


register_kernel("vector", lambda **x: retrieve("vector", x["vector"], None))
register_kernel("keyword", lambda **x: retrieve("keyword", None, x["keyword"]))
register_kernel("hybrid", lambda **x: retrieve("hybrid", x["vector"], x["keyword"]))
