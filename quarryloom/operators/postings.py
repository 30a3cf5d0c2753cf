"""A stored index for keyword search: blocks of postings with their bounds, in folders by bucket of the term.

A row is a term's postings in one block of chunks: kb_id, term, batch, block, n (postings), most_tf, least_len, words
(sum of the chunks' lengths), hits (chunk_id, tf, chunk_len), bucket. The empty term stands in every chunk; its rows give
the number of chunks and their mean length, so that adding a batch of chunks only appends rows. A block has some ``block``
chunks of one batch, the same ones for every term, whatever the size of the table.

A search reads the buckets of its terms. It looks at bounds first (column pruning leaves the postings on disk): a block's
score for a query is at most the sum of its terms' weights at ``most_tf`` and ``least_len``. The k blocks with the greatest
bounds hold k chunks at least and are scored; what these reach rules out every block whose bound is lower, and only the
others are scored. So results are those of scoring everything.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import checkpoint_ready
from .retrieval import B, K1, TOP_K, term_counts, terms_of, top_k, words
from .small import if_small

BUCKETS, BLOCK = 64, 16
PLACE = ["kb_id", "batch", "block"]
#: scores are ranked by nine places; a bound must be lower by more than that and the noise of a sum to rule a block out
PLACES, SLACK = 9, 1e-8


def bucket_of(term: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def add_to_index(chunks: DataFrame, path: str, tokens: Callable[[Column], Column] = words, buckets: int = BUCKETS, block: int = BLOCK) -> None:
    """Appends the postings of a batch of (kb_id, chunk_id, text) to the index at ``path``, which is made if need be.

    Rows without a kb are left out; a null text has no words but counts as a chunk. The chunks of a batch are new ones:
    nothing is replaced. ``buckets`` must stay the same for one index. An empty batch adds nothing.
    """
    own = chunks.where("kb_id is not null").select("kb_id", "chunk_id", "text")
    sizes = own.groupBy("kb_id").agg(F.ceil(F.count("*") / block).alias("blocks"))
    tf = term_counts(own, tokens).join(if_small(sizes), "kb_id")
    tf = tf.withColumn("block", F.pmod(F.xxhash64("chunk_id"), F.col("blocks")).cast("int"))
    hit = F.struct("chunk_id", F.col("tf").cast("int").alias("tf"), "chunk_len")
    rows = tf.groupBy("kb_id", "term", "block").agg(
        F.count("*").alias("n"), F.max("tf").alias("most_tf"), F.min("chunk_len").alias("least_len"), F.sum("chunk_len").alias("words"), F.array_sort(F.collect_list(hit)).alias("hits")
    )
    rows = rows.withColumn("batch", F.lit(uuid.uuid4().hex)).withColumn("bucket", bucket_of(F.col("term"), buckets))
    # files of even size, large buckets in several, small ones together
    rows.hint("rebalance", "bucket").sortWithinPartitions("bucket", "term", "kb_id").write.partitionBy("bucket").mode("append").parquet(path)


def read_index(spark: SparkSession, path: str, chunk_id: str = "long") -> DataFrame:
    """An index whose kb_id is a string; one to which nothing was added has no rows."""
    hit = f"struct<chunk_id: {chunk_id}, tf: int, chunk_len: int>"
    return spark.read.schema(f"kb_id string, term string, block int, n long, most_tf long, least_len int, words long, hits array<{hit}>, batch string, bucket int").parquet(path)


def buckets_of(index: DataFrame, terms: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """The part of an index that terms can be in: at most ``buckets`` numbers come to the driver."""
    asked = [r.b for r in terms.select(bucket_of(F.col("term"), buckets).alias("b")).distinct().collect()]
    return index.where(F.col("bucket").isin(asked))


def statistics(index: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(kb_id, chunks, avg_len), from the rows of the empty term."""
    whole = index.where((F.col("bucket") == bucket_of(F.lit(""), buckets)) & (F.col("term") == ""))
    return whole.groupBy("kb_id").agg(F.sum("n").alias("chunks"), (F.sum("words") / F.sum("n")).alias("avg_len"))


def weight(tf: str, length: str) -> Column:
    return F.col(tf) * (K1 + 1) / (F.col(tf) + K1 * (1 - B + B * F.col(length) / F.col("avg_len")))


def bounded_lists(terms: DataFrame, index: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(query_id, kb_id, term, batch, block, idf, avg_len, upper): the blocks that hold a term, with what it adds at most."""
    keys = [c for c in ("kb_id", "term") if c in terms.columns]
    heads = buckets_of(index, terms, buckets).select(*PLACE, "term", "n", "most_tf", "least_len")
    met = heads.join(if_small(terms.select(*keys).distinct()), keys)
    df = met.groupBy("kb_id", "term").agg(F.sum("n").alias("df"))
    idf = F.log(1 + (F.col("chunks") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf")
    of_term = df.join(if_small(statistics(index, buckets)), "kb_id").select("kb_id", "term", "avg_len", idf)
    lists = met.join(of_term, ["kb_id", "term"]).withColumn("upper", F.col("idf") * weight("most_tf", "least_len"))
    return lists.join(if_small(terms), keys).select("query_id", *PLACE, "term", "idf", "avg_len", "upper")


def scored(lists: DataFrame, which: DataFrame, postings: DataFrame) -> DataFrame:
    """(query_id, kb_id, chunk_id, score) of every chunk in the blocks ``which`` (query_id, kb_id, batch, block)."""
    needed = lists.join(which.select("query_id", *PLACE), ["query_id", *PLACE]).select("query_id", *PLACE, "term", "idf", "avg_len")
    hits = needed.join(postings.select(*PLACE, "term", "hits"), [*PLACE, "term"]).select("query_id", "kb_id", "idf", "avg_len", F.inline("hits"))
    return hits.groupBy("query_id", "kb_id", "chunk_id").agg(F.sum(F.col("idf") * weight("tf", "chunk_len")).alias("score"))


def split_blocks(lists: DataFrame, postings: DataFrame, k: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(scores of the first blocks, the other blocks that can still matter, all blocks), per query and kb."""
    blocks = lists.groupBy("query_id", *PLACE).agg(F.sum("upper").alias("upper"))
    order = F.row_number().over(Window.partitionBy("query_id", "kb_id").orderBy(F.desc("upper"), "batch", "block"))
    first = blocks.withColumn("place", order).where(F.col("place") <= k)
    scores = scored(lists, first, postings).checkpoint()
    reached = top_k(scores, k, per=("query_id", "kb_id"), places=PLACES).groupBy("query_id", "kb_id").agg(F.min("score").alias("reached"))
    rest = blocks.join(first.select("query_id", *PLACE), ["query_id", *PLACE], "left_anti")
    return scores, rest.join(if_small(reached), ["query_id", "kb_id"]).where(F.col("upper") + SLACK >= F.col("reached")), blocks


def search_index(queries: DataFrame, index: DataFrame, k: int = TOP_K, tokens: Callable[[Column], Column] = words, buckets: int = BUCKETS) -> DataFrame:
    """(query_id, kb_id, chunk_id, score, rank): the k best, by nine places, chunks of every kb for (query_id, text).

    Queries with a kb_id ask that one. A query without a term that a kb holds has no rows there; ties go to the lesser chunk.
    """
    checkpoint_ready(queries.sparkSession)
    terms = terms_of(queries, tokens).checkpoint()
    lists = bounded_lists(terms, index, buckets).checkpoint()
    postings = buckets_of(index, terms, buckets)
    scores, rest, _ = split_blocks(lists, postings, k)
    return top_k(scores.unionByName(scored(lists, rest, postings)), k, per=("query_id", "kb_id"), places=PLACES)
