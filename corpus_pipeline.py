"""The corpus pipeline: quality, language, near-duplicates, repeated passages, packing.

Each stage takes what its predecessor kept and returns the columns of ``documents``; the last returns the packed
pieces. ``run`` applies them to the documents of a folder and cuts the lineage after each stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryloom.llm import op1_near_dedup, op2_substring_dedup, op3_packing, op5_quality, op7_language_id
from quarryloom.llm.common import checkpoint_ready, table

#: a document is rejected below this score of its language
MIN_LANGUAGE_SCORE = 0.4


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score reaches the threshold stay as they are."""
    return op5_quality.keep(docs, op5_quality.train(docs, table(spark, sf_dir, "labels")), op5_quality.THRESHOLD)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a known language stay as they are; those without a letter, or of no language clearly, go."""
    return op7_language_id.keep(docs, op7_language_id.fit(op7_language_id.training_rows(docs)), MIN_LANGUAGE_SCORE)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near-duplicates the document with the least id stays, once.

    Rows count by id and text: of rows with one id those of other classes stay. A null id stays, once a text, if no row
    with an id has its class.
    """
    rows = op1_near_dedup.near_classes(docs).where("doc_id <=> class_id").groupBy("group", "doc_id", "version").count()
    # an id may stand for several texts of a class; null ids have no class but their text
    alone = F.when(F.col("group").isNull(), F.col("version"))
    stays = rows.groupBy("group", alone.alias("alone")).agg(F.min(F.struct("version", "doc_id", "count")).alias("row"))
    stays = stays.select(F.col("row.doc_id").alias("stays_id"), F.col("row.version").alias("stays_version"), F.col("row.count").alias("stays_rows")).checkpoint()
    kept = docs.join(stays, docs["doc_id"].cast("long").eqNullSafe(stays["stays_id"]) & (F.xxhash64(docs["text"]) == stays["stays_version"]), "left_semi")
    return kept if stays.where("stays_rows > 1").isEmpty() else kept.dropDuplicates(["doc_id", "text"])


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that a smaller document holds go; a text that loses none stays as it is, white space included."""
    out = op2_substring_dedup.remove_repeats(docs, carry=docs.columns)
    text = F.when(F.col("n_removed") == 0, F.col("carried.text")).otherwise(F.col("kept"))
    own = {"text": text, "n_chars": F.length(text).cast("long")}
    of = lambda c: F.col("carried").getField(c)
    return out.select([own.get(c, of(c)).alias(c) for c in docs.columns])


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of at most 2048 tokens."""
    import public_tokenizers

    return op3_packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality_classifier", quality),
    ("language_id", language),
    ("near_dedup", near_duplicates),
    ("substring_dedup", repeated_passages),
    ("packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of all documents that stay."""
    checkpoint_ready(spark)
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stage(spark, docs, sf_dir).checkpoint()
    return STAGES[-1][1](spark, docs, sf_dir)


#: fitted models and packing are no SQL; tests hold the stages against brute force
ORACLE_SQL = None
