"""Answers with sources and attachments, and their evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MAX_QUESTION = 4000


def validate_questions(questions: DataFrame, most: int = MAX_QUESTION) -> DataFrame:
    """Adds ``error``: null for a question that may be passed on."""
    text = F.trim(F.coalesce("text", F.lit("")))
    return questions.withColumn("error", F.when(text == "", "empty question").when(F.length("text") > most, F.format_string("question has %d characters, at most %d", F.length("text"), F.lit(most))))


def answer_attachments(hits: DataFrame) -> DataFrame:
    """(question_id, attachments): each once, in order of rank, an empty array if there is none."""
    own = hits.groupBy("question_id").agg(F.array_sort(F.collect_list(F.struct("rank", "attachments"))).alias("h"))
    return own.select("question_id", F.array_distinct(F.flatten(F.transform("h", lambda x: F.coalesce(x["attachments"], F.array().cast("array<string>"))))).alias("attachments"))


def assemble_answers(questions: DataFrame, hits: DataFrame, used: DataFrame, indexed: DataFrame, near: DataFrame | None = None) -> DataFrame:
    """One row a question (question_id, kb_id): status, sources, attachments, nearest, error.

    hits (question_id, rank, chunk_id, title, source, attachments) above the threshold; used (question_id, chunk_id)
    names those that the answer rests on; indexed (kb_id). Without hits it is refused, with the nearest candidates
    (question_id, rank, source) shown; a knowledge base without an index is an error.
    """
    cited = hits.join(used, ["question_id", "chunk_id"], "left_semi")
    sources = cited.groupBy("question_id").agg(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("rank", "title", "source"))), lambda x: F.concat_ws(" | ", x["title"], x["source"]))).alias("sources"))
    out = questions.select("question_id", "kb_id").join(indexed.select("kb_id", F.lit(True).alias("_indexed")).distinct(), "kb_id", "left").join(sources, "question_id", "left").join(answer_attachments(cited), "question_id", "left")
    if near is not None:
        turn = F.row_number().over(Window.partitionBy("question_id").orderBy("rank", "source"))
        few = near.select("question_id", "rank", "source").withColumn("_turn", turn).where("_turn <= 3")
        shown = few.groupBy("question_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("_turn", "source"))), lambda x: x["source"]).alias("nearest"))
        out = out.join(shown, "question_id", "left")
    else:
        out = out.withColumn("nearest", F.lit(None).cast("array<string>"))
    empty = F.array().cast("array<string>")
    status = F.when(F.col("_indexed").isNull(), "error").when(F.col("sources").isNull(), "refused").otherwise("answered")
    ok = status == "answered"
    return out.select(
        "question_id", "kb_id", status.alias("status"), F.when(ok, F.col("sources")).otherwise(empty).alias("sources"), F.when(ok, F.coalesce("attachments", empty)).otherwise(empty).alias("attachments"),
        F.when(status == "refused", F.coalesce("nearest", empty)).otherwise(empty).alias("nearest"), F.when(status == "error", F.concat(F.lit("no index for "), F.col("kb_id"))).alias("error"),
    )


def validate_cases(cases: DataFrame) -> DataFrame:
    """(case_id, field) of what is missing. Evaluate only if this is empty."""
    bad = F.filter(F.array(F.when(F.trim(F.coalesce("question", F.lit(""))) == "", "question"), F.when(F.size(F.coalesce("points", F.array().cast("array<string>"))) == 0, "points")), lambda x: x.isNotNull())
    return cases.select("case_id", F.explode(bad).alias("field"))


def merge_cases(cases: DataFrame, edits: DataFrame) -> DataFrame:
    """Cases with edited questions; an edited synthetic case is a human's. ``note`` marks a set that is all synthetic."""
    own = cases.join(edits.select("case_id", F.col("question").alias("_edit")), "case_id", "left")
    merged = own.withColumn("origin", F.when(F.col("_edit").isNotNull(), "human").otherwise(F.col("origin"))).withColumn("question", F.coalesce("_edit", "question")).drop("_edit")
    every = merged.agg(F.bool_and(F.col("origin") == "synthetic").alias("_all"))
    return merged.crossJoin(F.broadcast(every)).withColumn("note", F.when(F.col("_all"), "relative comparison only")).drop("_all")


def append_cases(path: str, trial: DataFrame) -> None:
    """Adds cases made of trial answers (case_id, question, points, ...) to a case set."""
    trial.withColumn("origin", F.lit("human")).write.mode("append").parquet(path)


def context_recall(cases: DataFrame, sources: DataFrame, hits: DataFrame) -> DataFrame:
    """(case_id, recall): share of the expected sources among the hits (case_id, source); null if none is expected.

    A case (case_id, label) expects the sources (source, label) of its label. These are counted and joined to the
    hits, never listed.
    """
    own = sources.select("label", "source").distinct()
    n = own.groupBy("label").agg(F.count("*").alias("n"))
    found = hits.select("case_id", "source").distinct().join(cases, "case_id").join(own, ["label", "source"]).groupBy("case_id").agg(F.count("*").alias("found"))
    return cases.join(n, "label", "left").join(found, "case_id", "left").select("case_id", F.when(F.col("n") > 0, F.coalesce("found", F.lit(0)) / F.col("n")).alias("recall"))


def attachment_hits(cases: DataFrame, answers: DataFrame) -> DataFrame:
    """(case_id, ok, missing, returned): whether all expected attachments were returned."""
    empty = F.array().cast("array<string>")
    own = cases.join(answers.select("case_id", "attachments"), "case_id", "left")
    returned, want = F.coalesce("attachments", empty), F.coalesce("expected_attachments", empty)
    missing = F.array_sort(F.array_except(want, returned))
    return own.select("case_id", (F.size(missing) == 0).alias("ok"), missing.alias("missing"), F.array_sort(returned).alias("returned"))


def eval_report(scores: DataFrame) -> DataFrame:
    """(metric, value, cases): the mean of (case_id, metric, value)."""
    return scores.groupBy("metric").agg(F.avg("value").alias("value"), F.count("value").alias("cases"))


def failing_cases(scores: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Cases below their metric's threshold, lowest first in a sort by value."""
    return scores.join(F.broadcast(thresholds), "metric").where(F.col("value") < F.col("threshold"))


def eval_gate(report: DataFrame, thresholds: DataFrame) -> DataFrame:
    """One row: passed only if every metric with a threshold reaches it; the names of those below, in order."""
    own = thresholds.join(report, "metric", "left").withColumn("ok", F.coalesce(F.col("value") >= F.col("threshold"), F.lit(False)))
    return own.agg(F.bool_and("ok").alias("passed"), F.array_sort(F.collect_list(F.when(~F.col("ok"), F.col("metric")))).alias("below"))
