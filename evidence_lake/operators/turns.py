"""Answers with retries: rounds over the papers that are open, each with the history of its own failed turns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidence_lake.functions import answers

MESSAGES = "array<struct<role:string,content:string>>"
SAMPLES = "array<struct<attempt:int,n_messages:int,completion:string,parsed_ok:boolean>>"
CORRECTION = "The answer could not be read. Answer again with one JSON object that follows the schema, and nothing else."

Generator = Callable[[DataFrame, int], DataFrame]


def canned(responses: DataFrame) -> Generator:
    """A generator that looks answers (paper_id, attempt, raw) up; a missing or null one is a failed generation."""
    return lambda open_, attempt: open_.select("paper_id").join(responses.where(F.col("attempt") == attempt).select("paper_id", "raw"), "paper_id")


def message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def retried(papers: DataFrame, generate: Generator, most: int = 3, valid: Callable[[Column], Column] | None = None, correction: str = CORRECTION, keep: Callable[[DataFrame, str], DataFrame] | None = None) -> DataFrame:
    """paper_id, attempt, raw, messages, samples of every paper (paper_id, messages).

    In each of at most `most` rounds the open papers get an answer. One that reads (`valid`) closes its paper. One
    that doesn't is recorded as a sample and, but for the last round, goes onto the history as an assistant turn with
    a correcting user turn. A generation that fails takes its round and leaves no sample. Papers without a
    valid answer have a null attempt and their last answer as raw. With `keep` (a DataFrame and a name to a stored
    DataFrame) each round's answers are generated once.
    """
    valid = valid or (lambda raw: answers.parsed(raw).isNotNull())
    empty = F.array().cast(SAMPLES)
    open_ = papers.select("paper_id", F.col("messages").cast(MESSAGES).alias("messages"), F.lit(None).cast("string").alias("raw"), empty.alias("samples"))
    closed = None
    for attempt in range(1, most + 1):
        found = generate(open_.select("paper_id", "messages"), attempt).select("paper_id", F.col("raw").alias("new"))
        told = open_.join(found, "paper_id", "left").withColumn("ok", F.when(F.col("new").isNotNull(), F.coalesce(valid(F.col("new")), F.lit(False))))
        if keep:
            told = keep(told, f"round-{attempt}")
        sample = F.struct(F.lit(attempt).alias("attempt"), F.size("messages").alias("n_messages"), F.col("new").alias("completion"), F.col("ok").alias("parsed_ok"))
        samples = F.when(F.col("ok").isNotNull(), F.concat("samples", F.array(sample))).otherwise(F.col("samples")).cast(SAMPLES)
        raw = F.coalesce("new", "raw")
        good = told.where("ok").select("paper_id", F.lit(attempt).alias("attempt"), raw.alias("raw"), "messages", samples.alias("samples"))
        closed = good if closed is None else closed.unionByName(good)
        more = F.concat("messages", F.array(message("assistant", F.col("new")), message("user", F.lit(correction))))
        history = F.when(F.col("ok").isNotNull(), more).otherwise(F.col("messages")) if attempt < most else F.col("messages")
        open_ = told.where("ok IS NULL OR NOT ok").select("paper_id", history.cast(MESSAGES).alias("messages"), raw.alias("raw"), samples.alias("samples"))
    return closed.unionByName(open_.select("paper_id", F.lit(None).cast("int").alias("attempt"), "raw", "messages", "samples"))
