"""A training-data pipeline: language ID, line dedup, near-duplicate removal, source mixing, packing."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidence_lake.llm import tokens
from evidence_lake.llm.common import shared_dir, staged
from evidence_lake.llm.op2_packing import pack
from evidence_lake.llm.op3_minhash import near_duplicate_rows
from evidence_lake.llm.op4_language import UNKNOWN, fit, held_out, identify, is_typical, known_shares, learned
from evidence_lake.llm.op5_lines import NOT_BLANK, without_lines
from evidence_lake.llm.op9_mixing import mixed_rows

#: Texts whose best language has a smaller share of the likelihood are rejected.
LEAST_SCORE = 0.5
#: Texts are rejected whose share of known words is under this part of what is usual in their language.
LEAST_KNOWN = 0.5


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with letters and a clear language whose words they hold; gibberish and languages not learned go. The columns stay as they are.

    The model is of all labelled documents but those held out, what is usual of all held-out ones; a document's own words count as known only if others have them.
    """
    text, lang = F.col("text").cast("string"), F.col("lang").cast("string")
    rows = docs.select(
        F.monotonically_increasing_id().alias("row_key"),
        text.alias("text"),
        F.when(learned(F.col("doc_id"), text, lang), lang).alias("own"),
        F.when(held_out(F.col("doc_id")), lang).alias("checked"),
    )
    judged = staged(identify(rows, fit(docs), carry=["row_key", "checked"], own_col="own", counted=True), "language_id")
    least = F.coalesce("share", F.lit(0.0)) * LEAST_KNOWN
    known = judged.join(F.broadcast(known_shares(judged, "checked")), "lang_pred", "left")
    kept = (F.col("lang_pred") != UNKNOWN) & (F.col("score") >= LEAST_SCORE) & is_typical(F.col("n_pieces"), F.col("n_known"), least)
    own = docs.select(F.monotonically_increasing_id().alias("row_key"), F.struct(*docs.columns).alias("row"))
    return own.join(known.where(~kept).select("row_key"), "row_key", "left_anti").select("row.*")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that an earlier document has, exactly or (long lines) but for one edit; n_chars follows."""
    out = without_lines(docs, least_repeat=NOT_BLANK)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates: that of the smallest doc_id (null last), then the first."""
    gone = near_duplicate_rows(docs).where("NOT first").select("row_key")
    own = docs.select(F.monotonically_increasing_id().alias("row_key"), F.struct(*docs.columns).alias("row"))
    return own.join(gone, "row_key", "left_anti").select("row.*")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixed_rows(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 2048 ids."""
    return pack(docs, tokens.default_path())


STAGES = [
    ("language ID", language_id),
    ("line dedup", line_dedup),
    ("MinHash near-dedup", near_dedup),
    ("mixing sources", mix_sources),
    ("packing", packing),
]

#: SQL can't express line dedup's neighbourhoods, the cube method or the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet and read again."""
    top = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs.write.option("compression", "zstd").parquet(f"{top}/{i}")
            docs = spark.read.parquet(f"{top}/{i}")
    return docs
