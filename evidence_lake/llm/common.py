"""Helpers shared by the training-data operators: columns, shared storage, partition counts."""

from __future__ import annotations

import ctypes
import gc
import re
import sys
import tempfile
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"


#: Arrow batches for Python workers hold about so many bytes at most (and a row at least).
BATCH_BYTES = 8 << 20
BATCH_CONF = "spark.sql.execution.arrow.maxBytesPerBatch"
#: Tables of one long a row (keys) are broadcast up to so many rows: 16 MB, counted before.
BROADCAST_ROWS = 1_000_000


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Where it is unset, a session of one process (tests) gets a temporary one; on a cluster that is an error."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="evidence_lake_")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def staged(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Write df as Parquet into the shared folder and read it back.

    This cuts the lineage durably: a lost executor costs no recomputation, and what a task wrote
    once (row positions, random choices) stays as it is.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_in = path
    return out


def released(*frames: DataFrame) -> None:
    """Delete staged tables that no later step reads."""
    for df in frames:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._staged_in)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def trim() -> None:
    """Memory that nothing uses goes back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def _tidied(batches, f: Callable, encodes: bool):
    """f's batches. Workers stay for later stages: one that turns to other work drops its tokenizers, and after a task unused memory is given back."""
    tokens = sys.modules.get("evidence_lake.llm.tokens")
    if tokens and not encodes and tokens.LOADED:
        tokens.LOADED.clear()
        trim()
    try:
        yield from f(batches)
    finally:
        trim()


def in_arrow(df: DataFrame, f: Callable, schema, encodes: bool = False) -> DataFrame:
    """df.mapInArrow(f, schema) with batches bounded by bytes, and with tidy workers; `encodes`: f uses tokenizers."""
    conf = df.sparkSession.conf
    if int(conf.get(BATCH_CONF).rstrip("b")) > BATCH_BYTES:
        conf.set(BATCH_CONF, str(BATCH_BYTES))
    return df.mapInArrow(lambda batches: _tidied(batches, f, encodes), schema)


def words(text: Column) -> Column:
    """Array of the words of a text; empty for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), GAP), lambda w: w != "")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def by_id(df: DataFrame, id_col: str, *cols: str) -> DataFrame:
    """Only the named columns, under names of our own, so that extra columns can't clash."""
    return df.select(F.col(id_col).alias("doc_id"), *[F.col(c).alias(c) for c in cols])
