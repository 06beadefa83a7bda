"""Packing by concatenate and cut.

Pass one tokenises every document once and writes, for each partition, the ids and each document's
offset inside that partition. The partitions' totals (one row a task) are summed up to global
offsets. Pass two cuts the one long stream into fixed windows, without any shuffle of ids.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evidence_lake.llm import tokens
from evidence_lake.llm.common import documents, in_arrow, staged

SEQUENCE_TOKENS = 2048
STAGED = "part long, doc_id long, at long, n long, ids binary"


def tokenised(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """part, doc_id, at (ids before it in its part), n, ids (little-endian uint32): a staged table."""

    def run(batches):
        part, at = TaskContext.get().partitionId(), 0
        for rows, ids, size in tokens.encoded(batches, path):
            ends = np.cumsum(size)
            raw = pa.py_buffer(ids.astype("<u4").tobytes())
            edge = np.zeros(len(size) + 1, np.int32)
            edge[1:] = ends * 4
            blob = pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(edge.tobytes()), raw])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(size), part, np.int64)), rows.column("doc_id"), pa.array(at + ends - size), pa.array(size), blob],
                names=["part", "doc_id", "at", "n", "ids"],
            )
            at += int(ends[-1])

    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return staged(own.transform(in_arrow, run, STAGED, encodes=True), "tokenised")


def global_offsets(parts: DataFrame) -> DataFrame:
    """part, base: ids in the parts before it. One row a task of pass one; only these counts reach the driver."""
    totals = parts.groupBy("part").agg(F.sum("n").alias("total")).orderBy("part").toPandas()
    totals["base"] = totals["total"].cumsum() - totals["total"]
    return parts.sparkSession.createDataFrame(
        [(int(p), int(b)) for p, b in zip(totals["part"], totals["base"])], "part long, base long"
    )


def pack(docs: DataFrame, path: str, length: int = SEQUENCE_TOKENS, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset; `ids` (binary) too on demand.

    Every document's ids (end id included) fill consecutive places of the stream; each window of
    `length` places is one sequence, so only the last can be short and no place is padding but in it.
    Null or empty text: the end id alone. Null or repeated doc_id: each row is a document of its own.
    Empty table: no rows. Extra columns are ignored.
    """
    rows = tokenised(docs, path, id_col, text_col)
    base = global_offsets(rows)
    first = F.col("g")
    last = F.col("g") + F.col("n") - 1

    def piece(s: Column) -> Column:
        start = F.greatest(F.lit(0).cast("long"), s * length - first)
        many = F.least(F.col("n"), (s + 1) * length - first) - start
        cut = F.col("ids").substr((start * 4 + 1).cast("int"), (many * 4).cast("int"))
        fields = [
            start.alias("start"),
            many.alias("length"),
            F.crc32(cut).alias("ids_crc32"),
            s.alias("sequence_id"),
            (first + start - s * length).alias("offset"),
        ]
        return F.struct(*fields, *([cut.alias("ids")] if with_ids else []))

    pieces = F.transform(F.sequence(F.floor(first / length), F.floor(last / length)), piece)
    return (
        rows.join(F.broadcast(base), "part")
        .withColumn("g", F.col("base") + F.col("at"))
        .select("doc_id", F.col("n").alias("doc_tokens"), F.explode(pieces).alias("p"))
        .select("doc_id", "p.start", "p.length", "p.ids_crc32", "doc_tokens", "p.sequence_id", "p.offset", *(["p.ids"] if with_ids else []))
    )


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir), tokens.default_path())
