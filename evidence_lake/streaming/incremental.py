"""Incremental indexing: new files as a stream, upserted into a store batch by batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from evidence_lake.operators import deltas
from evidence_lake.operators.index import Store


def file_stream(spark: SparkSession, path: str, schema: str, kind: str = "parquet", files_a_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).format(kind).load(path)


def index_stream(rows: DataFrame, store: Store, build: Callable[[DataFrame], DataFrame], checkpoint: str, key: str = "id") -> StreamingQuery:
    """Builds points of each batch and upserts them; a batch that is run again writes the same rows.

    The last batch wins for an id, and inside a batch the last of its rows by `seq`.
    """

    def write(batch: DataFrame, number: int) -> None:
        points = build(batch).withColumn("batch", F.lit(number).cast("long"))
        store.upsert(points.withColumn("seq", F.col("seq").cast("long") + F.lit(number << 40)))

    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def delta_stream(rows: DataFrame, index: deltas.DeltaIndex, build: Callable[[DataFrame], DataFrame], checkpoint: str, name: str = "stream", dims: int | None = None, compact_every: int = 10) -> StreamingQuery:
    """Builds rows of each batch's documents and adds them to the index as a delta; a batch that is run again adds nothing.

    Documents with a bad row are left out, the others of the batch go live. Buckets are compacted now and then.
    """

    def write(batch: DataFrame, number: int) -> None:
        good, _ = deltas.checked(build(batch), key=index.key, dims=dims)
        index.upsert(good, batch=(name, number))
        if compact_every and number % compact_every == compact_every - 1:
            index.compact(most_parts=2)

    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def counts_stream(rows: DataFrame, time: str, window: str, late: str, by: list[str]) -> DataFrame:
    """Rows in windows of time for each key; rows later than the watermark are left out."""
    return rows.withWatermark(time, late).groupBy(F.window(time, window), *by).agg(F.count(F.lit(1)).alias("n"))
